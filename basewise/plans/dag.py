"""Goals: named tables that depend on each other, made once and only when needed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Goal:
    """`make` gets the tables of `needs`, by name. A kept goal is written and read again; others are plans."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    kept: bool = False
    about: str = ""


@dataclass
class Graph:
    spark: SparkSession
    folder: str
    goals: dict[str, Goal] = field(default_factory=dict)
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, goal: Goal) -> None:
        for n in goal.needs:
            if n not in self.goals:
                raise KeyError(f"{goal.name} needs {n}, which is not defined before it")
        self.goals[goal.name] = goal

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str) -> DataFrame:
        """The goal's table: as made before, read from its folder, or made with all it needs."""
        if name not in self._made:
            goal = self.goals[name]
            if goal.kept and self._exists(name):
                self._made[name] = self.spark.read.parquet(self.path(name))
            else:
                df = goal.make(*(self.table(n) for n in goal.needs))
                if goal.kept:
                    df.write.mode("overwrite").parquet(self.path(name))
                    df = self.spark.read.parquet(self.path(name))
                self._made[name] = df
        return self._made[name]

    def clean(self, name: str) -> None:
        """Forget a goal and delete its folder."""
        self._made.pop(name, None)
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def clean_all(self, name: str) -> None:
        """Forget a goal and everything that was made for it."""
        for n in self.goals[name].needs:
            self.clean_all(n)
        self.clean(name)

    def dependents(self, name: str) -> list[str]:
        return [g.name for g in self.goals.values() if name in g.needs]
