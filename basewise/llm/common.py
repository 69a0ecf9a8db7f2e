"""Shared plumbing: stashed tables in the shared folder, size-checked joins, learning folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import discard, shared_dir, spread, stash

#: The white space of every word count here: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", max_rows: int = 20_000, salts: int = 32) -> DataFrame:
    """Join on keys (null equals null) where many rows of big may share a key.

    small must be stashed: its rows are counted, and it is broadcast only up to
    max_rows. Beyond that big is salted and small is repeated once for each salt, so
    a key with a third of all rows is spread over `salts` tasks.
    """
    if small.count() <= max_rows:
        small = F.broadcast(small)
    else:
        big = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = [*keys, "_salt"]
    s = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & big[k].eqNullSafe(s[f"_r_{k}"])
    return big.join(s, on, how).drop(*[f"_r_{k}" for k in keys], "_salt")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, label) for each labelled document; ids whose rows disagree, and nulls, are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(column).cast("int").alias("label"), F.max(column).cast("int").alias("_most"))
        .where("label = _most")
        .drop("_most")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Texts of fewer splits than there are cores are dealt over the cores."""
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(t) if name == "documents" else t


def text_key(text: str) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text key (text_key) are a row (doc_id, copy) of gone; null equals null."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key("text").alias("key"))
    return keyed.join(gone, F.col("key").eqNullSafe(F.col("_copy")) & F.col("id").eqNullSafe(F.col("_id")), "left_anti").select("row.*")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the package is installed on every executor too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def by_weight(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose strings or bytes in a column have about `most` bytes, a longer one alone."""
    for b in batches:
        x = b.column(column)
        if not len(x):
            continue
        wide = pa.types.is_large_string(x.type) or pa.types.is_large_binary(x.type)
        offsets, lo = np.frombuffer(x.buffers()[1], np.int64 if wide else np.int32)[x.offset :], 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(offsets[: b.num_rows + 1], int(offsets[lo]) + most, "right")) - 1
            hi = min(max(hi, lo + 1), lo + rows, b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi


_kept: dict[object, object] = {}


def kept[T](key: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps for its next tasks, one thing at a time; made when first asked for."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Frees what a worker keeps; unused memory stays at hand for the tasks to come."""
    _kept.clear()


def let_go() -> None:
    """Frees what a worker keeps, and returns unused memory to the system.

    Spark hands workers on from operator to operator: each that keeps nothing begins
    with this, so that the caches of one don't stand beside the memory of the next.
    """
    forget()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


__all__ = ["WORD", "by_weight", "discard", "fold", "forget", "join_small", "kept", "labels_of", "let_go", "shared_dir", "spread", "stash", "table", "text_key", "vocabulary", "without_rows"]
