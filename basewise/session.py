"""Spark session with the settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

VERSION = "0.2"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A closure of a large taxonomy has more rows than the default allows a recursion.
    "spark.sql.cteRecursionRowLimit": "2000000000",
}


def session(name: str = "basewise", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; `settings` (underscores for dots) come last."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    return b.config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
