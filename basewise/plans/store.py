"""Tables that are made once and read again."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: dict[tuple, tuple[SparkSession, str]] = {}
_stashed: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="basewise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt over the cores; others as they are.

    Small folders hold one file of one row group, and everything up to the first shuffle
    would run in one task. Large inputs have enough splits and are not moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: cuts the lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_drop)
    _made[("stash", path)] = (spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    _stashed[made] = path
    return made


def stash_buckets(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """As `stash`, in buckets by the column `bucket`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop)
    _made[("stash", path)] = (spark, path)
    return bucketed(df, path, buckets)


def discard(stashed: DataFrame) -> None:
    """Deletes a table of `stash` that no plan will read again, before the session ends."""
    if path := _stashed.pop(stashed, None):
        _delete(*_made.pop(("stash", path)))


@contextmanager
def joined_where_they_lie(spark: SparkSession) -> Iterator[None]:
    """Tables that are dealt by some of a join's keys are joined without being dealt again, where they are planned and written inside."""
    with _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        yield


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_number(df: DataFrame, order: list[str], name: str, within: tuple[str, ...] = (), most_runs: int = 1_000_000) -> DataFrame:
    """Adds `name`, the rows' number from 1 in the order of columns, apart for each group of the columns `within`.

    No task sees a whole group: ranges of (within, order) are sorted apart, and the sizes
    of a group's runs in the ranges before are added up. There is a run for each range and
    each group that begins in it; they are counted, and broadcast up to `most_runs`.
    """
    keys = [*within, *order]
    ranged = stash(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    runs = ranged.groupBy("_part", *within).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over((Window.partitionBy(*within) if within else Window).orderBy("_part"))
    before = stash(runs.select("_part", *[F.col(c).alias(f"_of_{c}") for c in within], (earlier - F.col("_n") - F.col("_first")).alias("_shift")), "runs")
    on = ranged["_part"] == before["_part"]
    for c in within:
        on = on & ranged[c].eqNullSafe(before[f"_of_{c}"])
    if before.count() <= most_runs:
        before = F.broadcast(before)
    return ranged.join(before, on).select(*df.columns, (F.col("_at") + F.col("_shift") + 1).alias(name))


def few(df: DataFrame, name: str, most: int = 1_000_000) -> DataFrame:
    """df, written and counted, to be broadcast up to `most` rows: a large table that is joined with few keys stays where it is, and no task gets all rows of a common key."""
    made = stash(df, name)
    return F.broadcast(made) if made.count() <= most else made


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Characters of texts whose windows one task opens, about.
TASK_CHARS = 1 << 21


def tasks_for(rows: DataFrame, text: str, least: int = 1) -> int:
    """As many tasks as open about TASK_CHARS windows of the texts each, so that what a task holds doesn't grow with the input."""
    return max(least, math.ceil((rows.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0) / TASK_CHARS))


def bucketed(df: DataFrame, path: str, buckets: int, by: str = "bucket", sort: str = "kmer") -> DataFrame:
    """df as Parquet in a folder, in `buckets` files by the hash of a column and sorted in each, and read back as such: joins and groups on `by` and more don't deal it again.

    Rows that repartition(buckets, by) has dealt are written where they lie, and so are those of
    a table in as many buckets: a task reads, sorts and writes one bucket. By splits of the files
    it would sort the buckets of a whole split, so that what a task holds would grow with the table.
    """
    spark, table = df.sparkSession, _table_of(path)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    with _set(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
        df.write.mode("overwrite").bucketBy(buckets, by).sortBy(sort).option("path", path).saveAsTable(table)
    return spark.table(table)


def read_bucketed(spark: SparkSession, path: str, schema: str, buckets: int, by: str = "bucket", sort: str = "kmer") -> DataFrame:
    """The table that `bucketed` wrote to a folder, in this or another session."""
    table = _table_of(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({sort}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def _table_of(path: str) -> str:
    return f"basewise_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def once(spark: SparkSession, name: tuple, make: Callable[[], DataFrame], buckets: int = 0) -> DataFrame:
    """The table of that name: written as Parquet in the shared folder when it is first asked for, in buckets if wanted, then read."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _made:
        path = f"{shared_dir(spark)}/tables/{name[0]}-{uuid.uuid4().hex}"
        if buckets:
            bucketed(make(), path, buckets)
        else:
            make().write.parquet(path)
        if not _made:
            atexit.register(_drop)
        _made[key] = (spark, path)
    return spark.table(_table_of(_made[key][1])) if buckets else spark.read.parquet(_made[key][1])


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop() -> None:
    for spark, path in _made.values():
        try:
            _delete(spark, path)
        except Exception:  # the JVM is gone already
            return
