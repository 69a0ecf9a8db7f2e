"""The tables of a scale-factor folder as taxonomy, genomes and reads.

Root, regions, nations and suppliers form the taxonomy; documents are genome regions of
nations; conversations are reads. Letters and blanks become bases, other characters stay
and are ambiguous. The SQL of the same mapping is in `workload_sql`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build as b
from ..operators import match as m
from ..operators import taxonomy as t
from .store import once, tasks_for

K = 15
LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz ", "CGATCGATCGATCGATCGATCGATCGA"
RULES = m.Rules(k=K)
#: Files of the database, at least.
BUCKETS = 16
_tasks: dict[tuple[str, str, str], int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks for the windows of a table's texts, found once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tasks:
        _tasks[key] = tasks_for(table(spark, sf_dir, name), "text")
    return _tasks[key]


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Files of the database: genomes and reads are looked up in as many tasks."""
    return max(BUCKETS, *(tasks(spark, sf_dir, name) for name in ("documents", "conversations")))


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, dealt over as many tasks as its windows and the cores ask for if its files have fewer splits."""
    scan = table(spark, sf_dir, name)
    wanted = max(tasks(spark, sf_dir, name), spark.sparkContext.defaultParallelism)
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan


def bases(text: Column) -> Column:
    return F.translate(F.lower(text), LETTERS, AS_BASES)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tax_id, parent_id, name, rank, ord)"""
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    row = lambda i, parent, name, rank, order: [i.alias("tax_id"), parent.alias("parent_id"), name.alias("name"), F.lit(rank).alias("rank"), order.cast("long").alias("ord")]
    root = spark.range(1).select(*row(F.lit("1"), F.lit("1"), F.lit("root"), "no rank", F.lit(0)))
    regions = table(spark, sf_dir, "region").select(*row(text("r", "r_regionkey"), F.lit("1"), F.col("r_name"), "superkingdom", F.col("r_regionkey")))
    nations = table(spark, sf_dir, "nation").select(*row(text("n", "n_nationkey"), text("r", "n_regionkey"), F.col("n_name"), "genus", F.col("n_nationkey")))
    suppliers = table(spark, sf_dir, "supplier").select(*row(text("s", "s_suppkey"), text("n", "s_nationkey"), F.col("s_name"), "species", F.col("s_suppkey")))
    return root.union(regions).union(nations).union(suppliers)


def tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, ("tax", sf_dir), lambda: t.numbered(nodes(spark, sf_dir)))


def up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, ("closure", sf_dir), lambda: t.closure(tax(spark, sf_dir)))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, region_no, accession, info, tax_id, category, seq)"""
    d = dealt(spark, sf_dir, "documents").where("text is not null")
    i = F.col("doc_id").cast("string")
    return d.select(
        F.col("source").alias("file"), F.col("doc_id").alias("region_no"), F.concat(F.lit("NC_"), i).alias("accession"), F.concat(F.lit(">NC_"), i, F.lit(" "), "lang").alias("info"),
        F.concat(F.lit("n"), (F.col("doc_id") % 25).cast("string")).alias("tax_id"), F.col("lang").alias("category"), bases(F.col("text")).alias("seq"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, file, read_no, descriptor, seq, qual)"""
    c = dealt(spark, sf_dir, "conversations").where("text is not null")
    number = lambda n: (F.col("conv_id") % n).cast("string")
    return c.select(
        F.concat(F.lit("k"), number(2)).alias("key"), F.concat(F.lit("f"), number(4)).alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("read_no"),
        F.concat(F.lit("@c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit(" "), "role").alias("descriptor"), bases(F.col("text")).alias("seq"),
        F.lit(None).cast("string").alias("qual"),
    )


def database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kmer, tax_id, bucket) of all genomes, in `buckets` files by minimizer."""
    n = buckets(spark, sf_dir)
    return once(spark, ("db", sf_dir), lambda: b.build(regions(spark, sf_dir), tax(spark, sf_dir), up(spark, sf_dir), None, b.Plan(k=K, buckets=n), buckets=True), n)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, ("key_hits", sf_dir), lambda: m.key_hits(reads(spark, sf_dir), database(spark, sf_dir), K, buckets(spark, sf_dir)))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, ("segments", sf_dir), lambda: m.read_segments(reads(spark, sf_dir), database(spark, sf_dir), K, buckets(spark, sf_dir)))


def classes(spark: SparkSession, sf_dir: str, rules: m.Rules = RULES) -> DataFrame:
    return once(spark, ("classes", sf_dir, rules), lambda: m.classify(reads(spark, sf_dir), segments(spark, sf_dir), tax(spark, sf_dir), up(spark, sf_dir), rules))
