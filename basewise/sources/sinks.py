"""Writers: FASTQ, per-read lines, CSV reports and the database folder."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import checksum
from ..operators.filtering import fastq_text


def file_name(project: str, goal: str, key: str = "", suffix: str = "", gzip: bool = False) -> str:
    """<project>_<goal>[_<key>]<suffix>[.gz], the key URL-encoded and cut to 256 characters."""
    return "_".join(x for x in (project, goal, quote(key, safe="")[:256]) if x) + suffix + (".gz" if gzip else "")


def write_fastq(reads: DataFrame, path: str, gzip: bool = True) -> None:
    text = reads.select(fastq_text(F.col("descriptor"), F.col("seq"), F.col("qual") if "qual" in reads.columns else None).alias("value"))
    text.write.option("compression", "gzip" if gzip else "none").text(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_lines(lines: DataFrame, path: str, gzip: bool = False) -> None:
    lines.select(F.col("line").alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)


def write_csv(report: DataFrame, path: str) -> None:
    """One ;-separated folder with a header; arrays become ;-joined text. NaN and null are empty."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in report.dtypes]
    report.select(*flat).write.option("sep", ";").option("header", True).csv(path)


def save_database(db: DataFrame, tax: DataFrame, config: dict[str, str], path: str) -> None:
    """kmers/ sorted and range-partitioned by k-mer, tax/ and config/ with a checksum of the content."""
    db.repartitionByRange("kmer").sortWithinPartitions("kmer").write.parquet(f"{path}/kmers")
    tax.write.parquet(f"{path}/tax")
    sum_ = checksum(db.sparkSession.read.parquet(f"{path}/kmers")).first()
    rows = [*config.items(), ("checksum", str(sum_["checksum"])), ("kmers", str(sum_["kmers"]))]
    db.sparkSession.createDataFrame(rows, "name string, value string").coalesce(1).write.parquet(f"{path}/config")


def load_database(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/kmers"), spark.read.parquet(f"{path}/tax")


def load_config(spark: SparkSession, path: str) -> dict[str, str]:
    """The database's settings, without a look at its k-mers."""
    return {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/config").collect()}
