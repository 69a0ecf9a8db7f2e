"""Streaming match: read files that keep arriving are matched batch by batch.

Every micro-batch writes what it adds under its batch id: additive counts for each taxon,
and the stored k-mers it hit. A repeated batch overwrites its own rows, so the state is
exact after restarts; distinct k-mers are counted when the state is read. Reads are whole
rows, so no run of windows spans two batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import match as m

READ_SCHEMA = "key string, file string, read_no long, descriptor string, seq string, qual string"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of reads in a folder, as a stream."""
    return spark.readStream.schema(READ_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(reads: DataFrame, db: DataFrame, k: int, state: str, buckets: int | None = None) -> StreamingQuery:
    """Matches the stream against db (kmer, tax_id), which stays where it lies if it is in `buckets` by minimizer, and keeps its state in the folder `state`."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        m.contig_stats(m.read_segments(batch, db, k, buckets), batch).write.mode("overwrite").parquet(f"{state}/counts/batch={batch_id}")
        hits = m.key_hits(batch, db, k, buckets).where(m.is_taxon(F.col("label"))).select("key", F.col("label").alias("tax_id"), "kmer")
        hits.write.mode("overwrite").parquet(f"{state}/hits/batch={batch_id}")
        batch.unpersist()

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()


def counts(spark: SparkSession, state: str) -> DataFrame:
    """(key, tax_id, kmers, contigs, squared_sum, max_len, reads_1kmer, unique_kmers) of all batches so far."""
    c = spark.read.parquet(f"{state}/counts").groupBy("key", "tax_id").agg(*[F.sum(x).alias(x) for x in ("kmers", "contigs", "squared_sum", "reads_1kmer")], F.max("max_len").alias("max_len"))
    u = spark.read.parquet(f"{state}/hits").select("key", "tax_id", "kmer").distinct().groupBy("key", "tax_id").agg(F.count("*").alias("unique_kmers"))
    return c.join(u, ["key", "tax_id"])


def compact(spark: SparkSession, state: str, to: str) -> None:
    """Folds the hit k-mers of all batches into one distinct table at `to`, for states of very many batches."""
    spark.read.parquet(f"{state}/hits").select("key", "tax_id", "kmer").distinct().write.mode("overwrite").parquet(f"{to}/hits/batch=0")
    c = spark.read.parquet(f"{state}/counts").drop("batch")
    c.groupBy("key", "tax_id").agg(
        *[F.sum(x).alias(x) for x in ("kmers", "contigs", "squared_sum")], F.max("max_len").alias("max_len"), F.max_by("max_desc", "max_len").alias("max_desc"), F.sum("reads_1kmer").alias("reads_1kmer")
    ).write.mode("overwrite").parquet(f"{to}/counts/batch=0")
