"""Keeping and dropping reads, and turning k-mers back into reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq
from ..plans.store import few, joined_where_they_lie, stash, with_number
from .match import NO_HIT, READ, numbered_reads, run_labels
from .windows import window_total


def accepted(reads: DataFrame, index: DataFrame, k: int, min_count: int = 1, min_share: float = 0.2, buckets: int | None = None) -> DataFrame:
    """(read, hits, windows, accepted): accepted if at least max(1, T) valid windows are in index (kmer).

    T is min_count, or the whole part of min_share of the windows if that is 0. Runs of
    windows are dealt by minimizer and looked up as in matching; an index in `buckets` by
    minimizer stays where it is.
    """
    numbered = numbered_reads(reads.select(*READ, "seq"))
    stored = index.select("bucket", "kmer") if buckets and "bucket" in index.columns else index.select("kmer").distinct()
    with joined_where_they_lie(reads.sparkSession):
        found = run_labels(numbered, stored.withColumn("tax_id", F.lit("1")), k, buckets if "bucket" in stored.columns else None)
        hits = stash(found.where(F.col("label") != NO_HIT).groupBy("rid").agg(F.count("*").alias("_h")), "filtered")
    r = numbered.select("rid", *READ, window_total(F.length("seq"), k).alias("windows")).join(hits, "rid", "left")
    need = F.greatest(F.lit(1), F.lit(min_count) if min_count else F.floor(F.col("windows") * min_share))
    r = r.withColumn("hits", F.coalesce("_h", F.lit(0)).cast("long"))
    return r.select(*READ, "hits", "windows", (F.col("hits") >= need).alias("accepted"))


def kept(reads: DataFrame, verdict: DataFrame) -> DataFrame:
    return reads.join(verdict.where("accepted"), READ, "left_semi")


def dumped(reads: DataFrame, verdict: DataFrame) -> DataFrame:
    return reads.join(verdict.where("accepted"), READ, "left_anti")


def extracted(reads: DataFrame, prefix: str) -> DataFrame:
    """Reads whose descriptor begins with prefix after its @."""
    return reads.where(F.regexp_replace("descriptor", "^@", "").startswith(prefix))


def fastq_text(descriptor: Column, sequence: Column, qual: Column | None = None) -> Column:
    """The four lines of a read; ~ for each base where the quality is missing."""
    plain = F.repeat(F.lit("~"), F.length(sequence))
    q = plain if qual is None else F.coalesce(qual, plain)
    name = F.when(descriptor.startswith("@"), descriptor).otherwise(F.concat(F.lit("@"), descriptor))
    return F.concat_ws("\n", name, sequence, F.lit("+"), q)


def database_reads(db: DataFrame, k: int, project: str, taxa: DataFrame | None = None) -> DataFrame:
    """(tax_id, n, descriptor, seq, text): a read for each stored k-mer, of the taxa (tax_id) if given, numbered in the k-mers' order."""
    d = db if taxa is None else db.join(few(taxa.select("tax_id"), "requested"), "tax_id", "left_semi")
    d = with_number(d, ["kmer"], "n", within=("tax_id",)).withColumn("n", F.col("n") - 1).withColumn("seq", seq.decode(F.col("kmer"), k))
    d = d.withColumn("descriptor", F.concat(F.lit(f"@{project}::"), "tax_id", F.lit("::"), F.col("n").cast("string")))
    return d.select("tax_id", "n", "descriptor", "seq", fastq_text(F.col("descriptor"), F.col("seq")).alias("text"))


def extracted_regions(regions: DataFrame) -> DataFrame:
    """(accession, tax_id, header, seq) of regions, with the header of a classifier's library."""
    return regions.select("accession", "tax_id", F.concat(F.lit(">"), "accession", F.lit("|kraken:taxid|"), "tax_id").alias("header"), "seq")
