"""Per-read output of classifiers: status, read, class, length and segments, by tab."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_read(lines: DataFrame) -> DataFrame:
    """(status, read, class_id, length, segments) of lines (value); segments are (label, n) structs."""
    f = F.split("value", "\t", -1)
    part = F.transform(F.filter(F.split(F.trim(f[4]), " "), lambda x: x.contains(":")), lambda x: F.struct(F.substring_index(x, ":", 1).alias("label"), F.substring_index(x, ":", -1).cast("long").alias("n")))
    return lines.where(F.size(f) >= 5).select(f[0].alias("status"), f[1].alias("read"), f[2].alias("class_id"), f[3].cast("long").alias("length"), part.alias("segments"))


def segments(rows: DataFrame) -> DataFrame:
    """(read, class_id, pos, label, n): A segments only move the place on."""
    s = rows.select("read", "class_id", F.posexplode("segments").alias("i", "s"), "segments")
    before = F.aggregate(F.slice("segments", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return s.select("read", "class_id", "i", before.alias("pos"), F.col("s.label").alias("label"), F.col("s.n").alias("n")).where("label <> 'A'")


def result_counts(rows: DataFrame) -> DataFrame:
    """(tax_id, reads, kmers, kmers_in_matching_reads) for each taxon that classifies a read or labels a segment.

    The last counts the first reported segment of a read whose class is its label.
    """
    s = segments(rows)
    first = s.groupBy("read").agg(F.min("i").alias("_f"))
    seg = s.join(first, "read").groupBy(F.col("label").alias("tax_id")).agg(
        F.sum("n").alias("kmers"), F.sum(F.when((F.col("label") == F.col("class_id")) & (F.col("i") == F.col("_f")), F.col("n")).otherwise(0)).alias("kmers_in_matching_reads")
    )
    reads = rows.groupBy(F.col("class_id").alias("tax_id")).agg(F.count("*").alias("reads"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return reads.join(seg, "tax_id", "full").select("tax_id", zero("reads"), zero("kmers"), zero("kmers_in_matching_reads"))
