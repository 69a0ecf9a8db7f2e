"""How well a database tells its genomes apart, and how coverage relates to depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import default_buckets, joined_where_they_lie, stash, tasks_for
from .report import ratio
from .taxonomy import ancestor_of_rank
from .windows import kmer_runs, run_windows, with_bucket


def leaf_counts(regions: DataFrame, db: DataFrame, up: DataFrame, k: int, buckets: int | None = None, most_taxa: int = 1_000_000) -> DataFrame:
    """(tax_id, tp, tp_fn, tp_fp) for each leaf taxon of regions (tax_id, seq).

    Over its distinct k-mers in the database: tp_fn all, tp those stored at the leaf or an
    ancestor; tp_fp counts the k-mers stored on the path from the leaf to the root. Runs of
    windows are dealt by minimizer once, and told apart and looked up where they lie; a
    database in `buckets` by minimizer isn't dealt. Up to
    most_taxa taxa are numbered by a broadcast.
    """
    taxa = stash(regions.select("tax_id").distinct().withColumn("leaf", F.monotonically_increasing_id()), "leaves")
    few = F.broadcast(taxa) if taxa.count() <= most_taxa else taxa
    runs = kmer_runs(regions.join(few, "tax_id"), ["leaf"], "seq", k, upper=True, invalid=False, distinct=True)
    tasks = buckets or tasks_for(regions, "seq", default_buckets(db.sparkSession))
    distinct = run_windows(runs.drop("start").repartition(tasks, "bucket"), ["bucket", "leaf"], k).select("bucket", "kmer", "leaf").distinct()
    stored = (db if "bucket" in db.columns else with_bucket(db.select("kmer", "tax_id"), k)).select("bucket", "kmer", F.col("tax_id").alias("anc"))
    with joined_where_they_lie(regions.sparkSession):
        met = stash(distinct.join(stored if buckets else stored.repartition(tasks, "bucket"), ["bucket", "kmer"]).groupBy("leaf", "anc").agg(F.count("*").alias("n")), "met")
    met = met.join(taxa, "leaf").select("tax_id", "anc", "n")
    on_path = met.join(up.select(F.col("node").alias("tax_id"), "anc", F.lit(1).alias("_on")), ["tax_id", "anc"], "left")
    counts = on_path.groupBy("tax_id").agg(F.sum(F.when(F.col("_on") == 1, F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("tp_fn"))
    stored = db.groupBy(F.col("tax_id").alias("anc")).agg(F.count("*").alias("n"))
    path = counts.select("tax_id").join(up.select(F.col("node").alias("tax_id"), "anc"), "tax_id").join(stored, "anc").groupBy("tax_id").agg(F.sum("n").alias("tp_fp"))
    return counts.join(path, "tax_id", "left").select("tax_id", "tp", "tp_fn", F.coalesce("tp_fp", F.lit(0)).cast("long").alias("tp_fp"))


def quality(leaves: DataFrame, tax: DataFrame, ranks: tuple[str, ...]) -> DataFrame:
    """(tax_id, name, rank, parent_id, tp, tp_fp, tp_fn, aggregated, avg_*, pooled_*) of the leaves and of their ancestors of the ranks.

    Ancestors that are leaves themselves keep their own counts. avg_* is the mean over the
    leaves, pooled_* the ratio of the summed counts.
    """
    own = leaves.select("*", ratio(F.col("tp"), F.col("tp_fp")).alias("precision"), ratio(F.col("tp"), F.col("tp_fn")).alias("recall"))
    rows = own.select("tax_id", "tp", "tp_fp", "tp_fn", "precision", "recall", F.lit(1).cast("long").alias("aggregated"))
    for rank in ranks:
        above = own.join(ancestor_of_rank(tax, rank), "tax_id").where("anc is not null").join(own.select(F.col("tax_id").alias("anc")), "anc", "left_anti")
        rows = rows.unionByName(
            above.groupBy(F.col("anc").alias("tax_id")).agg(*[F.sum(c).alias(c) for c in ("tp", "tp_fp", "tp_fn", "precision", "recall")], F.count("*").alias("aggregated"))
        )
    r = rows.join(tax.select("tax_id", "name", "rank", "parent_id"), "tax_id")
    return r.select(
        "tax_id", "name", "rank", "parent_id", "tp", "tp_fp", "tp_fn", "aggregated",
        ratio(F.col("precision"), F.col("aggregated")).alias("avg_precision"), ratio(F.col("recall"), F.col("aggregated")).alias("avg_recall"),
        ratio(F.col("tp"), F.col("tp_fp")).alias("pooled_precision"), ratio(F.col("tp"), F.col("tp_fn")).alias("pooled_recall"),
    )


def unique_model(rows: DataFrame) -> DataFrame:
    """Adds coverage, expected and its variance, z and valid to (n distinct stored, a matched, u distinct matched).

    Of n equally likely k-mers, a draws hit n (1 - (1 - 1/n)^a) on average. The normal
    approximation holds for 1.4 n^0.67 <= a <= 1.13 n^1.19 with n and a over 5.
    """
    n, a, u = (F.col(c).cast("double") for c in ("n", "a", "u"))
    once, twice = F.pow(1 - 1 / n, a), F.pow(1 - 2 / n, a)
    mean = n * (1 - once)
    variance = n * once + n * (n - 1) * twice - n * n * once * once
    r = rows.withColumn("coverage", ratio(u, n)).withColumn("normalised", ratio(a, n)).withColumn("expected", mean).withColumn("variance", F.greatest(F.lit(0.0), variance))
    r = r.withColumn("valid", (n > 5) & (a > 5) & (a >= 1.4 * F.pow(n, F.lit(0.67))) & (a <= 1.13 * F.pow(n, F.lit(1.19))))
    return r.withColumn("z", ratio(u - F.col("expected"), F.sqrt("variance")))
