"""Building a k-mer database from genome regions.

Regions are rows (file, region_no, accession, tax_id, category, seq). The value of a
stored k-mer is the lowest common ancestor of all taxa whose regions contain it, so the
build is one aggregation by k-mer of the least and the greatest preorder number.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import default_buckets, few, joined_where_they_lie, stash, stash_buckets, tasks_for, with_number
from .taxonomy import lca_of_extremes
from .windows import kmer_runs, run_windows, window_kmers


@dataclass(frozen=True)
class Plan:
    k: int = 31
    step: int = 1
    max_dust: int = -1
    upper: bool = True
    #: Regions outside the requested taxa do not lift stored k-mers.
    min_update: bool = False
    max_genomes: int | None = None
    max_kmers: int | None = None
    #: Limits count by the ancestor of this rank, by the taxon itself without one.
    limit_rank: str | None = None
    #: Files that k-mers are dealt over by minimizer; as many as the size of the regions asks for, and a shuffle has partitions at least, without one.
    buckets: int | None = None


def accession_of(info: Column) -> Column:
    """Text between > and the first space; null without a space."""
    return F.when(F.instr(info, " ") > 0, F.substring_index(F.regexp_replace(info, "^>", ""), " ", 1))


def is_complete(accession: Column) -> Column:
    """Prefixes of complete genomic and of RNA and mRNA records."""
    return accession.rlike("^(AC_|NC_|NZ_|NR_|XR_|NM_|XM_)")


def with_taxon(regions: DataFrame, accessions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds tax_id: of the file if it is in files (file, tax_id), else of the accession; regions with neither go."""
    r = regions.withColumn("accession", accession_of(F.col("info"))).join(accessions.select("accession", F.col("tax_id").alias("_acc")), "accession", "left")
    if files is None:
        return r.withColumnRenamed("_acc", "tax_id").where("tax_id is not null")
    r = r.join(files.select("file", F.col("tax_id").alias("_file")), "file", "left")
    return r.withColumn("tax_id", F.coalesce("_file", "_acc")).drop("_file", "_acc").where("tax_id is not null")


def within_limits(regions: DataFrame, plan: Plan, up: DataFrame | None = None, tax: DataFrame | None = None) -> DataFrame:
    """The regions that a taxon's limits admit, in the order of file and number.

    Regions at artificial nodes count for their natural_id. A genome limit admits a taxon's first max_genomes regions. A k-mer limit skips regions
    once the taxon has max_kmers windows, and cuts the region that reaches the limit there.
    """
    if plan.max_genomes is None and plan.max_kmers is None:
        return regions
    r = regions.withColumn("_limited", F.col("natural_id" if "natural_id" in regions.columns else "tax_id"))
    if plan.limit_rank:
        of_rank = up.join(tax.where(F.col("rank") == plan.limit_rank).select(F.col("tax_id").alias("anc")), "anc", "left_semi").select(F.col("node").alias("tax_id"), F.col("anc").alias("_a"))
        of_rank = of_rank.withColumnRenamed("tax_id", "_own")
        r = r.join(of_rank, F.col("_limited") == F.col("_own"), "left").drop("_own").withColumn("_limited", F.coalesce("_a", "_limited")).drop("_a")
    order = Window.partitionBy("_limited").orderBy("file", "region_no")
    size = F.greatest(F.length("seq") - (plan.k - 1), F.lit(0))
    admitted = r.select("_limited", "file", "region_no", size.alias("_size"))  # sequences stay where they are
    if plan.max_genomes is not None:
        admitted = admitted.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= plan.max_genomes).drop("_n")
    before = F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    admitted = admitted.withColumn("_before", before).select("file", "region_no", "_before")
    if plan.max_kmers is not None:
        admitted = admitted.where(F.col("_before") < plan.max_kmers)
    r = r.join(admitted, ["file", "region_no"])
    if plan.max_kmers is not None:
        r = r.withColumn("seq", F.substring("seq", F.lit(1), (plan.max_kmers - F.col("_before") + plan.k - 1).cast("int")))
    r = r.drop("_before")
    return r.drop("_limited")


def region_kmers(regions: DataFrame, plan: Plan) -> DataFrame:
    """(tax_id, kmer) of the windows that the plan includes."""
    return window_kmers(regions, ["tax_id"], "seq", plan.k, plan.upper, plan.step, plan.max_dust, invalid=False).select("tax_id", "kmer")


def opened_runs(regions: DataFrame, keys: list[str], plan: Plan, distinct: bool = True) -> DataFrame:
    """(keys, bucket, kmer) of the windows that the plan includes, dealt by minimizer as runs: what is grouped by bucket and more stays where it is."""
    runs = kmer_runs(regions, keys, "seq", plan.k, plan.upper, plan.step, plan.max_dust, invalid=False, distinct=distinct)
    return run_windows(runs.drop("start").repartition(sized(plan, regions).buckets, "bucket"), [*keys, "bucket"], plan.k).drop("at")


def taxon_kmers(regions: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, kmer, tax_id, n): the windows of each taxon's k-mers, counted where their runs are dealt to."""
    return opened_runs(regions, ["tax_id"], plan, distinct=False).groupBy("bucket", "kmer", "tax_id").agg(F.count("*").alias("n"))


def sized(plan: Plan, regions: DataFrame) -> Plan:
    """The plan with its number of buckets."""
    return plan if plan.buckets else replace(plan, buckets=tasks_for(regions, "seq", default_buckets(regions.sparkSession)))


def build(regions: DataFrame, tax: DataFrame, up: DataFrame, requested: DataFrame | None, plan: Plan, buckets: bool = False) -> DataFrame:
    """(kmer, tax_id) of every k-mer of the requested taxa's regions; with `buckets` the k-mers' minimizers, by which reads are matched, are kept.

    Without limits one pass over the regions both selects k-mers and lifts them: each
    k-mer keeps whether a requested region has it. With limits the limited regions select.
    """
    numbers, plan = tax.select("tax_id", "pre"), sized(plan, regions)
    r = regions.join(requested.select("tax_id", F.lit(True).alias("_wanted")), "tax_id", "left") if requested is not None else regions.withColumn("_wanted", F.lit(True))
    r = r.withColumn("_wanted", F.coalesce("_wanted", F.lit(False))).join(numbers, "tax_id")
    if plan.min_update:
        r = r.where("_wanted")
    state = build_state(r, plan)
    if plan.max_genomes is not None or plan.max_kmers is not None:
        chosen = region_kmers(within_limits(r.where("_wanted"), plan, up, tax), plan).select("kmer").distinct()
        state = state.withColumn("wanted", F.lit(True)).join(chosen, "kmer", "left_semi")
    return database_of(stash_buckets(state, "state", plan.buckets), up, buckets)


def build_state(regions: DataFrame, plan: Plan) -> DataFrame:
    """(kmer, bucket, lo, hi, wanted) of the k-mers of regions (pre, _wanted, seq): the least and greatest preorder number of their taxa, and whether a wanted region has them.

    States of different regions merge by least, greatest and or (`merged`), so a database
    is built of parts in any order. Dealt by minimizer into the plan's buckets.
    """
    return opened_runs(regions, ["pre", "_wanted"], plan).groupBy("bucket", "kmer").agg(F.min("pre").alias("lo"), F.max("pre").alias("hi"), F.bool_or("_wanted").alias("wanted"))


def merged(stored: DataFrame, more: DataFrame) -> DataFrame:
    """The state of both; of the stored one in buckets nothing moves. To be planned under `joined_where_they_lie`."""
    m = more.select("bucket", "kmer", *[F.col(c).alias(f"_{c}") for c in ("lo", "hi", "wanted")])
    both = stored.join(m, ["bucket", "kmer"], "full")
    return both.select("bucket", "kmer", F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"), (F.coalesce("wanted", F.lit(False)) | F.coalesce("_wanted", F.lit(False))).alias("wanted"))


def database_of(state: DataFrame, up: DataFrame, buckets: bool = False) -> DataFrame:
    """(kmer, tax_id) of the wanted k-mers of a written state; with `buckets` also their minimizers."""
    kept = ["kmer", "bucket"] if buckets else ["kmer"]
    return lifted_taxa(state.where("wanted").select(*kept, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), up)


def lifted_taxa(lifted: DataFrame, up: DataFrame, most_pairs: int = 1_000_000) -> DataFrame:
    """(kmer, tax_id) of written rows (kmer, _lo, _hi): the ancestor of each pair of extremes.

    Few pairs occur, most k-mers belong to one taxon, so the pairs are counted and
    broadcast up to `most_pairs` (24 MB); the k-mers then keep the partitions of their
    aggregation and hot pairs meet in no task.
    """
    pairs = lifted.select("_lo", "_hi").distinct()
    found = stash(lca_of_extremes(pairs, "_lo", "_hi", up, "tax_id"), "extremes")
    if found.count() <= most_pairs:
        found = F.broadcast(found)
    return lifted.join(found, ["_lo", "_hi"]).select("kmer", "tax_id", *[c for c in lifted.columns if c == "bucket"])


def kmers_per_taxon(db: DataFrame) -> DataFrame:
    return db.groupBy("tax_id").agg(F.count("*").alias("db_kmers"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(moved): how many k-mers another value has been stored for. Databases that are both dealt by minimizer are joined where they lie."""
    on = [c for c in ("bucket", "kmer") if c in before.columns and c in after.columns]
    with joined_where_they_lie(before.sparkSession):
        both = before.join(after.select(*on, F.col("tax_id").alias("_t")), on)
        return stash(both.agg(F.count(F.when(F.col("tax_id") != F.col("_t"), 1)).alias("moved")), "moved")


def first_values(regions: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, kmer, tax_id) where the first region by file and number that has a k-mer sets its taxon.

    Regions are numbered in that order, so runs carry a number and a k-mer keeps the least
    where its runs are dealt to; numbers are broadcast up to a million.
    """
    place = ["file", "region_no", "tax_id"]
    places = stash(with_number(regions.select(*place).distinct(), place, "_ord"), "places")
    if places.count() <= 1_000_000:
        places = F.broadcast(places)
    of = places.select(*[F.col(c).alias(f"_of_{c}") for c in place], "_ord")
    at = regions.join(of, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in place]).select("_ord", "seq")
    least = opened_runs(at, ["_ord"], plan).groupBy("bucket", "kmer").agg(F.min("_ord").alias("_ord"))
    return least.join(places.select("_ord", "tax_id"), "_ord").select("bucket", "kmer", "tax_id")


def filter_index(db: DataFrame, requested: DataFrame) -> DataFrame:
    """(kmer) whose taxon is requested; k-mers are not dealt by taxon."""
    return db.join(few(requested.select("tax_id"), "requested"), "tax_id", "left_semi").select("kmer")


def checksum(db: DataFrame) -> DataFrame:
    """(checksum, kmers): independent of the order of rows."""
    return db.agg(F.bit_xor(F.xxhash64("kmer", "tax_id")).alias("checksum"), F.count("*").alias("kmers"))


def size_estimate(regions: DataFrame, plan: Plan) -> DataFrame:
    """(kmers, distinct_kmers): included windows, and their distinct k-mers by a sketch; to choose partitions by."""
    k = region_kmers(regions, plan)
    return k.agg(F.count("*").alias("kmers"), F.approx_count_distinct("kmer").alias("distinct_kmers"))


def lacking_genomes(tax: DataFrame, requested: DataFrame, regions: DataFrame, up: DataFrame, limit: int, rank: str | None = None) -> DataFrame:
    """(tax_id, regions) of requested taxa, of the rank if one is given, with fewer regions in their subtree than `limit`."""
    n = regions.join(up.select("node", "anc"), F.col("tax_id") == F.col("node")).groupBy(F.col("anc").alias("tax_id")).agg(F.count("*").alias("regions"))
    t = tax.join(requested, "tax_id", "left_semi")
    if rank:
        t = t.where(F.col("rank") == rank)
    return t.join(n, "tax_id", "left").select("tax_id", F.coalesce("regions", F.lit(0)).cast("long").alias("regions")).where(F.col("regions") < limit)


#: Assembly qualities from best to worst.
QUALITIES = ("ADDITIONAL", "COMPLETE_LATEST", "COMPLETE", "CHROMOSOME_LATEST", "CHROMOSOME", "SCAFFOLD_LATEST", "SCAFFOLD", "CONTIG_LATEST", "CONTIG", "LATEST", "NONE")


def chosen_assemblies(assemblies: DataFrame, taxa: DataFrame, n: int, allowed: tuple[str, ...] = ("COMPLETE_LATEST", "CHROMOSOME_LATEST"), reference_only: bool = False) -> DataFrame:
    """The n best assemblies (tax_id, quality, line, is_reference, ...) of each taxon; of equal ones the later lines."""
    a = assemblies.join(taxa, "tax_id", "left_semi").where(F.col("quality").isin(*allowed))
    if reference_only:
        a = a.where("is_reference")
    order = F.array_position(F.array(*map(F.lit, QUALITIES)), F.col("quality"))
    best = F.row_number().over(Window.partitionBy("tax_id").orderBy(order, F.desc("line")))
    return a.withColumn("_r", best).where(F.col("_r") <= n).drop("_r")
