"""Per-taxon reports of a match, and read-outs of a database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import with_number
from .taxonomy import rolled_up, sorted_by_tree

VALUES = ("reads_kmers", "kmers", "unique_kmers", "contigs", "reads")
SUMS = ("reads", "reads_kmers", "reads_bps", "kmers", "unique_kmers", "contigs", "squared_sum", "max_len", "reads_1kmer", "err_sum", "err_squared", "class_err_sum", "class_err_squared")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where it is undefined."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def deviation(squared: Column, total: Column, n: Column) -> Column:
    """Sample standard deviation from sums; null for fewer than two values."""
    inside = F.greatest(F.lit(0.0), squared.cast("double") - total.cast("double") * total / F.nullif(n, F.lit(0)))
    return F.when(n > 1, F.sqrt(inside / (n - 1)))


def expected_unique(unique_db: Column, kmers: Column) -> Column:
    """Distinct k-mers that so many draws from unique_db ones hit on average."""
    return F.when(unique_db > 0, (1 - F.pow(1 - 1 / unique_db.cast("double"), kmers)) * unique_db)


def taxon_rows(contigs: DataFrame, unique: DataFrame | None, classes: DataFrame | None) -> DataFrame:
    """One row (key, tax_id, SUMS, max_desc) for each taxon with a run or a classified read."""
    rows = contigs
    if unique is not None:
        rows = rows.join(unique, ["key", "tax_id"], "left")
    if classes is not None:
        rows = rows.join(classes, ["key", "tax_id"], "full")
    for c in SUMS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(0))
    kind = lambda c: "double" if "err" in c else "long"
    return rows.select("key", "tax_id", *[F.coalesce(c, F.lit(0)).cast(kind(c)).alias(c) for c in SUMS], "max_desc")


def with_ancestors(rows: DataFrame, up: DataFrame) -> DataFrame:
    """Rows of `taxon_rows` and a zero row for every ancestor that has none."""
    there = rows.select("key", "tax_id").join(up.select("node", "anc"), F.col("tax_id") == F.col("node")).select("key", F.col("anc").alias("tax_id")).distinct()
    return there.join(rows, ["key", "tax_id"], "left").select("key", "tax_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in SUMS], "max_desc")


def report(rows: DataFrame, tax: DataFrame, up: DataFrame, db_kmers: DataFrame, totals: DataFrame) -> DataFrame:
    """The full report: a row for each taxon and ancestor, and a TOTAL row for each key.

    db_kmers: (tax_id, db_kmers); totals: (key, reads, kmers, reads_bps) over all windows.
    Values are accumulated over subtrees plain and normalised by the taxon's stored k-mers.
    """
    r = with_ancestors(rows, up).join(db_kmers, "tax_id", "left").withColumn("db_kmers", F.coalesce("db_kmers", F.lit(0)).cast("long"))
    norm = {v: F.coalesce(ratio(F.col(v), F.col("db_kmers")), F.lit(0.0)) for v in VALUES}
    r = r.withColumns({f"norm_{v}": norm[v] for v in VALUES})
    summed = [*VALUES, *(f"norm_{v}" for v in VALUES), "err_sum", "err_squared", "class_err_sum", "class_err_squared"]
    acc = rolled_up(r.select("key", "tax_id", *summed), up, summed, by=["key"])
    acc = acc.select("key", "tax_id", *[F.col(c).alias(f"acc_{c}") for c in summed])
    r = r.join(acc, ["key", "tax_id"]).join(tax.select("tax_id", "parent_id", "name", "rank", "depth", "pre"), "tax_id")
    n = F.col("reads")
    r = r.withColumns(
        {
            "avg_contig_len": ratio(F.col("kmers"), F.col("contigs")),
            "avg_read_len": ratio(F.col("reads_bps"), n),
            "db_coverage": ratio(F.col("unique_kmers"), F.col("db_kmers")),
            "exp_unique": expected_unique(F.col("db_kmers"), F.col("kmers")),
            "mean_error": ratio(F.col("err_sum"), n),
            "mean_class_error": ratio(F.col("class_err_sum"), n),
            "error_sd": deviation(F.col("err_squared"), F.col("err_sum"), n),
            "class_error_sd": deviation(F.col("class_err_squared"), F.col("class_err_sum"), n),
            "contig_len_sd": deviation(F.col("squared_sum"), F.col("kmers"), F.col("contigs")),
            "acc_mean_error": ratio(F.col("acc_err_sum"), F.col("acc_reads")),
            "acc_mean_class_error": ratio(F.col("acc_class_err_sum"), F.col("acc_reads")),
            "acc_error_sd": deviation(F.col("acc_err_squared"), F.col("acc_err_sum"), F.col("acc_reads")),
            "acc_class_error_sd": deviation(F.col("acc_class_err_squared"), F.col("acc_class_err_sum"), F.col("acc_reads")),
        }
    )
    r = r.withColumn("exp_unique_ratio", ratio(F.col("unique_kmers"), F.col("exp_unique")))
    r = r.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("pre")).cast("long"))
    all_db = db_kmers.agg(F.coalesce(F.sum("db_kmers"), F.lit(0)).cast("long").alias("db_kmers"))
    total = totals.crossJoin(F.broadcast(all_db)).select(  # one row
        "key", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("depth"), F.lit("TOTAL").alias("name"), "reads", "kmers", "reads_bps", "db_kmers", ratio(F.col("reads_bps"), F.col("reads")).alias("avg_read_len")
    )
    return r.drop("pre", "err_sum", "err_squared", "class_err_sum", "class_err_squared").unionByName(total, allowMissingColumns=True)


def totals(reads: DataFrame, k: int) -> DataFrame:
    """(key, reads, kmers, reads_bps) over all windows, invalid ones included."""
    n = F.length("seq").cast("long")
    return reads.groupBy("key").agg(F.count("*").alias("reads"), F.sum(F.greatest(n - (k - 1), F.lit(0))).cast("long").alias("kmers"), F.sum(n).alias("reads_bps"))


def db_info(tax: DataFrame, up: DataFrame, db_kmers: DataFrame, k: int, requested: DataFrame | None = None) -> DataFrame:
    """(pos, level, name, rank, tax_id, stored_kmers, requested, distance, distance_portion) in preorder, TOTAL first.

    A node's distance is 1 - (1 - below / (above + below))^(1/k): `above` sums the k-mers
    of its strict ancestors, `below` is the heaviest path from it downwards. The portion
    is the distance less that of the child with the heaviest path.
    """
    own = tax.join(db_kmers, "tax_id", "left").withColumn("n", F.coalesce("db_kmers", F.lit(0)).cast("long"))
    paths = up.join(own.select(F.col("tax_id").alias("anc"), "n"), "anc").groupBy("node").agg(F.sum("n").alias("path"))
    own = own.join(paths, F.col("tax_id") == F.col("node")).select("tax_id", "parent_id", "name", "rank", "depth", "pre", "n", "path")
    deepest = up.join(own.select(F.col("tax_id").alias("node"), F.col("path").alias("_p")), "node").groupBy(F.col("anc").alias("tax_id")).agg(F.max("_p").alias("_deep"))
    both = own.join(deepest, "tax_id").withColumn("above", F.col("path") - F.col("n")).withColumn("below", F.col("_deep") - F.col("above"))
    distance = 1 - F.pow(1 - ratio(F.col("below"), F.col("above") + F.col("below")), F.lit(1.0 / k))
    both = both.withColumn("distance", F.coalesce(distance, F.lit(0.0)))
    branch = both.where("below > 0 and parent_id is not null").groupBy(F.col("parent_id").alias("tax_id")).agg(F.min_by("distance", F.struct(-F.col("below"), "pre")).alias("_branch"))
    r = both.join(branch, "tax_id", "left").withColumn("distance_portion", F.col("distance") - F.coalesce("_branch", F.lit(0.0)))
    if requested is None:
        r = r.withColumn("requested", F.lit(True))
    else:
        r = r.join(requested.select("tax_id", F.lit(True).alias("requested")), "tax_id", "left").withColumn("requested", F.coalesce("requested", F.lit(False)))
    r = with_number(r, ["pre"], "pos").select("pos", F.col("depth").alias("level"), "name", "rank", "tax_id", F.col("n").alias("stored_kmers"), "requested", "distance", "distance_portion")
    total = db_kmers.agg(F.coalesce(F.sum("db_kmers"), F.lit(0)).cast("long").alias("stored_kmers")).select(
        F.lit(0).cast("long").alias("pos"), F.lit(0).alias("level"), F.lit("TOTAL").alias("name"), F.lit("no rank").alias("rank"), F.lit(None).cast("string").alias("tax_id"),
        "stored_kmers", F.lit(False).alias("requested"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("distance_portion"),
    )
    return total.unionByName(r)


def tree_drawing(info: DataFrame) -> str:
    """An SVG of a database's tree, from `db_info`; nodes are indented by level. For small trees: it is drawn on the driver."""
    rows = [r for r in info.orderBy("pos").collect() if r["pos"]]
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" width="900" height="{20 * len(rows) + 20}" font-family="sans-serif" font-size="12">']
    for i, r in enumerate(rows):
        text = f"{r['name']} ({r['tax_id']}, {r['rank']}) [{r['stored_kmers']}, d={r['distance']:.4f}, dp={r['distance_portion']:.4f}]".replace("&", "&amp;").replace("<", "&lt;")
        lines.append(f'<text x="{10 + 20 * r["level"]}" y="{20 * i + 20}" font-weight="{"bold" if r["requested"] else "normal"}">{text}</text>')
    return "\n".join([*lines, "</svg>"])


__all__ = ["db_info", "deviation", "expected_unique", "ratio", "report", "sorted_by_tree", "taxon_rows", "totals", "tree_drawing", "with_ancestors"]
