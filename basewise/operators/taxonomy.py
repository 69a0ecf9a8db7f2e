"""Taxonomy operators.

A taxonomy is a DataFrame (tax_id, parent_id, name, rank, depth, pre, last): `pre` numbers
the nodes in preorder, children in the order of `ord`, and `last` is the greatest number
in a node's subtree, so that an ancestor test is an interval test. Its closure (node,
anc, and the numbers of both) turns tree questions into equi-joins.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import stash, with_number

ROOT = "1"
#: The ranks that have a level, from the top, each 20 levels under the one before.
RANKS = (
    "cellular root", "acellular root", "superkingdom", "domain", "realm", "kingdom", "phylum", "subphylum", "superclass", "class", "subclass",
    "superorder", "order", "suborder", "superfamily", "family", "subfamily", "tribe", "genus", "subgenus", "species group", "species", "varietas",
    "subspecies", "serogroup", "biotype", "strain", "serotype", "genotype", "forma", "forma specialis", "isolate",
)
#: The ordinals of the artificial ranks at the bottom, which follow those above and four others.
ARTIFICIAL = {"REFINED": 36, "DATA": 37, "FILE": 38, "ID": 39}
#: 10 levels under the rank named.
BETWEEN = {"subkingdom": "kingdom", "section": "genus"}
#: Never comparable.
INDETERMINATE = ("clade", "no rank")


def rank_levels(spark: SparkSession) -> DataFrame:
    """(rank, level): a fixed small table; indeterminate ranks have no level."""
    levels = {r: 20 * i for i, r in enumerate(RANKS)}
    levels |= {r: levels[above] + 10 for r, above in BETWEEN.items()} | {r: 20 * i for r, i in ARTIFICIAL.items()}
    return spark.createDataFrame([*levels.items(), *((r, None) for r in INDETERMINATE)], "rank string, level int")


def numbered(nodes: DataFrame) -> DataFrame:
    """Adds depth, pre and last to (tax_id, parent_id, name, rank, ord).

    Paths from the root are found by pointer doubling (`_paths`); the order of paths is
    preorder, so ranges of it number the nodes, and a node's subtree is as large as the
    number of paths that it is on. The root is the node that is its own parent, or has
    none, the first by `ord` of several; nodes that do not hang under it go, circles
    among them. Of rows with one tax_id the first by `ord` sets its place, all stay.
    """
    own = F.when(F.col("parent_id") != F.col("tax_id"), F.col("parent_id"))
    edges = nodes.groupBy("tax_id").agg(F.min(F.struct("ord", own.alias("up"))).alias("_e")).select("tax_id", "_e.ord", "_e.up")
    paths = _paths(edges)
    root = paths.where("size(path) = 1").orderBy("path").limit(1).select(F.col("tax_id").alias("_root"))
    placed = with_number(paths.join(F.broadcast(root), F.col("path")[0]["tax_id"] == F.col("_root"), "left_semi"), ["path"], "_n")
    sizes = placed.select(F.explode("path.tax_id").alias("_anc")).groupBy("_anc").agg(F.count("*").alias("_size"))
    pre = F.col("_n") - 1
    numbers = placed.join(sizes, F.col("tax_id") == F.col("_anc")).select("tax_id", (F.size("path") - 1).alias("depth"), pre.alias("pre"), (pre + F.col("_size") - 1).alias("last"))
    return nodes.join(numbers, "tax_id").select("tax_id", own.alias("parent_id"), "name", "rank", "depth", "pre", "last")


def _paths(edges: DataFrame) -> DataFrame:
    """(tax_id, path) of the nodes (tax_id, ord, up) whose line of parents ends; a path holds (ord, tax_id) from its end to the node.

    In each round every open path is joined to that of the node where it begins, so the
    rounds are the logarithm of the depth. Paths that meet a node twice, or a parent that
    is no node, are dropped.
    """
    rows = stash(edges.select("tax_id", F.array(F.struct("ord", "tax_id")).alias("path"), "up"), "paths")
    ended = rows.where("up is null")
    while not rows.where("up is not null").isEmpty():
        begun = rows.where("up is not null")
        upper = ended.unionByName(begun).select(F.col("tax_id").alias("_t"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        joined = begun.join(upper, F.col("up") == F.col("_t")).select("tax_id", F.concat("_path", "path").alias("path"), F.col("_up").alias("up"))
        rows = stash(joined.where(F.size(F.array_distinct("path")) == F.size("path")), "paths")
        ended = ended.unionByName(rows.where("up is null"))
    return ended.select("tax_id", "path")


def closure(tax: DataFrame) -> DataFrame:
    """(node, node_pre, anc, anc_pre, anc_last, anc_depth): every node with itself and all its ancestors.

    Recursive queries have limits of rows and of levels, which a tree with a node for each
    accession exceeds; the closure of a tree near them comes from paths (`_paths`).
    """
    spark = tax.sparkSession
    size = tax.agg(F.sum(F.col("depth").cast("long") + 1).alias("rows"), F.max("depth").alias("depth")).first()
    limits = [int(spark.conf.get(f"spark.sql.cteRecursion{x}Limit")) for x in ("Row", "Level")]
    if any(limit >= 0 and (has or 0) > limit // 2 for has, limit in zip(size, limits, strict=True)):
        paths = _paths(tax.select("tax_id", F.col("pre").alias("ord"), F.col("parent_id").alias("up")))
        each = paths.select(F.col("tax_id").alias("node"), F.element_at("path", -1)["ord"].alias("node_pre"), F.explode("path.tax_id").alias("anc"))
        above = tax.select(F.col("tax_id").alias("anc"), F.col("pre").alias("anc_pre"), F.col("last").alias("anc_last"), F.col("depth").alias("anc_depth"))
        return each.join(above, "anc").select("node", "node_pre", "anc", "anc_pre", "anc_last", "anc_depth")
    return _recursive(
        {"_basewise_tax": tax.select("tax_id", "parent_id", "pre", "last", "depth")},
        """
        WITH RECURSIVE up(node, node_pre, anc) AS (
          SELECT tax_id, pre, tax_id FROM _basewise_tax
          UNION ALL
          SELECT up.node, up.node_pre, t.parent_id FROM up JOIN _basewise_tax t ON up.anc = t.tax_id WHERE t.parent_id IS NOT NULL)
        SELECT up.node, up.node_pre, up.anc, t.pre AS anc_pre, t.last AS anc_last, t.depth AS anc_depth
        FROM up JOIN _basewise_tax t ON up.anc = t.tax_id""",
    )


def _recursive(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """A recursive query over tables, under view names that no other query of the session has; the views go once it is analysed."""
    spark, suffix = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    for name, table in tables.items():
        table.createOrReplaceTempView(f"{name}_{suffix}")
        sql = re.sub(rf"\b{name}\b", f"{name}_{suffix}", sql)
    found = spark.sql(sql)
    for name in tables:
        spark.catalog.dropTempView(f"{name}_{suffix}")
    return found


def is_ancestor(node_pre: Column, anc_pre: Column, anc_last: Column) -> Column:
    """Reflexive; false when either is null."""
    return F.coalesce((anc_pre <= node_pre) & (node_pre <= anc_last), F.lit(False))


def lca_of_extremes(rows: DataFrame, lo: str, hi: str, up: DataFrame, out: str) -> DataFrame:
    """Adds `out`, the lowest common ancestor of all nodes numbered between columns lo and hi.

    The ancestor of a set is that of its members with the least and the greatest
    preorder number: the deepest ancestor of `lo` whose interval reaches `hi`. It is found
    once for each distinct pair, in the list of the ancestors of `lo`, so that pairs stay one row each.
    """
    pairs = rows.select(F.col(lo).alias("_from"), F.col(hi).alias("_to")).where("_from is not null").distinct()
    lines = up.groupBy("node_pre").agg(F.array_sort(F.collect_list(F.struct("anc_depth", "anc_last", "anc"))).alias("_line"))
    reaching = F.filter("_line", lambda x: x["anc_last"] >= F.col("_to"))
    found = pairs.join(lines, F.col("_from") == F.col("node_pre")).select("_from", "_to", F.try_element_at(reaching, F.lit(-1))["anc"].alias(out))
    return rows.join(found, (F.col(lo) == F.col("_from")) & (F.col(hi) == F.col("_to")), "left").drop("_from", "_to")


def lca_pairs(pairs: DataFrame, tax: DataFrame, a: str, b: str) -> DataFrame:
    """Adds `lca` to rows with the tax ids a and b; null if either is null or unknown."""
    numbers = tax.select("tax_id", "pre")
    r = pairs.join(numbers.toDF("_ta", "_pa"), F.col(a) == F.col("_ta"), "left").join(numbers.toDF("_tb", "_pb"), F.col(b) == F.col("_tb"), "left")
    both = F.col("_pa").isNotNull() & F.col("_pb").isNotNull()
    r = r.withColumn("_l", F.when(both, F.least("_pa", "_pb"))).withColumn("_h", F.when(both, F.greatest("_pa", "_pb")))
    return lca_of_extremes(r, "_l", "_h", closure(tax), "lca").drop("_ta", "_tb", "_pa", "_pb", "_l", "_h")


def below(level: Column, than: Column) -> Column:
    """Whether a rank lies below another; false for indeterminate ones."""
    return F.coalesce(level > than, F.lit(False))


def descendants(tax: DataFrame, roots: DataFrame, rank: str | None = None) -> DataFrame:
    """(tax_id) of the roots (tax_id) and the nodes under them.

    With a rank, only children with a rank that is not below it are entered; indeterminate
    ranks count as not below, a null rank ends the walk.
    """
    if rank is None:
        own = tax.join(roots.select("tax_id").distinct(), "tax_id", "left_semi").select("tax_id")
        return closure(tax).join(own, F.col("anc") == F.col("tax_id"), "left_semi").select(F.col("node").alias("tax_id")).distinct()
    spark = tax.sparkSession
    levels = rank_levels(spark)
    limit = levels.where(F.col("rank") == rank).select(F.col("level").alias("_limit"))
    t = tax.join(F.broadcast(levels), "rank", "left").crossJoin(F.broadcast(limit))  # one row
    entered = t.select("tax_id", "parent_id", (F.col("rank").isNotNull() & ~below(F.col("level"), F.col("_limit"))).alias("entered"))
    return _recursive(
        {"_basewise_enter": entered, "_basewise_roots": roots.select("tax_id").distinct()},
        """
        WITH RECURSIVE down(tax_id) AS (
          SELECT t.tax_id FROM _basewise_enter t JOIN _basewise_roots r ON t.tax_id = r.tax_id
          UNION ALL
          SELECT t.tax_id FROM down JOIN _basewise_enter t ON t.parent_id = down.tax_id WHERE t.entered)
        SELECT DISTINCT tax_id FROM down""",
    )


def requested(tax: DataFrame, wanted: DataFrame, rank: str | None = None) -> DataFrame:
    """(tax_id) under wanted rows (tax_id, exclude) that are not excluded, less all that lie under an excluded one."""
    inside = descendants(tax, wanted.where(~F.col("exclude")), rank)
    return inside.join(descendants(tax, wanted.where("exclude")), "tax_id", "left_anti")


def rolled_up(counts: DataFrame, up: DataFrame, columns: Sequence[str], key: str = "tax_id", by: Sequence[str] = ()) -> DataFrame:
    """(by, key, columns): sums over each node's subtree. Ancestors without own row get one."""
    j = counts.join(up.select("node", "anc"), F.col(key) == F.col("node"))
    return j.groupBy(*by, F.col("anc").alias(key)).agg(*[F.sum(c).alias(c) for c in columns])


def under(tax: DataFrame, ancestors: DataFrame) -> DataFrame:
    """The nodes of tax at or under any of ancestors (tax_id)."""
    a = ancestors.select(F.col("tax_id").alias("_a")).distinct()
    inside = closure(tax).join(a, F.col("anc") == F.col("_a"), "left_semi").select(F.col("node").alias("tax_id")).distinct()
    return tax.join(inside, "tax_id", "left_semi")


def pruned(tax: DataFrame, used: DataFrame) -> DataFrame:
    """The nodes of tax that are used (tax_id) or have a used node under them."""
    needed = closure(tax).join(used.select(F.col("tax_id").alias("_u")).distinct(), F.col("node") == F.col("_u"), "left_semi").select(F.col("anc").alias("tax_id")).distinct()
    return tax.join(needed, "tax_id", "left_semi")


def sorted_by_tree(rows: DataFrame, tax: DataFrame) -> DataFrame:
    """Rows with tax_id in preorder; unknown ids first, by string."""
    return rows.join(tax.select("tax_id", "pre"), "tax_id", "left").orderBy(F.col("pre").asc_nulls_first(), "tax_id")


def ancestor_of_rank(tax: DataFrame, rank: str) -> DataFrame:
    """(tax_id, anc): the nearest ancestor or self with the rank, null if none."""
    ranked = tax.where(F.col("rank") == rank).select(F.col("tax_id").alias("_r"))
    near = closure(tax).join(ranked, F.col("anc") == F.col("_r"), "left_semi").groupBy("node").agg(F.max_by("anc", "anc_depth").alias("anc"))
    return tax.select("tax_id").join(near, F.col("tax_id") == F.col("node"), "left").select("tax_id", "anc")


def compared_ranks(spark: SparkSession) -> DataFrame:
    """(rank, other, comparable, is_above, is_below) of all pairs of ranks: a fixed table."""
    a, b = rank_levels(spark), rank_levels(spark).toDF("other", "_l")
    both = F.col("level").isNotNull() & F.col("_l").isNotNull()
    return a.crossJoin(b).select("rank", "other", both.alias("comparable"), F.coalesce(F.col("level") < F.col("_l"), F.lit(False)).alias("is_above"), F.coalesce(F.col("level") > F.col("_l"), F.lit(False)).alias("is_below"))


def artificial_nodes(tax: DataFrame, regions: DataFrame, data: bool = True, files: bool = True, ids: bool = True) -> DataFrame:
    """(tax_id, parent_id, name, rank): leaf taxa for where regions (tax_id, file, accession) come from.

    One DATA node for each taxon, under it one FILE node for each file, under that one ID
    node for each accession; a level that is off is skipped. Ids are `00` and a
    number, in the order of parent, kind and name.
    """
    levels = [(k, n) for k, n, on in (("DATA", F.concat(F.lit("Data for "), F.col("tax_id")), data), ("FILE", F.col("file"), files), ("ID", F.col("accession"), ids)) if on]
    path, found = F.col("tax_id"), None
    for kind, name in levels:
        rows = regions.select(path.alias("_parent"), name.alias("name"), F.concat(path, F.lit("\x1f"), name).alias("_path")).where("name is not null").distinct().withColumn("rank", F.lit(kind))
        found = rows if found is None else found.unionByName(rows)
        path = F.concat(path, F.lit("\x1f"), name)
    named = with_number(found, ["_parent", "rank", "name"], "_number").withColumn("tax_id", F.concat(F.lit("00"), F.col("_number").cast("string"))).drop("_number")
    parent = named.select(F.col("_path").alias("_pp"), F.col("tax_id").alias("_pid"))
    return named.join(parent, F.col("_parent") == F.col("_pp"), "left").select("tax_id", F.coalesce("_pid", "_parent").alias("parent_id"), "name", "rank")


def with_artificial_node(regions: DataFrame, nodes: DataFrame, data: bool = True, files: bool = True, ids: bool = True, most_places: int = 1_000_000) -> DataFrame:
    """Regions (tax_id, file, accession, ...) at their artificial nodes: tax_id becomes the lowest node on their way, natural_id is the taxon.

    The way goes by (parent, kind, name) through nodes of `artificial_nodes` with the same
    levels; a level that has no such child is passed over, so regions of taxa without
    artificial nodes stay where they are. Distinct places are looked up; they are
    broadcast up to `most_places`, so sequences don't move then.
    """
    place = ["tax_id", "file", "accession"]
    found = regions.select(*place).distinct().withColumn("_node", F.col("tax_id"))
    levels = [(k, n) for k, n, on in (("DATA", F.concat(F.lit("Data for "), F.col("tax_id")), data), ("FILE", F.col("file"), files), ("ID", F.col("accession"), ids)) if on]
    for kind, name in levels:
        child = nodes.where(F.col("rank") == kind).select(F.col("parent_id").alias("_parent"), F.col("name").alias("_name"), F.col("tax_id").alias("_child"))
        found = found.withColumn("_wanted", name).join(child, (F.col("_node") == F.col("_parent")) & (F.col("_wanted") == F.col("_name")), "left")
        found = found.withColumn("_node", F.coalesce("_child", "_node")).drop("_wanted", "_parent", "_name", "_child")
    found = stash(found.select(*[F.col(c).alias(f"_of_{c}") for c in place], "_node"), "places")
    if found.count() <= most_places:
        found = F.broadcast(found)
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in place]
    at = regions.join(found, on[0] & on[1] & on[2]).drop(*[f"_of_{c}" for c in place])
    return at.withColumn("natural_id", F.col("tax_id")).withColumn("tax_id", F.col("_node")).drop("_node")


def grown(tax: DataFrame, nodes: DataFrame) -> DataFrame:
    """The taxonomy with artificial nodes, numbered anew; they follow a taxon's own children."""
    own = tax.select("tax_id", "parent_id", "name", "rank", F.struct(F.lit(0).alias("kind"), F.col("pre").alias("n")).alias("ord"))
    more = nodes.select("tax_id", "parent_id", "name", "rank", F.struct(F.lit(1).alias("kind"), F.substring("tax_id", 3, 20).cast("long").alias("n")).alias("ord"))
    return numbered(own.unionByName(more))
