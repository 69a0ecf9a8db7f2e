"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, stash

#: Neighbours from which a node is a hub, whose rows are dealt over several tasks.
HUB = 1_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component.

    Every step keeps at most one row for each edge. Minima by node are pre-aggregated,
    and the edges of hubs meet their minimum in a broadcast or salted join; the number of
    steps grows with the logarithm of the longest chain. Self-loops and repeated edges are
    ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stash(e, "edges")
    before = _mark(e)
    while before[0]:
        both = e.union(e.select("v", "u")).toDF("n", "w")
        least = both.groupBy("n").agg(F.min("w").alias("m"), F.count("*").alias("many")).select("n", F.least("n", "m").alias("m"), "many")
        large = _with_least(both, least, "n").where("w > n").select(F.col("w").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))
        small = _with_least(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = least.select("u", "m")
        e = stash(small.union(least).distinct(), "stars")
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.toDF("node", "root").union(e.select("v", "v").distinct())


def _with_least(edges: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """edges and the column m of least (key, m, many), its row for each key."""
    hubs = stash(least.where(F.col("many") >= HUB).select(key, F.col("m").alias("_m")), "hubs")
    plain = least.select(key, "m")
    if not hubs.limit(1).count():
        return edges.join(plain, key)
    marked = join_small(edges, hubs, [key])
    hot = marked.where("_m is not null").withColumn("m", F.col("_m"))
    rest = marked.where("_m is null").join(plain, key)
    columns = [*edges.columns, "m"]
    return hot.select(*columns).unionByName(rest.select(*columns))


def _mark(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]
