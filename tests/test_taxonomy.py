"""Tree operators on literal and random trees."""

import random

import pytest
from pyspark.sql import functions as F

from basewise.operators import taxonomy as t

NODES = "tax_id string, parent_id string, name string, rank string, ord long"


def tree(spark, edges, ranks=None):
    rows = [(c, p, f"name {c}", (ranks or {}).get(c, "no rank"), i) for i, (c, p) in enumerate(edges)]
    return t.numbered(spark.createDataFrame(rows, NODES))


#: Child and parent of each node.
SEVEN = [("1", "1"), ("2", "1"), ("3", "2"), ("4", "2"), ("5", "3"), ("6", "5"), ("7", "1")]


def test_seven_nodes(spark):
    x = tree(spark, SEVEN)
    assert {r.tax_id: r.depth for r in x.collect()} == dict(zip("1234567", [0, 1, 2, 2, 3, 4, 1], strict=True))
    pairs = spark.createDataFrame([("5", "6"), ("1", "6"), ("6", "4"), ("3", "4"), ("6", "7"), (None, "1"), ("9", "1")], "a string, b string")
    assert {(r.a, r.b): r.lca for r in t.lca_pairs(pairs, x, "a", "b").collect()} == {("5", "6"): "5", ("1", "6"): "1", ("6", "4"): "2", ("3", "4"): "2", ("6", "7"): "1", (None, "1"): None, ("9", "1"): None}


def line(edges, n):
    parent = dict(edges)
    out = [n]
    while parent[n] != n:
        n = parent[n]
        out.append(n)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, seed):
    r = random.Random(seed)
    edges = [("0", "0")] + [(str(i), str(r.randrange(max(0, i - 6), i))) for i in range(1, 60)]
    x = tree(spark, edges)
    up = {}
    for c in t.closure(x).collect():
        up.setdefault(c.node, set()).add(c.anc)
    assert up == {c: set(line(edges, c)) for c, _ in edges}
    sets = [[str(r.randrange(60)) for _ in range(r.randint(1, 5))] for _ in range(40)]
    pre = {row.tax_id: row.pre for row in x.collect()}
    rows = spark.createDataFrame([(i, min(pre[n] for n in s), max(pre[n] for n in s)) for i, s in enumerate(sets)], "i int, lo long, hi long")
    for row in t.lca_of_extremes(rows, "lo", "hi", t.closure(x), "lca").collect():
        common = set.intersection(*(set(line(edges, n)) for n in sets[row.i]))
        assert row.lca == next(n for n in line(edges, sets[row.i][0]) if n in common)
    assert {row.tax_id for row in t.descendants(x, spark.createDataFrame([("5",)], "tax_id string")).collect()} == {c for c, _ in edges if "5" in line(edges, c)}


def test_rank_limits_requests_and_artificial_nodes(spark):
    ranks = {"2": "genus", "3": "species", "4": "clade", "5": "strain", "6": None, "7": "kingdom"}
    x = tree(spark, SEVEN, ranks)
    one = spark.createDataFrame([("2",)], "tax_id string")
    down = lambda r: {y.tax_id for y in t.descendants(x, one, r).collect()}
    assert down("species") == {"2", "3", "4"} and down("genus") == {"2", "4"} and down("strain") == {"2", "3", "4", "5"}
    wanted = spark.createDataFrame([("1", False), ("3", True)], "tax_id string, exclude boolean")
    assert {y.tax_id for y in t.requested(x, wanted).collect()} == {"1", "2", "4", "7"}
    assert {y.tax_id: y.anc for y in t.ancestor_of_rank(x, "genus").collect()} == {"1": None, "2": "2", "3": "2", "4": "2", "5": "2", "6": "2", "7": None}
    assert {y.tax_id for y in t.pruned(x, spark.createDataFrame([("5",), ("7",)], "tax_id string")).collect()} == {"1", "2", "3", "5", "7"}
    regions = spark.createDataFrame([("3", "f1", "a1"), ("3", "f1", "a2"), ("3", "f2", "a3"), ("7", "f1", "a4")], "tax_id string, file string, accession string")
    a = {y.tax_id: y for y in t.artificial_nodes(x, regions).collect()}
    assert len(a) == 2 + 3 + 4 and all(i.startswith("00") for i in a)
    for y in a.values():
        assert y.rank == "DATA" and y.parent_id in "37" or a[y.parent_id].rank == {"FILE": "DATA", "ID": "FILE"}[y.rank]


def test_compared_ranks(spark):
    c = {(r["rank"], r.other): (r.comparable, r.is_above, r.is_below) for r in t.compared_ranks(spark).collect()}
    assert c["genus", "species"] == (True, True, False) and c["section", "genus"] == (True, False, True) and c["section", "subgenus"] == (True, True, False)
    assert c["clade", "species"] == (False, False, False) and c["ID", "isolate"] == (True, False, True)


def walked(edges):
    """depth, pre and last by a walk."""
    children, out = {}, {}
    for c, p in edges:
        if c != p:
            children.setdefault(p, []).append(c)

    def visit(n, depth):
        pre = len(out)
        out[n] = None
        for c in children.get(n, ()):
            visit(c, depth + 1)
        out[n] = (depth, pre, len(out) - 1)

    visit(next(c for c, p in edges if c == p), 0)
    return out


def test_numbering_is_a_walk_in_preorder(spark):
    r = random.Random(0)
    edges = [("0", "0")] + [(str(i), str(r.randrange(max(0, i - r.choice([9, 300])), i))) for i in range(1, 300)]
    r.shuffle(edges)
    loose = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "nowhere"), ("f", "f"), ("g", "f")]  # a circle, a line into it, a lost parent, a second root
    got = {x.tax_id: (x.depth, x.pre, x.last) for x in tree(spark, edges + loose).collect()}
    assert got == walked(edges)


def test_regions_at_artificial_nodes(spark):
    x = tree(spark, SEVEN)
    rows = [("3", "f1", "a1", "s"), ("3", "f1", "a2", "t"), ("3", "f2", "a1", "u"), ("7", "f1", "a1", "v"), ("4", "f9", "a9", "w"), ("3", "f1", "a1", "x"), ("7", "f1", None, "y")]
    regions = spark.createDataFrame(rows, "tax_id string, file string, accession string, seq string")
    for levels in ({}, {"data": False}, {"files": False, "ids": False}):
        nodes = t.artificial_nodes(x, regions.where("tax_id <> '4'"), **levels).cache()
        big, at = {r.tax_id: r for r in t.grown(x, nodes).collect()}, t.with_artificial_node(regions, nodes, **levels).collect()
        assert len(big) == 7 + nodes.count() and sorted(r.pre for r in big.values()) == list(range(len(big)))
        assert {(r.natural_id, r.file, r.accession, r.seq) for r in at} == set(rows)
        for r in at:
            way, n = [], big[r.tax_id]
            while n.tax_id != r.natural_id:
                way.append((n["rank"], n.name))
                n = big[n.parent_id]
            want = [("DATA", f"Data for {r.natural_id}"), ("FILE", r.file), ("ID", r.accession)]
            on = [levels.get(k, True) for k in ("data", "files", "ids")]
            assert way[::-1] == ([] if r.natural_id == "4" else [w for w, o in zip(want, on, strict=True) if o and w[1]])


def test_nodes_off_the_tree_go(spark):
    assert {r.tax_id for r in tree(spark, [("1", "1"), ("2", "1"), ("8", "9")]).collect()} == {"1", "2"}
    assert t.numbered(spark.createDataFrame([], NODES)).count() == 0
    assert t.closure(tree(spark, SEVEN)).where(F.col("node") == "6").count() == 5


@pytest.mark.parametrize(("limit", "value"), [("Row", 60), ("Level", 4)])
def test_closure_beyond_the_limits_of_recursion(spark, limit, value):
    """A tree with more ancestors, or more levels, than a recursive query may have rows or levels has the same closure."""
    rows = [("1", "1", "n1", "no rank", 0)] + [(str(i), str(i // 2), f"n{i}", "no rank", i) for i in range(2, 40)]
    tax = t.numbered(spark.createDataFrame(rows, "tax_id string, parent_id string, name string, rank string, ord long"))
    wanted = sorted(map(tuple, t.closure(tax).collect()))
    name = f"spark.sql.cteRecursion{limit}Limit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        assert sorted(map(tuple, t.closure(tax).collect())) == wanted
    finally:
        spark.conf.set(name, before)
