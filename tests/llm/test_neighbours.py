"""Near duplicates, components and nearest neighbours against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewise.llm import jaccard_join, queries, stable_ann
from basewise.llm.components import components
from basewise.llm.shingles import Codes, MinHash, shingles


def sets_of(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(rows, threshold=0.8):
    """doc_id -> (class_id, links) by comparing all pairs."""
    s = {i: sets_of(t) for i, t in rows if i is not None}
    parent = {i: i for i in s}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = {i: set() for i in s}
    for a, b in combinations(sorted(s), 2):
        if s[a] and s[b] and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
            if s[a] != s[b]:
                linked[a].add(frozenset(s[b]))
                linked[b].add(frozenset(s[a]))
    return {i: (find(i), len(linked[i])) for i in s}


def corpus(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.randint(30, 120))]
        for _ in range(r.randint(1, 8)):
            t = list(base)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = word()
            rows.append((n, " ".join(t)))
            n += 1
    big = [word() for _ in range(200)]
    for k in range(60):  # a chain-like group of close copies
        t = list(big)
        t[k * 3] = word()
        rows.append((n, " ".join(t)))
        n += 1
    passage = " ".join(word() for _ in range(60))
    rows += [(n + k, " ".join(word() for _ in range(150)) + " " + passage) for k in range(40)]
    return rows + [(n + 50, ""), (n + 51, None), (n + 52, " \n "), (n + 53, "few words"), (n + 54, "few words"), (n + 55, rows[0][1])]


@pytest.mark.parametrize("blocks", [{}, {"bucket_block": 7, "group_block": 9}])
def test_near_duplicates_match_brute_force(spark, blocks):
    rows = corpus()
    d = spark.createDataFrame([*rows, (None, "few words")], "doc_id long, text string").withColumns({"node": F.lit(1), "sig": F.lit(1), "group": F.lit("x")})
    got = jaccard_join.near_duplicates(d, jaccard_join.Params(**blocks)).collect()
    assert len(got) == len(rows) + 1
    want = plain_classes(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got if r.doc_id is not None} == want
    same = min(i for i, t in rows if t == "few words")  # a row without an id is a document like any other
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(same, 0)]


def test_one_of_each_class_stays(spark):
    rows = [*corpus(3), (None, "no id here")]
    rows.append(rows[0])  # a repeated row
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = jaccard_join.drop_near_duplicates(d)
    assert kept.columns == d.columns
    want = sorted({c for c, _ in plain_classes(rows[:-1]).values()})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.where("doc_id is null").count() == 1


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(d).count() == 0 and jaccard_join.drop_near_duplicates(d).count() == 0


def test_prefixes_shorten_until_the_recall():
    p = jaccard_join.Params()
    count = p.depth - p.shortest + 1
    assert p.found(p.threshold, p.shortest) >= p.recall > p.found(p.threshold, p.shortest + 1)
    sizes = np.ones((4, p.trees, count), np.int64)
    sizes[1] = p.few + 1  # crowded in every tree, down to the whole key
    sizes[2, :, :-1] = 10_000 - np.arange(p.trees)[:, None]
    sizes[2, :, -1] = 2
    sizes[3, ::2, 0] = p.few + 5
    d = jaccard_join.lengths_of(sizes, p)
    recall = 1 - np.prod(1 - p.threshold ** d.astype(float), axis=1)
    assert (recall >= p.recall).all() and (d >= p.shortest).all()
    assert (d[0] == p.shortest).all() and d[1].max() > p.shortest  # crowded prefixes are kept as long as the recall allows
    for row in (1, 2):  # one step less would miss the target
        longer = d[row].copy()
        longer[longer.argmin()] += 1
        assert 1 - np.prod(1 - p.threshold ** longer.astype(float)) < p.recall
    assert (np.diff(d[2]) <= 0).all()  # the trees whose prefixes lead to fewer nodes come first


def links_of(texts):
    """Pairs of places of different sets at similarity 0.8 or more, through an inverted index of the shingles."""
    sets, where, met = [frozenset(sets_of(t)) for t in texts], {}, Counter()
    first = {}
    for k, s in enumerate(sets):
        if s and s not in first:
            first[s] = k
            for g in s:
                where.setdefault(g, []).append(k)
    for own in where.values():
        met.update(combinations(own, 2))
    return {(a, b) for (a, b), n in met.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}, sets


def test_recall_and_classes_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    pairs, sets = links_of([re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in docs])
    degree = Counter(k for pair in pairs for k in pair)
    of_set = {}
    for k, s in enumerate(sets):
        of_set.setdefault(s, k)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {i for i, _ in docs}
    want = [degree[of_set[s]] if s else 0 for s in sets]
    found = [got[i].n_links for i, _ in docs]
    assert sum(want) > 0 and all(f <= w for f, w in zip(found, want, strict=True)) and sum(found) >= 0.95 * sum(want)
    together = sum(got[docs[a][0]].class_id == got[docs[b][0]].class_id for a, b in pairs)
    assert together >= 0.95 * len(pairs)


def test_recall_near_the_threshold(spark):
    r, rows = random.Random(8), []
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    for n in range(300):
        base = [word() for _ in range(150)]
        other = list(base)
        for at in r.sample(range(10, 140, 6), 3):  # five shingles each: similarities of 131 / 161 and more
            other[at] = word()
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(other))]
    pairs, _ = links_of([t for _, t in rows])
    assert len(pairs) > 250
    got = {x.doc_id: x.n_links for x in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got.values()) >= 0.99 * 2 * len(pairs)


def test_long_texts_are_taken_in_slices():
    r = random.Random(2)
    text = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(3000))
    whole = shingles(text, Codes())
    assert all(np.array_equal(whole, shingles(text, Codes(500), chars)) for chars in (1, 7, 100, 5000))
    assert len(whole) == len(sets_of(text)) and len(shingles("a b c", Codes(), 1)) == 1


def test_hubs_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr("basewise.llm.components.HUB", 20)
    edges = [(1000, k) for k in range(500)] + [(2000, k) for k in range(600, 700)] + [(699, 3000), (3000, 3001), (5000, 5001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in [*range(500), 1000]} == {0} and {got[k] for k in [*range(600, 700), 2000, 3000, 3001]} == {600} and got[5001] == 5000


def test_rows_without_id_are_documents(spark):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (7, "one two three four five six"), (7, "another text under the same number here"), (None, None), (8, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("?") for c in ("copy", "_key", "_id", "class_id", "n")})
    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in jaccard_join.near_duplicates(d).collect()), key=repr)
    assert got == sorted([(None, 7, 3), (None, 7, 3), (7, 7, 3), (7, 7, 1), (None, None, 1), (8, 8, 1)], key=repr)
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.drop_near_duplicates(d).collect()), key=repr)
    assert kept == sorted([rows[2], rows[3], rows[4], rows[5]], key=repr)


def test_signatures_estimate_similarity():
    low, codes = MinHash(128), Codes()
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:360] + [f"v{i}" for i in range(40)])
    s, t = shingles(a, codes), shingles(b, codes)
    true = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
    assert abs((low(s) == low(t)).mean() - true) < 0.13


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + k] for k in range(40)} == {100} and got[201] == 200 and len(got) == 61 + 40 + 2


# --- nearest neighbours ---


def plain_nearest(rows, k):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    out = {}
    for i, x in rows:
        if i % 20 == 0:
            s = v @ np.array(x)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = ids[order].tolist()
    return out


@pytest.mark.parametrize("norms", [False, True])
def test_recall_against_brute_force(spark, norms):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 16))
    v = centres[r.integers(0, 12, 1500)] + 0.6 * r.normal(size=(1500, 16))
    if not norms:
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = stable_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, stable_ann.Params(block=400, query_block=16)).collect()
    want = plain_nearest(rows, 20)
    found: dict[int, list] = {i: [] for i in want}
    for x in sorted(got, key=lambda x: (x["query_id"], x["rank"])):
        found[x.query_id].append(x.vec_id)
        assert x.score == pytest.approx(float(v[x.vec_id] @ v[x.query_id]), abs=1e-12)
    assert all(len(f) == 20 for f in found.values())
    assert np.mean([len(set(found[i]) & set(want[i])) / 20 for i in want]) >= 0.95


def test_recall_of_the_registered_query(spark):
    """Every row of embeddings is a candidate; blocks small enough that queries cross regions."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    fine = [(i, [float(y) for y in v]) for i, v in rows if v is not None and np.isfinite(np.array(v, float)).all() and any(v)]
    want = plain_nearest(fine, 20)
    table = spark.createDataFrame(fine, "vec_id long, embedding array<float>")
    for got in (queries.op9_stable_ann(spark, "/root/testdata/sf0.1"), stable_ann.nearest(table, F.col("vec_id") % 20 == 0, stable_ann.Params(block=300, query_block=20))):
        found: dict[int, set] = {i: set() for i in want}
        for x in got.collect():
            found[x["query_id"]].add(x["vec_id"])
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert np.mean([len(found[i] & set(want[i])) / len(want[i]) for i in want]) >= 0.95


def test_far_clusters_in_small_regions(spark):
    """Recall holds where clusters lie far apart and regions are small."""
    r = np.random.default_rng(4)
    centres = 50 * r.normal(size=(16, 8))
    v = np.vstack([c + 0.1 * r.normal(size=(200, 8)) for c in centres])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = stable_ann.build_index(stable_ann.usable(table), stable_ann.Params(block=200))
    assert len(index.regions) >= 16 and index.blocks.agg(F.sum(F.octet_length("ids"))).first()[0] == 8 * len(v)
    want = plain_nearest([(i, x.tolist()) for i, x in enumerate(v)], 20)
    got: dict[int, list] = {}
    for x in stable_ann.nearest(table, F.col("vec_id") % 20 == 0, stable_ann.Params(block=200)).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.95


def test_regions_of_a_top_tree():
    x = np.random.default_rng(2).normal(size=(1000, 3))
    dims, values = stable_ann.cuts_of(x, 7)
    region = stable_ann.region_of(x, dims, values)
    assert len(dims) == 7 and np.bincount(region).tolist() == [125] * 8
    assert not len(stable_ann.cuts_of(x, 1)[0]) and (stable_ann.region_of(x, *stable_ann.cuts_of(x, 1)) == 0).all()


def test_unusable_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (40, None)]
    got = stable_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert stable_ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_copies_of_the_query_are_all_found(spark):
    r = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(300)] + [(300 + i, r.normal(size=4).tolist()) for i in range(700)]
    got = stable_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 260, stable_ann.Params(block=200)).orderBy("rank").collect()
    s = {i: x[0] for i, x in rows if i != 260}
    assert [x.vec_id for x in got] == sorted(s, key=lambda i: (-s[i], i))[:20]


def test_chi_square_quantiles():
    assert stable_ann.chi_square_at(0.95, 6) == pytest.approx(12.5916, abs=1e-3) and stable_ann.chi_square_at(0.5, 2) == pytest.approx(1.3863, abs=1e-3)
