"""The Merkle manifest, against a plain Python tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from basewise.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, place long, size int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def grown(hashes):
    """(root, for each leaf the siblings level by level as (left, right))."""
    ways, groups = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        above, joined = [], []
        for lo in range(0, len(hashes), 8):
            run = hashes[lo : lo + 8]
            for k, own in enumerate(groups[lo : lo + 8]):
                for i in own:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest(*run))
            joined.append([i for own in groups[lo : lo + 8] for i in own])
        hashes, groups = above, joined
    return hashes[0], ways


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by_lang = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in langs}
    trees = {x: grown([leaf_of(r) for r in own]) for x, own in by_lang.items()}
    root, tops = grown([trees[x][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for r, way in zip(by_lang[x], trees[x][1], strict=True):
            way = [*way, *tops[n]]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            text = "".join(c.lower() if c.isascii() else c for c in r[4]) if changed else r[4]
            acc = leaf_of((*r[:4], text))
            for left, right in way:
                acc = digest(left, acc, right)
            out.append((r[0], leaf_of(r), trees[x][0], root, digest(*[a + b for a, b in way]), acc, acc == root))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    v = merkle.verify(merkle.manifest(docs, more={"tampered": merkle.tampered_leaf}), F.coalesce("tampered", "leaf"))
    return sorted((tuple(r) for r in v.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def rows_of(n, lang, start=0):
    return [(start + i, "web", lang, i, f"Text {i} É", "x", "y", 1, 2) for i in range(n)]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 1}, {"en": 9, "fr": 65, None: 3}, {f"l{k}": 1 + k % 3 for k in range(70)}])
def test_equals_a_plain_tree(spark, sizes):
    rows = [r for k, (lang, n) in enumerate(sizes.items()) for r in rows_of(n, lang, 1000 * k)]
    assert found(spark, rows) == expected(rows)


def test_nulls_repeated_rows_long_and_empty_texts(spark):
    rows = [(None, None, None, None, None, *[None] * 4), (3, "a", "en", 0, "", *["q", "q", 1, 1]), (3, "a", "en", 0, "", *["q", "q", 1, 1]), (3, "b", "", 5, "A" * 300_000, None, None, 3, 3), (None, "", "en", -1, "Z", None, None, 3, 3)]
    rows += rows_of(20, "en", 3)
    assert found(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_manifest_stores_preimages_that_hash_to_the_nodes_above(spark):
    m = merkle.manifest(spark.createDataFrame(rows_of(200, "en") + rows_of(3, "de", 500), SCHEMA))
    nodes = merkle.node_table(m).collect()
    assert {n.hash for n in nodes} == {digest(n.preimage) for n in nodes} and len(nodes) == 25 + 4 + 1 + 1 + 1
    above = "".join(n.preimage for n in nodes)
    root = m.subroots.first().root
    assert all(n.hash in above or n.hash == root for n in nodes)


def test_a_claimed_hash_is_refuted(spark):
    m = merkle.manifest(spark.createDataFrame(rows_of(30, "en"), SCHEMA))
    v = merkle.verify(m, F.when(F.col("id") == 7, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.col("leaf")))
    assert [r.id for r in v.where("not verified").collect()] == [7]
