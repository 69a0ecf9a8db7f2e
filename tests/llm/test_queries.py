"""The registered queries: columns, folds and held-out results on a folder of the driver's, and brute force for what the classifiers count."""

import math
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basewise.llm import jaccard_join, language_id, packing, quality_classifier, queries, toxicity
from basewise.llm.common import vocabulary

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def one_for_each(rows, documents):
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) == len(documents) and set(got) == set(documents)
    return got


@pytest.mark.parametrize(("op", "folds", "held", "label", "least"), [("op5_quality_classifier", 5, 0, "quality", 0.97), ("op6_toxicity", 4, 2, "toxic", 0.9)])
def test_scores_of_held_out_documents(spark, documents, labels, op, folds, held, label, least):
    d = queries.queries()[op](spark, FOLDER)
    assert d.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and dict(d.dtypes)["predicted"] == "int"
    got = one_for_each(d.collect(), documents)
    assert all(r.held_out == (fold(i, folds) == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    asked = [(got[i].predicted, getattr(r, label)) for i, r in labels.items() if i in got and got[i].held_out]
    assert len(asked) > 30 and np.mean([p == y for p, y in asked]) >= least


def test_languages_of_held_out_documents(spark, documents):
    d = queries.op4_language_id(spark, FOLDER)
    assert d.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = one_for_each(d.collect(), documents)
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 for i, r in got.items())
    learnt = {r.lang for r in documents.values() if r.lang is not None}
    assert {r.lang_pred for r in got.values()} <= learnt | {"und"}
    asked = [(got[i].lang_pred, r.lang) for i, r in documents.items() if got[i].held_out and r.lang is not None and any(c.isalpha() for c in r.text or "")]
    assert len(asked) > 100 and np.mean([p == y for p, y in asked]) >= 0.98


def test_token_queries_equal_the_library(spark, documents):
    import hashlib

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = one_for_each(queries.op7_bpe_tree(spark, FOLDER).collect(), documents)
    for i, r in documents.items():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = one_for_each(queries.op10_token_files(spark, FOLDER).collect(), documents)
    start = 0
    for i in sorted(documents):
        ids = [*library.encode(documents[i].text or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_packing_and_duplicates_of_documents(spark, documents):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = queries.op1_best_fit_packing(spark, FOLDER).collect()
    n, filled, sizes = Counter(), Counter(), {}
    for r in rows:
        n[r.doc_id] += r.length
        filled[r.bin] += r.length
        sizes[r.bin] = r.bin_size
    want = {i: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in documents.items()}
    assert n == {i: x for i, x in want.items() if x > 1}
    assert all(filled[b] <= sizes[b] == min(s for s in packing.Params().sizes if s >= filled[b]) for b in filled)
    assert sum(filled.values()) >= 0.98 * sum(sizes.values())
    d = queries.op3_ngram_jaccard_join(spark, FOLDER)
    assert d.columns == ["doc_id", "class_id", "n_links", "n_copies"]
    got = one_for_each(d.collect(), documents)
    assert all(r.class_id <= i and got[r.class_id].class_id == r.class_id for i, r in got.items())


def plain_share(part, whole):
    return math.asin(math.sqrt(min(1.0, part / (whole + 10.0))))


@pytest.mark.parametrize("text", ["", "one", "The THE the, the! # | 12 34.\nline two\nline two\n\n  \nx x x é", "a b " * 50, "ÄÖ ß\n" * 3, "1234 5678 $%&*"])
def test_statistics_against_plain_counts(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    count = lambda chars: sum(c in chars for c in text)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    solid = sum(len(c.encode()) for c in text if c not in " \t\n\r\x0b\x0c")
    most = max(Counter(words).values(), default=0)
    want = [
        math.log1p(len(words)), math.log1p(solid / len(words)) if words else 0.0, plain_share(count(upper), count(upper + lower)), plain_share(count("#$%&*"), solid), plain_share(count("!"), solid), plain_share(count("|"), solid),
        plain_share(count("0123456789"), solid), plain_share(count(".,"), solid), math.log1p(len(set(words))) / math.log1p(len(words)) if words else 1.0, plain_share(most - 1, len(words)) if words else 0.0,
        plain_share(sum(a == b for a, b in pairwise(words)), len(words)), plain_share(len(lines) - len(set(lines)), len(lines)),
    ]
    assert quality_classifier.statistics(text) == pytest.approx(want)


def test_sparse_rows_fit_as_dense_ones():
    r = np.random.default_rng(1)
    dense = [(r.random((n, 6)) < 0.3) * r.random((n, 6)) + (np.arange(6) < k) for n, k in ((40, 2), (300, 0))]
    sparse = [toxicity.Sparse(*np.nonzero(x), x[np.nonzero(x)], x.shape) for x in dense]
    (w, b), (v, c) = toxicity.fit_weights(*dense, 0.1), toxicity.fit_weights(*sparse, 0.1)
    assert np.allclose(w, v, atol=1e-3) and abs(b - c) < 1e-3


def test_weights_minimise_the_non_negative_risk():
    """The fitted weights against small changes of them, under the risk written out."""
    r = np.random.default_rng(0)
    xp, xu, prior = r.normal(1.5, 1, (200, 2)).astype(np.float32), np.vstack([r.normal(1.5, 1, (100, 2)), r.normal(-1, 1, (900, 2))]).astype(np.float32), 0.1
    p = toxicity.Params(steps=3000, rate=0.02)
    w, b = toxicity.fit_weights(xp, xu, prior, p)

    def risk(w, b):
        zp, zu = xp @ w + b, xu @ w + b
        toxic, as_clean = np.log1p(np.exp(-zp)).mean(), np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        return prior * toxic + max(0.0, as_clean) + 0.5 * p.ridge / len(xp) * prior * (w @ w)

    least = risk(w, b)
    assert all(risk(w + dw, b + db) >= least - 1e-5 for dw, db in [(np.array([0.1, 0]), 0), (np.array([-0.1, 0]), 0), (np.array([0, 0.1]), 0), (np.array([0, -0.1]), 0), (np.zeros(2), 0.1), (np.zeros(2), -0.1)])
    assert (1 / (1 + np.exp(-(xp @ w + b))) > 0.3).mean() > 0.9


def test_pipeline_edge_rows(spark, tmp_path):
    good = " ".join(f"the quiet river number {k} runs past old stones" for k in range(12))
    rows = [(1, good), (1, good), (1, "another text that shares its number " + good[60:]), (None, good), (None, None), (2, ""), (3, " ".join(f"word{k}" for k in range(40_000))), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("?") for c in ("copy", "row", "key", "_id", "_key", "score", "predicted", "x", "node")})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:  # nothing is learnt, nothing goes
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() == len(rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, good), rows[2], rows[4], rows[5], rows[6], rows[7]], key=repr)
    assert {r.doc_id for r in corpus_pipeline.pack(spark, kept, str(tmp_path)).collect()} == {1, 3}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
