"""Packing, quality rules, classifiers, language and URLs against brute force and on the defined edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basewise.llm import language_id, packing, quality_classifier, quality_rules, toxicity, url_reputation

DOCS = "doc_id long, text string, lang string, source string"
EDGE = [(None, "a b c", None, None), (1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t ", "en", None), (4, "word", None, "s"), (5, "x " * 30_000, "en", "s"), (6, "same text here", "en", "s"), (6, "same text here", "en", "s")]


def docs(spark, rows=EDGE):
    """With columns whose names clash with those the operators use inside."""
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({c: F.lit("?") for c in ("_text", "_words", "score", "label", "n_words", "node", "_n", "_h", "x", "length")})


# --- packing ---


@pytest.mark.parametrize("seed", range(4))
def test_pack_fills_bins_within_their_sizes(seed):
    r = np.random.default_rng(seed)
    p = packing.Params(sizes=(16, 32, 64), costs=(17, 33, 64))
    lengths = r.integers(1, 65, size=500).tolist()
    bins, offsets, sizes, cost = packing.pack(lengths, p)
    filled = Counter()
    taken = set()
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        filled[b] += n
        new = {(b, o + i) for i in range(n)}
        assert not new & taken
        taken |= new
    for b, n in filled.items():
        assert n <= sizes[b] and sizes[b] == min(s for s in p.sizes if s >= n)
    assert cost == pytest.approx(sum(p.costs[p.sizes.index(s)] for s in sizes))
    assert cost <= 1.1 * sum(lengths) * min(c / s for s, c in zip(p.sizes, p.costs, strict=True))  # near the least that any packing could cost
    alone = sum(min(c for s, c in zip(p.sizes, p.costs, strict=True) if s >= n) for n in lengths)
    assert cost <= alone


def test_pack_is_best_fit_of_plain_rows():
    """Against a linear search for the tightest open bin, with one size."""
    p = packing.Params(sizes=(50,), costs=(1.0,))
    lengths = np.random.default_rng(1).integers(1, 50, size=300).tolist()
    open_bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(open_bins) if room >= n]
        if fit:
            open_bins[min(fit, key=lambda i: open_bins[i])] -= n
        else:
            open_bins.append(50 - n)
    assert len(packing.pack(lengths, p)[2]) == len(open_bins)


def least_cost(lengths, p):
    """Of all ways to deal the pieces over bins."""
    best = float("inf")

    def deal(k, bins):
        nonlocal best
        cost = sum(min((c for s, c in zip(p.sizes, p.costs, strict=True) if s >= n), default=float("inf")) for n in bins)
        if cost >= best:
            return
        if k == len(lengths):
            best = cost
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= p.sizes[-1]:
                deal(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        deal(k + 1, [*bins, lengths[k]])

    deal(0, [])
    return best


@pytest.mark.parametrize("costs", [(9, 17, 32), (8, 15, 40), (10, 16, 27)])
def test_pack_of_several_sizes_against_all_packings(costs):
    p = packing.Params(sizes=(8, 16, 32), costs=costs)
    r, over = np.random.default_rng(sum(costs)), []
    for _ in range(60):
        lengths = r.integers(1, 33, size=6).tolist()
        cost, least = packing.pack(lengths, p)[3], least_cost(lengths, p)
        assert least <= cost <= 1.35 * least
        over.append(cost / least)
    assert np.mean(over) <= 1.05
    assert packing.pack([32], p)[3] == costs[2] and packing.pack([8, 8], p)[3] == least_cost([8, 8], p)


def test_pack_documents_keeps_every_token(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    p = packing.Params(sizes=(64, 128), costs=(64, 128), block=100)
    rows = packing.pack_documents(docs(spark), p=p).collect()
    got, want = Counter(), Counter()
    for r in rows:
        got[r.doc_id] += r.length
        assert r.offset + r.length <= r.bin_size
    for i, text, *_ in EDGE:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[i] += n + 1 if n else 0
    assert got == {k: n for k, n in want.items() if n}
    by_bin = Counter()
    for r in rows:
        by_bin[r.bin] += r.length
        assert r.start % 128 == 0
    assert all(by_bin[r.bin] <= r.bin_size for r in rows)
    assert len({r.bin.split("-")[0] for r in rows}) == -(-len(rows) // 100)  # blocks do not depend on partitions
    assert packing.pack_documents(docs(spark, []), p=p).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs(spark), p=packing.Params(sizes=(2, 1), costs=(1, 1)))


# --- quality rules ---


def plain_counts(text):
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    lines = [x for x in text.split("\n") if word.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = ["a b c d e f a b c d e g", "x\nx\n \nx", "# $ % no\xa0break é", "a a a a a a a a", "one two three four five one two three four five", "a\x0bb\x0cc\rd\te \x1c f"]


def test_counts_match_plain_python(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + EDGE
    got = quality_rules.text_counts(docs(spark, rows), "doc_id").collect()
    want = Counter((r[0], *plain_counts(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_limits_follow_the_group_and_small_groups_their_language(spark):
    good = [(i, " ".join(f"w{i}{j}" for j in range(40)), "en", "s1") for i in range(300)]
    noisy = [(1000 + i, " ".join(f"w{i}{j}#" for j in range(40)), "en", "s2") for i in range(300)]
    odd = [(5000, "### " * 50 + " ".join(f"v{j}" for j in range(40)), "en", "s1"), (5001, " ".join(f"q{j}" for j in range(40)), "en", "rare")]
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs(spark, good + noisy + odd)).collect()}
    assert all(got[r[0]].kept for r in good + noisy), "a source's own habit is no fault"
    assert not got[5000].kept and got[5001].kept


def test_equal_documents_of_different_groups_get_different_verdicts(spark):
    """What is common in one source is rare in another; only the learnt limits tell them apart."""
    plain = [(i, " ".join(f"w{i}{j}" for j in range(40)), "en", "plain") for i in range(2000)]
    noisy = [(5000 + i, " ".join(f"w{i}{j}#" for j in range(40)), "en", "noisy") for i in range(2000)]
    long = [(10_000 + i, " ".join(f"extraordinarily{i}{j}" for j in range(40)), "de", "plain") for i in range(2000)]
    some, wide = " ".join(f"w5999{j}#" for j in range(40)), " ".join(f"extraordinarily{j}" for j in range(40))
    same = [(20_000, some, "en", "plain"), (20_001, some, "en", "noisy"), (20_002, wide, "en", "plain"), (20_003, wide, "de", "plain")]
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs(spark, plain + noisy + long + same)).collect()}
    assert [got[i].kept for i in range(20_000, 20_004)] == [False, True, False, True]
    assert got[20_000].symbols == got[20_001].symbols and got[20_002].word_length == got[20_003].word_length


def test_a_symbol_in_a_group_without_symbols_rejects_no_text(spark):
    """A group of plain texts has no tail of its own: its language's decides, and without one symbols don't."""
    plain = [(i, " ".join(f"w{i}{j}" for j in range(40)), "en", "plain") for i in range(500)]
    marked = [(1000, "#" + plain[0][1], "en", "plain"), (1001, " ".join(f"v{j}" for j in range(5000)) + " #", "en", "plain")]
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs(spark, plain + marked)).collect()}
    assert all(r.kept for r in got.values()) and got[1000].symbols == got[1001].symbols == got[0].symbols
    junk = [(2000 + i, " ".join(f"x{i}{j}$$" for j in range(40 + i)), "en", "other") for i in range(20)]
    rest = [(3000 + i, " ".join(f"y{i}{j}" for j in range(40)), "en", "other") for i in range(180)]
    some = [(4000, "## " + plain[1][1], "en", "plain"), (4001, "$$ " * 60 + plain[2][1], "en", "plain")]
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs(spark, plain + marked + junk + rest + some)).collect()}
    assert {i for i, r in got.items() if not r.kept} == {4001} | {r[0] for r in junk}


def test_quality_rules_edge_cases(spark):
    got = quality_rules.judge_quality(docs(spark)).collect()
    assert len(got) == len(EDGE) and all(r.base_failed and not r.kept for r in got)
    assert quality_rules.judge_quality(docs(spark, [])).count() == 0


# --- quality classifier ---


def test_discriminant_is_the_gaussian_log_ratio(spark):
    r = np.random.default_rng(0)
    d = len(quality_classifier.STATISTICS)
    a, b = r.normal(size=(400, d)), r.normal(1.0, 2.0, size=(300, d))
    rows = spark.createDataFrame([(x.tolist(), 0) for x in a] + [(x.tolist(), 1) for x in b], "x array<double>, label int")
    p = quality_classifier.Params(to_pooled=0, to_identity=0)
    model = quality_classifier.fit(rows, p)

    def log_density(x, rows):
        m, c = rows.mean(0), np.cov(rows.T, bias=True)
        return -0.5 * (np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + np.linalg.slogdet(c)[1])

    x = np.concatenate([a[:20], b[:20]])
    z = log_density(x, b) - log_density(x, a) + math.log(300 / 400)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(z, -40, 40))), atol=1e-6)


def test_quality_classifier_learns_and_survives_edges(spark):
    good = [(i, f"These are plain words number {i} of a fine text, and they go on for a while. " * 3, "en", "s") for i in range(60)]
    bad = [(100 + i, f"BUY### now$$$ {i} &&& now*** " * 12, "en", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, *_ in good[:50] + bad[:50]], "doc_id long, label int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs(spark, good + bad + EDGE[:5]), labels, F.lit(True)).collect()}
    assert all(got[i].predicted == 1 for i, *_ in good[50:]) and all(got[i].predicted == 0 for i, *_ in bad[50:])
    assert all(0 <= r.score <= 1 for r in got.values()) and None in got
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality_classifier.classify(docs(spark), none, F.lit(True)).collect()} == {0.5}
    assert quality_classifier.classify(docs(spark, []), none, F.lit(True)).count() == 0


# --- toxicity ---


def test_risk_estimate_recovers_clean_text_among_unlabelled():
    r = np.random.default_rng(0)
    xp = np.column_stack([np.ones(200), r.random(200) < 0.3]).astype(np.float32)
    xu = np.concatenate([xp[:100], np.column_stack([np.zeros(900), r.random(900) < 0.3]).astype(np.float32)])
    w, b = toxicity.fit_weights(xp, xu, 0.1)
    s = 1 / (1 + np.exp(-(xu @ w + b)))
    assert s[:100].min() > 0.5 and s[100:].max() < 0.1


def test_toxicity_learns_from_positive_and_unlabelled(spark):
    r = np.random.default_rng(2)
    clean = [(i, " ".join(f"word{k}" for k in r.integers(0, 300, 30)), "en", "s") for i in range(400)]
    toxic = [(1000 + i, " ".join(f"word{k}" for k in r.integers(0, 300, 30)) + (" nastyone" if i % 2 else " VileThing"), "en", "s") for i in range(80)]
    labels = spark.createDataFrame([(i, 1) for i, *_ in toxic[:60]], "doc_id long, label int")
    got = {x.doc_id: x for x in toxicity.classify(docs(spark, clean + toxic + EDGE[:5]), labels, F.lit(True)).collect()}
    assert all(got[i].predicted == 1 for i, *_ in toxic[60:]) and not any(got[i].predicted for i, *_ in clean)
    assert not got[2].predicted and 1 in got and None in got
    none = spark.createDataFrame([], "doc_id long, label int")
    assert all(x.predicted == 0 for x in toxicity.classify(docs(spark), none, F.lit(True)).collect())
    assert toxicity.classify(docs(spark, []), none, F.lit(True)).count() == 0


def test_toxicity_learns_an_insult_of_few_confirmed_documents(spark):
    r = np.random.default_rng(5)
    text = lambda *more: " ".join([*(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwx'[k // 100]}" for k in r.integers(0, 300, 30)), *more])
    clean = [(i, text(), "en", "s") for i in range(2000)]
    toxic = [(5000 + i, text("rareslur" if i % 25 == 0 else "nastyone"), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 1) for i, *_ in toxic[:200]], "doc_id long, label int")
    got = {x.doc_id: x.predicted for x in toxicity.classify(docs(spark, clean + toxic), labels, F.lit(True)).collect()}
    assert all(got[5000 + i] for i in range(200, 400, 25)), "8 of 200 confirmed documents have it"
    assert not any(got[i] for i, *_ in clean)


def test_prior_is_the_share_of_toxic_text_though_all_of_it_is_confirmed(spark):
    rows = [(i, f"plain text {'abcdefghij'[i % 10]}x of document" + (" nastyone" if i < 100 else ""), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, label int")
    model, _ = toxicity.fit(docs(spark, rows), labels, F.lit(True))
    assert abs(model.prior - 0.25) < 0.02


# --- language ---


def test_filters_have_no_false_negative_and_correct_for_false_positives():
    r = np.random.default_rng(0)
    sets = {x: r.integers(0, 1 << 62, 500).astype(np.uint64) for x in ("aa", "bb", "cc")}
    f = language_id.Filters(sets, "aa", language_id.Params(slots_log2=14))
    for b, name in enumerate(f.languages):
        assert ((f.masks(sets[name]) >> np.uint8(b)) & np.uint8(1)).all()
    other = f.masks(r.integers(0, 1 << 62, 20_000).astype(np.uint64))
    for b in range(3):
        assert ((other >> b) & 1).mean() == pytest.approx(f.false[b], abs=0.01)


def test_grams_do_not_depend_on_slices(monkeypatch):
    text = "Straße naïve—the quick brown fox jumps. " * 40
    whole = Counter(k for _, codes in language_id.grams([text, text[:50]]) for k in codes.tolist())
    monkeypatch.setattr(language_id, "SLICE", 64)
    assert Counter(k for _, codes in language_id.grams([text, text[:50]]) for k in codes.tolist()) == whole


def test_language_of_documents(spark):
    en, de = "the cat and the dog went with them to the house", "der hund und die katze gehen mit ihnen in das haus"
    rows = [(i, f"{en if i % 2 else de} {i}", "en" if i % 2 else "de", "s") for i in range(80)] + [(100, "the dog and the cat", None, "s"), (101, "die katze und der hund", None, "s"), (102, "12 34 !", None, "s"), (103, None, None, "s"), (104, "", None, "s"), (105, "zzz", None, "s")]
    got = {r.doc_id: r for r in language_id.identify(docs(spark, rows), F.col("doc_id") < 80).collect()}
    assert got[100].lang_pred == "en" and got[101].lang_pred == "de"
    assert {got[i].lang_pred for i in (102, 103, 104)} == {"und"} and got[105].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(docs(spark), F.lit(False)).collect()} == {"und"}
    assert language_id.identify(docs(spark, []), F.lit(True)).count() == 0


# --- URLs ---

RULES = tuple(url_reputation.Rule(*x) for x in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")))


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "x://example.org/en/2", "https://notexample.org", "https://b.com/fr/", "https://com/de/1", "no scheme", None, "http://h?a://b/c", "ftp://É.net/a b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, spark.createDataFrame([], "host string, outcome int"), RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(10)] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("notexample.org", "", None), ("b.com", "/fr/", "com/fr/"),
        ("com", "/de/1", "com/de/"), ("", "", None), ("", "", None), ("h", "", None), ("É.net", "/a b", None),
    ]
    assert [got[i].verdict for i in (0, 1, 2, 5)] == ["block", "block", "allow", "block"] and got[3].verdict == "allow"


def test_reputation_shrinks_towards_parents(spark):
    bad = [("bad.a.net", 0)] * 60 + [("bad.a.net", 1)]
    rows = bad + [("good.b.net", 1)] * 200 + [("one.b.net", 0)] + [("x.c.net", 1)] * 50 + [("y.c.net", i % 2) for i in range(40)]
    hosts = spark.createDataFrame([(h,) for h in {h for h, _ in rows} | {"new.b.net", "new.a.net", "co.uk", "w.a.co.uk", "", "10.0.0.1"}], "host string")
    got = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, outcome int"), hosts).collect()}
    assert not got["bad.a.net"].allowed and got["good.b.net"].allowed and got["one.b.net"].allowed
    assert got["one.b.net"].rate > 0.3 and got["new.a.net"].rate < got["new.b.net"].rate
    assert (got["w.a.co.uk"].domain, got["w.a.co.uk"].suffix) == ("a.co.uk", "co.uk") and got["10.0.0.1"].domain == "10.0.0.1"


def test_urls_of_empty_tables(spark):
    assert url_reputation.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, outcome int"), RULES).count() == 0


def test_join_small_gives_the_same_rows_salted_or_broadcast(spark):
    from basewise.llm.common import join_small, stash

    big = spark.createDataFrame([(i, None if i % 3 else "hot", "x") for i in range(300)], "id long, k string, v string")
    small = stash(spark.createDataFrame([("hot", 1), (None, 2), ("other", 3)], "k string, n long"), "small")
    rows = [list(map(tuple, join_small(big, small, ["k"], max_rows=n).select("id", "k", "n").collect())) for n in (10, 1)]
    assert [len(r) for r in rows] == [300, 300]
    key = lambda r: (r[0], str(r[1]), r[2])
    assert sorted(rows[0], key=key) == sorted(rows[1], key=key)


def test_feature_counts_are_those_of_each_text_and_made_in_rows(spark, monkeypatch):
    texts = [f"Wort{chr(97 + k % 7)}{chr(97 + k % 11)}ung abc ab a zzzzzzzz zzzzzzzzz élan élanvital {'x' * 50} Straße don't" for k in range(200)] + ["", "12 34", "漢字漢字漢字"]
    want = Counter({-1: len(texts)})
    for t in texts:
        words = set(re.findall(r"[^\W\d_]{2,40}", t.lower()))
        want.update({zlib.crc32(x.encode()) for w in words for x in (w, *(f"{w[:n]}*" for n in range(4, min(len(w), 8) + 1)))})
    kept = {c for c in want if c >= 0 and c % 3}
    bits = np.zeros(1 << 24, np.uint8)
    for c in kept:
        bits[c >> 8] |= 1 << (c >> 5 & 7)
    held = lambda c: bits[c >> 8] >> (c >> 5 & 7) & 1
    some = Counter({-1: len(texts)})
    for t in texts:
        found = set()
        for w in set(re.findall(r"[^\W\d_]{2,40}", t.lower())):
            for x in (*(f"{w[:n]}*" for n in range(4, min(len(w), 8) + 1)), w):
                if not held(zlib.crc32(x.encode())):
                    break
                found.add(zlib.crc32(x.encode()))
        some.update(found)
    calls, plain = [], zlib.crc32

    class Tasks:
        def __getattr__(self, name):
            return (lambda f, _: Run(f)) if name == "mapInArrow" else lambda *_: self

    class Run:
        def __init__(self, f):
            self.f = f

        def groupBy(self, *_):  # noqa: N802
            return self

        def agg(self, *_):
            return self

    monkeypatch.setattr(zlib, "crc32", lambda x, *a: calls.append(x) or plain(x, *a))
    for slots, expected in ((None, want), (zlib.compress(bits.tobytes()), some)):
        got = Counter()
        for b in toxicity._feature_counts(Tasks(), slots).f(iter([pa.record_batch([pa.array(texts[:150])], ["text"]), pa.record_batch([pa.array(texts[150:])], ["text"])])):
            got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        assert got == expected
    assert len(calls) < 100  # of words with other characters; the rest by numpy
