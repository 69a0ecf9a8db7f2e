"""Class-based bigrams, against plain Python."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewise.llm import class_lm, queries
from basewise.llm.blocks import blocks, words_cut

SCHEMA = "doc_id long, text string, flag boolean, class int, n long, hash long"
SMALL = class_lm.Params(classes=4, heads=12, sweeps=4, kappa=5.0, block=200)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed=0, n=60):
    r = random.Random(seed)
    sides = [[f"{c}{k}" for k in range(9)] for c in "abx"]
    docs = [" ".join(r.choice(sides[(at + r.random().__lt__(0.1)) % 3]) for at in range(r.randint(0, 40))) for _ in range(n)]
    return [(i, t, i % 4 != 1, 1, 2, 3) for i, t in enumerate([*docs, None, "", "RARE a0 Rare\nonce", "unseen words only", "a0 a0 a0"])]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def trained(spark, rows, p=SMALL):
    made = blocks(frame(spark, rows).select(F.col("doc_id"), F.col("flag"), "text"), words_cut, p.block, "test", packed=True)
    return made, class_lm.train(made, p)[0]


def class_counts(rows, classes, c):
    m = np.zeros((c + 1, c + 1))
    for _, t, flag, *_ in rows:
        if flag:
            line = [c, *[classes[w] for w in words(t)], c]
            for a, b in zip(line, line[1:]):
                m[a, b] += 1
    return m


def test_gains_are_differences_of_the_likelihood():
    r = np.random.default_rng(0)
    flow, c = r.integers(0, 9, 4000), 4
    of = r.integers(0, c, 9)
    pairs = collections.Counter(zip(flow.tolist(), flow[1:].tolist()))

    def counts(of):
        m = np.zeros((c, c))
        for (a, b), n in pairs.items():
            m[of[a], of[b]] += n
        return m

    sides = []
    for which in (0, 1):
        found = collections.Counter()
        for pair, n in pairs.items():
            if pair[0] != pair[1]:
                found[pair[which], of[pair[1 - which]]] += n
        keys = sorted(found)
        sides.append((np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([found[k] for k in keys])))
    loops = np.array([pairs[w, w] for w in range(9)])
    got = class_lm.gains(counts(of), of, *sides, loops, c)
    for w in range(9):
        scores = []
        for b in range(c):
            moved = of.copy()
            moved[w] = b
            scores.append(class_lm.likelihood(counts(moved)))
        assert np.allclose(got[w] - got[w, of[w]], np.array(scores) - scores[of[w]])


def test_model_counts_classes_and_sums_to_one(spark):
    rows = corpus()
    _, model = trained(spark, rows)
    seen = collections.Counter(w for _, t, flag, *_ in rows if flag for w in words(t))
    known = {w.piece: w for w in model.words.collect()}
    assert {w: x.n for w, x in known.items()} == seen
    assert model.tokens == sum(seen.values()) + sum(r[2] for r in rows) and model.types == len(seen) + 1
    of = {w: x["class"] for w, x in known.items()}
    sizes = collections.Counter()
    for w, n in seen.items():
        sizes[of[w]] += n
    emission = {w: math.log10(n) - model.class_sizes[of[w]] for w, n in seen.items()}
    for before in range(SMALL.classes + 2):
        row = model.transitions[before]
        total = sum(10 ** (row[of[w]] + emission[w]) for w in seen) + 10 ** row[SMALL.classes] + 10 ** row[SMALL.classes + 1]
        assert math.isclose(total, 1.0, rel_tol=1e-9)
    m, c = class_counts(rows, of, SMALL.classes), SMALL.classes
    once, u = np.zeros((3, c + 1, c + 1)), SMALL.kappa
    for _, t, flag, *_ in rows:
        line = [None, *words(t), None] if flag else []
        for a, b in zip(line, line[1:]):
            i, j = (c if x is None else of[x] for x in (a, b))
            once[:, i, j] += [seen[b] == 1, seen[a] == 1, seen[a] == seen[b] == 1]
    share = (once[0].sum() + 0.5) / (m.sum() + 1)
    for i, line, new in [*((i, m[i], once[0][i].sum()) for i in range(c + 1)), (c + 1, once[1].sum(0), once[2].sum())]:
        unknown = (new + u * share) / (line.sum() + u)
        assert np.allclose(10 ** model.transitions[i, :-1], (1 - unknown) * (line + u * m.sum(0) / m.sum()) / (line.sum() + u)) and np.isclose(10 ** model.transitions[i, -1], unknown)


def test_sweeps_raise_the_likelihood_and_find_the_kinds(spark):
    rows = corpus(n=200)
    _, model = trained(spark, rows, class_lm.Params(classes=3, heads=27, sweeps=8, block=10_000))
    path = model.clusters.likelihood
    assert path == sorted(path) and path[-1] > path[0]
    of = {w.piece: w["class"] for w in model.words.collect()}
    kinds = [collections.Counter(of[f"{c}{k}"] for k in range(9)).most_common(1)[0] for c in "abx"]
    assert len({k for k, _ in kinds}) == 3 and sum(n for _, n in kinds) >= 25


def test_other_words_get_the_class_of_greatest_gain(spark):
    rows = corpus()
    made, model = trained(spark, rows)
    found = model.clusters
    hashed = {w.piece: w.hash for w in class_lm.with_hashes(model.words.select("piece")).collect()}
    head = {w: int(found.classes[np.searchsorted(found.heads, h)]) for w, h in hashed.items() if h in set(found.heads.tolist())}
    assert len(head) == SMALL.heads
    c, m = SMALL.classes, found.bigrams
    for w in model.words.collect():
        if w.piece in head:
            assert w["class"] == head[w.piece]
            continue
        after, before = collections.Counter(), collections.Counter()
        for _, t, flag, *_ in rows:
            line = [None, *words(t), None] if flag else []
            for a, b in zip(line, line[1:]):
                for own, other, side in ((a, b, after), (b, a, before)):
                    if own == w.piece and (other is None or other in head):
                        side[c if other is None else head[other]] += 1
        scores = []
        for k in range(c):
            grown = m.copy()
            for j, n in after.items():
                grown[k, j] += n
            for j, n in before.items():
                grown[j, k] += n
            f = lambda x: x * math.log(max(x, 1.0))
            cells = sum(f(grown[i, j]) - f(m[i, j]) for i in range(c + 1) for j in range(c + 1))
            scores.append(cells - f(m[k].sum() + sum(after.values())) + f(m[k].sum()) - f(m[:, k].sum() + sum(before.values())) + f(m[:, k].sum()))
        assert np.isclose(scores[w["class"]], max(scores))


def plain_base(rows):
    seen = collections.Counter(w for _, t, flag, *_ in rows if flag for w in [*words(t), None])
    n, v = sum(seen.values()), len(seen)
    return {i: (len(words(t)) + 1, sum(seen[w] > 0 for w in [*words(t), None]), n, sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None])) for i, t, *_ in rows}


@pytest.mark.parametrize("block", [1, 200, 1 << 20])
def test_scores_equal_sums_over_tokens(spark, block):
    rows, p = corpus(), class_lm.Params(classes=4, heads=12, sweeps=2, kappa=5.0, block=block)
    _, model = trained(spark, rows, p)
    of = {w.piece: (w["class"], math.log10(w.n) - model.class_sizes[w["class"]]) for w in model.words.collect()}
    base = plain_base(rows)
    for r in class_lm.score(frame(spark, rows), F.col("flag"), p).collect():
        line = [(4, 0.0), *[of.get(w, (5, 0.0)) for w in words(dict((x[0], x[1]) for x in rows)[r.doc_id])], (4, 0.0)]
        want = sum(model.transitions[a[0], b[0]] + b[1] for a, b in zip(line, line[1:]))
        assert (r.n_tokens, r.n_known, r.train_tokens) == base[r.doc_id][:3]
        assert math.isclose(r.base_score, base[r.doc_id][3], rel_tol=1e-9) and math.isclose(r.score, want, rel_tol=1e-9)


def test_edges(spark):
    assert class_lm.score(frame(spark, []), F.col("flag"), SMALL).count() == 0
    none = class_lm.score(frame(spark, [(1, "a b", False, 1, 1, 1), (None, None, None, 1, 1, 1)]), F.col("flag"), SMALL).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in none) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    only_empty = class_lm.score(frame(spark, [(1, None, True, 1, 1, 1), (2, "", True, 1, 1, 1)]), F.col("flag"), SMALL).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in only_empty] == [(1, 1, 2)] * 2
    long = class_lm.score(frame(spark, [(1, "w" * 100_000 + " a" * 50_000, True, 1, 1, 1), (1, "a", True, 1, 1, 1), (1, "a", True, 1, 1, 1)]), F.col("flag"), SMALL).collect()
    assert sorted(r.n_tokens for r in long) == [2, 2, 50_002] and len({r.score for r in long}) == 2


def test_registered_query_beats_single_words_on_held_out_documents(spark, small):
    found = queries.queries()["op12_brown_class_lm"](spark, small).toPandas()
    held = found[found.held_out]
    assert len(found) == 200 and 20 < len(held) < 70
    assert held.score.sum() > held.base_score.sum()
