"""Toxicity: a linear classifier learnt from confirmed toxic documents and unlabelled text.

Non-negative positive-unlabelled learning: with class prior pi the risk of calling text
clean is taken from unlabelled text less pi times the confirmed toxic part, and where
that estimate turns negative (over-fitting) its gradient is reversed. Features are the
lower-cased words of the whole text and their beginnings of 4 to 8 letters (insults are
inflected); a feature's value is how far its count, in logarithms, exceeds what the
text's length lets one expect.

Spark counts features over all confirmed and over all documents. The likelihood ratio
decides which are over-represented among the confirmed ones, as it holds for the few
documents of a rare insult too, and the lower bound of their lift, whether that matters;
up to `features` of those with the highest bound are kept. The unlabelled side is every document, confirmed ones among them,
whatever the size. The prior comes from the same counts: a word that only toxic text
uses appears in all text pi times as often. Only the weights are fitted to a bounded
sample: a document's chance to be in it is that of the base rate or of its rarest feature,
of which `carriers` documents are expected, and its weight the inverse of the chance. So
about most_positive + unlabelled + 2 * carriers * features rows at most are expected, as
triples of row, feature and value; one task fits them, which can be run again, and the
driver sees the weights alone. Every document is then scored over its whole text.

Defined cases: null and empty texts have no word and get the score of the bias alone;
a document with a null id is scored, never learnt from; repeated ids each count; without
a confirmed document, or without a telling feature, every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_weight, let_go, stash, text_key
from .token_files import _gathered

WORDS = re.compile(r"[^\W\d_]{2,40}")
#: Letters of a beginning.
_LEAST, _MOST = 4, 8


@dataclass(frozen=True)
class Params:
    most_positive: int = 6_000
    unlabelled: int = 12_000
    features: int = 65_536
    least_support: int = 4
    #: Least signed root of the likelihood ratio.
    least_root: float = 3.5
    #: Least lower bound of the lift's logarithm: with enough documents any difference is significant.
    least_lift: float = 0.2
    carriers: int = 16
    steps: int = 500
    rate: float = 0.1
    #: Divided by the number of confirmed documents.
    ridge: float = 4.0
    cut: float = 0.3


def _codes_of(word: str) -> list[int]:
    """Codes of a word's features, its own the last."""
    return [zlib.crc32((f"{word[:n]}*" if n else word).encode()) for n in (*range(_LEAST, min(len(word), _MOST) + 1), 0)]


class _Codes(dict):
    """word -> columns of its features, of those that `only` maps; forgets all when it has grown large."""

    def __init__(self, only: dict[int, int]) -> None:
        super().__init__()
        self.only, self.most = only, 250_000  # most words have no column

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > self.most:
            self.clear()
        self[word] = found = tuple(self.only[c] for c in _codes_of(word) if c in self.only)
        return found


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


#: The steps of crc32 by byte.
STEPS = _table()


def _many_codes(words: list[str], slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words in a row, number of codes of each), of those that `slots` holds if given.

    A text with a word has its beginnings too, so where `slots` lacks a beginning it lacks the longer ones and the word.
    """
    sizes = np.array(list(map(len, words)), np.int64)
    plain = np.array(list(map(str.isascii, words)), bool)
    codes = np.zeros((len(words), _MOST - _LEAST + 2), np.int64)
    asked = np.zeros(codes.shape, bool)
    own = np.flatnonzero(plain)
    if len(own):
        width = int(sizes[own].max())
        raw = np.array([w for w in words if w.isascii()], f"S{width}").view(np.uint8).reshape(len(own), width)
        state, size = np.full(len(own), 0xFFFFFFFF, np.uint32), sizes[own]
        step = lambda c, x: STEPS[(c ^ x) & 255] ^ c >> 8
        for n in range(width):
            live = np.flatnonzero(size > n)
            state[live] = step(state[live], raw[live, n])
            if _LEAST <= n + 1 <= _MOST:
                codes[own[live], n + 1 - _LEAST] = ~step(state[live], np.uint32(ord("*")))
                asked[own[live], n + 1 - _LEAST] = True
        codes[own, -1] = ~state
        asked[own, -1] = True
    for k in np.flatnonzero(~plain).tolist():
        of = list(_codes_of(words[k]))
        codes[k, : len(of) - 1], codes[k, -1] = of[:-1], of[-1]
        asked[k, : len(of) - 1] = asked[k, -1] = True
    if slots is not None:
        there = (slots[codes >> 8] >> (codes >> 5 & 7) & 1).astype(bool) | ~asked
        asked &= np.logical_and.accumulate(there, 1)
    return codes[asked], asked.sum(1)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class _Documents(dict):
    """word -> number of its list of features, of those that `slots` holds if given; counts the documents with each feature."""

    def __init__(self, slots: bytes | None) -> None:
        super().__init__()
        self.slots, self.most = None if slots is None else np.frombuffer(slots, np.uint8), 50_000 if slots is None else 250_000
        self.new: list[str] = []
        self._forget()
        self._start()

    def _forget(self) -> None:
        self.clear()
        self.flat, self.widths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _start(self) -> None:
        self.codes, self.counts, self.parts, self.waiting, self.documents = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, 0

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k

    def add(self, texts: list[str]) -> None:
        if len(self) > self.most:
            self._forget()
        found = [WORDS.findall(t.lower()) for t in texts]
        sizes = np.array(list(map(len, found)), np.int64)
        k = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        if self.new:
            codes, widths = _many_codes(self.new, self.slots)
            self.flat, self.widths, self.new = np.concatenate([self.flat, codes]), np.concatenate([self.widths, widths]), []
        row = np.repeat(np.arange(len(texts)), sizes)
        there = self.widths[k] > 0
        row, k = np.divmod(_distinct(row[there] * len(self.widths) + k[there]), max(1, len(self.widths)))
        codes, _ = _gathered(self.flat, self.widths, k)
        codes = _distinct(np.repeat(row, self.widths[k]) << 32 | codes) & 0xFFFFFFFF
        self.documents += len(texts)
        self.parts.append(codes)
        self.waiting += len(codes)
        if self.waiting > 2_000_000:
            self._add_up()

    def _add_up(self) -> None:
        codes, n = np.unique(np.concatenate(self.parts), return_counts=True) if self.parts else (self.codes, self.counts)
        if self.parts and len(self.codes):
            both = np.concatenate([self.codes, codes])
            codes, at = np.unique(both, return_inverse=True)
            n = np.bincount(at, np.concatenate([self.counts, n])).astype(np.int64)
        self.codes, self.counts, self.parts, self.waiting = codes, n, [], 0

    def taken(self) -> pa.RecordBatch:
        """(code, n) so far, with the documents as code -1; counting begins anew."""
        self._add_up()
        rows = [pa.array(np.append(x, last)) for x, last in ((self.codes, -1), (self.counts, self.documents))]
        self._start()
        return pa.RecordBatch.from_arrays(rows, ["code", "n"])


def _counted(text: str, codes: _Codes) -> tuple[Counter, int]:
    words = WORDS.findall(text.lower())
    return Counter(chain.from_iterable(map(codes.__getitem__, words))), len(words)


def _slots(found: DataFrame) -> bytes:
    """A bit for every 32 codes, set where one of them is among (code): 16 MB, compressed. At most 2^21 rows of 64 bits are collected, whatever the vocabulary."""
    masks = found.groupBy(F.expr("shiftright(code, 11)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(shiftright(code, 5) & 63 as int)))").alias("mask")).toArrow()
    bits = np.zeros(1 << 21, "<i8")
    bits[masks["at"].to_numpy()] = masks["mask"].to_numpy()
    return zlib.compress(bits.tobytes(), 1)


@dataclass(frozen=True)
class Model:
    """columns: code -> column; rates: occurrences of each column's feature in a word of all text."""

    columns: dict[int, int]
    rates: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, words: np.ndarray, sizes: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of rows with so many words and, row after row, `sizes` columns `at` that occur n times."""
        row = np.repeat(np.arange(len(words)), sizes)
        z = self.bias + np.bincount(row, self.weights[at] * _excess(n, self.rates[at], words[row]), len(words))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _excess(n: np.ndarray, rate: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.log1p(n) - np.log1p(rate * words))


NONE = Model({}, np.zeros(0), np.zeros(0), -40.0, 0.0)


@dataclass(frozen=True)
class Sparse:
    """A matrix as triples of row, column and value; stands for an array in products with vectors."""

    row: np.ndarray
    at: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    @property
    def T(self) -> Sparse:  # noqa: N802
        return Sparse(self.at, self.row, self.values, self.shape[::-1])

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, v[self.at] * self.values, self.shape[0])


def fit_weights(
    xp: np.ndarray | Sparse, xu: np.ndarray | Sparse, prior: float, p: Params = Params(), op: np.ndarray | None = None, ou: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk, as means over the last fifth of the steps, since a step that reverses may be the last; xp, xu: feature values of confirmed and of unlabelled rows; op, ou: for how many documents a row stands."""
    op, ou = (np.ones(x.shape[0]) if o is None else o for x, o in ((xp, op), (xu, ou)))
    confirmed, op, ou = op.sum(), op / op.sum(), ou / ou.sum()
    w, b = np.zeros(xp.shape[1], np.float32), -2.0
    m, v, mean, last = np.zeros(len(w) + 1), np.zeros(len(w) + 1), np.zeros(len(w) + 1), p.steps - max(1, p.steps // 5)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    of = lambda x, g: np.append(x.T @ g.astype(np.float32), g.sum())
    for step in range(1, p.steps + 1):
        sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
        # logistic loss: -log s as toxic, -log(1 - s) as clean
        clean = -(ou @ np.log1p(-su.clip(max=1 - 1e-7))) + prior * (op @ np.log1p(-sp.clip(max=1 - 1e-7)))
        # confirmed rows pull by sp - 1 as toxic, less sp as clean; where the clean part is negative it alone is climbed
        g = of(xu, su * ou) - of(xp, prior * op) if clean >= 0 else of(xp, prior * sp * op) - of(xu, su * ou)
        g[:-1] += p.ridge / confirmed * w * prior
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - change[:-1]).astype(np.float32), float(b - change[-1])
        if step > last:
            mean += np.append(w, b) / (p.steps - last)
    return mean[:-1].astype(np.float32), float(mean[-1])


def _rates(found: DataFrame, features: int) -> np.ndarray:
    """Occurrences of each feature in a word of rows (words, at, n); each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(features + 1)
        for b in batches:
            sums[:-1] += np.bincount(b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy(), features)
            sums[-1] += b.column(0).to_numpy().sum()
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there].astype(np.int64))], ["at", "n"])

    added = found.select("words", "at", "n").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each feature
    sums = np.zeros(features + 1)
    sums[added["at"].to_numpy()] = added["n"].to_numpy()
    return sums[:-1] / max(1.0, sums[-1])


def _fitted(sample: DataFrame, rates: np.ndarray, prior: float, p: Params) -> tuple[np.ndarray, float] | None:
    """Weights and bias of a sample (words, at, n, cp, cu, as_p, as_u), fitted by one task; none without a confirmed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        parts, total = [], 0
        for b in batches:
            x = {c: b.column(c) for c in ("words", "at", "n", "cp", "cu", "as_p", "as_u")}
            sizes, at = np.diff(x["at"].offsets.to_numpy()), x["at"].flatten().to_numpy().astype(np.int32)
            local = np.repeat(np.arange(b.num_rows), sizes)
            values = _excess(x["n"].flatten().to_numpy(), rates[at], x["words"].to_numpy()[local])
            parts.append((local + total, at, values, *(x[c].to_numpy(zero_copy_only=False) for c in ("cp", "cu", "as_p", "as_u"))))
            total += b.num_rows
        if not parts:
            return
        row, at, values, cp, cu, as_p, as_u = map(np.concatenate, zip(*parts, strict=True))
        parts.clear()
        if not as_p.any() or not as_u.any():
            return

        def side(chosen: np.ndarray) -> Sparse:
            ours = chosen[row]
            return Sparse((np.cumsum(chosen) - 1)[row[ours]], at[ours], values[ours], (int(chosen.sum()), len(rates)))

        w, b = fit_weights(side(as_p), side(as_u), prior, p, 1 / cp[as_p], 1 / cu[as_u])
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float32())), pa.array([b])], ["w", "b"])

    made = sample.repartition(1).sortWithinPartitions("doc_id", "copy").mapInArrow(run, "w array<float>, b double").collect()  # a row at most
    return (np.array(made[0]["w"], np.float32), made[0]["b"]) if made else None


def _feature_counts(texts: DataFrame, slots: bytes | None = None) -> DataFrame:
    """(code, n): documents with the feature, and all of them as code -1, of rows (text); added up by task first. Features outside `slots` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counted = _Documents(zlib.decompress(slots) if slots is not None else None)
        for b in by_weight(batches, 0, 1_000_000):
            counted.add(b.column(0).to_pylist())
            if len(counted.codes) > 500_000:  # what a task holds is bounded; Spark adds the parts up
                yield counted.taken()
        yield counted.taken()

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def telling(counts: DataFrame, np_: int, nu: int, p: Params = Params()) -> DataFrame:
    """(code, p, u, z, ratio, lift) of the features whose share among the np_ confirmed documents is significantly, and by more than least_lift, above that among the others of all nu.

    z: signed root of the likelihood ratio; ratio: share of all documents to that of confirmed ones; lift: lower bound of the logarithm of the confirmed share to that of the others.
    """
    at, o, chance = F.col("p"), F.col("u") - F.col("p"), np_ / nu
    both = at * F.log(at / (F.col("u") * chance)) + F.when(o > 0, o * F.log(o / (F.col("u") * (1 - chance)))).otherwise(0.0)
    z = F.sqrt(F.greatest(2 * both, F.lit(0.0))) * F.signum(at - F.col("u") * chance)
    share, oshare = (at + 0.5) / (np_ + 1), (o + 0.5) / (nu - np_ + 1)
    lift = F.log(share / oshare) - 2 * F.sqrt(1 / (at + 0.5) + 1 / (o + 0.5))
    rows = counts.where((F.col("code") >= 0) & (at >= p.least_support))
    return rows.select("code", "p", "u", z.alias("z"), ((F.col("u") + 0.5) / (nu + 1) / share).alias("ratio"), lift.alias("lift")).where((F.col("z") > p.least_root) & (F.col("lift") > p.least_lift))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, p: Params = Params()) -> tuple[Model, DataFrame | None]:
    """The model, and a stashed row (doc_id, copy, words, at, n) of features for each document; no rows if there is nothing to learn from."""
    confirmed = stash(labels.where(learn & (F.col("label") == 1)).select("doc_id", F.lit(True).alias("_positive")), "toxicity-confirmed")
    if confirmed.count() <= 2_000_000:  # ids only; texts are not shuffled for them
        confirmed = F.broadcast(confirmed)
    texts = docs.select("doc_id", text_key("text").alias("copy"), F.coalesce("text", F.lit("")).alias("text"))
    total = lambda counts: sum(r["n"] for r in counts.where("code = -1").collect())  # noqa: E731; one row
    of_p = _feature_counts(texts.join(confirmed, "doc_id").select("text")).where((F.col("n") >= p.least_support) | (F.col("code") < 0))
    of_p = stash(of_p, "toxicity-candidates")
    slots = _slots(of_p.where("code >= 0"))  # vocabulary of the confirmed documents
    of_u = stash(_feature_counts(texts.where("doc_id is not null").select("text"), slots), "toxicity-counts")
    np_, nu = total(of_p), total(of_u)
    counts = of_p.withColumnRenamed("n", "p").join(of_u.withColumnRenamed("n", "u"), "code")
    if not np_ or np_ == nu:
        return NONE, None
    top = telling(counts, np_, nu, p).orderBy(F.desc("lift"), "code").limit(p.features).toPandas()  # bounded by `features`
    if not len(top):
        return NONE, None
    texts = texts.join(confirmed, "doc_id", "left").select("doc_id", "copy", F.coalesce("_positive", F.lit(False)).alias("positive"), "text")
    columns = {int(c): j for j, c in enumerate(top["code"])}
    surest = top.sort_values(["z", "code"], ascending=[False, True])["ratio"].iloc[:30]
    prior = float(np.clip(np.quantile(surest, 0.25), 0.001, 0.5))
    chances = np.minimum(1.0, p.carriers / top[["p", "u"]].to_numpy(np.float64).T)
    base = np.array([min(1.0, p.most_positive / np_), min(1.0, p.unlabelled / nu)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        codes = _Codes(columns)
        for b in by_weight(batches, 3):
            found = [_counted(t, codes) for t in b.column(3).to_pylist()]
            at, n = [list(c.keys()) for c, _ in found], [list(c.values()) for c, _ in found]
            chance = np.array([np.maximum(base, chances[:, a].max(1)) if a else base for a in at]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([k for _, k in found], pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int64())), pa.array(chance[:, 0]), pa.array(chance[:, 1])],
                ["doc_id", "copy", "positive", "words", "at", "n", "cp", "cu"],
            )

    found = stash(texts.mapInArrow(run, "doc_id long, copy binary, positive boolean, words long, at array<long>, n array<long>, cp double, cu double"), "toxicity-features")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    learnt = found.where("doc_id is not null")
    asked = learnt.select("*", (F.col("positive") & (h < F.col("cp"))).alias("as_p"), (h < F.col("cu")).alias("as_u")).where("as_p or as_u")
    rates = _rates(learnt, len(top))
    made = _fitted(asked, rates, prior, p)
    if made is None:
        return NONE, None
    return Model(columns, rates, *made, prior), found.select("doc_id", "copy", "words", "at", "n")


def classify(docs: DataFrame, labels: DataFrame, learn: Column, p: Params = Params()) -> DataFrame:
    """(doc_id, copy, score, predicted) for every row of docs (doc_id, text), copy names the text; labels: (doc_id, label), learnt from where `learn` holds."""
    (model, found), cut = fit(docs, labels, learn, p), p.cut
    if found is None:
        score = 1 / (1 + np.exp(-model.bias))
        return docs.select("doc_id", text_key("text").alias("copy"), F.lit(float(score)).alias("score"), F.lit(int(score >= cut)).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = b.column(3), b.column(4)
            sizes = np.diff(at.offsets.to_numpy())
            s = model.scores(b.column(2).to_numpy(), sizes, at.flatten().to_numpy(), n.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "copy", "score", "predicted"])

    return found.mapInArrow(run, "doc_id long, copy binary, score double, predicted int")
