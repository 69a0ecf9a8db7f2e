"""Language identification with language-bitmask n-gram filters.

A filter is one array of slots, each a bit mask of languages: bit slices of one Bloom
filter for each language, read together. A look-up ands the slots at `hashes` places and
gives every language that has the n-gram. Over all letter 3- and 4-grams of a text the
hits of each language are counted (popcounts); hits that the fill of a language's slice
explains are taken off: (hits - n f) / (1 - f) with f its false-positive rate. The
language with the highest corrected count decides.

A language's set is its `grams` most frequent n-grams, of those that are not far more
typical of another language, in a bounded sample of about `sample` labelled texts of that
language, the least by a hash of the id; Spark counts them. Texts are looked up whole, in slices that overlap by three characters.

Defined cases: a null text, or one without a letter, is `und` with score 0; a text whose
n-grams no language knows goes to the language with the most labelled texts; ties go to
the language first in alphabetical order; repeated rows each count; without labelled text
all are `und`. At most 64 languages fit one mask; more raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
SLICE = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


@dataclass(frozen=True)
class Params:
    sample: int = 2_000
    grams: int = 6_000
    slots_log2: int = 20
    hashes: int = 3
    least: int = 3
    #: A language has an n-gram if it is at least this share as frequent there as where it is most frequent.
    typical: float = 0.25


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, code) of the letter n-grams of lower-cased texts, group by group.

    Other characters count as a space; an n-gram has at most one, at an end.
    """
    pieces: list[tuple[int, str]] = []
    size = 0
    for k, t in enumerate(texts):
        t = f" {t.lower()} "
        for lo in range(0, len(t), SLICE):
            pieces.append((k, t[lo : lo + SLICE + 3]))
            size += len(pieces[-1][1])
            if size >= SLICE:
                yield _codes(pieces)
                pieces, size = [], 0
    if pieces:
        yield _codes(pieces)


def _codes(pieces: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer("".join(p for _, p in pieces).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(p) for _, p in pieces])
    owner = np.repeat(np.array([k for k, _ in pieces]), lengths)
    place = np.arange(len(c)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.repeat(lengths, lengths) - place  # characters of the piece from here on
    real = letters()[c]
    x = np.where(real, c, 32).astype(np.uint64)
    n = len(c)
    many = np.concatenate([[0], np.cumsum(real)])
    out = []
    for g in (3, 4):
        if n < g:
            continue
        m = n - g + 1
        inner = many[g - 1 : g - 1 + m] - many[1 : 1 + m]  # letters strictly inside
        ends = real[:m].astype(np.int8) + real[g - 1 :]
        ok = np.flatnonzero((inner == g - 2) & (ends > 0) & (place[:m] < SLICE) & (left[:m] >= g))
        code = np.full(len(ok), g, np.uint64)
        for i in range(g):
            code = (code + x[ok + i]) * _P
            code ^= code >> np.uint64(29)
        out.append((owner[ok], code))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate([o for o, _ in out]), np.concatenate([k for _, k in out])


class Filters:
    """The bit-sliced filters of the languages, in alphabetical order."""

    def __init__(self, sets: dict[str, np.ndarray], common: str, p: Params = Params()) -> None:
        self.languages, self.common, self.p = sorted(sets), common, p
        if len(self.languages) > 64:
            raise ValueError("more than 64 languages")
        kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(self.languages) <= bits)
        self.slots = np.zeros(1 << p.slots_log2, kind)
        for b, name in enumerate(self.languages):
            for at in self._places(sets[name]):
                self.slots[at] |= kind(1 << b)
        fill = [np.count_nonzero(self.slots >> kind(b) & kind(1)) / len(self.slots) for b in range(len(self.languages))]
        self.false = np.array(fill) ** p.hashes

    def _places(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        mask = np.uint64((1 << self.p.slots_log2) - 1)
        step = (codes >> np.uint64(40)) | np.uint64(1)
        for i in range(self.p.hashes):
            yield ((codes + np.uint64(i) * step) ^ (codes >> np.uint64(31))) & mask

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """The languages of each n-gram, as bits."""
        out = None
        for at in self._places(codes):
            found = self.slots[at]
            out = found if out is None else out & found
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        some = letters()
        for owner, codes in grams([t or "" for t in texts]):
            masks = self.masks(codes)
            first = int(owner[0]) if len(owner) else 0
            width = int(owner.max()) - first + 1 if len(owner) else 0
            at = owner - first
            total[first : first + width] += np.bincount(at, minlength=width)
            for b in range(len(self.languages)):
                hits[first : first + width, b] += np.bincount(at, weights=(masks >> masks.dtype.type(b)) & masks.dtype.type(1), minlength=width)
        right = np.maximum(0, (hits - total[:, None] * self.false) / (1 - self.false))
        names, scores = [], []
        for t, r in zip(texts, right, strict=True):
            if not self.languages or not t or not any(some[ord(c)] for c in t[:64]) and not any(c.isalpha() for c in t):
                names.append(UNKNOWN)
                scores.append(0.0)
            elif not r.sum():
                names.append(self.common)
                scores.append(1 / len(self.languages))
            else:
                names.append(self.languages[int(r.argmax())])
                scores.append(float(r.max() / r.sum()))
        return names, scores


def learn(docs: DataFrame, p: Params = Params()) -> Filters:
    """Filters from docs (doc_id, text, lang), all with a language."""
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(65).collect()}
    if not sizes:
        return Filters({}, UNKNOWN, p)
    if len(sizes) > 64:
        raise ValueError("more than 64 languages")
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, p.sample / n))])
    sample = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)) < share[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for owner, codes in grams([t or "" for t in b.column(1).to_pylist()]):
                of = number[owner]
                for k, name in enumerate(names):
                    found, n = np.unique(codes[of == k], return_counts=True)
                    into = held.setdefault(name, {})
                    for c, x in zip(found.view(np.int64).tolist(), n.tolist(), strict=True):
                        into[c] = into.get(c, 0) + x
        for name, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(counts), pa.string()), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["lang", "code", "n"])

    counted = sample.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    whole = counted.groupBy("lang").agg(F.sum("n").alias("_all"))
    counted = counted.where(F.col("n") >= p.least).join(F.broadcast(whole), "lang").withColumn("_share", F.col("n") / F.col("_all"))
    counted = counted.withColumn("_most", F.max("_share").over(Window.partitionBy("code"))).where(F.col("_share") >= p.typical * F.col("_most"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = counted.withColumn("_r", rank).where(F.col("_r") <= p.grams).groupBy("lang").agg(F.collect_list("code").alias("codes")).collect()  # 64 x `grams` at most
    sets = {k: np.empty(0, np.uint64) for k in sizes} | {r["lang"]: np.array(r["codes"], np.int64).view(np.uint64) for r in rows}
    return Filters(sets, min(sizes, key=lambda k: (-sizes[k], k)), p)


def identify(docs: DataFrame, learn_from: Column, p: Params = Params()) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs (doc_id, text, lang); learns from the rows with a language for which `learn_from` holds."""
    filters = learn(docs.where(learn_from & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = filters.decide(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
