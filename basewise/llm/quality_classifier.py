"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass over the texts turns each document into STATISTICS. Class sizes, means and
second moments are sums over all labelled learning rows (no sample), added up by Spark;
only those 2 x (1 + d + d^2) numbers reach the driver. Each class covariance is shrunk
towards the pooled one and towards a multiple of the identity, and its Cholesky factor is
inverted once. A score is the logistic function of the difference of the two Gaussian log
densities (Mahalanobis distances through the cached factors) plus the prior log odds.

Defined cases: a null text counts as empty; an empty text has all shares 0 and is scored
like any other; a document with a null id is scored, never learnt from; repeated ids each
count; very long texts are read whole, of few at a time; an empty table gives no row;
other columns, whatever their names, are not read; if the learning rows hold fewer than two rows of a class, every score is the share
of label 1 among them (0.5 without any).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_weight, let_go, stash, text_key

STATISTICS = ("words", "word_length", "upper", "symbols", "shouts", "bars", "digits", "stops", "distinct", "top_word", "stutter", "dup_lines")


@dataclass(frozen=True)
class Params:
    to_pooled: float = 0.2
    to_identity: float = 0.05
    cut: float = 0.3


def _share(part: float, whole: float) -> float:
    """Variance-stabilised share; ten pseudo-counts keep short texts near 0."""
    return math.asin(math.sqrt(min(1.0, part / (whole + 10.0))))


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    words = text.split()
    n = len(words)
    solid = int(by.sum()) - int(by[[9, 10, 11, 12, 13, 32]].sum())
    letters = int(by[65:91].sum() + by[97:123].sum())
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n),
        math.log1p(solid / n) if n else 0.0,
        _share(int(by[65:91].sum()), letters),
        _share(int(by[[35, 36, 37, 38, 42]].sum()), solid),
        _share(int(by[33]), solid),
        _share(int(by[124]), solid),
        _share(int(by[48:58].sum()), solid),
        _share(int(by[46] + by[44]), solid),
        math.log1p(len(counts)) / math.log1p(n) if n else 1.0,
        _share(max(counts.values(), default=0) - 1, n) if n else 0.0,
        _share(sum(map(eq, words, words[1:])), n),
        _share(len(lines) - len(set(lines)), len(lines)),
    ]


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns and x array<double>, from `text`."""
    kept = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in by_weight(batches, len(keep)):
            x = [statistics(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", x array<double>")


@dataclass(frozen=True)
class Model:
    """means[c], inverse Cholesky factors[c], log determinants and the prior log odds; `flat` scores all alike."""

    means: np.ndarray
    roots: np.ndarray
    offset: float
    flat: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        d = [np.square((x - self.means[c]) @ self.roots[c].T).sum(1) for c in (0, 1)]
        z = 0.5 * (d[0] - d[1]) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: DataFrame, p: Params = Params()) -> Model:
    """Fits to all rows (x, label); label is 0 or 1."""
    d = len(STATISTICS)
    at = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(a) for a in at] + [F.sum(at[i] * at[j]) for i in range(d) for j in range(i, d)]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect()}  # two rows
    n = [found[c]["n"] if c in found else 0 for c in (0, 1)]
    if min(n) < 2:
        flat = n[1] / sum(n) if sum(n) else 0.5
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), 0.0, flat)
    means, spreads = np.zeros((2, d)), np.zeros((2, d, d))
    upper = np.triu_indices(d)
    for c in (0, 1):
        s = np.array(found[c]["s"])
        means[c] = s[:d] / n[c]
        second = np.zeros((d, d))
        second[upper] = s[d:]
        second = second + np.triu(second, 1).T
        spreads[c] = second / n[c] - np.outer(means[c], means[c])
    pooled = (n[0] * spreads[0] + n[1] * spreads[1]) / sum(n)
    scale = np.maximum(np.diag(pooled), 1e-8)
    roots, logs = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        cov = (1 - p.to_pooled) * spreads[c] + p.to_pooled * pooled
        cov = (1 - p.to_identity) * cov + p.to_identity * np.diag(scale)
        low = np.linalg.cholesky(cov)
        roots[c], logs[c] = np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()
    return Model(means, roots, 0.5 * (logs[0] - logs[1]) + math.log(n[1] / n[0]))


def classify(docs: DataFrame, labels: DataFrame, learn: Column, p: Params = Params()) -> DataFrame:
    """(doc_id, copy, score, predicted) for every row of docs (doc_id, text); copy names the text.

    labels: (doc_id, label). Only rows for which `learn`, a condition on doc_id, holds are learnt from.
    """
    rows = docs.select("doc_id", text_key("text").alias("copy"), "text")
    stats = stash(with_statistics(rows, "doc_id", "copy"), "statistics")
    model = fit(stats.where(learn).join(labels, "doc_id"), p)
    cut = p.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2).flatten()).reshape(b.num_rows, -1)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "copy", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, copy binary, score double, predicted int")
