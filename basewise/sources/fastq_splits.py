"""Plain FASTQ files parsed split by split.

Where a split begins inside a file, a line may be anything: a quality line may begin like a
record. So each split is first read as what it does to a parser in any state: at a line end
the parser waits for a record, is in a sequence of so many characters, or lacks so many
characters of quality. A record that begins at some line ends at a line that running sums
of lengths tell, so for every line of the split the state in which a parser that waits
there leaves the split follows by pointer doubling. With a state of missing quality the
parser waits at the line where the sum reaches it: the transition of a split is a step
function of the characters missing, in which lines in a row that lead to one state are one
step. Nearly all lead to the same, so it is small.

The product of these transitions over the splits before it gives each split its state, one
row a split. Then splits are parsed apart, and the two ends of a record that a split
divides are joined by its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.store import stash

#: States of the parser, with a number: of sequence characters read, of quality characters missing.
RECORD, SEQUENCE, QUALITY = 0, 1, 2
TRANSITION = "file string, split long, total long, plus long, before long, sums array<long>, kinds array<int>, numbers array<long>"


class Lines:
    """Lengths and beginnings of the lines of a split; sums[i] are the characters before line i."""

    def __init__(self, values: list[pa.Array]) -> None:
        trimmed = pc.utf8_rtrim(pa.concat_arrays(values), "\r")
        self.sums = np.concatenate([[0], np.cumsum(pc.utf8_length(trimmed).to_numpy(zero_copy_only=False), dtype=np.int64)])
        self.at, self.plus = (np.flatnonzero(pc.starts_with(trimmed, x).to_numpy(zero_copy_only=False)) for x in "@+")
        self.n = len(trimmed)

    def _after(self, place: int) -> tuple[int, int]:
        """(first line with + from a line on, characters up to it), n without one."""
        k = np.searchsorted(self.plus, place)
        return (int(self.plus[k]), int(self.sums[self.plus[k]])) if k < len(self.plus) else (self.n, int(self.sums[-1]))

    def waits(self, kind: int, number: int) -> int:
        """The line at which a parser that enters in a state waits for a record; n + 1 if it doesn't."""
        if kind == RECORD:
            return 0
        need = number
        if kind == SEQUENCE:
            plus, upto = self._after(0)
            if plus == self.n:
                return self.n + 1
            need = number + upto + int(self.sums[plus + 1])
        k = int(np.searchsorted(self.sums, need))  # the first line by whose beginning the sum is reached
        return k if k <= self.n else self.n + 1

    def records(self) -> tuple[np.ndarray, np.ndarray]:
        """For each line and the end, the line from which a waiting parser leaves the split (the end, or that of an unfinished record), and how many records it begins."""
        to = np.minimum(np.arange(self.n + 1) + 1, self.n)
        k = np.searchsorted(self.plus, self.at, "right")
        whole = k < len(self.plus)
        begun, plus = self.at[whole], self.plus[k[whole]]
        done = np.searchsorted(self.sums, self.sums[plus + 1] + self.sums[plus] - self.sums[begun + 1])
        to[self.at[~whole]] = self.at[~whole]
        to[begun] = np.where(done <= self.n, np.maximum(done, plus + 1), begun)
        count = np.zeros(self.n + 1, np.int64)
        count[self.at] = 1
        while True:
            further = to[to]
            if (further == to).all():
                break
            own = to != np.arange(self.n + 1)
            count[own] += np.where(further[own] != to[own], count[to[own]], 0)
            to = further
        last = to != np.arange(self.n + 1)
        count[last] += np.isin(to[last], self.at)
        return to, count

    def state(self, line: int) -> tuple[int, int]:
        """The state at the split's end of a parser that leaves the split from a line (see records)."""
        if line == self.n:
            return RECORD, 0
        plus, upto = self._after(line + 1)
        if plus == self.n:
            return SEQUENCE, int(self.sums[-1] - self.sums[line + 1])
        return QUALITY, int(self.sums[plus + 1] + upto - self.sums[line + 1] - self.sums[-1])


def _splits(batches: Iterator[pa.RecordBatch], more: int = 0) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """((file, split, further columns), lines) of rows (value, file, split, ...), as they follow each other."""
    key, own = None, []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.zeros(b.num_rows, bool)
        codes = [b.column(1).dictionary_encode().indices.to_numpy(), b.column(2).to_numpy()]
        same[1:] = np.all([c[1:] == c[:-1] for c in codes], axis=0)
        starts = [*np.flatnonzero(~same).tolist(), b.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            found = tuple(b.column(j)[lo].as_py() for j in range(1, 3 + more))
            if found != key and own:
                yield key, own
                own = []
            key = found
            own.append(b.column(0).slice(lo, hi - lo))
    if own:
        yield key, own


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in TRANSITION.split(", ")]
    for (file, split), values in _splits(batches):
        x = Lines(values)
        to, _ = x.records()
        begins = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        states = [x.state(int(to[k])) for k in begins]
        plus, before = x._after(0)
        row = [file, split, int(x.sums[-1]), int(x.sums[plus + 1]) if plus < x.n else -1, before, x.sums[np.append(begins[1:] - 1, x.n)].tolist(), [s[0] for s in states], [s[1] for s in states]]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], names)


def _product(rows: pd.DataFrame) -> pd.DataFrame:
    """(file, split, kind, number): the state in which each split of a file begins, from its transitions."""
    rows, kind, number, out = rows.sort_values("split"), RECORD, 0, []
    for r in rows.itertuples():
        out.append((r.file, r.split, kind, number))
        if kind == RECORD:
            kind, number = r.kinds[0], r.numbers[0]
            continue
        if kind == SEQUENCE and r.plus < 0:
            number += r.before
            continue
        need = number if kind == QUALITY else number + r.before + r.plus
        k = int(np.searchsorted(r.sums, need))
        kind, number = (r.kinds[k], r.numbers[k]) if k < len(r.sums) else (QUALITY, need - r.total)
    return pd.DataFrame(out, columns=["file", "split", "kind", "number"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, split, kind, number), values in _splits(batches, 2):
        x = Lines(values)
        line = x.waits(kind, number)
        n = int(x.records()[1][line]) if line <= x.n else 0
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split], pa.int64()), pa.array([n], pa.int64())], ["file", "split", "n"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, read_no, whole, descriptor, seq, qual): records that a split holds whole, and parts of those that it shares with others."""
    rows: list[tuple] = []
    lines = ((key, v) for b in batches for key, v in zip(zip(*(b.column(j).to_pylist() for j in range(1, 6)), strict=True), b.column(0).to_pylist(), strict=True))
    for (file, split, kind, number, first), own in groupby(lines, key=lambda x: x[0]):
        no, have, need, descriptor, seq, qual, inside = first - 1, 0, 0, None, [], [], True
        if kind == SEQUENCE:
            have = number
        elif kind == QUALITY:
            need = number
        for _, v in own:
            line = v.rstrip("\r")
            if kind == RECORD:
                if line.startswith("@"):
                    no, kind, have, descriptor, seq, qual, inside = no + 1, SEQUENCE, 0, line, [], [], False
                continue
            if kind == SEQUENCE:
                if line.startswith("+"):
                    kind, need = QUALITY, have
                else:
                    seq.append(line)
                    have += len(line)
                    continue
            else:
                qual.append(line)
                need -= len(line)
            if need <= 0:
                rows.append((file, split, no, not inside, descriptor, "".join(seq), "".join(qual)))
                kind, descriptor, seq, qual, inside = RECORD, None, [], [], False
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
        if kind != RECORD:
            rows.append((file, split, no, False, descriptor, "".join(seq), "".join(qual)))
    if rows:
        yield _batch(rows)


PARTS = "file string, split long, read_no long, whole boolean, descriptor string, seq string, qual string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PARTS.split(", ")])


def read_splits(spark: SparkSession, paths: list[str], most_splits: int = 1_000_000) -> DataFrame:
    """(file, read_no, descriptor, seq, qual) of plain FASTQ files, by as many tasks as they have splits.

    States and numbers of up to most_splits splits are broadcast, of more joined by shuffle.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    states = lines.mapInArrow(_transitions, TRANSITION).groupBy("file").applyInPandas(_product, "file string, split long, kind int, number long")  # a row a split
    states = stash(states, "splits")
    small = F.broadcast if states.count() <= most_splits else lambda x: x
    ordered = lambda x: lines.join(small(x), ["file", "split"]).select("value", "file", "split", *x.columns[2:])
    counts = stash(ordered(states).mapInArrow(_counts, "file string, split long, n long"), "counts")
    by = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    begins = states.join(counts, ["file", "split"]).select("file", "split", "kind", "number", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("first"))
    parts = ordered(begins).mapInArrow(_parsed, PARTS)
    whole = parts.where("whole").select("file", "read_no", "descriptor", "seq", "qual")
    pieces = F.array_sort(F.collect_list(F.struct("split", "descriptor", "seq", "qual")))  # as many as splits share the record
    shared = parts.where("not whole").groupBy("file", "read_no").agg(pieces.alias("p")).where(F.get("p", F.lit(0))["descriptor"].isNotNull())
    joined = lambda c: F.array_join(F.col(f"p.{c}"), "").alias(c)
    return whole.unionByName(shared.select("file", "read_no", F.get("p", F.lit(0))["descriptor"].alias("descriptor"), joined("seq"), joined("qual")))
