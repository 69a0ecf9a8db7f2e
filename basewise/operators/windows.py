"""K-mer windows of sequences, as rows.

`windows` cuts a sequence into overlapping chunks before it explodes places, because a
substring walks its string from the start; it is built-in expressions throughout.
`window_kmers` computes codes with numpy and is the bulk path. Sequences are cut into slices
that overlap by k - 1 first, so what a task holds doesn't grow with their length, and rows
of a batch are taken together up to as many windows. `kmer_runs` keeps neighbouring windows
that share a minimizer in one row: that is what shuffles move instead of windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, seq
from ..plans.store import stash

CHUNK = 256
#: Windows that are made at once.
SLICE = 1 << 18


def windows(rows: DataFrame, keys: Sequence[str], sequence: str, k: int, upper: bool = False) -> DataFrame:
    """(keys, pos, kmer): every window of `sequence`, kmer null where a base is none of CGAT."""
    s = seq.upper_bases(F.col(sequence)) if upper else F.col(sequence)
    long_enough = rows.where(F.length(sequence) >= k).select(*keys, s.alias("_s"))
    starts = F.sequence(F.lit(0), F.length("_s") - k, F.lit(CHUNK))
    chunks = long_enough.select(*keys, "_s", F.explode(starts).alias("_at")).select(*keys, "_at", F.substring("_s", F.col("_at") + 1, F.lit(CHUNK + k - 1)).alias("_c"))
    places = chunks.select(*keys, "_at", "_c", F.explode(F.sequence(F.lit(0), F.length("_c") - k)).alias("_i"))
    return places.select(*keys, (F.col("_at") + F.col("_i")).cast("long").alias("pos"), seq.canonical(F.substring("_c", F.col("_i") + 1, F.lit(k))).alias("kmer"))


def _bytes_of(sequence: Column) -> Column:
    """A byte for each character: other characters than ASCII are one invalid base each, however many bytes they have."""
    return F.when(F.octet_length(sequence) == F.length(sequence), sequence).otherwise(F.regexp_replace(sequence, "[^\\x00-\\x7F]", "?")).cast("binary")


def slices(rows: DataFrame, keys: Sequence[str], sequence: str, k: int, most: int = SLICE) -> DataFrame:
    """(keys, _at, _s): sequences of k bases and more cut into bytes of at most `most` windows each, neighbours overlapping by k - 1.

    A chromosome so becomes rows that tasks stream; nothing after holds it whole.
    """
    own = rows.where(F.length(sequence) >= k).select(*keys, _bytes_of(F.col(sequence)).alias("_b"))
    starts = own.select(*keys, "_b", F.explode(F.sequence(F.lit(0), F.length("_b") - k, F.lit(most))).alias("_at"))
    return starts.select(*keys, F.col("_at").cast("long").alias("_at"), F.substring("_b", F.col("_at") + 1, F.lit(most + k - 1)).alias("_s"))


def _parts(batches: Iterator[pa.RecordBatch], k: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (keys, _at, _s) of about `most` windows at a time: the rows, their bytes in a row, and for each window its row, its place in the sequence and in the bytes."""
    for b in batches:
        column = b.column(b.num_columns - 1)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + b.num_rows + 1].astype(np.int64)
        upto, lo = np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - (k - 1), 0))]), 0
        while lo < b.num_rows:
            hi = max(int(np.searchsorted(upto, upto[lo] + most, "right")) - 1, lo + 1)
            part, counts = b.slice(lo, hi - lo), np.diff(upto[lo : hi + 1])
            raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[lo] : offsets[hi]] if offsets[hi] else np.empty(0, np.uint8)
            own = np.repeat(np.arange(hi - lo), counts)
            inside = np.arange(len(own)) - np.repeat(upto[lo:hi] - upto[lo], counts)
            yield part, raw, own, inside + part.column(b.num_columns - 2).to_numpy()[own], inside + (offsets[lo:hi] - offsets[lo])[own]
            lo = hi


def _included(raw: np.ndarray, pos: np.ndarray, at: np.ndarray, k: int, upper: bool, step: int, max_dust: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the bytes, and for each window its validity and whether step and dust leave it."""
    code = kernels.base_codes(raw, upper)
    valid = kernels.valid_windows(code, k)[at] if len(at) else np.empty(0, bool)
    keep = np.ones(len(at), bool)
    if step > 1:
        keep &= (pos + k) % step == 0
    if max_dust >= 0:
        keep &= ~valid | (kernels.dust(code, k)[at] <= max_dust)
    return code, valid, keep


def _chosen(raw: np.ndarray, pos: np.ndarray, at: np.ndarray, k: int, upper: bool, step: int, max_dust: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `_included`, with each window's k-mer."""
    code, valid, keep = _included(raw, pos, at, k, upper, step, max_dust)
    return code, kernels.canonical_codes(code, k)[0][at], valid, keep


def kmer_batches(batches: Iterator[pa.RecordBatch], k: int, upper: bool = False, step: int = 1, max_dust: int = -1, invalid: bool = True, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """(keys, pos, kmer) of rows (keys, _at, _s) of at most `most` windows each, as many windows at a time."""
    for part, raw, own, pos, at in _parts(batches, k, most):
        _, kmers, valid, keep = _chosen(raw, pos, at, k, upper, step, max_dust)
        if not invalid:
            keep &= valid
        take = pa.array(own[keep])
        names = part.schema.names[:-2]
        yield pa.RecordBatch.from_arrays([*(part.column(j).take(take) for j in range(len(names))), pa.array(pos[keep]), pa.array(kmers[keep], mask=~valid[keep])], [*names, "pos", "kmer"])


def window_kmers(rows: DataFrame, keys: Sequence[str], sequence: str, k: int, upper: bool = False, step: int = 1, max_dust: int = -1, invalid: bool = True) -> DataFrame:
    """(keys, pos, kmer) by numpy, about SLICE windows at a time.

    step keeps the windows whose last base has a 1-based place divisible by it; max_dust
    of 0 or more drops low-complexity k-mers; without `invalid`, windows without a k-mer go.
    """
    cut = slices(rows, keys, sequence, k)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema[:-2])
    return cut.mapInArrow(lambda batches: kmer_batches(batches, k, upper, step, max_dust, invalid), f"{kinds}, pos long, kmer long")


#: Windows of a run: its bases are those of its first window and at most 31 more, in a long each.
RUN = 32


def run_batches(batches: Iterator[pa.RecordBatch], k: int, upper: bool = False, step: int = 1, max_dust: int = -1, invalid: bool = True, distinct: bool = False, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """(keys, start, n, bucket, first, onward) of rows (keys, _at, _s): see `kmer_runs`."""
    for part, raw, own, pos, at in _parts(batches, k, most):
        code, valid, keep = _included(raw, pos, at, k, upper, step, max_dust)
        if not invalid:
            keep &= valid
        own, pos, at, valid = own[keep], pos[keep], at[keep], valid[keep]
        names = part.schema.names[:-2]
        if len(own):
            least = np.where(valid, kernels.minimizers(code, k)[at], -1)
            fresh = np.append(True, (own[1:] != own[:-1]) | (pos[1:] != pos[:-1] + 1) | (least[1:] != least[:-1]))
            place = np.arange(len(own))
            since = place - np.maximum.accumulate(np.where(fresh, place, 0))
            begins = np.flatnonzero(fresh | valid & (since % RUN == 0))
            n = np.diff(np.append(begins, len(own)))
            four = kernels.fours(np.concatenate([code, np.zeros(RUN, np.uint8)]))
            good = valid[begins]
            first = kernels.straight_codes_at(four, at[begins], k)
            unused = 2 * (RUN - np.minimum(n, RUN))
            onward = kernels.straight_codes_at(four, at[begins] + k, RUN - 1) >> unused << unused
            if distinct:
                order = np.lexsort((onward, first, n, own[begins]))
                by = [x[order] for x in (own[begins], n, first, onward)]
                order = order[np.append(True, np.any([x[1:] != x[:-1] for x in by], axis=0))]
                begins, n, good, first, onward = begins[order], n[order], good[order], first[order], onward[order]
            columns = [pos[begins], n, np.where(good, least[begins], -1), pa.array(first, mask=~good), pa.array(onward, mask=~good)]
        else:
            begins, columns = own, [pos, pos, pos, pos, pos]
        take = pa.array(own[begins])
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(part.column(j).take(take) for j in range(len(names))), *(c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))],
            [*names, "start", "n", "bucket", "first", "onward"],
        )


def kmer_runs(rows: DataFrame, keys: Sequence[str], sequence: str, k: int, upper: bool = False, step: int = 1, max_dust: int = -1, invalid: bool = True, distinct: bool = False) -> DataFrame:
    """(keys, start, n, bucket, first, onward): windows that follow each other and share a minimizer, as one row.

    bucket is the minimizer, which both strands of a k-mer have, so equal k-mers meet by
    bucket; first has the bases of the first window and onward the next 31, two bits each
    (zero beyond the run). A run has up to RUN windows. With `invalid`, windows without a
    k-mer come as runs of any length of bucket -1 without bases. With `distinct`, of a
    row's equal runs those made at once stay as one, so that a repeat is not many rows.
    """
    cut = slices(rows, keys, sequence, k)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema[:-2]]
    return cut.mapInArrow(lambda batches: run_batches(batches, k, upper, step, max_dust, invalid, distinct), ", ".join([*kinds, "start long", "n long", "bucket int", "first long", "onward long"]))


def _swapped(x: Column, bits: int, mask: int) -> Column:
    return F.shiftrightunsigned(x, bits).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), bits))


def reverse_complement_code(code: Column, k: int) -> Column:
    """Of the code of k bases: complemented, the pairs of bits in reverse."""
    x = code.bitwiseXOR(F.lit(0x5555555555555555))
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = _swapped(x, bits, mask)
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def run_windows(runs: DataFrame, keep: Sequence[str], k: int) -> DataFrame:
    """(keep, start, at, kmer): the windows of runs with bases; tasks keep what they hold, since a run is opened where it lies. start only if runs have it.

    The run's bases are complemented once, before it is opened: a window's other strand is
    the complement of the last of its bases, then of the first. k-mers can't be null, so no
    plan evaluates them again to look for nulls.
    """
    kept = [*keep, *(["start"] if "start" in runs.columns else [])]
    whole = runs.where("first is not null and onward is not null")
    both = [reverse_complement_code(F.col("first"), k).alias("_first"), reverse_complement_code(F.col("onward"), RUN - 1).alias("_onward")]
    ready = whole.select(*kept, "n", "first", "onward", *both)  # apart, so that it is not evaluated again for each window
    each = ready.select(*kept, "first", "onward", "_first", "_onward", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("at"))
    shift = lambda way, x, by: F.call_function(way, x, by.cast("int"))
    at, zero, mask = F.col("at"), F.lit(0).cast("long"), F.lit((1 << 2 * k) - 1).cast("long")
    more = F.when(at == 0, zero).otherwise(shift("shiftrightunsigned", F.col("onward"), 2 * (RUN - 1) - 2 * at))
    straight = shift("shiftleft", F.col("first"), 2 * at).bitwiseOR(more).bitwiseAND(mask)
    behind = F.when(at == 0, zero).otherwise(shift("shiftrightunsigned", shift("shiftleft", F.col("_onward"), 64 - 2 * at), 64 - 2 * at))
    mixed = shift("shiftleft", behind, 2 * k - 2 * at).bitwiseOR(shift("shiftrightunsigned", F.col("_first"), 2 * at))
    back = F.when(at <= k, mixed).otherwise(shift("shiftrightunsigned", F.col("_onward"), 2 * at - 2 * k).bitwiseAND(mask))
    return each.select(*kept, "at", F.coalesce(F.greatest(straight, back), zero).alias("kmer"))


def with_bucket(db: DataFrame, k: int, kmer: str = "kmer") -> DataFrame:
    """Adds bucket, the minimizer of each k-mer."""
    at = db.columns.index(kmer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kernels.kmer_minimizers(b.column(at).to_numpy(), k))], [*b.schema.names, "bucket"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in db.schema)
    return db.mapInArrow(run, f"{kinds}, bucket int")


def window_total(length: Column, k: int) -> Column:
    """Windows of a sequence, invalid ones included."""
    return F.greatest(length - (k - 1), F.lit(0)).cast("long")


def kmer_count_batches(batches: Iterator[pa.RecordBatch], k: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """(keys, windows, valid, distinct_kmers, top) of rows (keys, _at, _s): what a slice's windows add up to."""
    for part, raw, own, pos, at in _parts(batches, k, most):
        _, kmers, valid, _ = _chosen(raw, pos, at, k, False, 1, -1)
        rows, of, kmer = part.num_rows, own[valid], kmers[valid]
        order = np.lexsort((kmer, of))
        of, kmer = of[order], kmer[order]
        fresh = np.append(True, (of[1:] != of[:-1]) | (kmer[1:] != kmer[:-1]))[: len(of)]
        has, top = np.bincount(of, minlength=rows), np.zeros(rows, np.int64)
        top[of] = kmer  # the last of a row is its greatest
        counts = [pa.array(x.astype(np.int64)) for x in (np.bincount(own, minlength=rows), has, np.bincount(of[fresh], minlength=rows))]
        yield pa.RecordBatch.from_arrays([*part.columns[:-2], *counts, pa.array(top, mask=has == 0)], [*part.schema.names[:-2], "windows", "valid", "distinct_kmers", "top"])


def sequence_counts(rows: DataFrame, keys: Sequence[str], sequence: str, k: int, most: int = SLICE) -> DataFrame:
    """(keys, windows, valid, distinct_kmers, top) of the sequences of each key, for keys of few windows: a slice counts its own, no window is a row.

    The distinct k-mers of keys with several slices are found by rows, as slices may share them.
    """
    cut = slices(rows, keys, sequence, k, most)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema[:-2])
    each = cut.mapInArrow(lambda batches: kmer_count_batches(batches, k), f"{kinds}, windows long, valid long, distinct_kmers long, top long")
    sums = [F.sum(c).alias(c) for c in ("windows", "valid", "distinct_kmers")]
    counted = stash(each.groupBy(*keys).agg(*sums, F.max("top").alias("top"), F.count("*").alias("_slices")), "counted")
    several = counted.where("_slices > 1").select(*[F.col(c).alias(f"_of_{c}") for c in keys])
    if several.isEmpty():
        return counted.drop("_slices")
    same = lambda of: [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in of]
    found = window_kmers(rows.join(several, same(keys), "left_semi"), keys, sequence, k, invalid=False).groupBy(*keys).agg(F.count_distinct("kmer").alias("_d"))
    found = found.select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_d")
    both = counted.join(found, same(keys), "left")
    return both.select(*keys, "windows", "valid", F.coalesce("_d", "distinct_kmers").alias("distinct_kmers"), "top")


def count_batches(batches: Iterator[pa.RecordBatch], k: int, max_dust: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """(keys, total, dusty) of rows (keys, _at, _s): a slice's valid windows and those of them whose score is over max_dust."""
    for part, raw, own, pos, at in _parts(batches, k, most):
        code, _, valid, _ = _chosen(raw, pos, at, k, True, 1, -1)
        dusty = valid & (kernels.dust(code, k)[at] > max_dust)
        counts = [pa.array(np.bincount(own[x], minlength=part.num_rows).astype(np.int64)) for x in (valid, dusty)]
        yield pa.RecordBatch.from_arrays([*part.columns[:-2], *counts], [*part.schema.names[:-2], "total", "dusty"])


def extraction_counts(rows: DataFrame, keys: Sequence[str], sequence: str, k: int, max_dust: int) -> DataFrame:
    """(keys, total, dusty, included, dust_ratio) of the valid windows. A slice counts its own; windows are no rows."""
    cut = slices(rows, keys, sequence, k)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema[:-2])
    each = cut.mapInArrow(lambda batches: count_batches(batches, k, max_dust), f"{kinds}, total long, dusty long").where("total > 0")
    c = each.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("dusty").alias("dusty"))
    return c.withColumn("included", F.col("total") - F.col("dusty")).withColumn("dust_ratio", F.col("dusty") / F.col("total"))
