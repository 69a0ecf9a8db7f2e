"""Documents as blocks of codes: a dictionary of distinct pieces and, for each document, places in it.

A text in pieces (words, or parts that encoders treat on their own) has a row a piece as a
relation, far more rows than there are distinct pieces. A block holds about `size` bytes of
neighbouring texts once: its distinct pieces and the documents as arrays of codes. Tables
over pieces then have a row for each distinct piece of a block, which is aggregated before
it is shuffled, so a piece that is a third of all text is a third of nothing: it is one row
a block. What is learnt of a piece from the corpus comes back the same way, as one array a
block, whose places are the codes.

A block is one row, bounded by `size` or by its longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_weight, let_go, stash

#: A block's id, its documents' ids, flags and offsets into codes, codes, distinct pieces and how often each occurs in flagged documents.
SCHEMA = "block long, ids array<long>, flags array<boolean>, offsets array<int>, codes array<int>, pieces array<string>, counts array<int>"

#: Pieces of each text as one flat array, and the offsets of the texts in it.
Cut = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


def blocks(rows: DataFrame, cut: Cut, size: int, name: str, packed: bool = False) -> DataFrame:
    """Rows of SCHEMA, written and read again, of rows (id, flag, text); null texts have no piece. `packed` codes are bytes for `unpacked`, half as many to move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        base, serial = TaskContext.get().partitionId() << 32, 0
        for b in by_weight(batches, 2, size, 1 << 20):
            pieces, offsets = cut(b.column(2))
            coded = pieces.dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int32)
            flagged = np.repeat(np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool), np.diff(offsets))
            counts = np.bincount(codes[flagged], minlength=len(coded.dictionary)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + serial]), _one(b.column(0)), _one(b.column(1)), _one(pa.array(offsets.astype(np.int32))), pa.array([_packed(codes)]) if packed else _one(pa.array(codes)), _one(coded.dictionary), _one(pa.array(counts))],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )
            serial += 1

    return stash(rows.mapInArrow(run, SCHEMA.replace("codes array<int>", "codes binary") if packed else SCHEMA), name)


def _packed(codes: np.ndarray) -> bytes:
    """Codes as compressed planes of bytes; the upper ones are nearly all zero."""
    return pa.Codec("zstd").compress(codes.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unpacked(packed: pa.Buffer, n: int) -> np.ndarray:
    """The n codes of `packed` bytes."""
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, 4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _one(values: pa.Array) -> pa.ListArray:
    """The values as the list of one row."""
    values = values.cast(pa.string()) if pa.types.is_large_string(values.type) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pieces_of(made: DataFrame) -> DataFrame:
    """(block, code, piece, n): the distinct pieces of each block, n times in flagged documents."""
    return made.select("block", F.posexplode(F.arrays_zip("pieces", "counts")).alias("code", "_p")).select("block", "code", F.col("_p.pieces").alias("piece"), F.col("_p.counts").cast("long").alias("n"))


def attached(made: DataFrame, columns: Sequence[str], values: DataFrame, wanted: Sequence[str], in_task: int = 4) -> DataFrame:
    """The blocks' columns and, for each wanted column of values (piece, ...), an array in the order of the codes; null for pieces that values lacks.

    About in_task blocks meet in a task, however many there are.
    """
    tasks = made.count() // in_task + 1
    own = pieces_of(made).select("block", "code", "piece").join(values.select("piece", *wanted), "piece", "left")
    arrays = own.repartition(tasks, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", *wanted))).alias("_v"))  # bounded by a block
    arrays = arrays.select("block", *[F.col(f"_v.{c}").alias(c) for c in wanted])
    return made.select("block", *columns).repartition(tasks, "block").join(arrays, "block", "left")


def _bytes_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts as large strings without nulls, their bytes, and where each begins and ends in these."""
    wide = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    raw = np.frombuffer(wide.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    return wide, raw, bounds


def words_cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between blanks (space and the controls 9 to 13), A-Z in lower case: the bytes without the blanks, cut where a word begins."""
    _, raw, bounds = _bytes_of(texts)
    own = bounds - bounds[0]
    solid = (raw != 32) & ((raw < 9) | (raw > 13))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = own[:-1][own[:-1] < own[1:]]
    begins[first] = solid[first]
    data = raw[solid]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    cuts = np.append((np.cumsum(solid) - 1)[begins], len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
    return words, np.concatenate([[0], np.cumsum(begins)])[own]


def _blank_ends(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: whether a white-space character ends at each, and whether one begins there."""
    ascii_blank = (raw <= 32) | (raw == 127)
    ends, begins = ascii_blank.copy(), ascii_blank.copy()
    b1, b2 = raw[1:], raw[2:]
    two = (raw[:-1] == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    a, b, c = raw[:-2], raw[1:-1], b2
    three = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    ends[1:] |= two
    begins[:-1] |= two
    ends[2:] |= three
    begins[:-2] |= three
    return ends, begins


def blank_cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before each space or newline that stands between two characters that are no white space: bytes are shared, nothing is copied."""
    wide, raw, bounds = _bytes_of(texts)
    first, size = bounds[0], len(raw)
    if not size:
        return pa.array([], pa.large_string()), np.zeros(len(wide) + 1, np.int64)
    at = np.zeros(size + 1, bool)
    if size > 2:
        ends, begins = _blank_ends(raw)
        at[1:-2] = ((raw[1:-1] == 32) | (raw[1:-1] == 10)) & ~ends[:-2] & ~begins[2:]
    own = bounds - first
    at[own[1:] - 1] = False  # what follows a text's last character is another text
    at[own] = True  # an empty text has no piece
    cuts = np.flatnonzero(at)
    pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts + first), wide.buffers()[2])
    return pieces, np.searchsorted(cuts, own)
