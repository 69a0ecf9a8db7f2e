"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are token ids of a tokenizer, the end id of each document included. Documents are
cut into pieces of at most the largest length. Within a block of pieces the pieces are
placed in decreasing order into the open bin that they fit most tightly; a piece that fits
none opens the bin of least cost. The permitted lengths are optimised jointly: an
opening weighs all of them by the cost of a unit that they would hold, given what is left
to place, or by that of the piece at hand alone, or prefers one length; each of these
policies packs the block, each bin is then downsized to the least length that holds its
contents, and the cheapest result is kept.

There are as many blocks as make about `block` pieces each, whatever the partitions; the
pieces are dealt over them by numbers that are written with the lengths, so that a
document with very many rows or pieces is spread and a retried task meets the same block.
Blocks bound a task's memory; at most one unfilled bin for each length is lost at a
block's end.

Defined cases: null and empty documents, and those without an id of the vocabulary, have
no piece and no row; a null id is carried through; repeated rows are packed each; pieces
of equal length are placed in the order of doc_id and start; very long texts have as many
pieces as they need; an empty table gives no row; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import token_files
from .common import let_go, stash, vocabulary


@dataclass(frozen=True)
class Params:
    #: Permitted sequence lengths, and the cost of a sequence of each; attention makes long ones dearer for each unit.
    sizes: tuple[int, ...] = (512, 1024, 2048, 4096)
    costs: tuple[float, ...] = (512 * 1.02, 1024 * 1.01, 2048 * 1.0, 4096 * 1.01)
    block: int = 65_536
    #: A path that every executor can open; None: the public vocabulary `word_bpe_49k.json`.
    tokenizer: str | None = None

    @property
    def tokens(self) -> token_files.Params:
        return token_files.Params(self.tokenizer or vocabulary("word_bpe_49k.json"))


#: Opening policies besides a preferred size.
BY_PIECE, BY_REST = -1, -2


def pack(lengths: Sequence[int], p: Params = Params()) -> tuple[list[int], list[int], list[int], float]:
    """(bin of each length, offset of each in its bin, size of each bin, cost); lengths are from 1 to the largest size."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    policies = [BY_REST, BY_PIECE, *range(len(p.sizes))]
    return min((_pack(lengths, order, policy, p) for policy in policies), key=lambda x: x[3])


def _pack(lengths: Sequence[int], order: list[int], policy: int, p: Params) -> tuple[list[int], list[int], list[int], float]:
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    room: list[int] = []  # of each bin
    opened: list[int] = []
    free: list[list[int]] = [[] for _ in range(p.sizes[-1] + 1)]  # bins by room left
    some = 0  # bit r is set if free[r] has a bin
    rest = sum(lengths)
    for i in order:
        n = lengths[i]
        rest -= n
        if tight := some >> n:
            r = n + (tight & -tight).bit_length() - 1
            k = free[r].pop()
            if not free[r]:
                some &= ~(1 << r)
        else:
            least = bisect_left(p.sizes, n)
            if policy == BY_REST:  # the cheapest for each unit that it would hold of this piece and what follows
                s = min(range(least, len(p.sizes)), key=lambda j: (p.costs[j] / min(p.sizes[j], n + rest), p.sizes[j]))
            elif policy == BY_PIECE:  # the cheapest for each unit of as many such pieces as it holds
                s = min(range(least, len(p.sizes)), key=lambda j: (p.costs[j] / (p.sizes[j] // n * n), p.sizes[j]))
            else:
                s = max(policy, least)
            k, r = len(room), p.sizes[s]
            room.append(r)
            opened.append(r)
        bins[i], offsets[i] = k, opened[k] - r
        room[k] = r - n
        if room[k]:
            free[room[k]].append(k)
            some |= 1 << room[k]
    final = [bisect_left(p.sizes, o - r) for o, r in zip(opened, room, strict=True)]
    return bins, offsets, [p.sizes[s] for s in final], sum(p.costs[s] for s in final)


def pack_documents(docs: DataFrame, length: Column | None = None, p: Params = Params()) -> DataFrame:
    """One row for each piece of each document (doc_id, text): doc_id, start, length, bin, bin_size, offset.

    length: units of a document, by default its token ids and the end id. `start` is the
    piece's place in its document, `offset` its place in the bin; `bin` names bins uniquely.
    """
    if list(p.sizes) != sorted(set(p.sizes)) or len(p.costs) != len(p.sizes):
        raise ValueError("sizes must ascend, with a cost for each")
    most, block = p.sizes[-1], p.block
    if length is None:
        docs = token_files.token_counts(docs, p.tokens, "doc_id")
        length = F.when(F.col("n_tokens") > 0, F.col("n_tokens") + 1)
    d = docs.select("doc_id", length.cast("long").alias("_n")).where("_n > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(most).cast("long"))
    d = d.select("doc_id", F.explode(starts).alias("start"), "_n")
    d = d.select("doc_id", "start", F.least(F.lit(most).cast("long"), F.col("_n") - F.col("start")).alias("length"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    d = stash(d, "pieces")
    blocks = max(1, -(-d.count() // block))
    d = d.select("doc_id", "start", "length", F.pmod("deal", F.lit(blocks)).alias("block")).repartition("block").sortWithinPartitions("block", "doc_id", "start", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[pa.RecordBatch] = []

        def flush(of: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            bins, offsets, sizes, _ = pack(t.column("length").to_pylist(), p)
            named = [f"{of}-{k}" for k in range(len(sizes))]
            cols = [pa.concat_arrays(t.column(c).chunks) for c in ("doc_id", "start", "length")]
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array([named[k] for k in bins]), pa.array([sizes[k] for k in bins], pa.int64()), pa.array(offsets, pa.int64())],
                ["doc_id", "start", "length", "bin", "bin_size", "offset"],
            )

        own = None
        for b in batches:
            block_of = b.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block_of)) + 1).tolist(), b.num_rows]
            for lo, hi in pairwise(edges):
                if lo == hi:
                    continue
                if held and block_of[lo] != own:
                    yield flush(own)
                    held = []
                own = int(block_of[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield flush(own)

    return d.mapInArrow(run, "doc_id long, start long, length long, bin string, bin_size long, offset long")
