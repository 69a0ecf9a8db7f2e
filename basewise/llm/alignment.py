"""Alignment of two tokenizers' tokens, of documents as arrays of aligned pieces.

Where tokens of both tokenizers end at one byte, the text is cut into groups; these common
ends are the links between the two vocabularies.

The texts that are aligned so are not whole documents but the pieces between which every
document may be cut: before a space or newline between two solid characters both
tokenizers begin a token whatever stands before (the first begins a pre-token there, and
no piece of the second holds a space or newline after another character), so a document's
tokens, groups and links are those of its pieces in a row.

A block is a row: some neighbouring documents as codes of their distinct pieces, the pieces
as their tokens in the order of the groups, and the pairs of ids that its links hold with
their numbers. Tokens are made where the text lies and are never dealt: what is
shuffled are pairs, a row for each distinct one of a block, so a pair in every line is no
longer than the blocks are many. A pair's count is summed over all blocks, a B token's
highest count found by B id, and both come back to the blocks by a join on the pair. A
document's numbers are then sums, its groups the concatenation, over its pieces' values.

Where one piece's bytes, as a tokenizer gives them back, differ from the piece (U+2581,
which the second takes for a space), its documents have no tokens: none of their pieces
counts.

Defined cases: null and empty texts have no tokens; a very long text without a cut is one
piece; repeated rows count each; ties for the highest count are all best; an empty table
gives no row; null ids are carried through; other columns, whatever their names, are not
read. No token is empty, so a common end is one link.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import _one, _packed, attached, blank_cut, pieces_of, unpacked
from .bpe_tree import _byte_of
from .common import by_weight, kept, let_go, stash

#: Documents as codes of distinct pieces, the pieces' tokens and how many each has, and, as `pieces`, the distinct pairs of linked ids (the first times 2 ** 32 and the second) with their counts.
SCHEMA = "block long, ids array<long>, offsets array<int>, exact array<boolean>, codes binary, tokens binary, sizes array<int>, pieces array<long>, counts array<long>"
#: What follows a token's id: of the first tokenizer within and at the end of a group, then of the second. A token is an id times four and the place of its sign here.
SIGNS = (",", "|", ",", ";")
#: Bytes of text that are cut, and pieces that a task writes out as groups, at once.
CUT, WRITTEN = 4_000_000, 500_000
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@dataclass(frozen=True)
class Params:
    #: Paths that every executor can open: a tokenizers file with a byte-level vocabulary, a sentencepiece model.
    a: str
    b: str
    #: Bytes of text in a block.
    block: int = 32_000_000
    #: Pairs of linked ids that are broadcast; more are joined by shuffle.
    most_pairs: int = 1_000_000


class Pair:
    """Both tokenizers, of pieces that begin with a space or a newline."""

    def __init__(self, p: Params) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(p.a), sentencepiece.SentencePieceProcessor(model_file=p.b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(p.a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte_of = _byte_of()
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token)
        of = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [of(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))

    def a_ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]

    def b_ids(self, pieces: list[str]) -> list[list[int]]:
        """The second tokenizer adds a space: of a piece that begins with one the rest is encoded, before others the space is a token of its own, which goes."""
        spaced = [x[0] == " " for x in pieces]
        ids = self.b.encode([x[1:] if s else x for x, s in zip(pieces, spaced, strict=True)], num_threads=1)
        return [x if s else x[1:] for x, s in zip(ids, spaced, strict=True)]


def aligned(pair: Pair, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all pieces in a row, and how many each has: of each group those of the first tokenizer, then the second's. Inexact pieces have none.

    Ends are counted on from piece to piece, so that tokens of both sides that end together
    are found by one search.
    """
    ids, raw = [pair.a_ids(pieces), pair.b_ids(pieces)], [x.encode() for x in pieces]
    exact = [b"".join(map(pair.a_bytes.__getitem__, x)) == t == b"".join(map(pair.b_bytes.__getitem__, y)) for x, y, t in zip(*ids, raw, strict=True)]
    a, b = (np.fromiter(chain.from_iterable(x for x, ok in zip(side, exact, strict=True) if ok), np.int64) for side in ids)
    a_ends, b_ends = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    at, b_last = np.searchsorted(b_ends, a_ends), np.zeros(len(b), bool)
    a_last = b_ends[at] == a_ends
    b_last[at[a_last]] = True
    made = np.empty(len(a) + len(b), np.int32)
    made[np.arange(len(a)) + _before(b_last)[np.cumsum(a_last) - a_last]] = 4 * a + a_last
    made[np.arange(len(b)) + _before(a_last)[np.cumsum(b_last) - b_last + 1]] = 4 * b + 2 + b_last
    sizes = np.array([(len(x) + len(y)) * ok for x, y, ok in zip(*ids, exact, strict=True)], np.int64)
    return made, sizes


def _before(last: np.ndarray) -> np.ndarray:
    """Of tokens marked as the last of their groups: how many stand before each group, and in all."""
    return np.append(0, np.flatnonzero(last) + 1)


def _within(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring bounds."""
    return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[bounds])


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """The linked ids of each group of the tokens as one number: the last of both sides."""
    sign, ids = tokens & 3, tokens.astype(np.int64) >> 2
    return ids[sign == 1] << 32 | ids[sign == 3]


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in order, and the sum of the n of each."""
    distinct, at = np.unique(pairs, return_inverse=True)
    return distinct, np.bincount(at, n, len(distinct)).astype(np.int64)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the texts' pieces, the texts' offsets in them, and the distinct pieces. Texts are cut a few at a time: cutting takes many times their bytes."""
    parts, ends = [], [np.zeros(1, np.int64)]
    for b in by_weight(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), 0, CUT):
        pieces, offsets = blank_cut(b.column(0))
        parts.append(pieces.dictionary_encode())
        ends.append(offsets[1:] + ends[-1][-1])
    parts = pa.chunked_array(parts).unify_dictionaries().chunks
    return np.concatenate([x.indices.to_numpy() for x in parts]).astype(np.int32), np.concatenate(ends), parts[-1].dictionary


def block_rows(batches: Iterator[pa.RecordBatch], p: Params, base: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA, numbered from base, of batches (id, text)."""
    pair = kept(p, lambda: Pair(p))
    for serial, b in enumerate(by_weight(batches, 1, p.block, 1 << 20)):
        codes, offsets, distinct = _coded(b.column(1))
        made = [(np.empty(0, np.int32), np.empty(0, np.int64))]  # a few pieces at a time, for their links too
        made += [aligned(pair, x.column(0).to_pylist()) for x in by_weight(iter([pa.RecordBatch.from_arrays([distinct], ["piece"])]), 0, 1_000_000, 10_000)]
        tokens, sizes = (np.concatenate(x) for x in zip(*made, strict=True))
        exact = np.ones(b.num_rows, bool)
        exact[np.searchsorted(offsets, np.flatnonzero((sizes == 0)[codes]), "right") - 1] = False
        often = np.bincount(codes if exact.all() else codes[np.repeat(exact, np.diff(offsets))], minlength=len(sizes))
        each = np.split(often, np.cumsum([len(x) for _, x in made[:-1]]))
        links = [_summed(_pairs(t), np.repeat(n, _within(t & 3 == 3, _bounds(x)))) for (t, x), n in zip(made, each, strict=True)]
        pairs, counts = _summed(*(np.concatenate(x) for x in zip(*links, strict=True)))
        lists = [_one(b.column(0)), _one(pa.array(offsets.astype(np.int32))), _one(pa.array(exact)), pa.array([_packed(codes)]), pa.array([_packed(tokens)]), _one(pa.array(sizes.astype(np.int32))), _one(pa.array(pairs)), _one(pa.array(counts))]
        yield pa.RecordBatch.from_arrays([pa.array([base + serial]), *lists], [x.split()[0] for x in SCHEMA.split(", ")])


def pair_counts(linked: DataFrame) -> DataFrame:
    """(link_a, link_b, count, best) of rows (link_a, link_b, n): how many links hold a pair, and whether no other pair of its B id has more."""
    counts = linked.groupBy("link_a", "link_b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("link_b").agg(F.max("count").alias("_most"))
    return counts.join(most, "link_b").select("link_a", "link_b", "count", (F.col("count") == F.col("_most")).cast("long").alias("best"))


def align(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of docs (doc_id, text); groups is `a1,a2|b1;a3|b2,b3`."""
    text = F.when(F.length("text") > 0, F.concat(F.lit(" "), "text"))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    made = stash(rows.mapInArrow(lambda batches: block_rows(batches, p, TaskContext.get().partitionId() << 32), SCHEMA), "aligned")
    linked = pieces_of(made).select(F.shiftright("piece", 32).alias("link_a"), F.col("piece").bitwiseAND(F.lit(0xFFFFFFFF)).alias("link_b"), "n")
    counts = stash(pair_counts(linked).select(F.shiftleft("link_a", 32).bitwiseOR(F.col("link_b")).alias("piece"), "count", "best"), "pairs")
    small = F.broadcast(counts) if counts.count() <= p.most_pairs else counts
    valued = attached(made, ["ids", "offsets", "exact", "codes", "tokens", "sizes", "pieces"], small, ("best", "count"), in_task=1)
    return valued.mapInArrow(_documents, f"doc_id long, {', '.join(f'{x} long' for x in NUMBERS)}, groups string")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents' numbers and groups, of blocks with the values of their pairs; inexact documents have none."""
    let_go()
    for b in batches:
        for i in range(b.num_rows):
            yield from _of_block({c: x[i] for c, x in zip(b.schema.names, b.columns, strict=True)})


def _of_block(row: dict[str, pa.Scalar]) -> Iterator[pa.RecordBatch]:
    offsets, sizes = (row[x].values.to_numpy() for x in ("offsets", "sizes"))
    exact, bounds = row["exact"].values.to_numpy(zero_copy_only=False), _bounds(sizes)
    codes, tokens = unpacked(row["codes"].as_buffer(), int(offsets[-1])), unpacked(row["tokens"].as_buffer(), int(bounds[-1]))
    sign, at = tokens & 3, np.searchsorted(row["pieces"].values.to_numpy(), _pairs(tokens))
    groups = _within(sign == 3, bounds)
    of_links = [_within(row[x].values.to_numpy()[at], _bounds(groups)) if len(at) else groups for x in ("best", "count")]
    values = [_within(sign < 2, bounds), _within(sign > 1, bounds), groups, groups, *of_links]
    signed = [f"{t >> 2}{SIGNS[t & 3]}" for t in range(int(tokens.max(initial=0)) + 1)]
    lengths = _within(np.array(list(map(len, signed)))[tokens], bounds)
    written = pa.array(signed, pa.large_string()).take(pa.array(tokens))
    pieces = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(_bounds(lengths)), _data(written))
    lo = 0
    while lo < len(exact):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + WRITTEN, "right")) - 1)
        each = np.diff(offsets[lo : hi + 1])
        own, ends = codes[offsets[lo] : offsets[hi]][np.repeat(exact[lo:hi], each)], _bounds(each * exact[lo:hi])
        text = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(_bounds(lengths[own])[ends]), _data(pieces.take(pa.array(own))))
        columns = [row["ids"].values[lo:hi], *(pa.array(_within(v[own], ends)) for v in values), pc.ascii_rtrim(text, ";").cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *NUMBERS, "groups"])
        lo = hi


def _data(texts: pa.Array) -> pa.Buffer:
    """The texts' bytes in a row, of an array that begins at its first."""
    return texts.buffers()[2] or pa.py_buffer(b"")


def digests(docs: DataFrame, p: Params) -> DataFrame:
    """As `align`, with the groups' SHA-256 instead of themselves; '' without tokens."""
    found = align(docs, p)
    return found.select(*found.columns[:-1], F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"))
