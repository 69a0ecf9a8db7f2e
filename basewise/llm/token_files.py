"""Token-id files: documents as ids in shards of Re-Pair grammars.

Texts are encoded where they lie, into 16-bit ids; only these are then dealt by ranges of
(doc_id, hash of the text) and sorted. Each task appends the end id to each document and
packs the documents into shards of about `shard` ids (a document is never split). A shard
is one row of a Parquet table: its place (part, serial, ids of the part before it), the
doc_ids and lengths, and the grammar (repair.py): rules, expansion lengths, rewritten
sequence and marks. `read` gives every document from the files, `Shard` decodes any range
of ids without the rest.

Only counts by part are summed up to place a shard in the whole.

Defined cases: null and empty texts have the end id alone; documents with a null id come
first; rows with equal ids follow each other by a hash of their text, and a very frequent
id is dealt over several tasks by it; very long texts and words are encoded whole, the
latter without being remembered; an empty table has no shard and no row; other columns of
the documents, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_weight, forget, join_small, kept, stash
from .repair import Grammar, Params as GrammarParams, grammar_of

_WHOLE = ("part", "serial", "step", "terminals")
_LONG = ("before", "docs", "tokens")
_PACKED = ("doc_ids", "known", "doc_lengths", "rules", "rule_lengths", "sequence", "marks")
SCHEMA = ", ".join([*(f"{c} int" for c in _WHOLE), *(f"{c} long" for c in _LONG), *(f"{c} binary" for c in _PACKED)])
ARROW = pa.schema([*((c, pa.int32()) for c in _WHOLE), *((c, pa.int64()) for c in _LONG), *((c, pa.binary()) for c in _PACKED)])


@dataclass(frozen=True)
class Params:
    #: A path that every executor can open.
    tokenizer: str
    end: int = 1
    terminals: int = 49_408
    shard: int = 1 << 21
    #: Bytes that each of the two generations of a worker's cache of pieces may take; whole words of other texts have a quarter.
    cache: int = 48_000_000
    #: Longer pieces and words are encoded each time they occur.
    cached_chars: int = 64


#: Texts of these characters only, where Python's letters, digits, blanks and lower case are the library's.
PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]*")


def _splitter() -> re.Pattern:
    """The splitter of the vocabulary file for plain texts in lower case, and single blanks, which part words."""
    plain = [c for c in map(chr, range(0x250)) if PLAIN.fullmatch(c)]
    kind = lambda c: 0 if c.isalpha() else 1 if c.isnumeric() else 3 if c.isspace() else 2
    letters, digits, signs = (re.escape("".join(c for c in plain if kind(c) == k)) for k in range(3))
    # fixed values: the contractions that the vocabulary's splitter keeps whole
    return re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digits}]|[{signs}]+| ")


PIECES = _splitter()


class Cache:
    """str -> bytes in two generations of at most `most` bytes each; what was used lately survives."""

    def __init__(self, most: int, longest: int, learn: Callable[[list[str]], list[bytes]]) -> None:
        self.most, self.longest, self.learn = most, longest, learn
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def values(self, keys: list[str]) -> list[bytes]:
        """Of keys without repetition."""
        found = list(map(self.young.get, keys))
        gaps = [k for k, x in enumerate(found) if x is None]
        for k in gaps:
            found[k] = self.old.get(keys[k])
        unknown = [k for k in gaps if found[k] is None]
        for k, x in zip(unknown, self.learn([keys[k] for k in unknown]), strict=True):
            found[k] = x
        young, longest = self.young, self.longest
        for k in gaps:
            key, value = keys[k], found[k]
            if len(key) <= longest:
                self.held += 200 + 2 * len(key) + len(value)  # with what dicts and objects take
                young[key] = value
                if self.held > self.most:
                    self.old, self.young, self.held = young, {}, 0
                    young = self.young
        return found


class Words:
    """Ids of texts through the tokenizers library, as bytes of 16-bit numbers.

    The normaliser and the splitter of a word-end vocabulary treat words between blanks
    on their own, and within a word the pieces of the splitter. The distinct words of a
    batch are found by Arrow; of plain texts they are cut into pieces, which a cache maps
    to ids. New pieces of letters go to the library many at once, joined by blanks, and
    are told apart by the tokens that end a word. Texts with other characters go there
    word by word.
    """

    def __init__(self, p: Params) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.p = Tokenizer.from_file(p.tokenizer), p
        self.pieces = Cache(p.cache, p.cached_chars, self._learn)
        self.others = Cache(p.cache // 4, p.cached_chars, self._encoded)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, p: Params) -> Words:
        """One for each Python worker, whatever the number of its tasks."""
        return kept(p, lambda: cls(p))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids: list[np.ndarray] = [np.empty(0, np.uint16)] * len(texts)
        for own, flat, sizes, codes, edges in self._coded(texts):
            all_ids, stops = _gathered(flat, sizes, codes)
            places = np.concatenate([[0], stops])[edges].tolist()
            for i, lo, hi in zip(own, places[:-1], places[1:], strict=True):
                ids[i] = all_ids[lo:hi]
        return ids

    def counts(self, texts: list[str]) -> np.ndarray:
        """Numbers of ids of each text."""
        n = np.zeros(len(texts), np.int64)
        for own, _, sizes, codes, edges in self._coded(texts):
            n[own] = np.diff(np.concatenate([[0], np.cumsum(sizes[codes])])[edges])
        return n

    def _coded(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the plain and of the other texts: their places, the ids of their distinct words in a row, the words' sizes, the words of all texts as numbers, and where each text begins among these."""
        plain = [PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        for kind, of_words in ((True, self._of_plain), (False, self._of_others)):
            own = [i for i, x in enumerate(plain) if x == kind]
            if not own:
                continue
            cut = pc.split_pattern(pa.array([(texts[i].lower() if kind else texts[i]).replace("\n", " ") for i in own], pa.large_string()), " ")
            coded = cut.flatten().dictionary_encode()
            flat, sizes = of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            yield own, flat, sizes, coded.indices.to_numpy(), cut.offsets.to_numpy()

    def _of_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each)."""
        coded = pa.array(PIECES.findall(" ".join(words)), pa.large_string()).dictionary_encode()
        pieces, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = self.pieces.values(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 1
        blank = np.array([x == " " for x in pieces], bool)  # no id
        flat, stops = _gathered(np.frombuffer(b"".join(found), np.uint16), sizes, codes)
        edges = np.concatenate([[0], stops[np.flatnonzero(blank[codes])], [len(flat)]])
        return flat, np.diff(edges)

    def _of_others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.others.values(words)
        return np.frombuffer(b"".join(found), np.uint16), np.fromiter(map(len, found), np.int64, len(found)) >> 1

    def _encoded(self, new: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in self.library.encode_batch_fast(new, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> list[bytes]:
        letters, signs, known = [x for x in new if x.isalpha()], [x for x in new if not x.isalpha()], {}
        known.update(zip(signs, self._encoded(signs), strict=True))
        for k in range(0, len(letters), 200):
            part = letters[k : k + 200]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint16)
            stops = (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            known.update((x, raw[lo:hi]) for x, lo, hi in zip(part, [0, *stops[:-1]], stops, strict=True))
        return list(map(known.__getitem__, new))


def _gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of flat that codes name, in a row, and where each ends); run c has sizes[c] items."""
    first, width = np.cumsum(sizes) - sizes, sizes[codes]
    stops = np.cumsum(width)
    at = np.repeat(first[codes] - (stops - width), width)
    at += np.arange(len(at))
    return flat[at], stops


def encoded(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, tie, ids binary) of every row of docs (doc_id, text): its 16-bit ids without the end id; tie orders rows of one id."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(p)
        for b in by_weight(batches, 2, 8_000_000, 5_000):
            ids = pa.array([x.tobytes() for x in words.encode_all(b.column(2).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], ["doc_id", "tie", "ids"])

    return rows.mapInArrow(run, "doc_id long, tie long, ids binary")


def token_counts(docs: DataFrame, p: Params, *keep: str) -> DataFrame:
    """`keep` columns of docs and n_tokens, the number of ids of `text` without an end id."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(p)
        for b in by_weight(batches, len(keep), 8_000_000, 5_000):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(words.counts(b.column(len(keep)).to_pylist()))], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{kinds}, n_tokens long")


def _row(part: int, serial: int, before: int, ids: list, lengths: list, tokens: np.ndarray, p: Params) -> dict:
    g = grammar_of(tokens, GrammarParams(p.terminals))
    return {
        "part": part, "serial": serial, "before": before, "docs": len(ids), "tokens": len(tokens),
        "doc_ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "known": np.array([i is not None for i in ids], np.uint8).tobytes(), "doc_lengths": np.array(lengths, np.int64).tobytes(),
        "rules": g.rules.astype(np.uint16).tobytes(), "rule_lengths": g.lengths.astype(np.uint32).tobytes(), "sequence": g.sequence.astype(np.uint16).tobytes(), "marks": g.marks.tobytes(), "step": g.step, "terminals": g.terminals,
    }


def write(docs: DataFrame, path: str, p: Params) -> None:
    """Writes docs (doc_id, text) to the Parquet table at path, which must be in a folder that all executors share."""
    ordered = stash(encoded(docs, p), "token-ids").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        part, serial, before, end = TaskContext.get().partitionId(), 0, 0, np.array([p.end], np.uint16)
        ids, lengths, held, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_row(part, serial, before, ids, lengths, np.concatenate(held), p)], ARROW)

        for b in by_weight(batches, 1):
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint16)
                ids.append(i)
                lengths.append(len(own) + 1)
                held += [own, end]
                size += len(own) + 1
                if size >= p.shard:
                    yield shard()
                    before, serial = before + size, serial + 1
                    ids, lengths, held, size = [], [], [], 0
        if ids:
            yield shard()

    ordered.mapInArrow(run, SCHEMA).write.parquet(path)


@dataclass(frozen=True)
class Shard:
    doc_ids: list[int | None]
    lengths: np.ndarray
    grammar: Grammar

    @classmethod
    def of(cls, r: dict) -> Shard:
        ids = np.frombuffer(r["doc_ids"], np.int64).tolist()
        known = np.frombuffer(r["known"], np.uint8)
        g = Grammar(r["terminals"], np.frombuffer(r["rules"], np.uint16).reshape(-1, 2).astype(np.int64), np.frombuffer(r["rule_lengths"], np.uint32), np.frombuffer(r["sequence"], np.uint16), np.frombuffer(r["marks"], np.int64), r["step"])
        return cls([i if k else None for i, k in zip(ids, known, strict=True)], np.frombuffer(r["doc_lengths"], np.int64), g)

    def document(self, k: int) -> np.ndarray:
        """ids of the k-th document, by random access."""
        stop = int(self.lengths[: k + 1].sum())
        return self.grammar.ids(stop - int(self.lengths[k]), stop)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files at path."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n"))  # a row for each task that wrote
    first = stash(parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_first")), "token-parts")
    placed = join_small(shards, first, ["part"], "inner").withColumn("first", F.col("_first") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                shard = Shard.of(r)
                stops = np.cumsum(shard.lengths)
                starts = stops - shard.lengths
                crcs = np.empty(len(stops), np.int64)
                lo = 0
                while lo < len(stops):  # documents of about 64k ids at a time
                    hi = max(lo + 1, int(np.searchsorted(stops, starts[lo] + (1 << 16), "right")))
                    ids = shard.grammar.ids(int(starts[lo]), int(stops[hi - 1])).astype("<u4")
                    for d in range(lo, hi):
                        crcs[d] = zlib.crc32(ids[starts[d] - starts[lo] : stops[d] - starts[lo]].data)
                    lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + r["first"], pa.int64()), pa.array(shard.lengths), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
