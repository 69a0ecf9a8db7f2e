"""Byte-level BPE by tree concatenation.

A text longer than `leaf` characters is cut in half, wherever that is; the halves are
encoded independently, and so on down to leaves. At every join a window around the cut is
encoded again and grown until its first token is the left side's token there and its last
token the right side's; then the tokens outside the window stand. Texts longer than `part`
characters are cut into parts of that size first: the parts are rows of their own, which
many tasks encode at once, and a task for each text joins its parts.

Why that is exact. A window only begins and ends where the text allows it: at a blank
between two solid characters, which always begins a pre-token, or inside a run of letters,
of digits, of other signs or of blanks, where the rest of the run is one pre-token whatever
stands before. Within a pre-token a sequence of tokens is its encoding if and only if each
two neighbours are the encoding of their own concatenation. Neighbours inside the window
are, because the window was encoded; neighbours across its ends are, because the outer
token's neighbour is the very token it had in its side's encoding.

For the same reason a very long run of one character is encoded from a shorter one: where
the shorter run has the same token twice in a row, more of it may follow.

A leaf is cut at such blanks into short words. The distinct words of a batch are found by
Arrow, a bounded cache maps them to ids, and numpy gathers these for all words. New words
go to the tokenizers library many at once: one that begins with such a blank may follow
another, and the bytes of the tokens tell where each ends. The special token's string is
its id, as in that library.

Defined cases: null counts as empty and has no token; ids and texts decode to what the
library's decoder gives, invalid bytes to U+FFFD; repeated rows each have a row; an empty
table gives none; null ids are carried through; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_weight, kept
from .token_files import Cache, _gathered

CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: What a text must not hold that is cut at all its blanks and newlines; a zero marks its beginning.
UNEVEN = ("  ", "\n\n", " \n", "\n ", "\0", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
ASCII_UNEVEN = tuple(x for x in UNEVEN if x.isascii())


@dataclass(frozen=True)
class Params:
    #: A path that every executor can open.
    tokenizer: str
    leaf: int = 8192
    window: int = 16
    #: Characters of a text from which its parts are rows of their own.
    part: int = 1 << 16
    #: Characters of a run of one character that is encoded from a shorter one.
    run: int = 16_384
    #: Bytes that each of the two generations of the cache of words may take.
    cache: int = 48_000_000
    #: Longer words are encoded each time they occur.
    cached_chars: int = 48


def _is_even(text: str) -> bool:
    """Whether every blank and newline of the text stands between two solid characters, and nothing else is blank."""
    return bool(text) and not text[0].isspace() and not text[-1].isspace() and not any(x in text for x in (ASCII_UNEVEN if text.isascii() else UNEVEN))


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, p: Params) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.p, self.library = p, Tokenizer.from_file(p.tokenizer)
        with open(p.tokenizer, encoding="utf-8") as f:
            made = json.load(f)
        self.specials = {t["content"]: t["id"] for t in made["added_tokens"] if t["special"]}
        self.library.encode_special_tokens = True  # special strings are cut out before
        byte_of = _byte_of()
        self.bytes = [b""] * (1 + max([*made["model"]["vocab"].values(), *self.specials.values()]))
        for token, i in made["model"]["vocab"].items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.chars = [sum(c & 0xC0 != 0x80 for c in b) for b in self.bytes]  # characters that begin in a token
        self.whole = [not b or b[0] & 0xC0 != 0x80 for b in self.bytes]  # whether a token begins with one
        self.sizes = np.array(list(map(len, self.bytes)))
        self.words = Cache(p.cache, p.cached_chars, self._learn)

    @classmethod
    def of(cls, p: Params) -> Encoder:
        """One for each Python worker, whatever the number of its tasks."""
        return kept(p, lambda: cls(p))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str]) -> list[list[int]]:
        """Ids of each text. The leaves of all texts are encoded together, then each tree is joined."""
        parts = [self.special.split(t) if self.special and any(s in t for s in self.specials) else [t] for t in texts]
        short = [[(x, None) if k % 2 else self._shortened(x) for k, x in enumerate(own)] for own in parts]
        leaves: list[str] = []
        for own in short:
            for k, (part, _) in enumerate(own):
                if k % 2 == 0:
                    leaves += self._leaves(part)
        done = iter(self._encode_leaves(leaves))
        out = []
        for i, own in enumerate(short):
            made = [[self.specials[x]] if k % 2 else self._restored(self._join_tree(x, done), cut, parts[i][k]) for k, (x, cut) in enumerate(own)]
            out.append(made[0] if len(made) == 1 else list(chain.from_iterable(made)))
        return out

    def _shortened(self, text: str) -> tuple[str, list[tuple[int, int, int]] | None]:
        """The text with its very long runs of one character cut, and (place, characters kept, characters cut) of each."""
        half = self.p.run // 2
        if len(text) < self.p.run or not any(text[k : k + half] == text[k] * half for k in range(0, len(text) - half + 1, half)):
            return text, None
        out, cuts, at, size = [], [], 0, 0
        for m in re.finditer(r"(.)\1{%d,}" % (self.p.run - 1), text, re.DOTALL):
            n = m.end() - m.start()
            kept = 4096 + n % 256 if n > 8192 else n  # congruent for tokens of a power of two of characters
            out.append(text[at : m.start() + kept])
            size += m.start() + kept - at
            cuts.append((size - kept, kept, n - kept))
            at = m.end()
        out.append(text[at:])
        return "".join(out), cuts

    def _restored(self, ids: list[int], cuts: list[tuple[int, int, int]] | None, text: str) -> list[int]:
        """ids of the text from those of the shortened one; a run without a token that repeats and divides what was cut is encoded in full."""
        if not cuts:
            return ids
        out, k, chars = [], 0, 0
        for place, kept, gone in cuts:
            middle = place + kept // 2
            while chars < middle:
                out.append(ids[k])
                chars += self.chars[ids[k]]
                k += 1
            t = ids[k - 1]
            if ids[k] != t or not self.whole[t] or not self.chars[t] or gone % self.chars[t] or len(set(self.bytes[t].decode("utf-8", "replace"))) != 1:
                return self._join_tree(text, iter(self._encode_leaves(self._leaves(text))))
            out += [t] * (gone // self.chars[t])
        return out + ids[k:]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def _leaves(self, text: str) -> list[str]:
        if len(text) <= self.p.leaf:
            return [text]
        half = len(text) // 2
        return self._leaves(text[:half]) + self._leaves(text[half:])

    def _join_tree(self, text: str, done: Iterator[list[int]]) -> list[int]:
        if len(text) <= self.p.leaf:
            return next(done)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self._join(left, self._join_tree(left, done), right, self._join_tree(right, done))

    def join_all(self, texts: list[str], ids: list[list[int]]) -> list[int]:
        """Ids of the texts' concatenation from the ids of each, joined pair by pair."""
        cut = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        while len(texts) > 1:
            pairs = [(texts[k], ids[k], texts[k + 1], ids[k + 1]) for k in range(0, len(texts) - 1, 2)]
            joined = [self._join_specials(*x, cut) for x in pairs]
            rest = slice(len(texts) - len(texts) % 2, None)
            texts, ids = [a + b for a, _, b, _ in pairs] + texts[rest], joined + ids[rest]
        return ids[0]

    def _join_specials(self, left: str, lids: list[int], right: str, rids: list[int], cut: re.Pattern | None) -> list[int]:
        """As `_join`, of texts that may hold special strings, one of them across the cut."""
        longest = max(map(len, self.specials), default=0)
        near = left[-longest + 1 :] + right[: longest - 1] if longest > 1 else ""
        if cut is None or not cut.search(near) and not any(i in lids or i in rids for i in self.specials.values()):
            return self._join(left, lids, right, rids)
        return self.encode(left + right)

    def _encode_leaves(self, leaves: list[str]) -> list[list[int]]:
        """Plain encodings; the distinct words of all leaves are looked up at once."""
        even = [_is_even(x) for x in leaves]
        out: list[list[int]] = [[]] * len(leaves)
        for kind in (True, False):
            own = [i for i, x in enumerate(even) if x == kind]
            if not own:
                continue
            if kind:
                cut = pc.split_pattern(pa.array(["\0" + leaves[i].replace("\n", " \n") for i in own], pa.large_string()), " ")
                flat, offsets = cut.flatten(), cut.offsets.to_numpy()
            else:
                words = [CUT.split(leaves[i]) for i in own]
                flat, offsets = pa.array(chain.from_iterable(words), pa.large_string()), np.cumsum([0, *map(len, words)])
            coded = flat.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if kind:  # the blank that began a word, but for the first word of a leaf
                distinct = [x[1:] if x[0] == "\0" else x if x[0] == "\n" else " " + x for x in distinct]
            found, place = self._values(distinct)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            codes = coded.indices.to_numpy() if place is None else place[coded.indices.to_numpy()]
            ids, stops = _gathered(np.frombuffer(b"".join(found), np.int32), sizes, codes)
            edges = np.concatenate([[0], stops])[offsets].tolist()
            for i, lo, hi in zip(own, edges[:-1], edges[1:], strict=True):
                out[i] = ids[lo:hi].tolist()
        return out

    def _values(self, words: list[str]) -> tuple[list[bytes], np.ndarray | None]:
        """Ids of distinct words, and where each word's are if some occur twice: a leaf's first word may be another's later one."""
        at = {w: k for k, w in enumerate(dict.fromkeys(words))}
        if len(at) == len(words):
            return self.words.values(words), None
        return self.words.values(list(at)), np.array([at[w] for w in words])

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of new words as 32-bit numbers. Words that begin with a cut are encoded in a row, others alone."""
        known: dict[str, bytes] = {}
        chained = [w for w in new if len(w) > 1 and w[0] in " \n" and not w[1].isspace() and not w[-1].isspace()]
        for k in range(0, len(chained), 200):
            part = chained[k : k + 200]
            ids = np.array(self._plain("".join(part)), np.int32)
            ends = np.cumsum([len(w.encode()) for w in part])
            stops = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            known.update((w, raw[lo:hi]) for w, lo, hi in zip(part, [0, *stops[:-1]], stops, strict=True))
        alone = [w for w in new if w not in known]
        known.update((w, np.array(e.ids, np.int32).tobytes()) for w, e in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True))
        return list(map(known.__getitem__, new))

    def _plain(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _join(self, left: str, lids: list[int], right: str, rids: list[int]) -> list[int]:
        if not left or not right:
            return lids or rids
        w = self.p.window
        while True:
            a, na = self._before(left, right, lids, w)
            b, nb = self._after(left, right, rids, w)
            mid = self._plain(left[a:] + right[:b])
            first, last = len(lids) - na, nb - 1
            if (a == 0 or mid[0] == lids[first]) and (b == len(right) or mid[-1] == rids[last]):
                return lids[:first] + mid + rids[nb:]
            w *= 2

    def _before(self, left: str, right: str, ids: list[int], w: int) -> tuple[int, int]:
        """(place in left, number of tokens from there) of the nearest possible window start at least w bytes from the end."""
        size = n = chars = 0
        while n < len(ids):
            n += 1
            t = ids[-n]
            size += len(self.bytes[t])
            chars += self.chars[t]
            if size >= w and self.whole[t]:
                at = len(left) - chars
                if at > 0 and may_cut(left[at - 1], left[at], (left[at + 1 : at + 2] or right[:1])):
                    return at, n
        return 0, len(ids)

    def _after(self, left: str, right: str, ids: list[int], w: int) -> tuple[int, int]:
        size = n = at = 0
        while n < len(ids):
            size += len(self.bytes[ids[n]])
            at += self.chars[ids[n]]
            n += 1
            if size >= w and n < len(ids) and self.whole[ids[n]] and at < len(right) and may_cut(right[at - 1], right[at], right[at + 1 : at + 2]):
                return at, n
        return len(right), len(ids)


#: Characters that are blanks to the library's splitter and to Python.
BLANKS = frozenset(" \n\r\t")


def may_cut(before: str, after: str, then: str) -> bool:
    """Whether a window may begin or end between two characters; `then` follows them."""
    if before.isspace():  # not before the last blank of a run, which may begin the next pre-token
        return before in BLANKS and after in BLANKS and then in BLANKS
    if after in " \n":
        return bool(then) and not then.isspace()
    kinds = [0 if c.isspace() else 1 if c.isalpha() else 2 if c.isnumeric() else 3 for c in (before, after)]
    return kinds[0] == kinds[1] != 0 and "'" not in (before, after)


def round_trip(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, ids, decoded) for every row of docs (doc_id, text)."""
    return _encoded(docs, p, "ids array<int>, decoded string", lambda e, ids: (ids, e.decode(ids)), (pa.list_(pa.int32()), pa.string()))


def digests(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs (doc_id, text)."""

    def of(e: Encoder, ids: list[int]) -> tuple:
        if not hasattr(e, "decimal"):
            e.decimal = [str(i) for i in range(len(e.bytes))]
        joined = ",".join(map(e.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()

    return _encoded(docs, p, "n_tokens long, ids_sha256 string, decoded_sha256 string", of, (pa.int64(), pa.string(), pa.string()))


def _encoded(docs: DataFrame, p: Params, schema: str, of, kinds: tuple) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def made(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *names])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(p)
        for b in by_weight(batches, 1):
            yield made(b.column(0), [of(encoder, ids) for ids in encoder.encode_all(b.column(1).to_pylist())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_weight(batches, 1, 1):
            (i,), (text,) = b.column(0).to_pylist(), b.column(1).to_pylist()
            name = hashlib.blake2b(text.encode(), digest_size=16).digest()
            for k in range(0, len(text), p.part):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([name]), pa.array([k], pa.int64()), pa.array([text[k : k + p.part]])], ["doc_id", "name", "place", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(p)
        for b in by_weight(batches, 3, 1):
            ids = encoder.encode(b.column(3)[0].as_py())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([np.array(ids, np.int32).tobytes()])], ["doc_id", "name", "place", "text", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(p)
        rows = (r for b in by_weight(batches, 3, 1) for r in b.to_pylist())
        for (i, _), own in groupby(rows, key=lambda r: (r["doc_id"], r["name"])):
            copies, parts = 0, []
            for r in own:  # copies of a row bring each part again
                if r["place"] == 0:
                    copies += 1
                if not parts or parts[-1][2] != r["place"]:
                    parts.append((r["text"], np.frombuffer(r["ids"], np.int32).tolist(), r["place"]))
            row = of(encoder, encoder.join_all([x[0] for x in parts], [x[1] for x in parts]))
            yield made(pa.array([i] * copies, pa.int64()), [row] * copies)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > p.part
    found = rows.where(~is_long).mapInArrow(short, f"doc_id long, {schema}")
    kind = "doc_id long, name binary, place long, text string"
    parts = rows.where(is_long).mapInArrow(cut, kind).repartition("doc_id", "name", "place").mapInArrow(encode, f"{kind}, ids binary")
    joined = parts.repartition("doc_id", "name").sortWithinPartitions("doc_id", "name", "place").mapInArrow(join, f"doc_id long, {schema}")
    return found.unionByName(joined)
