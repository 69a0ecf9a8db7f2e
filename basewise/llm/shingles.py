"""Word shingles and their MinHash signatures, vectorised for one text at a time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import xxhash

from .common import WORD

WORDS = re.compile(WORD)
GRAM = 5
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Codes(dict):
    """64-bit hash of a word; forgets all when what it holds takes about `most` bytes, and keeps no long word."""

    def __init__(self, most: int = 32_000_000, longest: int = 64) -> None:
        super().__init__()
        self.most, self.longest, self.held = most, longest, 0

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= self.longest:
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[word] = code
            self.held += 200 + len(word)
        return code


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BLANK = re.compile(r"[\x20\x09-\x0D]")


def _slices(text: str, chars: int) -> Iterator[str]:
    """The text in slices of about `chars` characters that end at blanks."""
    lo = 0
    while lo < len(text):
        cut = BLANK.search(text, lo + chars)
        hi = cut.end() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def shingles(text: str | None, codes: Codes, chars: int = 500_000) -> np.ndarray:
    """Sorted distinct hashes of the five-word windows; fewer words form one shingle, none form none.

    A long text is taken in slices, so only its hashes are held, not its words.
    """
    found, tail = np.empty(0, np.uint64), np.empty(0, np.uint64)
    new: list[np.ndarray] = []
    for part in _slices(text or "", chars):
        words = WORDS.findall(part)
        h = np.concatenate([tail, np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))])
        if len(h) >= GRAM:
            new.append(_windows(h, GRAM))
        tail = h[-GRAM + 1 :]
        if sum(map(len, new)) > max(100_000, len(found)):
            found, new = np.unique(np.concatenate([found, *new])), []
    if not len(found) and not new:
        return _windows(tail, len(tail)) if len(tail) else found
    return np.unique(np.concatenate([found, *new])) if new else found


def _windows(h: np.ndarray, g: int) -> np.ndarray:
    n = len(h) - g + 1
    s = np.full(n, g, np.uint64)
    for i in range(g):
        s = s * _P + h[i : i + n]
        s ^= s >> np.uint64(29)
    return _mixed(s)


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits that name the set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class MinHash:
    """`width` 16-bit minima; equal positions estimate the Jaccard similarity."""

    def __init__(self, width: int, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.a = r.integers(1 << 31, size=(width, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = r.integers(1 << 32, size=(width, 1), dtype=np.uint32)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            part = x[None, i : i + 1024] * self.a
            part += self.b
            np.minimum(low, part.min(1), out=low)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
