"""The same codes as `seq`, over whole sequences with numpy; used by Arrow batch operators."""

from __future__ import annotations

import numpy as np

from .seq import BASES, run_weight

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(BASES.encode()):
    _CODE[_b] = _i
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[list(b"acgt")] = list(b"ACGT")


def base_codes(seq: bytes | np.ndarray, upper: bool = False) -> np.ndarray:
    """The code of each base, 4 for other characters."""
    raw = np.frombuffer(seq, np.uint8)
    return _CODE[_UPPER[raw] if upper else raw]


def _wide(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(straight, reverse complement) of every window of k bases, put together from windows of powers of two; short windows are 32 bits."""
    part = codes.astype(np.int32 if k < 16 else np.int64)
    back = part ^ 1
    done, done_back, size, width = part[:0], part[:0], 0, 1
    while True:
        if k & width:
            if size:
                n = len(codes) - size - width + 1
                done, done_back = done[:n] << 2 * width | part[size : size + n], back[size : size + n] << 2 * size | done_back[:n]
            else:
                done, done_back = part, back
            size += width
        if size == k:
            return done, done_back
        n = len(codes) - 2 * width + 1
        part, back = part[:n] << 2 * width | part[width : width + n], back[width : width + n] << 2 * width | back[:n]
        width *= 2


def windows(seq: bytes | np.ndarray, k: int, upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(canonical k-mer, validity) of each window; a window with another character than CGAT is invalid."""
    return canonical_codes(base_codes(seq, upper), k)


def canonical_codes(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As `windows`, of codes."""
    if len(code) < k:
        return np.empty(0, np.int64), np.empty(0, bool)
    return np.maximum(*_wide(np.where(code > 3, 0, code), k)).astype(np.int64, copy=False), valid_windows(code, k)


def valid_windows(code: np.ndarray, k: int) -> np.ndarray:
    """Whether all k bases of each window are of CGAT."""
    bad = np.concatenate([[0], np.cumsum(code > 3, dtype=np.int32)])
    return bad[k:] == bad[:-k]


def fours(code: np.ndarray) -> np.ndarray:
    """The codes of the four bases from each place on, a byte each, for `straight_codes_at`; other characters count as the first base, and so does what is behind the end."""
    x = np.concatenate([np.where(code > 3, 0, code), np.zeros(3, np.uint8)]).astype(np.uint8, copy=False)
    return x[:-3] << 6 | x[1:-2] << 4 | x[2:-1] << 2 | x[3:]


def straight_codes_at(four: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The codes, as they are read, of the windows of k bases that begin at places of what `fours` gave."""
    out = np.zeros(len(at), np.int64)
    for i in range(0, k, 4):
        own = min(4, k - i)
        out = out << 2 * own | four[at + i] >> 2 * (4 - own)
    return out


def dust(code: np.ndarray, k: int) -> np.ndarray:
    """Low-complexity scores of every window of codes, in a fixed number of steps whatever k is.

    For each lag the places that equal the place `lag` before form runs. A window has the
    end of the run that it begins in, the whole runs after it, whose weights are a
    difference of running sums, and the beginning of the run that it ends in.
    """
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    weights = np.array([run_weight(r) for r in range(k + 1)])
    total, place = np.zeros(n, np.int64), np.arange(len(code))
    for lag in (1, 2, 3):
        if k <= lag:
            continue
        same = np.zeros(len(code), bool)
        same[lag:] = code[lag:] == code[:-lag]
        breaks = np.where(same, -1, place)
        upto = place - np.maximum.accumulate(breaks)  # length of the run that ends here
        onward = np.minimum.accumulate(np.where(same, len(code), place)[::-1])[::-1] - place  # length of the run from here
        ended = np.zeros(len(code), np.int64)  # weights of the runs that ended before or at a place
        ended[1:] = np.cumsum(np.where(same[1:], 0, weights[np.minimum(upto[:-1], k)]))
        size = k - lag
        first, last = place[lag : lag + n], place[k - 1 :]
        head = np.minimum(onward[first], size)
        rest = ended[last] - ended[np.minimum(first + head, last)] + weights[np.minimum(upto[last], k)]
        total += weights[head] + np.where(head == size, 0, rest)
    return total


#: An odd number near 2 to the power of 64 divided by the golden ratio: spreads codes over all bits.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def minimizer_size(k: int) -> int:
    return max(1, k // 2)


def _spread(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * _SPREAD
    x ^= x >> np.uint64(29)
    return ((x * _SPREAD) >> np.uint64(33)).astype(np.int32)


def minimizers(code: np.ndarray, k: int) -> np.ndarray:
    """For each window the least spread code of its canonical parts of minimizer_size(k) bases; both strands have the same."""
    m = minimizer_size(k)
    least = _spread(np.maximum(*_wide(np.where(code > 3, 0, code), m)))
    width, wanted = 1, k - m + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(code) - k + 1
    return np.minimum(least[:n], least[wanted - width : wanted - width + n])


def kmer_minimizers(kmers: np.ndarray, k: int) -> np.ndarray:
    """The same for k-mers."""
    m = minimizer_size(k)
    mask = (1 << 2 * m) - 1
    least = np.full(len(kmers), np.iinfo(np.int32).max, np.int32)
    for at in range(k - m + 1):
        part = (kmers >> 2 * (k - m - at)) & mask
        back = np.zeros(len(kmers), np.int64)
        for i in range(m):
            back = back << 2 | ((part >> 2 * i) & 3) ^ 1
        least = np.minimum(least, _spread(np.maximum(part, back)))
    return least
