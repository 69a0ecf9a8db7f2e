"""Re-Pair grammars of id sequences, with random access.

A sequence of ids is rewritten by rules (left, right): symbol `terminals` + r stands for
rule r's pair. Rules are made in rounds. A round takes the frequent pairs, most frequent
first, as long as no symbol is the right half of one and the left half of another: then
no two of their occurrences overlap and all are replaced at once. A pair of equal symbols
is replaced from the left of each run. Rounds end when no pair is frequent enough or the
symbols are used up. Stored with each grammar are every rule's expansion length and, for
every `step`-th symbol of the rewritten sequence, the number of ids before it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


@dataclass(frozen=True)
class Params:
    terminals: int
    #: Symbols fit in 16 bits, which bounds the rules of a shard.
    symbols: int = 65_536
    #: Pairs of one round at most; their halves index a table.
    round: int = 4_096
    least: int = 8
    #: A round takes pairs at least this share as frequent as its most frequent one.
    share: float = 0.05
    step: int = 1024


@dataclass(frozen=True)
class Grammar:
    terminals: int
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray
    marks: np.ndarray
    step: int

    @cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expansions of all symbols in a row, where each begins and its length."""
        n = np.concatenate([np.ones(self.terminals, np.int64), self.lengths.astype(np.int64)])
        begin = np.cumsum(n) - n
        flat = np.empty(int(n.sum()), np.int32)
        flat[: self.terminals] = np.arange(self.terminals)
        at, size = begin.tolist(), n.tolist()
        for r, (a, b) in enumerate(self.rules.tolist(), self.terminals):  # a rule only names earlier ones
            here, there = at[r], at[r] + size[a]
            flat[here:there] = flat[at[a] : at[a] + size[a]]
            flat[there : there + size[b]] = flat[at[b] : at[b] + size[b]]
        return flat, begin.astype(np.int32), n.astype(np.int32)

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        flat, begin, n = self._flat
        width = n[symbols]
        ends = np.cumsum(width, dtype=np.int32)
        places = np.repeat(begin[symbols] - (ends - width), width)
        places += np.arange(len(places), dtype=np.int32)
        return flat[places]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids start:stop, without expanding what lies outside but for a part of a step."""
        if stop <= start:
            return np.empty(0, np.int32)
        lo = (int(np.searchsorted(self.marks, start, "right")) - 1) * self.step
        hi = min(len(self.sequence), int(np.searchsorted(self.marks, stop, "left")) * self.step)
        before = int(self.marks[lo // self.step])
        return self.expanded(self.sequence[lo:hi])[start - before : stop - before]


def grammar_of(ids: np.ndarray, p: Params) -> Grammar:
    if len(ids) and int(ids.max()) >= p.terminals:
        raise ValueError("an id is not a terminal")
    x = ids.astype(np.uint16)
    rules = np.empty((0, 2), np.int64)
    while len(x) > 1 and p.terminals + len(rules) < p.symbols:
        pairs = _frequent(x, p, min(p.round, p.symbols - p.terminals - len(rules)))
        if not len(pairs):
            break
        x = _replaced(x, pairs, p.terminals + len(rules), p.symbols)
        rules = np.concatenate([rules, pairs])
    lengths = _lengths(rules, p.terminals)
    per = np.where(x < p.terminals, 1, lengths[np.maximum(x.astype(np.int64) - p.terminals, 0)] if len(lengths) else 1)
    before = np.concatenate([[0], np.cumsum(per)[:-1]]) if len(x) else np.zeros(1, np.int64)
    return Grammar(p.terminals, rules, lengths, x, before[:: p.step].astype(np.int64), p.step)


def _lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    n = np.ones(len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):  # a rule only names earlier ones
        n[r] = (n[a - terminals] if a >= terminals else 1) + (n[b - terminals] if b >= terminals else 1)
    return n


def _frequent(x: np.ndarray, p: Params, room: int) -> np.ndarray:
    """The pairs of a round, in order of frequency."""
    keys = np.sort((x[:-1].astype(np.uint32) << np.uint32(16)) | x[1:])
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(edge, len(keys)))
    least = max(p.least, int(counts.max() * p.share))
    often = np.flatnonzero(counts >= least)
    often = often[np.argsort(-counts[often], kind="stable")]
    lefts, rights, out = set(), set(), []
    for k in keys[edge[often]].tolist():
        a, b = k >> 16, k & 0xFFFF
        if a in rights or b in lefts or a == b and (a in lefts or b in rights):
            continue
        lefts.add(a)
        rights.add(b)
        out.append((a, b))
        if len(out) == room:
            break
    return np.array(out, np.int64).reshape(-1, 2)


def _replaced(x: np.ndarray, pairs: np.ndarray, first: int, symbols: int) -> np.ndarray:
    # rule of a pair by the ranks of its halves among the round's left and right halves; rank and rule 0 are none
    lefts, i = np.unique(pairs[:, 0], return_inverse=True)
    rights, j = np.unique(pairs[:, 1], return_inverse=True)
    left, right = np.zeros(symbols, np.int32), np.zeros(symbols, np.int32)
    width = len(rights) + 1
    left[lefts], right[rights] = np.arange(1, len(lefts) + 1) * width, np.arange(1, width)
    rule = np.zeros((len(lefts) + 1) * width, np.uint16)
    rule[(i + 1) * width + j + 1] = np.arange(1, len(pairs) + 1)
    at = np.flatnonzero((left > 0)[x[:-1]] & (right > 0)[x[1:]])
    found = rule[left[x[at]] + right[x[at + 1]]]
    at, found = at[found > 0], found[found > 0]
    same = x[at] == x[at + 1]
    if same.any():  # of a run of one symbol, every second place
        run = np.concatenate([[True], (np.diff(at) != 1) | ~same[1:] | ~same[:-1]])
        start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        keep = ~same | ((np.arange(len(at)) - start) % 2 == 0)
        at, found = at[keep], found[keep]
    out = x.copy()
    out[at] = first - 1 + found
    gone = np.ones(len(x), bool)
    gone[at + 1] = False
    return out[gone]
