"""Brown class-based bigrams: words in classes by exchange clustering, and texts scored by them.

The probability of a word after another is the probability of its class after the other's
class times the probability of the word in its class. Classes are chosen to make the
training text likely: in a sweep each word is taken out of its class and put where the
log likelihood of the class bigrams gains most, by the counts of the classes before and
after it (exchange clustering). All words of one part move at once against the counts of
the sweep before, and the parts take turns, so that two words don't chase each other; a
step that lowers the likelihood is undone.

Whatever the corpus, sweeps take bounded work: the `heads`, the most frequent words, move
over their own table of neighbours, a row a word, with all other words as one class of
context. Then every other word, however rare, is put by the same gain where its
occurrences in the whole corpus are likeliest, given the classes of the heads around it.
Counts of words, of neighbours and of class bigrams are taken over all learning documents.

Smoothing: a class bigram is interpolated with the frequency of the class, by a prior of
`kappa` occurrences. The share of words not seen in training that follows a class is that
of words seen once (Good-Turing), by the same prior; an unknown word is one word of a
class of its own, whose successors are those of words seen once. So the probabilities of
all words after any word add up to one. A document begins after an end.

Documents are blocks of codes (blocks.py), so words are rows once a block. Within the
clustering a word is its 64-bit hash: two words that share one share a class, and no
probability is wrong for it.

Defined cases: null and empty texts are one end token; very long texts and words are read
whole; repeated rows count each; of words with equal counts the one with the smaller hash
is more frequent, of equal gains the first class is taken; null ids do not learn; a table
without learning documents knows no word, and all scores are those of one unknown word; an
empty table gives no row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import attached, blocks, pieces_of, unpacked, words_cut
from .common import by_weight, discard, let_go, stash


@dataclass(frozen=True)
class Params:
    #: Classes of words; the end of a document has one more.
    classes: int = 64
    #: Words that take part in the sweeps: bounds what these read and the driver holds.
    heads: int = 16_384
    sweeps: int = 6
    #: Turns of a sweep.
    parts: int = 2
    kappa: float = 20.0
    #: Bytes of text in a block.
    block: int = 16_000_000


@dataclass(frozen=True)
class Clusters:
    """heads: hashes in ascending order; classes of these; counts of class bigrams, the end's class last; the log likelihood after each step."""

    heads: np.ndarray
    classes: np.ndarray
    bigrams: np.ndarray
    likelihood: list[float]


#: Neighbours whose gains are computed at once.
CHUNK = 16_384


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(m: np.ndarray) -> float:
    """What of the training text's log likelihood depends on the classes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def gains(m: np.ndarray, own: np.ndarray, after: tuple, before: tuple, loops: np.ndarray, classes: int) -> np.ndarray:
    """(words, classes): what the likelihood gains when each word, taken out of its class, is put into a class.

    own is the class of each word, or -1 if its occurrences are in no row or column of m;
    after and before are (word, class, n) in order without repetition, the classes of its neighbours other than itself;
    loops counts the word after itself. Classes are the first `classes` rows of m.
    """
    w, k = len(own), m.shape[0]
    s, p = np.zeros((w, k)), np.zeros((w, k))
    s[after[:2]], p[before[:2]] = after[2], before[2]
    out = np.zeros((w, classes))
    rows = np.arange(classes)
    for (i, c, n), counts, other in ((after, m, p), (before, m.T, s)):
        for lo in range(0, len(i), CHUNK):
            wi, ci, ni = i[lo : lo + CHUNK], c[lo : lo + CHUNK], n[lo : lo + CHUNK, None].astype(float)
            base = counts[:classes, ci].T.astype(float)  # cells between each candidate and the neighbour's class
            mine = own[wi]
            same = ci == mine
            base[same] -= other[wi[same]][:, :classes]
            apart = np.flatnonzero(~same & (mine >= 0))
            base[apart, mine[apart]] -= ni[apart, 0]
            change = _xlogx(base + ni) - _xlogx(base)
            change[rows[None, :] == ci[:, None]] = 0.0  # on the diagonal both sides change: below
            starts = np.flatnonzero(np.append(True, wi[1:] != wi[:-1]))
            out[wi[starts]] += np.add.reduceat(change, starts, axis=0)
    has = np.flatnonzero(own >= 0)
    diagonal = np.tile(np.diag(m)[:classes].astype(float), (w, 1))
    diagonal[has, own[has]] -= s[has, own[has]] + p[has, own[has]] + loops[has]
    joined = s[:, :classes] + p[:, :classes] + loops[:, None]
    out += _xlogx(diagonal + joined) - _xlogx(diagonal)
    for sums, n in ((m.sum(1), s.sum(1) + loops), (m.sum(0), p.sum(1) + loops)):
        rest = np.tile(sums[:classes].astype(float), (w, 1))
        rest[has, own[has]] -= n[has]
        out -= _xlogx(rest + n[:, None]) - _xlogx(rest)
    return out


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in words.to_pylist()), np.uint64, len(words)).view(np.int64)


def with_hashes(words: DataFrame) -> DataFrame:
    """Adds hash to words (piece, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_weight(batches, 0, 8_000_000, 1 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_hashes(b.column(0)))], [*b.schema.names, "hash"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(run, f"{kinds}, hash long")


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of numbers under 2 ** 31, in order, and their counts."""
    key, n = np.unique(a.astype(np.int64) << 32 | b, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n


def _flows(row: dict, codes_of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands before and after each step of a block's learning documents: `end`, words by codes_of, `end`."""
    offsets, flags = row["offsets"], row["flags"]
    sizes = np.diff(offsets)
    flat = codes_of[row["codes"]]
    learn = np.repeat(flags, sizes)
    flat, sizes = flat[learn], sizes[flags]
    stops = np.cumsum(sizes)
    return np.insert(flat, stops - sizes, end), np.insert(flat, stops, end)


def _blocks_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    """One block after another: its whole numbers and flags as numpy arrays, other columns and those with nulls as Arrow arrays."""
    for b in batches:
        for i in range(b.num_rows):
            row = {}
            for name in names:
                found = b.column(b.schema.get_field_index(name))[i]
                if name == "codes":
                    row[name] = unpacked(found.as_buffer(), int(row["offsets"][-1]))
                    continue
                values = found.values if found.is_valid else pa.array([], found.type.value_type)  # a block without pieces has no values
                plain = pa.types.is_string(values.type) or pa.types.is_floating(values.type) or values.null_count
                row[name] = values if plain else values.to_numpy(zero_copy_only=False)
            yield row


def _neighbours(made: DataFrame, heads: np.ndarray) -> DataFrame:
    """(w, others, n): for each place w among the heads its successors (2 * place) and predecessors (2 * place + 1) and their counts.

    Places beyond the heads: other words, and the end, which have no row.
    """
    shared = made.sparkSession.sparkContext.broadcast(heads)
    k = len(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for row in _blocks_of(batches, ["flags", "offsets", "codes", "pieces"]):
            x, y, n = _counted(*_flows(row, _places(_hashes(row["pieces"]), shared.value), k + 1))
            near = (x < k) | (y < k)
            yield pa.RecordBatch.from_arrays([pa.array(v[near].astype(np.int32)) for v in (x, y, n)], ["x", "y", "n"])

    pairs = stash(made.mapInArrow(run, "x int, y int, n int").groupBy("x", "y").agg(F.sum("n").alias("n")), "bigrams")
    sides = [pairs.where(F.col(w) < k).select(F.col(w).alias("w"), (F.col(o) * 2 + kind).alias("other"), "n") for w, o, kind in (("x", "y", 0), ("y", "x", 1))]
    lists = sides[0].unionByName(sides[1]).groupBy("w").agg(F.collect_list(F.struct("other", "n")).alias("_l"))  # at most two for each head
    found = stash(lists.select("w", F.col("_l.other").alias("others"), F.col("_l.n").alias("n")), "neighbours")
    discard(pairs)
    return found


def _places(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The place of each hash among the heads, their number for others."""
    at = np.searchsorted(heads, hashes)
    found = at < len(heads)
    found[found] = heads[at[found]] == hashes[found]
    return np.where(found, at, len(heads)).astype(np.int32)


def cluster(made: DataFrame, words: DataFrame, p: Params) -> Clusters:
    """Classes of the heads of words (hash, n) by exchange over the neighbours in blocks."""
    spark, c = made.sparkSession, p.classes
    top = words.groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(p.heads).toArrow()  # p.heads rows
    by_count = top.column("hash").to_numpy()
    order = np.argsort(by_count)
    heads, classes = by_count[order], (np.arange(len(order)) % c)[order]  # frequent words begin apart
    table = _neighbours(made, heads)
    k, likelihoods = len(heads), []
    states = c + 2  # classes, other words, the end

    def step(of: np.ndarray, m: np.ndarray | None, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Without m: sums of class bigrams by the classes `of`. With it: (place, best class) of the heads of a part."""
        shared = spark.sparkContext.broadcast((np.append(of, [c, c + 1]), m))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, m = shared.value
            sums = np.zeros((states, states), np.int64)
            for b in batches:
                if m is not None:
                    b = b.filter(pa.array(b.column(0).to_numpy() % p.parts == part))
                w, others, n = b.column(0).to_numpy().astype(np.int64), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
                own = np.repeat(np.arange(len(w)), np.diff(b.column(1).offsets.to_numpy()))
                other, is_before = others >> 1, (others & 1).astype(bool)
                near, here = of[other], of[w]
                if m is None:
                    outer = is_before & (other >= k)  # of other words and the end only the heads know
                    for i, j, chosen in ((here[own], near, ~is_before), (near, here[own], outer)):
                        sums += np.bincount(i[chosen] * states + j[chosen], n[chosen], states * states).astype(np.int64).reshape(states, states)
                    continue
                loop = other == w[own]
                loops = np.bincount(own[loop & ~is_before], n[loop & ~is_before], len(w))
                sides = [_grouped(own[side], near[side], n[side]) for side in (~is_before & ~loop, is_before & ~loop)]
                found = gains(m, here, *sides, loops, c)
                stay = found[np.arange(len(w)), here]
                best = np.where(found.max(1) > stay + 1e-9, found.argmax(1), here)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(best.astype(np.int64)), pa.array(np.zeros(len(w), np.int64))], ["i", "j", "n"])
            if m is None:
                i, j = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums[i, j])], ["i", "j", "n"])

        rows = table.mapInArrow(run, "i long, j long, n long")
        got = (rows.groupBy("i", "j").agg(F.sum("n").alias("n")) if m is None else rows).toArrow()  # at most states ** 2 rows, or a row a head
        shared.destroy()
        i, j = got.column("i").to_numpy(), got.column("j").to_numpy()
        if m is not None:
            return i, j
        out = np.zeros((states, states))
        out[i, j] = got.column("n").to_numpy()
        return out, out

    m = step(classes, None, 0)[0] if k else np.zeros((states, states))
    best = likelihood(m)
    likelihoods.append(best)
    for sweep in range(p.sweeps if k else 0):
        at_start = best
        for part in range(p.parts):
            i, j = step(classes, m, part)
            moved = classes.copy()
            moved[i] = j
            tried = step(moved, None, 0)[0]
            if likelihood(tried) > best:
                classes, m, best = moved, tried, likelihood(tried)
            likelihoods.append(best)
        if best - at_start < 1e-4 * abs(best):
            break
    discard(table)
    keep = [*range(c), c + 1]
    return Clusters(heads, classes, m[np.ix_(keep, keep)], likelihoods)


def _grouped(i: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple:
    """Sums of n by (i, c), in order."""
    key, at = np.unique(i.astype(np.int64) << 32 | c, return_inverse=True)
    return key >> 32, key & 0xFFFFFFFF, np.bincount(at, n, len(key))


def tail_classes(made: DataFrame, found: Clusters, p: Params) -> DataFrame:
    """(hash, class) of all learnt words beyond the heads: the class of greatest gain, by the classes of the heads and ends beside all their occurrences."""
    shared = made.sparkSession.sparkContext.broadcast(found)
    k, c = len(found.heads), p.classes
    none = c + 1  # a neighbour that is no head tells nothing

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        of = np.append(shared.value.classes, [none, c]).astype(np.int32)
        for row in _blocks_of(batches, ["flags", "offsets", "codes", "pieces"]):
            hashes = _hashes(row["pieces"])
            place = _places(hashes, shared.value.heads)
            x, y = _flows(row, np.arange(len(place), dtype=np.int32), -1)
            if not len(place):
                continue
            at = np.flatnonzero(y >= 0)  # ends are -1
            beside = lambda z: np.where(z >= 0, of[place[z]], c)
            before, after, words = beside(x[at]), beside(y[at + 1]), y[at]
            tail = place[words] == k
            w, pair, n = _counted(words[tail], before[tail] * (c + 2) + after[tail])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[w]), pa.array(pair.astype(np.int32)), pa.array(n.astype(np.int64))], ["hash", "pair", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = shared.value.bigrams
        for b in batches:
            for lo in range(0, b.num_rows, 8192):
                part = b.slice(lo, 8192)
                pairs, n = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                own = np.repeat(np.arange(part.num_rows), np.diff(part.column(1).offsets.to_numpy()))
                sides = []
                for near in (pairs % (c + 2), pairs // (c + 2)):
                    known = near != none
                    sides.append(_grouped(own[known], near[known], n[known]))
                g = gains(m, np.full(part.num_rows, -1), *sides, np.zeros(part.num_rows), c)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(g.argmax(1).astype(np.int32))], ["hash", "class"])

    met = made.mapInArrow(rows, "hash long, pair int, n long").repartition("hash")
    summed = met.groupBy("hash", "pair").agg(F.sum("n").alias("n"))
    lists = summed.groupBy("hash").agg(F.collect_list(F.struct("pair", "n")).alias("_l"))  # at most a row for each two classes
    return lists.select("hash", F.col("_l.pair").alias("pairs"), F.col("_l.n").alias("n")).mapInArrow(choose, "hash long, class int")


@dataclass(frozen=True)
class Model:
    """Words (piece, n, class), what each class has as log10, class bigrams as log10 (the end's class, then that of unknown words, come last)."""

    words: DataFrame
    class_sizes: np.ndarray
    transitions: np.ndarray
    tokens: int
    types: int
    ends: int
    clusters: Clusters


def train(made: DataFrame, p: Params) -> tuple[Model, DataFrame]:
    """The model of the flagged documents of blocks, and the blocks with the class and count of each piece."""
    c = p.classes
    counts = pieces_of(made).where("n > 0").groupBy("piece").agg(F.sum("n").alias("n"))
    words = stash(with_hashes(counts), "words")
    found = cluster(made, words, p)
    shared = made.sparkSession.sparkContext.broadcast(found)

    def of_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(b.column(b.schema.get_field_index("hash")).to_numpy(), shared.value.heads)
            head = at < len(shared.value.heads)
            kind = np.append(shared.value.classes, 0)[at].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kind, mask=~head)], [*b.schema.names, "head"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    headed = words.mapInArrow(of_heads, f"{kinds}, head int")
    classed = headed.join(tail_classes(made, found, p), "hash", "left").select("piece", "n", F.coalesce("head", "class", F.lit(0)).alias("class"))
    classed = stash(classed, "classed")
    discard(words)
    sums = classed.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow()  # a row a class
    of_class = np.zeros(c)
    of_class[sums.column("class").to_numpy()] = sums.column("n").to_numpy()
    ends = made.select(F.explode("flags").alias("f")).where("f").count()
    tokens, types = int(of_class.sum()) + ends, int(sum(sums.column("types").to_pylist())) + (ends > 0)
    valued = stash(attached(made, ["ids", "flags", "offsets", "codes"], classed, ["class", "n"], in_task=1), "classed_blocks")
    transitions = _smoothed(*_class_bigrams(valued, p), p.kappa)
    return Model(classed, np.log10(np.maximum(of_class, 1.0)), transitions, tokens, types, ends, found), valued


def _class_bigrams(valued: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Counts of class bigrams over all learning documents, and three parts of them: of words seen once after others, before others, and after each other."""
    c = p.classes
    states = c + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sums = np.zeros((4, states, states), np.int64)
        for row in _blocks_of(batches, ["flags", "offsets", "codes", "class", "n"]):
            kind, n = (_numbers(row[x]) for x in ("class", "n"))
            x, y = _flows(row, np.arange(len(kind), dtype=np.int32), -1)
            of = np.append(kind, c).astype(np.int32)  # the end's place is the last
            seen = np.append(n == 1, False)
            for which, chosen in enumerate((slice(None), seen[y], seen[x], seen[x] & seen[y])):
                sums[which] += np.bincount(of[x[chosen]] * states + of[y[chosen]], minlength=states * states).reshape(states, states)
        which, i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(i), pa.array(j), pa.array(sums[which, i, j])], ["k", "i", "j", "n"])

    rows = valued.select("flags", "offsets", "codes", "class", "n").mapInArrow(run, "k long, i long, j long, n long")
    got = rows.groupBy("k", "i", "j").agg(F.sum("n").alias("n")).toArrow()  # four rows for each two classes
    out = np.zeros((4, states, states))
    out[tuple(got.column(x).to_numpy() for x in "kij")] = got.column("n").to_numpy()
    return out[0], out[1:]


def _numbers(values: pa.Array | np.ndarray) -> np.ndarray:
    """Whole numbers, 0 for null."""
    return (values.fill_null(0).to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values).astype(np.int64)


def _smoothed(m: np.ndarray, once: np.ndarray, kappa: float) -> np.ndarray:
    """log10 of (states, states): rows are what was before; the last row and column are unknown words, which stand where words seen once do."""
    total, (after, before, both) = m.sum(), once
    frequency = m.sum(0) / max(total, 1.0)
    unknown = (after.sum() + 0.5) / (total + 1.0)
    rows = np.vstack([m, before.sum(0)])
    news = np.append(after.sum(1), both.sum())
    size = rows.sum(1)
    new = (news + kappa * unknown) / (size + kappa)
    known = (rows + kappa * frequency) / (size + kappa)[:, None]
    with np.errstate(divide="ignore"):
        return np.log10(np.hstack([known * (1.0 - new)[:, None], new[:, None]]))


def score(docs: DataFrame, learn: Column, p: Params = Params()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of docs (doc_id, text); the model learns from the rows of `learn`.

    base_score is the log10 probability by single words with half an occurrence added to each.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(learn, F.lit(False)).alias("flag"), "text")
    made = blocks(rows, words_cut, p.block, "lm", packed=True)
    model, valued = train(made, p)
    shared = made.sparkSession.sparkContext.broadcast((model.transitions, model.class_sizes, model.tokens, model.types, model.ends))
    c = p.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        transitions, class_sizes, tokens, types, ends = shared.value
        bottom = np.log10(tokens + 0.5 * (types + 1))
        for row in _blocks_of(batches, ["ids", "offsets", "codes", "class", "n"]):
            n, own = _numbers(row["n"]), _numbers(row["class"])
            kind = np.append(np.where(n > 0, own, c + 1), c).astype(np.int32)  # the end's place is the last
            emission = np.append(np.where(n > 0, np.log10(np.maximum(n, 1)) - class_sizes[own], 0.0), 0.0)
            counts = np.append(n, ends)
            if not ends:  # nothing is known: every token is the one unknown word
                kind[:] = c + 1
            x, y = _flows({**row, "flags": np.ones(len(row["offsets"]) - 1, bool)}, np.arange(len(n), dtype=np.int32), -1)
            starts = np.asarray(row["offsets"])[:-1] + np.arange(len(row["offsets"]) - 1)
            add = lambda v: np.add.reduceat(v, starts)
            first = transitions[kind[x], kind[y]] + emission[y] if ends else np.zeros(len(y))
            sizes = np.diff(np.append(starts, len(y)))
            ids = row["ids"] if isinstance(row["ids"], pa.Array) else pa.array(row["ids"])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(add((counts[y] > 0).astype(np.int64))), pa.array(np.full(len(starts), tokens)), pa.array(add(np.log10(counts[y] + 0.5) - bottom)), pa.array(add(first))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    found = valued.select("ids", "offsets", "codes", "class", "n").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
