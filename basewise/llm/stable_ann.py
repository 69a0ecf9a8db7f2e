"""Approximate nearest neighbours by few stable projections and a kd-tree.

Vectors get one more coordinate that makes all norms the largest one, so the largest
inner product is the least Euclidean distance. `projections` Gaussian (2-stable)
projections follow: the squared projected distance over the squared distance is
chi-square distributed. The kd-tree over the projections has two levels. Its top, whose
cuts come from a bounded sample, deals all vectors over regions of about `block` vectors
(`most_regions` at most; a fuller region has several blocks). Every block is a row of the
index: its vectors in the leaf order of a kd-tree of its own, and the leaves' boxes.

A query first searches the region that it lies in: it takes leaves in the order of their
projected distance and verifies their vectors by the exact inner product, until a vector
closer than its k-th best so far would have been seen by now with probability `sure` (the
chi-square test). With the k-th best of that region it then goes to those other regions
alone whose boxes pass the same test, and stops in each by it; the best of all are merged.

Defined cases: null or zero vectors, and those with a null or non-finite component or
another dimension than most, take no part; null ids take none either; of rows that repeat
an id the one with the least vector counts; ties go to the smaller id, and copies of a
query's vector are all verified, since nothing closer ends the search; fewer candidates
than k are all returned; an empty table gives no row; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, stash


@dataclass(frozen=True)
class Params:
    k: int = 20
    projections: int = 6
    sure: float = 0.95
    block: int = 16_384
    #: Bounds what every task knows of the regions: 96 bytes each.
    most_regions: int = 65_536
    #: Vectors whose projections give the cuts of the regions.
    sample: int = 65_536
    query_block: int = 2_048
    leaf: int = 64
    seed: int = 5


def chi_square_at(p: float, m: int) -> float:
    """Quantile of the chi-square distribution with an even number m of degrees of freedom, by bisection of its closed form."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def usable(rows: DataFrame) -> DataFrame:
    """Stashed (vec_id, vector) of the rows that take part, an id once."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), v.alias("vector"))
    most = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    good = stash(good.where(F.size("vector") == (most["d"] if most else 0)), "vectors")
    again = stash(good.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated")
    if again.limit(1).count():
        once = good.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
        good = stash(good.join(again, "vec_id", "left_anti").unionByName(once), "vectors")
    return good


def cuts_of(x: np.ndarray, regions: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value) of each inner node of a complete kd-tree with at least `regions` leaves, as a heap, from projections of a sample."""
    depth = max(0, math.ceil(math.log2(max(1, regions))))
    dims, values = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    todo = [(0, x)]
    while todo:
        node, own = todo.pop()
        if node >= len(dims):
            continue
        if len(own):
            dims[node] = int(np.argmax(np.ptp(own, 0)))
            values[node] = float(np.median(own[:, dims[node]]))
        above = own[:, dims[node]] > values[node] if len(own) else np.zeros(0, bool)
        todo += [(2 * node + 1, own[~above]), (2 * node + 2, own[above])]
    return dims, values


def region_of(x: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Leaf of each row of projections."""
    node = np.zeros(len(x), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > values[node])
    return node - len(dims)


def kd_order(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by leaves, first place of each leaf): halves at the median of the widest dimension."""
    order, bounds = np.arange(len(x)), [0]
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            bounds.append(hi)
            continue
        own = x[order[lo:hi]]
        mid = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(own[:, np.argmax(np.ptp(own, 0))], mid)]
        todo += [(lo + mid, hi), (lo, lo + mid)]
    return order, np.array(bounds[:-1], np.int64)


def _projection(d: int, p: Params) -> np.ndarray:
    return np.random.default_rng(p.seed).standard_normal((d + 1, p.projections))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(region, part, ids, vectors) of rows sorted by region, part and id."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    own = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
        ids, vectors = b.column(2).to_numpy(), _matrix(b.column(3))
        edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
        for lo, hi in pairwise(edges):
            key = tuple(keys[lo].tolist())
            if held and key != own:
                yield *own, *(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            own = key
            held.append((ids[lo:hi], vectors[lo:hi]))
    if held:
        yield *own, *(np.concatenate(x) for x in zip(*held, strict=True))


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """rows (region, vec_id, vector, ...) with `part`: every region is cut into parts of about `size` rows, sorted for `_units`."""
    parts = stash(rows.groupBy("region").agg(F.ceil(F.count("*") / size).cast("int").alias("_parts")), "region-parts")
    rows = join_small(rows, parts, ["region"], "inner").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("int"))
    return rows.select("region", "part", *[c for c in rows.columns if c not in ("region", "part", "_parts")]).repartition("region", "part").sortWithinPartitions("region", "part", "vec_id")


@dataclass(frozen=True)
class Index:
    """blocks: stashed (region, index_part, top, ids, vectors, first, low, high); boxes: (region, low, high) as arrays."""

    blocks: DataFrame
    top: float
    regions: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build_index(vectors: DataFrame, p: Params = Params()) -> Index | None:
    """The index of stashed rows (vec_id, vector); None of an empty table."""
    n = vectors.count()
    if not n:
        return None
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    top = float(vectors.agg(F.max(norm).alias("m")).first()["m"])

    def projected(v: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(0, top * top - np.square(v).sum(1)))
        return np.column_stack([v, more]) @ _projection(v.shape[1], p)

    def xs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = projected(_matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, j]) for j in range(x.shape[1])], [f"x{j}" for j in range(x.shape[1])])

    chosen = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(p.seed)), F.lit(1 << 30)) < int(min(1.0, p.sample / n) * (1 << 30))).select("vector")
    sample = chosen.mapInArrow(xs, ", ".join(f"x{j} double" for j in range(p.projections))).toPandas().to_numpy(np.float64)  # about `sample` rows
    dims, values = cuts_of(sample, min(p.most_regions, -(-n // p.block)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region = region_of(projected(_matrix(b.column(1))), dims, values)
            yield pa.RecordBatch.from_arrays([pa.array(region.astype(np.int32)), *b.columns], ["region", "vec_id", "vector"])

    kind = vectors.schema["vector"].dataType.simpleString()
    rows = _dealt(stash(vectors.mapInArrow(route, f"region int, vec_id long, vector {kind}"), "routed"), p.block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, part, ids, v in _units(batches):
            x = projected(v)
            order, first = kd_order(x, p.leaf)
            x = x[order]
            low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
            made = [[region], [part], *([a.tobytes()] for a in (ids[order], v[order], first, low, high, low.min(0), high.max(0)))]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(made, kinds, strict=True)], ["region", "index_part", "ids", "vectors", "first", "low", "high", "least", "most"])

    blocks = stash(rows.mapInArrow(run, "region int, index_part int, ids binary, vectors binary, first binary, low binary, high binary, least binary, most binary"), "index")
    own: dict[int, list[np.ndarray]] = {}
    for r in blocks.select("region", "least", "most").toLocalIterator():  # a row for each block, merged by region
        least, most = np.frombuffer(r["least"]), np.frombuffer(r["most"])
        box = own.setdefault(r["region"], [least, most])
        box[0], box[1] = np.minimum(box[0], least), np.maximum(box[1], most)
    regions = sorted(own)
    return Index(blocks, top, np.array(regions), np.array([own[r][0] for r in regions]), np.array([own[r][1] for r in regions]))


def _search(queries: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, vectors: np.ndarray, edges: np.ndarray, low: np.ndarray, high: np.ndarray, top: float, limit: float, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of each query's k best in a block; x are the queries' projections, `least` their k-th best scores so far.

    Every query goes through its own order of leaves, in rounds of doubling size; the
    queries that want a leaf in a round meet it in one product. What is selected is
    rounded to a fine grid, so that equal vectors tie whatever their place in a product;
    the scores of the best are then computed pair by pair.
    """
    n, leaves = len(queries), len(edges) - 1
    radius = np.zeros((n, leaves))
    for j in range(x.shape[1]):
        radius += np.square(np.maximum(0, np.maximum(low[:, j] - x[:, j : j + 1], x[:, j : j + 1] - high[:, j])))
    order = np.argsort(radius, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(leaves)[None, :], axis=1)
    best, found = np.full((n, k), -np.inf), np.full((n, k), len(ids))
    by_id = np.argsort(ids, kind="stable")  # places in the order of ids, so that ties go to the smaller one
    number = np.empty(len(ids), np.int64)
    number[by_id] = np.arange(len(ids))
    # |q|^2 with the extra coordinate 0, plus the common squared norm
    both, scale = np.square(queries).sum(1) + top * top, max(top * top, 1e-300)
    grid = 1e-12 * max(scale, float(both.max(initial=0)))
    rows, done, take = np.flatnonzero(radius.min(1) <= _reach(limit, both - 2 * least, scale)), 0, 4
    while done < leaves and len(rows):
        wanted = (rank[rows] >= done) & (rank[rows] < done + take)
        for leaf in np.flatnonzero(wanted.any(0)):
            r, at = rows[wanted[:, leaf]], slice(edges[leaf], edges[leaf + 1])
            s = np.rint(queries[r] @ vectors[at].T / grid)
            s[qids[r][:, None] == ids[at][None, :]] = -np.inf
            up = s.max(1) >= best[r, -1]
            if up.any():
                r = r[up]
                both_s = np.hstack([best[r], s[up]])
                both_i = np.hstack([found[r], np.broadcast_to(number[at], (len(r), s.shape[1]))])
                keep = np.lexsort((both_i, -both_s), axis=1)[:, :k]
                best[r], found[r] = np.take_along_axis(both_s, keep, 1), np.take_along_axis(both_i, keep, 1)
        done, take = done + take, 2 * take
        if done < leaves:
            kth = np.maximum(0, both[rows] - 2 * np.maximum(grid * best[rows, -1], least[rows]))
            rows = rows[radius[rows, order[rows, done]] <= _reach(limit, kth, scale)]
    q, j = np.nonzero(best > -np.inf)
    place = by_id[found[q, j]]
    return qids[q], ids[place], np.einsum("ij,ij->i", queries[q], vectors[place])


def _reach(limit: float, kth: np.ndarray, scale: float) -> np.ndarray:
    """Squared projected distance up to which the chi-square test lets a search go on whose k-th best lies at the squared distance kth."""
    return np.maximum(limit * np.maximum(0, kth), 1e-9 * scale)


def nearest(rows: DataFrame, is_query: Column, p: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of all other rows (vec_id, embedding), for each row for which is_query holds."""
    vectors = usable(rows)
    index = build_index(vectors, p)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = vectors.where(is_query)
    limit, top, k = chi_square_at(p.sure, p.projections), index.top, p.k
    regions, low, high = index.regions, index.low, index.high
    kind = vectors.schema["vector"].dataType.simpleString()

    def visits(home: bool):
        """Rows (vec_id, vector, least) as (region, vec_id, vector, least): to the nearest region, or to all others that pass the test."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
                v, least = _matrix(b.column(1)), b.column(2).to_numpy()
                x = np.column_stack([v, np.zeros(len(v))]) @ _projection(v.shape[1], p)
                radius = np.zeros((len(v), len(regions)))
                for j in range(p.projections):
                    radius += np.square(np.maximum(0, np.maximum(low[:, j] - x[:, j : j + 1], x[:, j : j + 1] - high[:, j])))
                nearest = radius.argmin(1)
                if home:
                    q, r = np.arange(len(v)), nearest
                else:
                    there = radius <= _reach(limit, np.square(v).sum(1) + top * top - 2 * least, max(top * top, 1e-300))[:, None]
                    there[np.arange(len(v)), nearest] = False
                    q, r = np.nonzero(there)
                for i in range(0, len(q), 10_000):
                    own = pa.array(q[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(regions[r[i : i + 10_000]].astype(np.int32)), *(c.take(own) for c in b.columns)], ["region", "vec_id", "vector", "least"])

        return run

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = None
        for region, _, ids, v in _units((pa.RecordBatch.from_arrays([*b.columns[:3], _with(b.column(3), b.column(4))], ["region", "part", "vec_id", "vector"]) for b in batches)):
            d = v.shape[1] - 1
            yield pa.RecordBatch.from_arrays([pa.array([region], pa.int32()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (ids, v[:, :d], v[:, d]))], ["region", "query_ids", "queries", "least"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                (r,) = b.slice(j, 1).to_pylist()
                ids, qids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["query_ids"], np.int64)
                vectors, queries = np.frombuffer(r["vectors"]).reshape(len(ids), -1), np.frombuffer(r["queries"]).reshape(len(qids), -1)
                edges = np.append(np.frombuffer(r["first"], np.int64), len(ids))
                low, high = (np.frombuffer(r[c]).reshape(len(edges) - 1, -1) for c in ("low", "high"))
                x = np.column_stack([queries, np.zeros(len(queries))]) @ _projection(queries.shape[1], p)
                own, near, scores = _search(queries, qids, x, ids, vectors, edges, low, high, top, limit, k, np.frombuffer(r["least"]))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(near), pa.array(scores)], ["query_id", "vec_id", "score"])

    def found(asked: DataFrame, home: bool) -> DataFrame:
        dealt = _dealt(stash(asked.mapInArrow(visits(home), f"region int, vec_id long, vector {kind}, least double"), "visits"), p.query_block)
        packed = dealt.mapInArrow(pack, "region int, query_ids binary, queries binary, least binary")
        return packed.join(index.blocks.drop("least", "most"), "region").mapInArrow(search, "query_id long, vec_id long, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda d: d.withColumn("rank", rank).where(F.col("rank") <= k)
    first = stash(best(found(queries.withColumn("least", F.lit(float("-inf"))), True)), "nearest-home")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    asked = queries.join(kth, "vec_id", "left").select("vec_id", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    every = first.select("query_id", "vec_id", "score")
    if len(regions) > 1:
        every = every.unionByName(found(asked, False))
    return best(every).select("query_id", "rank", "vec_id", "score")


def _with(vectors: pa.Array, last: pa.Array) -> pa.Array:
    """Vectors with one more component each."""
    wide = np.column_stack([_matrix(vectors), last.to_numpy()])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(wide) + 1, dtype=np.int32) * wide.shape[1]), pa.array(wide.ravel()))
