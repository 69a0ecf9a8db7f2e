"""N-gram Jaccard join: near duplicates by a MinHash LSH forest and exact verification.

Documents with the same set of five-word shingles are copies and stand for one node,
named by a 128-bit fingerprint of the set. Every node has `trees` x `depth` minima; a tree
is the prefix trie of its `depth` minima. The keys of a tree are sorted, so that every
prefix is a run of them, and the nodes below each prefix are counted.

A node starts with its whole keys and shortens the matched prefix of each tree as long as
it leads to at most `few` nodes, down to the length at which all trees together find a
pair at the threshold with the target recall. Where crowded prefixes leave it short of
that, it goes on in the tree whose next prefix leads to the fewest nodes, until the
recall of its own lengths, 1 - product over trees of (1 - s^length), reaches the target.
A prefix that any node asks for is a bucket of all nodes below it.

A bucket only has to say who might belong together: within it, nodes whose signatures
agree well enough are linked by a spanning forest (so rows grow with the nodes, not with
the pairs). The components of these links are small groups; each node's text goes there
once, and all pairs within a group are verified exactly by multiplying incidence matrices
of their shingles. Buckets and groups of more than `block` nodes are cut into blocks and
every pair of blocks is a task of its own, so nothing is capped and no task is unbounded.

Defined cases: a null, empty or blank text has no shingle and no link and is its own
class; a text of one to four words is one shingle; a row with a null id is a document like
any other; repeated rows are copies; class_id is the least doc_id of the class, null only
if all are null; very long texts are taken in slices; an empty table gives no row; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_weight, let_go, stash, text_key, without_rows
from .components import components
from .shingles import Codes, MinHash, fingerprint, shingles


@dataclass(frozen=True)
class Params:
    threshold: float = 0.8
    trees: int = 16
    depth: int = 8
    #: Least probability with which a node's prefixes find another at the threshold.
    recall: float = 0.999
    #: Nodes to which a prefix may lead without further need.
    few: int = 64
    #: Standard deviations by which a signature may fall short of the threshold.
    slack: float = 4.0
    bucket_block: int = 8192
    group_block: int = 1024
    #: Shingles in a block of a group.
    block_shingles: int = 2_000_000

    @property
    def width(self) -> int:
        return self.trees * self.depth

    @property
    def agree(self) -> float:
        return self.threshold - self.slack * (self.threshold * (1 - self.threshold) / self.width) ** 0.5

    def found(self, s: float, d: int) -> float:
        """Probability that a pair of similarity s shares a prefix of length d in some tree."""
        return 1 - (1 - s**d) ** self.trees

    @property
    def shortest(self) -> int:
        return max((d for d in range(1, self.depth + 1) if self.found(self.threshold, d) >= self.recall), default=1)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, copy, node, size, sig): copy names the text, size is the number of shingles, node is null for documents without shingles."""
    width = p.width
    rows = docs.select("doc_id", text_key("text").alias("copy"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        codes, low = Codes(), MinHash(width)
        for b in by_weight(batches, 2):
            nodes, sizes, sigs = [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), codes)
                nodes.append(fingerprint(s) if len(s) else None)
                sizes.append(len(s))
                sigs.append(low(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "copy", "node", "size", "sig"])

    return rows.mapInArrow(run, "doc_id long, copy binary, node binary, size long, sig binary")


def _prefix(d: int) -> Column:
    return F.substring("key", 1, 2 * d)


def _by_prefix(rows: DataFrame, p: Params, of: Callable[[Window, int], Column]) -> DataFrame:
    """rows (tree, key, ...) sorted as tries, with the column at_<d> for each prefix length d: `of` over the rows of one prefix."""
    lengths = range(p.shortest, p.depth)
    names = [f"_p{d}" for d in lengths]
    tries = rows.select("*", *[_prefix(d).alias(n) for d, n in zip(lengths, names, strict=True)])
    if names:
        tries = tries.repartition("tree", names[0]).sortWithinPartitions("tree", *names)
    for k, d in enumerate(lengths):
        tries = tries.withColumn(f"at_{d}", of(Window.partitionBy("tree", *names[: k + 1]), d))
    return tries.drop(*names)


def tries(nodes: DataFrame, p: Params) -> DataFrame:
    """(node, tree, key, sizes): the keys of nodes (node, sig) that share their shortest prefix; sizes[i]: nodes below the prefix of length shortest + i."""
    keys = F.array(*[F.substring("sig", 2 * p.depth * t + 1, 2 * p.depth) for t in range(p.trees)])
    rows = nodes.select("node", F.posexplode(keys).alias("tree", "key"))
    counted = _by_prefix(rows.groupBy("tree", "key").agg(F.count("*").alias("n")), p, lambda w, d: F.sum("n").over(w))
    sizes = F.array(*[F.col(f"at_{d}") for d in range(p.shortest, p.depth)], F.col("n"))
    shared = counted.select("tree", "key", sizes.alias("sizes")).where("sizes[0] > 1")
    return rows.join(shared, ["tree", "key"])


def lengths_of(sizes: np.ndarray, p: Params) -> np.ndarray:
    """Prefix lengths (nodes x trees) from sizes (nodes x trees x lengths from the shortest), the numbers of nodes below each prefix."""
    last = sizes.shape[2] - 1
    fit = sizes <= p.few
    at = np.where(fit.any(2), fit.argmax(2), last)
    while True:
        missed = np.log1p(-np.power(p.threshold, p.shortest + at)).sum(1)
        short = np.flatnonzero((missed > np.log(1 - p.recall)) & (at > 0).any(1))
        if not len(short):
            return p.shortest + at
        own = at[short]
        following = np.where(own > 0, np.take_along_axis(sizes[short], np.maximum(own - 1, 0)[:, :, None], 2)[:, :, 0], np.iinfo(np.int64).max)
        at[short, following.argmin(1)] -= 1


def buckets(nodes: DataFrame, p: Params) -> DataFrame:
    """(node, tree, bucket, n): the nodes below each prefix that one of them asks for; n is their number."""
    shared = stash(tries(nodes, p), "tries")
    asked = shared.groupBy("node").agg(F.collect_list(F.struct("tree", "key", "sizes")).alias("own"))  # at most a key for each tree
    trees, count = p.trees, p.depth - p.shortest + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            own = b.column(0)
            each = own.flatten()
            tree, key, sizes = each.field("tree"), each.field("key"), each.field("sizes")
            row = np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy()))
            all_sizes = np.ones((b.num_rows, trees, count), np.int64)
            at = tree.to_numpy()
            all_sizes[row, at] = sizes.flatten().to_numpy().reshape(-1, count)
            d = lengths_of(all_sizes, p)[row, at]
            yield pa.RecordBatch.from_arrays([tree, key, sizes, pa.array(d.astype(np.int32))], ["tree", "key", "sizes", "length"])

    asked = asked.select("own").mapInArrow(run, "tree int, key binary, sizes array<long>, length int")
    asked = asked.groupBy("tree", "key").agg(F.min("length").alias("length"), F.first("sizes").alias("sizes"))
    asked = _by_prefix(asked, p, lambda w, d: F.min("length").over(w))
    length = F.coalesce(*[F.when(F.col(f"at_{d}") <= d, F.lit(d)) for d in range(p.shortest, p.depth)], F.lit(p.depth))
    asked = asked.select("tree", "key", length.alias("length"), "sizes").withColumn("n", F.get("sizes", F.col("length") - p.shortest)).where("n > 1")
    rows = shared.select("node", "tree", "key").join(asked.select("tree", "key", "length", "n"), ["tree", "key"])
    return rows.select("node", "tree", F.expr("substring(key, 1, 2 * length)").alias("bucket"), "n")


def in_blocks(rows: DataFrame, key: list[str], node: str, block: int, weight: Column | None = None, heaviest: int = 1) -> DataFrame:
    """Keeps the rows of keys with several rows and adds _blocks and _own.

    A key is cut into _blocks blocks of about `block` rows, or of the weight `heaviest`
    if that is less; _own is a row's block.
    """
    by_weight = F.lit(1) if weight is None else F.ceil(F.sum(weight) / heaviest)
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.greatest(F.ceil(F.count("*") / block), by_weight).cast("int").alias("_blocks"))
    sizes = sizes.where("_n > 1").drop("_n")
    return rows.join(sizes, key).withColumn("_own", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))


def _units(rows: DataFrame) -> DataFrame:
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    r = rows.withColumn("_other", other)
    return r.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_other")


def _by_unit(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Units of rows sorted by keys; only one unit is held."""
    rows = (r for b in batches for k in range(0, b.num_rows, 1000) for r in b.slice(k, 1000).to_pylist())
    for key, unit in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield key, list(unit)


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Component of each of n nodes, as its least member.

    near(k, rest) says which of rest are linked to k; a node is only held against those
    that nothing has reached yet, so a group of close copies costs a few rows of its matrix.
    """
    label, rest = np.arange(n), np.arange(n)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        open_nodes = [seed]
        while open_nodes and len(rest):
            hit = near(open_nodes.pop(), rest)
            new, rest = rest[hit], rest[~hit]
            label[new] = seed
            open_nodes += new.tolist()
    return label


def forest_links(nodes: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) of nodes (node, sig) that share a bucket and whose signatures agree well enough."""
    rows = buckets(nodes, p).withColumn("_blocks", F.ceil(F.col("n") / p.bucket_block).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = _units(rows.join(nodes.select("node", "sig"), "node"))
    unit = ["tree", "bucket", "_i", "_j"]
    rows = rows.select(*unit, "node", "sig").repartition(*unit).sortWithinPartitions(*unit, "node")
    width, agree = p.width, p.agree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        a, b = [], []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        for _, unit in _by_unit(batches, ["tree", "bucket", "_i", "_j"]):
            sig = np.frombuffer(b"".join(r["sig"] for r in unit), np.uint16).reshape(len(unit), width)
            label = _forest(len(unit), lambda k, rest, sig=sig: (sig[rest] == sig[k]).sum(1) >= agree * width)
            for k in np.flatnonzero(label != np.arange(len(unit))):
                a.append(unit[k]["node"])
                b.append(unit[label[k]]["node"])
            if len(a) >= 10_000:
                yield out()
                a, b = [], []
        yield out()

    return rows.mapInArrow(run, "a binary, b binary")


def _verify(unit: list[dict], sets: list[np.ndarray], i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(component label, number of links) of each row of a unit, from exact intersections."""
    n = len(unit)
    size = np.array([len(s) for s in sets], np.int64)
    whole, back, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1  # others meet in no pair
    column = np.where(shared, np.cumsum(shared) - 1, -1)[back]
    row = np.repeat(np.arange(n), size)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    top = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, top, 4096):
        x = np.zeros((n, min(4096, top - lo)), np.float32)
        at = slice(*np.searchsorted(column, [lo, lo + 4096]))
        x[row[at], column[at] - lo] = 1
        common += x @ x.T
    met = common.astype(np.int64)
    whole = size[:, None] + size[None, :] - met
    linked = met * 10_000 >= round(threshold * 10_000) * whole
    np.fill_diagonal(linked, False)
    if i != j:
        own = np.array([r["_own"] for r in unit])
        linked &= own[:, None] != own[None, :]
    return _forest(n, lambda k, rest: linked[k, rest]), linked.sum(1)


def verified_links(docs: DataFrame, members: DataFrame, p: Params) -> DataFrame:
    """(node, root, links, blocks) for each unit of each member (node, copy, size, group)."""
    rows = in_blocks(members, ["group"], "node", p.group_block, F.col("size"), p.block_shingles)
    texts = docs.select("doc_id", "text").withColumn("copy", text_key("text")).join(rows.hint("merge"), (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("copy") == F.col("_copy")))
    unit = ["group", "_i", "_j"]
    rows = _units(texts).select(*unit, "_blocks", "_own", "node", "text").repartition(*unit).sortWithinPartitions(*unit, "node")
    threshold = p.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        codes = Codes()
        for (_, i, j), unit in _by_unit(batches, ["group", "_i", "_j"]):
            kept, sets = {}, {}
            for r in unit:  # a repeated row brings the same text
                s = shingles(r.pop("text"), codes)
                if r["node"] not in kept and fingerprint(s) == r["node"]:
                    kept[r["node"]], sets[r["node"]] = r, s
            unit = list(kept.values())
            if not unit:
                continue
            label, links = _verify(unit, list(sets.values()), i, j, threshold)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["node"] for r in unit], pa.binary()),
                    pa.array([unit[k]["node"] for k in label], pa.binary()),
                    pa.array(links.astype(np.int64)),
                    pa.array([r["_blocks"] for r in unit], pa.int32()),
                ],
                ["node", "root", "links", "blocks"],
            )

    return rows.mapInArrow(run, "node binary, root binary, links long, blocks int")


def classes_of(docs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Stashed rows (doc_id, copy, node) of docs (doc_id, text), and (node, class_id, n_links, n_copies, first, class_first) of their nodes.

    first: the least (whether doc_id is null, doc_id, copy) of a node; class_first: of its class.
    """
    known = stash(signatures(docs, p), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    nodes = known.where("node is not null").groupBy("node").agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("sig").alias("sig"))
    nodes = stash(nodes, "nodes")
    groups = components(forest_links(nodes, p)).select("node", F.col("root").alias("group"))
    members = groups.join(nodes.select("node", F.col("first.doc_id").alias("_id"), F.col("first.copy").alias("_copy"), "size"), "node")
    units = stash(verified_links(docs, stash(members, "members"), p), "verified")
    whole = units.where("blocks = 1").select("node", "root", "links")
    cut = units.where("blocks > 1")
    if cut.limit(1).count():
        roots = components(cut.select(F.col("node").alias("a"), F.col("root").alias("b")))
        counted = cut.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node", "left")
        whole = whole.unionByName(counted.select("node", F.coalesce("root", "node").alias("root"), "links"))
    joined = whole.join(nodes.select("node", "first"), "node")
    least = joined.groupBy("root").agg(F.min("first").alias("class_first"))
    classes = joined.join(least, "root").select("node", "class_first", "links")
    nodes = nodes.select("node", "first", "copies").join(classes, "node", "left").withColumn("class_first", F.coalesce("class_first", "first"))
    nodes = nodes.select("node", F.col("class_first.doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("copies").alias("n_copies"), "first", "class_first")
    return known.select("doc_id", "copy", "node"), stash(nodes, "classes")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id, n_links, n_copies.

    n_links counts the different texts at or over the threshold, n_copies the documents
    with the same shingle set, this one included.
    """
    known, nodes = classes_of(docs, p)
    out = known.join(nodes.select("node", F.struct("class_id", "n_links", "n_copies").alias("of")), "node", "left")
    alone = F.struct(F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.select("doc_id", F.coalesce("of", alone).alias("of")).select("doc_id", "of.*")


def drop_near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs with one row of each class, one with the least doc_id; rows without shingles stay.

    Rows are told apart by doc_id and text, so another text under a dropped row's id
    stays. Of rows that repeat both, one stays.
    """
    known, nodes = classes_of(docs, p)
    rows = known.where("node is not null").groupBy("doc_id", "copy", "node").agg(F.count("*").alias("n"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    rows = rows.join(nodes.select("node", "class_first"), "node")
    kept = without_rows(docs, rows.where(key != F.col("class_first")).select("doc_id", "copy"))
    repeated = stash(rows.where((key == F.col("class_first")) & (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")), "repeated")
    if repeated.limit(1).count():
        is_row = F.col("key").eqNullSafe(F.col("_copy")) & F.col("id").eqNullSafe(F.col("_id"))
        keyed = kept.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key("text").alias("key"))
        one = keyed.join(repeated, is_row, "left_semi").groupBy("id", "key").agg(F.first("row").alias("row"))
        kept = keyed.join(repeated, is_row, "left_anti").unionByName(one).select("row.*")
    return kept
