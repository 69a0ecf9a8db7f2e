"""Merkle manifest of a dataset, with the preimages of parents as proofs.

Each row is a leaf: the hash of its fields. Within a group (a language) the leaves stand in
the order of a column; every eight consecutive nodes become a parent until one remains, the
group's subroot, and the subroots of all groups become the root in the same way. A parent
is stored with its preimage, the concatenated hashes of its children, as a row of the
manifest. A leaf joins the preimages of all its ancestors: in each of them its own
64-character slot follows from its place alone; the rest of the preimage are the siblings,
and the preimage with the slot replaced by a recomputed hash, hashed, is what the next
ancestor up has to hold.

Texts are hashed where they lie and read once; only hashes, places and preimages move.
Leaves are numbered by ranges, so a group with a third of all rows meets in no task, and
rows that are equal in all fields are dealt over several ranges. A level has an eighth of
the rows of the level below it and is a table of its own; there is one for each factor of
eight in the size of the largest group.

Defined cases: a null field is `-`, an empty one `0:`; null groups form a group of their
own that comes first, rows with a null id come first in their group; rows with equal ids
follow each other by their leaves, repeated rows are leaves of their own; very long texts
are hashed whole; an empty table has no leaf, no root and no row; columns that are not
fields are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import with_number
from .common import join_small, stash

DIGEST = 64


@dataclass(frozen=True)
class Params:
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "lang"
    order: str = "doc_id"
    #: Children of a parent are 2 to the power of this.
    bits: int = 3


@dataclass(frozen=True)
class Manifest:
    """leaves (order, tree, place, size, leaf, further columns), nodes (tree, level, place, preimage, hash), subroots (tree, subroot, place) and their own nodes; places from 0."""

    leaves: DataFrame
    nodes: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    params: Params


def field_text(value: Column) -> Column:
    """`-` for null, else bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, values)).cast("binary"), 256)


def manifest(docs: DataFrame, p: Params = Params(), more: dict[str, Callable[[dict[str, Column]], Column]] | None = None) -> Manifest:
    """The manifest of docs. `more` are columns made of the fields that the leaves carry along."""
    fields = {c: F.col(c) for c in p.fields}
    tree = F.coalesce(F.concat(F.lit("="), fields[p.group].cast("string")), F.lit(""))  # null comes first
    made = docs.select(fields[p.order].alias("id"), tree.alias("tree"), leaf_hash(list(fields.values())).alias("leaf"), *[f(fields).alias(c) for c, f in (more or {}).items()])
    hashed = stash(made, "leaves").withColumn("_deal", F.rand(0))  # equal rows are interchangeable
    placed = with_number(hashed, ["id", "leaf", "_deal"], "place", within=("tree",)).drop("_deal")
    placed = stash(placed.withColumn("place", F.col("place") - 1), "placed")
    sizes = stash(placed.groupBy("tree").agg(F.count("*").alias("size")), "sizes")
    leaves = join_small(placed, sizes, ["tree"], "inner")
    nodes, roots = _levels(leaves.select("tree", "place", "size", F.col("leaf").alias("hash")), p)
    subroots = with_number(roots.select("tree", F.col("hash").alias("subroot")), ["tree"], "place")
    subroots = stash(subroots.withColumn("place", F.col("place") - 1), "subroots")
    count = subroots.count()
    top, root = _levels(subroots.select(F.lit("").alias("tree"), "place", F.lit(count).cast("long").alias("size"), F.col("subroot").alias("hash")), p)
    found = root.select("hash").first()  # one row, or none
    return Manifest(leaves, nodes, subroots.withColumn("root", F.lit(found[0] if found else None).cast("string")), top, p)


def _levels(leaves: DataFrame, p: Params) -> tuple[list[DataFrame], DataFrame]:
    """Levels (tree, place, size, preimage, hash) over leaves (tree, place, size, hash), and the last node (tree, hash) of each tree; size counts the tree's leaves."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    nodes, below, roots = [], leaves, [leaves.where("size = 1")]
    while 1 << p.bits * len(nodes) < most:
        level = len(nodes)
        children = F.array_sort(F.collect_list(F.struct("place", "hash")))  # at most 2 ** bits
        joined = F.array_join(F.transform(children, lambda x: x["hash"]), "")
        parents = (
            below.where(F.col("size") > (1 << p.bits * level))
            .groupBy("tree", F.shiftright("place", p.bits).alias("place"))
            .agg(F.max("size").alias("size"), joined.alias("preimage"))
            .withColumn("hash", F.sha2(F.col("preimage").cast("binary"), 256))
        )
        below = stash(parents, f"level{level + 1}")
        nodes.append(below)
        roots.append(below.where(F.col("size") <= (1 << p.bits * (level + 1))))
    return nodes, reduce(DataFrame.unionByName, [r.select("tree", "hash") for r in roots])


def node_table(m: Manifest) -> DataFrame:
    """(tree, level, place, preimage, hash) of all parents, those over the subroots under a null tree: what a manifest stores."""
    parts = [n.select("tree", F.lit(k + 1).alias("level"), "place", "preimage", "hash") for k, n in enumerate(m.nodes)]
    parts += [n.select(F.lit(None).cast("string").alias("tree"), F.lit(k + 1).alias("level"), "place", "preimage", "hash") for k, n in enumerate(m.top)]
    empty = m.leaves.select("tree", F.lit(0).alias("level"), "place", F.lit("").alias("preimage"), F.lit("").alias("hash")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts, empty)


def _preimages(nodes: list[DataFrame], p: Params) -> DataFrame | None:
    """(tree, place, path) of the lowest parents: their preimages and those of their ancestors, upwards."""
    found = None
    for level in reversed(nodes):
        own = level.select("tree", "place", F.array("preimage").alias("path"))
        if found is not None:
            above = found.select(F.col("tree"), F.col("place").alias("_up"), F.col("path").alias("_above"))
            own = own.withColumn("_up", F.shiftright("place", p.bits)).join(above, ["tree", "_up"], "left")
            own = own.select("tree", "place", F.concat("path", F.coalesce("_above", F.array().cast("array<string>"))).alias("path"))
        found = own
    return found


def _steps(place: Column, path: Column, p: Params) -> Column:
    """(preimage, characters before the own slot) of each ancestor."""
    slot = lambda k: F.call_function("shiftright", place, k * p.bits).bitwiseAND((1 << p.bits) - 1)
    return F.transform(path, lambda x, k: F.struct(x.alias("preimage"), (slot(k) * DIGEST).cast("int").alias("at")))


def proofs(m: Manifest) -> DataFrame:
    """The leaves with subroot, root and steps, the preimages from the lowest parent to the root, each with the place of the own slot."""
    p, none = m.params, F.array().cast("array<string>")
    groups = m.subroots.select("tree", "subroot", "root", F.col("place").alias("_group"))
    if m.top:
        above = _preimages(m.top, p).select(F.col("place").alias("_up"), F.col("path").alias("_top"))
        groups = groups.withColumn("_up", F.shiftright("_group", p.bits)).join(above, "_up", "left").drop("_up")
    else:
        groups = groups.withColumn("_top", none)
    leaves = m.leaves.withColumn("_parent", F.shiftright("place", p.bits))
    if m.nodes:
        leaves = leaves.join(_preimages(m.nodes, p).withColumnRenamed("place", "_parent"), ["tree", "_parent"], "left")
    else:
        leaves = leaves.withColumn("path", none)
    joined = join_small(leaves, stash(groups, "groups"), ["tree"], "inner").withColumn("path", F.coalesce("path", none)).withColumn("_top", F.coalesce("_top", none))
    steps = F.concat(_steps(F.col("place"), F.col("path"), p), _steps(F.col("_group"), F.col("_top"), p))
    return joined.withColumn("steps", steps).drop("_parent", "path", "_group", "_top", "size")


def siblings(steps: Column) -> Column:
    """The hashes beside each node of a leaf's way to the root: the preimages without the own slots."""
    other = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["at"]), F.substring(s["preimage"], s["at"] + DIGEST + 1, F.length(s["preimage"])))
    return F.array_join(F.transform(steps, other), "")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's hash gives: spliced into each preimage in turn."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.overlay(s["preimage"], acc, s["at"] + 1, F.lit(DIGEST)).cast("binary"), 256))


def verify(m: Manifest, claimed: Column) -> DataFrame:
    """The leaves with subroot, root, proof_sha256, folded_root and verified; `claimed` is the hash that each leaf is said to have."""
    r = proofs(m)
    r = r.withColumn("proof_sha256", F.sha2(siblings(F.col("steps")).cast("binary"), 256)).withColumn("folded_root", folded(claimed, F.col("steps")))
    return r.withColumn("verified", F.col("folded_root") == F.col("root")).drop("steps")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_leaf(fields: dict[str, Column]) -> Column:
    """The leaf of a document whose text has been lower-cased, where 3 divides the crc32 of its id; null for others."""
    changed = fields | {"text": F.translate(fields["text"], UPPER, LOWER)}
    return F.when(F.crc32(fields["doc_id"].cast("string").cast("binary")) % 3 == 0, leaf_hash(list(changed.values())))
