"""Bloom filters over k-mers as rows: one row of packed bits for each block of keys.

Keys are dealt to blocks by a hash; each block is a small filter of its own, so that a
filter of any size is built by one aggregation and probed by an equi-join on the block,
and no task holds more than one block. No false negatives; the share of false positives is
about `fpp`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_KEYS = 1 << 16


@dataclass(frozen=True)
class Filter:
    blocks: DataFrame
    n_blocks: int
    bits: int
    hashes: int


def sizes(n: int, fpp: float) -> tuple[int, int]:
    """(bits, hashes) for n keys."""
    bits = max(64, math.ceil(-n * math.log(fpp) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _places(keys: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """(hashes, keys) bit places, by double hashing of a mixed key."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    a, step = x * np.uint64(0xD6E8FEB86659FD93), (x >> np.uint64(17)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * step) % np.uint64(bits) for i in range(hashes)])


def build(rows: DataFrame, key: str, fpp: float) -> Filter:
    """A filter over the distinct keys (long); blocks hold about BLOCK_KEYS keys, with room for uneven ones."""
    keys = rows.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    n = max(1, math.ceil(keys.count() / BLOCK_KEYS))
    bits, hashes = sizes(int(BLOCK_KEYS * 1.05), fpp)
    dealt = keys.select(_block(F.col("k"), n).alias("block"), "k").repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = None, None
        for b in batches:
            of, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            for name in np.unique(of):
                if name != block:
                    if found is not None:
                        yield _row(block, found)
                    block, found = name, np.zeros(bits, bool)
                found[_places(k[of == name], bits, hashes).ravel()] = True
        if found is not None:
            yield _row(block, found)

    return Filter(dealt.mapInArrow(run, "block int, packed binary"), n, bits, hashes)


def _row(block: int, found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(found).tobytes()], pa.binary())], ["block", "packed"])


def probe(rows: DataFrame, key: str, f: Filter) -> DataFrame:
    """(key, maybe): whether the filter may hold the key of each row."""
    bits, hashes = f.bits, f.hashes
    asked = rows.select(_block(F.col(key).cast("long"), f.n_blocks).alias("block"), F.col(key).cast("long").alias("k")).where("k is not null")
    parts = max(1, math.ceil(asked.count() / f.n_blocks / BLOCK_KEYS))  # keys meet a copy of their block in lists of about BLOCK_KEYS
    listed = asked.groupBy("block", F.pmod(F.hash("k"), F.lit(parts)).alias("_part")).agg(F.collect_list("k").alias("ks"))
    both = listed.join(f.blocks, "block").select("block", "ks", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            out, hit = [], []
            for ks, packed in zip(b.column(1), b.column(2), strict=True):
                raw = packed.as_py()
                if raw is not last:
                    last, held = raw, np.unpackbits(np.frombuffer(raw, np.uint8))
                k = ks.values.to_numpy()
                out.append(k)
                hit.append(held[_places(k, bits, hashes)].all(0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(hit).astype(bool))], ["k", "maybe"])

    return both.mapInArrow(run, "k long, maybe boolean").withColumnRenamed("k", key)
