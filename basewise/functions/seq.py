"""DNA sequences as strings, k-mers as longs: two bits a base, C=0 G=1 A=2 T=3, first base highest.

A k-mer is canonical when it is the greater of itself and its reverse complement. All
functions are built-in expressions; a null, or a base outside CGAT, gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, CODES, COMPLEMENT_CODES, COMPLEMENTS = "CGAT", "0123", "1032", "GCTA"


def is_cgat(seq: Column) -> Column:
    """Whether all characters are bases; a negated class, since $ would allow a final line break."""
    return ~seq.rlike("[^CGAT]") & (F.length(seq) > 0)


def upper_bases(seq: Column) -> Column:
    """a, c, g and t in upper case; other letters as they are."""
    return F.translate(seq, "acgt", "ACGT")


def complement(seq: Column) -> Column:
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def digits(seq: Column) -> Column:
    """Base-4 digits of the straight strand."""
    return F.translate(seq, BASES, CODES)


def digits_rc(seq: Column) -> Column:
    return F.translate(F.reverse(seq), BASES, COMPLEMENT_CODES)


def _number(d: Column) -> Column:
    return F.conv(d, 4, 10).cast("long")


def encode(seq: Column) -> Column:
    return F.when(is_cgat(seq), _number(digits(seq)))


def encode_rc(seq: Column) -> Column:
    return F.when(is_cgat(seq), _number(digits_rc(seq)))


def canonical(seq: Column) -> Column:
    """The greater of both strands; digit strings of one length order as their numbers."""
    return F.when(is_cgat(seq), _number(F.greatest(digits(seq), digits_rc(seq))))


#: The bases of each byte of a k-mer.
_FOUR = ",".join(map("".join, product(BASES, repeat=4)))


def decode(kmer: Column, k: int) -> Column:
    """The k bases of a code, looked up four at a time: a conversion by digits is most of what a build's output costs."""
    four, size = F.split(F.lit(_FOUR), ","), -(-k // 4)  # a constant
    parts = [F.get(four, F.shiftright(kmer, 8 * i).bitwiseAND(F.lit(255)).cast("int")) for i in reversed(range(size))]
    return F.substring(F.concat(*parts), 4 * size - k + 1, k)


def bad_base_at(seq: Column) -> Column:
    """0-based place of the first character that is no base, -1 if there is none."""
    return F.length(F.regexp_extract(seq, "^[CGAT]*", 0)) - F.when(is_cgat(seq) | (seq == ""), F.length(seq) + 1).otherwise(0)


def radix(kmer: Column, bits: int) -> Column:
    """The low bits of a k-mer: a partition key."""
    return kmer.bitwiseAND(F.lit((1 << bits) - 1))


def run_weight(n: int) -> int:
    """Weight of a run of n equal neighbours: 0, 1, 2, 3, 5, 8, ..., each the sum of the two before it."""
    a, b = 1, 1
    for _ in range(n):
        a, b = b, a + b
    return a if n else 0


def _equals_before(seq: Column, lag: int) -> Callable[[Column], Column]:
    return lambda i: F.substring(seq, i, F.lit(1)) == F.substring(seq, i - lag, F.lit(1))


def dust(seq: Column, k: int) -> Column:
    """Low-complexity score of a k-mer: over the lags 1, 2 and 3, the weights of the runs of places that equal the place `lag` before."""
    weights = F.array(*[F.lit(run_weight(n)).cast("long") for n in range(k + 1)])
    total = F.lit(0).cast("long")
    for lag in (1, 2, 3):
        if k <= lag:
            continue
        same = F.transform(F.sequence(F.lit(lag + 1), F.lit(k)), _equals_before(seq, lag))
        runs = F.aggregate(
            same,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("run")),
            lambda a, x: F.struct((a["sum"] + F.when(x, F.lit(0)).otherwise(F.get(weights, a["run"]))).cast("long").alias("sum"), F.when(x, a["run"] + 1).otherwise(F.lit(0)).alias("run")),
            lambda a: a["sum"] + F.get(weights, a["run"]),
        )
        total = total + runs
    return F.when(F.length(seq) == k, total)
