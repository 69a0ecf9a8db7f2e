"""Sequence functions and windows against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewise.functions import kernels, seq
from basewise.operators import windows as w

CODE = {"C": 0, "G": 1, "A": 2, "T": 3}
PAIR = {"C": "G", "G": "C", "A": "T", "T": "A"}


def number(s):
    n = 0
    for c in s:
        n = n * 4 + CODE[c]
    return n


def canonical(s):
    return max(number(s), number("".join(PAIR[c] for c in reversed(s))))


def plain_dust(s):
    fib = [0, 1, 2]
    while len(fib) <= len(s):
        fib.append(fib[-1] + fib[-2])
    total = 0
    for lag in (1, 2, 3):
        run = 0
        for i in range(lag, len(s)):
            if s[i] == s[i - lag]:
                run += 1
            else:
                total, run = total + fib[run], 0
        total += fib[run]
    return total


#: K-mers and their scores.
DUST = {"TTTCGCGA": 5, "ACATA": 2, "ACAT": 1, "AAAAA": 10, "AAAT": 3, "AATAA": 5, "AAAA": 6, "TATAT": 3, "ACAA": 3}


@pytest.mark.parametrize(("kmer", "score"), DUST.items())
def test_dust_literals(spark, kmer, score):
    k = len(kmer)
    assert plain_dust(kmer) == score
    assert spark.createDataFrame([(kmer,)], "s string").select(seq.dust(F.col("s"), k)).first()[0] == score
    assert kernels.dust(kernels.base_codes(kmer.encode()), k).tolist() == [score]


def test_dust_of_long_runs_and_strands():
    r = random.Random(0)
    for _ in range(300):
        s = "".join(r.choice("CGAT") for _ in range(31))
        rc = "".join(PAIR[c] for c in reversed(s))
        assert [kernels.dust(kernels.base_codes(x.encode()), 31).tolist() for x in (s, rc)] == [[plain_dust(s)]] * 2
    f = seq.run_weight
    assert [kernels.dust(kernels.base_codes(x), 31).tolist() for x in ((b"AC" * 16)[:31], b"A" * 31)] == [[f(29)], [f(30) + f(29) + f(28)]]


@pytest.mark.parametrize("k", [1, 2, 15, 31])
def test_codes(spark, k):
    r = random.Random(k)
    rows = [("".join(r.choice("CGAT") for _ in range(k)),) for _ in range(50)]
    got = spark.createDataFrame(rows, "s string").select(
        "s", seq.encode(F.col("s")).alias("e"), seq.encode_rc(F.col("s")).alias("r"), seq.canonical(F.col("s")).alias("c"), seq.decode(seq.encode(F.col("s")), k).alias("d"), seq.reverse_complement(F.col("s")).alias("rc")
    )
    for x in got.collect():
        rc = "".join(PAIR[c] for c in reversed(x.s))
        assert (x.e, x.r, x.c, x.d, x.rc) == (number(x.s), number(rc), canonical(x.s), x.s, rc)


def test_bad_bases(spark):
    got = spark.createDataFrame([("ACGN",), ("ACG\n",), ("acg",), ("",), (None,)], "s string").select(seq.is_cgat(F.col("s")).alias("ok"), seq.encode(F.col("s")).alias("e"), seq.upper_bases(F.col("s")).alias("u")).collect()
    assert [bool(x.ok) for x in got] == [False] * 5 and all(x.e is None for x in got)
    assert [x.u for x in got] == ["ACGN", "ACG\n", "ACG", "", None]


def plain_windows(s, k):
    return [canonical(s[i : i + k]) if set(s[i : i + k]) <= set("CGAT") else None for i in range(len(s) - k + 1)]


@pytest.mark.parametrize("k", [3, 15])
def test_windows_match_plain_python(spark, k):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("CGATCGATCGATNé") for _ in range(n))) for i, n in enumerate([0, 1, k - 1, k, k + 1, 255, 256, 257 + k, 1000])] + [(99, None)]
    d = spark.createDataFrame(rows, "id long, s string")
    want = {(i, p): x for i, s in rows if s for p, x in enumerate(plain_windows(s, k))}
    for f in (w.windows, w.window_kmers):
        assert {(x.id, x.pos): x.kmer for x in f(d, ["id"], "s", k).collect()} == want
    stepped = {(x.id, x.pos): x.kmer for x in w.window_kmers(d, ["id"], "s", k, step=4, max_dust=3, invalid=False).collect()}
    place = lambda i, p: dict(rows)[i][p : p + k]
    assert stepped == {a: x for a, x in want.items() if x is not None and (a[1] + k) % 4 == 0 and plain_dust(place(*a)) <= 3}
    low = spark.createDataFrame([(1, "acgtNacgt")], "id long, s string")
    assert w.window_kmers(low, ["id"], "s", 3, invalid=False).count() == 0 and w.window_kmers(low, ["id"], "s", 3, upper=True, invalid=False).count() == 4


def test_decoding_looks_bases_up(spark):
    """As a conversion by digits, which costs four times as much."""
    for k in (1, 3, 4, 15, 31):
        d = spark.range(200).select((F.xxhash64("id").bitwiseAND(F.lit((1 << 2 * k) - 1))).alias("x")).unionByName(spark.sql(f"select {(1 << 2 * k) - 1}L as x union all select 0L"))
        by_digits = F.translate(F.lpad(F.conv(F.col("x").cast("string"), 10, 4), k, "0"), seq.CODES, seq.BASES)
        got = d.select(seq.decode(F.col("x"), k).alias("s"), by_digits.alias("t"))
        assert got.where("s is null or s <> t").count() == 0 and "conv(" not in got.select("s")._jdf.queryExecution().optimizedPlan().toString()
