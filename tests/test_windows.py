"""Windows in slices and runs: bounded work, the same rows."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basewise.functions import kernels, seq
from basewise.operators import windows as w

LONG = '''
import resource, sys
import numpy as np, pyarrow as pa
from basewise.operators import windows as w
sequences, k, dust = int(sys.argv[1]), 31, int(sys.argv[2])
n, most = int(sys.argv[3]), w.SLICE
def batches():
    r = np.random.default_rng(0)
    for i in range(sequences):
        bases = np.frombuffer(b"CGAT", np.uint8)[r.integers(0, 4, n, dtype=np.uint8)]
        for lo in range(0, n - k + 1, 200 * most):  # what Spark's batches of 64 MB hold
            cut = [bases[at : at + most + k - 1].tobytes() for at in range(lo, min(n - k + 1, lo + 200 * most), most)]
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(cut)), pa.array([lo + j * most for j in range(len(cut))]), pa.array(cut, pa.binary())], ["id", "_at", "_s"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = [b.num_rows for b in w.kmer_batches(batches(), k, max_dust=dust)]
print(sum(rows), max(rows), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
'''


def sequences(seed=1):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice(r.choice(["CGAT", "CGATN", "CA", "cgat"])) for _ in range(n))) for i, n in enumerate([0, 1, 14, 15, 16, 40, 100, 300, 1000, 5000])]
    return [*rows, (98, "é" * 50 + "ACGTACGTACGTACGTAé" + "C" * 400), (99, None)]


@pytest.mark.parametrize(("sequences", "bases"), [(8, 5_000_000), (1, 100_000_000)])
@pytest.mark.parametrize("dust", [-1, 500])
def test_memory_does_not_grow_with_sequences(sequences, bases, dust):
    """Eight bacterial genomes, and one large chromosome: a worker's peak and its largest batch."""
    if dust > 0 and bases > 10_000_000:
        bases //= 4
    done = subprocess.run([sys.executable, "-c", LONG, str(sequences), str(dust), str(bases)], capture_output=True, text=True, cwd=Path(__file__).parents[1], check=True)
    rows, largest, peak = map(int, done.stdout.split())
    assert largest <= w.SLICE and peak < 500 and (dust > 0 or rows == sequences * (bases - 30))


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 18])
@pytest.mark.parametrize("options", [{}, {"invalid": False}, {"step": 3, "invalid": False}, {"max_dust": 12, "upper": True, "invalid": False}, {"step": 5, "max_dust": 20}])
def test_slices_give_the_windows_of_whole_sequences(most, options):
    k, rows = 15, [(i, s.encode("ascii", "replace")) for i, s in sequences() if s and len(s) >= 15]
    cut = [(i, at, s[at : at + most + k - 1]) for i, s in rows for at in range(0, len(s) - k + 1, most)]
    columns = lambda x: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*x, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "_at", "_s"])
    found = [b for b in w.kmer_batches(iter([columns(cut)]), k, most=most, **options)]
    whole = [b for b in w.kmer_batches(iter([columns([(i, 0, s) for i, s in rows])]), k, **options)]
    assert max(b.num_rows for b in found) <= most
    assert pa.Table.from_batches(found).to_pylist() == pa.Table.from_batches(whole).to_pylist()


@pytest.mark.parametrize("k", [1, 2, 15, 31])
@pytest.mark.parametrize("options", [{}, {"invalid": False, "max_dust": 30}, {"step": 4, "invalid": False}])
def test_runs_open_into_windows(spark, k, options):
    d = spark.createDataFrame(sequences(k), "id long, s string").withColumn("name", F.concat(F.lit("n"), "id"))
    runs = w.kmer_runs(d, ["id", "name"], "s", k, **options)
    got = {(r.id, r.start + r.at): r.kmer for r in w.run_windows(runs, ["id"], k).collect()}
    got |= {(r.id, p): None for r in runs.where("first is null").collect() for p in range(r.start, r.start + r.n)}
    assert got == {(r.id, r.pos): r.kmer for r in w.window_kmers(d, ["id"], "s", k, **options).collect()}
    opened = w.with_bucket(w.run_windows(runs, ["id", "bucket"], k).withColumnRenamed("bucket", "own"), k)
    assert opened.where("own <> bucket").count() == 0
    assert not options or runs.where("n > 32").count() == 0


def test_runs_are_few(spark):
    bases = "".join(random.Random(0).choices("CGAT", k=100_000))
    runs = w.kmer_runs(spark.createDataFrame([(1, bases)], "id long, s string"), ["id"], "s", 31)
    assert 99_970 / runs.count() > 6


def test_both_strands_have_one_minimizer():
    r = np.random.default_rng(0)
    code = r.integers(0, 4, 500).astype(np.uint8)
    assert (kernels.minimizers(code, 31) == kernels.minimizers((code ^ 1)[::-1], 31)[::-1]).all()


def test_extraction_counts_come_from_slices(spark):
    """Counts equal those of the windows as rows, and no window becomes a row on the way."""
    k, rows = 15, sequences(3)
    d = spark.createDataFrame(rows, "id long, s string").withColumn("odd", F.col("id") % 2)
    found = w.extraction_counts(d, ["odd"], "s", k, 20)
    each = w.windows(d, ["odd"], "s", k, upper=True).where("kmer is not null").withColumn("score", seq.dust(seq.decode(F.col("kmer"), k), k))
    wanted = each.groupBy("odd").agg(F.count("*").alias("total"), F.count(F.when(F.col("score") > 20, 1)).alias("dusty"))
    assert {(r.odd, r.total, r.dusty, r.included) for r in found.collect()} == {(r.odd, r.total, r.dusty, r.total - r.dusty) for r in wanted.collect()}
    cut = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([b"CGAT" * 500, b"N" * 100], pa.binary())], ["id", "_at", "_s"])
    assert [b.column("total").to_pylist() for b in w.count_batches(iter([cut]), k, 20)] == [[1986, 0]]


def test_a_run_is_complemented_once(spark):
    """Complements are computed below the explode, and neither they nor k-mers are evaluated again by a join's filter."""
    d = spark.createDataFrame(sequences(4), "id long, s string")
    opened = w.run_windows(w.kmer_runs(d, ["id"], "s", 15, invalid=False), ["bucket"], 15).distinct()
    plan = opened.join(opened.withColumnRenamed("bucket", "b"), "kmer")._jdf.queryExecution().optimizedPlan().toString()
    above = [line for line in plan.split("\n") if " at#" in line and "_first#" in line and "Generate" not in line]
    assert above and not any(str(0x5555555555555555) in line for line in above)
    assert not any("Filter" in line and "shiftleft" in line for line in plan.split("\n"))


@pytest.mark.parametrize("most", [7, 64, w.SLICE])
def test_counts_of_sequences_equal_those_of_rows(spark, most):
    """Keys of several slices or rows too, whose distinct k-mers are no sum."""
    d = spark.createDataFrame([*sequences(6), (5, "CGATTACA" * 20)], "id long, s string")
    found = w.sequence_counts(d, ["id"], "s", 15, most)
    wanted = w.window_kmers(d, ["id"], "s", 15).groupBy("id").agg(F.count("*"), F.count("kmer"), F.count_distinct("kmer"), F.max("kmer"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_tasks_follow_the_size_of_texts(spark, monkeypatch, small):
    """Four times the texts have four times the tasks and files of the database, at the same size of a task."""
    from basewise.plans import store, workload

    d = spark.createDataFrame([(i, "x" * 1000) for i in range(40)], "id long, s string")
    monkeypatch.setattr(store, "TASK_CHARS", 1000)
    assert store.tasks_for(d.where("id < 10"), "s") == 10 and store.tasks_for(d, "s") == 40 and store.tasks_for(d.where("id < 0"), "s", 3) == 3
    monkeypatch.setattr(workload, "_tasks", {})
    assert workload.buckets(spark, small) > workload.BUCKETS and workload.reads(spark, small).rdd.getNumPartitions() > 8


def test_tables_in_buckets_are_written_bucket_by_bucket(spark, tmp_path):
    """A task writes one bucket, not those of a split of the files, which grows with the table."""
    from basewise.plans import store

    rows = spark.range(4000).select(F.col("id").alias("kmer"), (F.col("id") % 997).cast("int").alias("bucket"))
    made = store.stash_buckets(rows.repartition(24, "bucket"), "test", 24)
    again = store.bucketed(made.withColumn("task", F.spark_partition_id()), f"file://{tmp_path}/again", 24)
    assert again.select("task").distinct().count() == 24 and again.groupBy("bucket").agg(F.count_distinct("task").alias("n")).where("n > 1").count() == 0
    assert sorted(map(tuple, again.select("kmer", "bucket").collect())) == sorted(map(tuple, rows.collect()))
