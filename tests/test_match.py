"""Matching, classification and reports: literal cases, recounts and invariance."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basewise.functions import seq
from basewise.operators import build as b
from basewise.operators import filtering as fl
from basewise.operators import match as m
from basewise.operators import report as rp
from basewise.operators import taxonomy as t
from basewise.operators import windows as w

from .test_functions import canonical

READS = "key string, file string, read_no long, descriptor string, seq string, qual string"
NODES = "tax_id string, parent_id string, name string, rank string, ord long"


@pytest.fixture(scope="module")
def three(spark):
    """Root 1 with children 2 and 3."""
    x = t.numbered(spark.createDataFrame([("1", "1", "one", "no rank", 0), ("2", "1", "two", "species", 1), ("3", "1", "three", "species", 2)], NODES)).cache()
    return x, t.closure(x).cache()


def as_reads(spark, seqs):
    return spark.createDataFrame([("k", "f", i, f"@r{i} x", s, None) for i, s in enumerate(seqs)], READS)


def classified(spark, three, seqs, db, rules):
    r = as_reads(spark, seqs)
    d = spark.createDataFrame([(canonical(k), v) for k, v in db.items()], "kmer long, tax_id string")
    segs = m.segments(m.lookup(r, d, rules.k))
    return r, segs, m.classify(r, segs, *three, rules)


#: Limit of errors, reads and their classes, for k = 2 and the database CC 1, CT 2, CG 3.
CASES = {
    0: {"CCCC": "1", "GAGAGA": None, "CCCG": "3", "AGGGG": "2", "CCCCCCT": "2"},
    1: {"CTCCT": "2", "CTCTCCT": None, "TAGGGG": "2", "TAGGGGT": None},
    0.5: {"CCA": "1", "CCAA": None},
    0.1: {"CC": "1", "CCA": None, "CCAA": None},
    0.99: {"TTTT": None, "CTTT": "2"},
}


@pytest.mark.parametrize(("limit", "cases"), CASES.items())
def test_literal_classes(spark, three, limit, cases):
    _, _, c = classified(spark, three, list(cases), {"CC": "1", "CT": "2", "CG": "3"}, m.Rules(k=2, max_errors=limit, max_paths=4))
    assert [r.class_id for r in c.orderBy("read_no").collect()] == list(cases.values())


def test_thresholds_gates_and_bad_bases(spark, three):
    db = {"CC": "1", "CT": "2", "CG": "3"}
    run = lambda seqs, **k: [(r.class_id, r.read_kmers, r.errors, r.counted) for r in classified(spark, three, seqs, db, m.Rules(k=2, **k))[2].orderBy("read_no").collect()]
    assert run(["CCT"], min_kmers=2) == [("1", 1, 0, True)] and run(["CCT"], min_kmers=3) == [(None, None, 0, False)]
    # two unrelated winners meet at the root
    assert run(["CTNCG"])[0][:2] == ("1", 1)
    # bases that are none count once each, unless the windows have ended
    assert [x[2] for x in run(["CCNCC", "CCNNCC", "NCC", "CCN", "NN", "CCCN"])] == [1, 2, 1, 1, 1, 1]
    assert run(["CCAAAA"], max_class_errors=0.5)[0][3] is False and run(["CCAAAA"], max_class_errors=1)[0][3] is True
    assert run(["CCAAAA"], max_class_errors=1, strict_class_errors=True)[0][3] is False
    # with one path, the first unrelated node stays
    assert run(["CGNCTCT"], max_paths=1)[0][0] == "3" and run(["CGNCTCT"])[0][0] == "2"


def test_per_read_line(spark):
    """A read whose ends differ from the genome; all k-mers of the genome belong to the root."""
    genome = "AGTTGTTAGTCTACGTGGACCGACAAGAACAGTTTCGAATCGGAAGCTTGCTTAACGTAGTTCTAACAGTTTTTTATTAG"
    read = "AAAGTTGTTAGTCTACGTGGACCGACAAGAACAGTTTCGTT"
    x = t.numbered(spark.createDataFrame([("1", "1", "root", "no rank", 0)], NODES))
    up = t.closure(x)
    regions = spark.createDataFrame([("f", 0, "1", genome)], "file string, region_no long, tax_id string, seq string")
    db = b.build(regions, x, up, None, b.Plan(k=31))
    r = spark.createDataFrame([("", "f", 0, "@test", read, None), ("", "f", 1, "@short", "ACGT", None)], READS)
    segs = m.segments(m.lookup(r, db, 31))
    lines = m.per_read_lines(r, segs, m.classify(r, segs, x, up, m.Rules(k=31)), 31)
    assert [y.line for y in lines.collect()] == ["C\ttest\t1\t41\t0:2 1:7 0:2"]


def runs(labels):
    out = []
    for x in labels:
        if out and out[-1][0] == x:
            out[-1][1] += 1
        else:
            out.append([x, 1])
    return out


def test_statistics_equal_a_recount_and_do_not_depend_on_partitions(spark, three):
    r = random.Random(4)
    seqs = ["".join(r.choice("CGATN" if r.random() < 0.02 else "CGAT") for _ in range(80)) for _ in range(120)]
    db = {"CC": "1", "CT": "2", "CG": "3", "AA": "2"}
    codes = {canonical(k): v for k, v in db.items()}
    kmers, contigs, longest, unique, with_kmer = Counter(), Counter(), Counter(), {}, Counter()
    for s in seqs:
        w = [s[i : i + 2] for i in range(len(s) - 1)]
        labels = ["A" if "N" in x else codes.get(canonical(x), "0") for x in w]
        for label, n in runs(labels):
            if label in "123":
                kmers[label] += n
                contigs[label] += 1
                longest[label] = max(longest[label], n)
        for label in set(labels) & set("123"):
            with_kmer[label] += 1
        for x, label in zip(w, labels, strict=True):
            if label in "123":
                unique.setdefault(label, set()).add(canonical(x))
    d = spark.createDataFrame(list(codes.items()), "kmer long, tax_id string")
    seen = []
    for n in (1, 7):
        reads = as_reads(spark, seqs).repartition(n)
        w = m.lookup(reads, d, 2)
        segs = m.segments(w)
        got = {x.tax_id: x for x in m.contig_stats(segs, reads).collect()}
        assert {i: (x.kmers, x.contigs, x.max_len, x.reads_1kmer) for i, x in got.items()} == {i: (kmers[i], contigs[i], longest[i], with_kmer[i]) for i in kmers}
        assert {x.tax_id: x.unique_kmers for x in m.unique_kmers(w).collect()} == {i: len(s) for i, s in unique.items()}
        c = m.classify(reads, segs, *three, m.Rules(k=2))
        rows = rp.taxon_rows(m.contig_stats(segs, reads), m.unique_kmers(w), m.class_stats(c))
        rep = rp.report(rows, *three, b.kmers_per_taxon(d), rp.totals(reads, 2))
        total = next(x for x in rep.collect() if x.name == "TOTAL")
        assert (total.reads, total.kmers, total.reads_bps, total.db_kmers) == (120, 120 * 79, 120 * 80, 4)
        seen.append(sorted(map(str, rep.select("tax_id", "pos", "reads", "kmers", "max_desc", F.round("acc_norm_kmers", 9), F.round("error_sd", 9)).collect())))
        root = next(x for x in rep.collect() if x.tax_id == "1")
        assert root.acc_kmers == sum(kmers.values())
    assert seen[0] == seen[1]


def test_database_reads_match_exactly_what_is_stored(spark, three):
    r = random.Random(5)
    genome = lambda: "".join(r.choice("CGAT") for _ in range(300))
    shared = genome()
    regions = spark.createDataFrame([("f", 0, "2", genome() + shared), ("f", 1, "3", shared + genome().lower())], "file string, region_no long, tax_id string, seq string")
    db = b.build(regions, *three, None, b.Plan(k=15)).cache()
    stored = {x.tax_id: x.db_kmers for x in b.kmers_per_taxon(db).collect()}
    assert set(stored) == {"1", "2", "3"} and stored["1"] >= 286
    pseudo = fl.database_reads(db, 15, "p").select(F.lit("k").alias("key"), F.lit("f").alias("file"), (F.col("tax_id").cast("long") * 1_000_000 + F.col("n")).alias("read_no"), "descriptor", "seq", F.lit(None).cast("string").alias("qual"))
    w = m.lookup(pseudo, db, 15)
    assert {x.tax_id: x.unique_kmers for x in m.unique_kmers(w).collect()} == stored
    assert {x.tax_id: x.kmers for x in m.contig_stats(m.segments(w), pseudo).collect()} == stored
    info = {x.tax_id: x for x in rp.db_info(*three, b.kmers_per_taxon(db), 15).collect()}
    assert info[None].stored_kmers == sum(stored.values()) and 0 < info["2"].distance < 1
    assert rp.tree_drawing(rp.db_info(*three, b.kmers_per_taxon(db), 15)).count("<text") == 3
    wanted = spark.createDataFrame([("2",)], "tax_id string")
    part = b.build(regions, *three, wanted, b.Plan(k=15))
    assert {x.tax_id: x.db_kmers for x in b.kmers_per_taxon(part).collect()} == {"1": stored["1"], "2": stored["2"]}
    sums = {b.checksum(db.repartition(n)).first() for n in (1, 5)}
    assert len(sums) == 1


def test_filter_keeps_what_matches(spark):
    index = spark.createDataFrame([(canonical("CCC"),), (canonical("ACG"),)], "kmer long")
    r = as_reads(spark, ["CCCCC", "CCCTTTTTTT", "TTTTTT", "GGG", "NNCCCN", "AC"])
    names = lambda d: sorted(x.read_no for x in d.collect())
    one = fl.accepted(r, index, 3, 1)
    assert names(fl.kept(r, one)) == [0, 1, 3, 4] and names(fl.dumped(r, one)) == [2, 5]
    assert names(fl.kept(r, fl.accepted(r, index, 3, 0, 0.5))) == [0, 3]
    assert names(fl.extracted(r, "r1")) == [1]
    assert r.select(fl.fastq_text(F.col("descriptor"), F.col("seq"))).first()[0] == "@r0 x\nCCCCC\n+\n~~~~~"
    assert spark.range(1).select(seq.decode(F.lit(canonical("CCC")), 3)).first()[0] == "GGG"


@pytest.mark.parametrize("most", [1, m.CROWD])
def test_hits_by_key_are_those_of_the_windows(spark, monkeypatch, most):
    """With every minimizer crowded too, when a k-mer is looked up in several cells."""
    monkeypatch.setattr(m, "LOOKED_AT", 1.0)
    r = random.Random(5)
    rows = [(f"k{i % 2}", "f", i, f"@r{i}", "".join(r.choices("CGAT", k=40)) + "CAGGTCATTG" * 3 + "N" * (i % 3)) for i in range(12)]
    reads = spark.createDataFrame(rows, "key string, file string, read_no long, descriptor string, seq string")
    db = w.window_kmers(reads.where("read_no < 8"), ["file"], "seq", 7, invalid=False).select("kmer").distinct().withColumn("tax_id", F.concat(F.lit("t"), F.col("kmer") % 3))
    wanted = {tuple(x) for x in m.lookup(reads, db, 7).groupBy("key", "label", "kmer").agg(F.count("*").alias("n")).collect()}
    found = m.key_hits(reads, db, 7, most=most)
    got = [tuple(x) for x in found.select("key", "label", "kmer", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert set(map(tuple, m.unique_kmers(found).collect())) == set(map(tuple, m.unique_kmers(m.lookup(reads, db, 7)).collect()))


def test_a_database_is_not_dealt_by_taxon(spark, three):
    """Requested taxa come to the k-mers, or all k-mers of a common taxon would meet in one task."""
    db = spark.range(1000).select(F.col("id").alias("kmer"), F.when(F.col("id") % 10 == 0, "2").otherwise("3").alias("tax_id"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = t.descendants(three[0], spark.createDataFrame([("2",)], "tax_id string"))
        index = b.filter_index(db, wanted)
        plan = index._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r.kmer for r in index.collect()) == list(range(0, 1000, 10))
        reads = fl.database_reads(db, 15, "p", wanted).collect()
        assert sorted((r.n, r.seq) for r in reads) == sorted((i, r[0]) for i, r in enumerate(db.where("tax_id = '2'").orderBy("kmer").select(seq.decode(F.col("kmer"), 15)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_runs_go_back_to_reads_in_as_many_tasks_as_the_look_up(spark):
    """A shuffle's partitions would be put together until each task holds a core's share of the input."""
    reads = as_reads(spark, ["CGATTACAGATTACA" * 3] * 40)
    found = m.read_segments(reads, spark.createDataFrame([(canonical("CGATT"), "2")], "kmer long, tax_id string"), 5, 24)
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 16
