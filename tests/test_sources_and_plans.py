"""Readers, settings, goals, streaming and a whole project from files."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from basewise.__main__ import main
from basewise.operators import build as b
from basewise.operators import match as m
from basewise.operators import membership
from basewise.plans.config import config, read_properties
from basewise.plans.dag import Goal, Graph
from basewise.plans.project import Project
from basewise.plans.store import with_number
from basewise.sources import kraken, ncbi, reads, sinks
from basewise.streaming import match_stream

from .test_functions import canonical


def lines(spark, *rows):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "value string, line long")


def test_wrapped_fastq(spark, tmp_path):
    text = "@S one\nGATTTG\nGGG\n+\n!''*(\n@(((\n@T\nC\nG\n+\n~\n~\n"
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gzip", "wt") as f:
        f.write(text)
    for name in ("a.fastq", "b.fq.gzip"):
        got = reads.read_any(spark, [("k", str(tmp_path / name))]).orderBy("read_no").collect()
        assert [(r.key, r.read_no, r.descriptor, r.seq, r.qual) for r in got] == [("k", 0, "@S one", "GATTTGGGG", "!''*(@((("), ("k", 1, "@T", "CG", "~~")]


def test_fasta_and_formats(spark, tmp_path):
    (tmp_path / "g.fasta").write_bytes(b">NC_1 first one\r\nACGT\r\nAC\r\n>NC_2\nTTTT\n\n>NC_3 x\nGG")
    got = reads.read_fasta(spark, [str(tmp_path / "g.fasta")]).orderBy("region_no").collect()
    assert [(r.region_no, r["info"], r.seq) for r in got] == [(0, "NC_1 first one", "ACGTAC"), (1, "NC_2", "TTTT"), (2, "NC_3 x", "GG")]
    assert [r.descriptor for r in reads.fasta_as_reads(reads.read_fasta(spark, [str(tmp_path / "g.fasta")])).orderBy("read_no").collect()] == ["@NC_1 first one", "@NC_2", "@NC_3 x"]
    names = spark.createDataFrame([(x,) for x in ("a.fa", "a.FNA.gz", "b.fq.gzip", "c.fastq", "d.txt")], "p string")
    assert [r[0] for r in names.select(reads.format_of(F.col("p"))).collect()] == ["fasta", "fasta", "fastq", "fastq", None]
    assert reads.map_file("k1 a.fq # x\n# no\nk2  b c.fq\nk1 d.fq") == [("k1", "a.fq"), ("k2", "b c.fq"), ("k1", "d.fq")]
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    for name in ("one/a.fq", "two/a.fq", "two/b1.fq", "two/b2.fq"):
        (tmp_path / name).write_text("")
    places = [str(tmp_path / "one"), str(tmp_path / "two")]
    assert reads.resolved(spark, "a.fq", places) == [f"{tmp_path}/one/a.fq"] and reads.resolved(spark, f"{tmp_path}/two/a.fq", places) == [f"{tmp_path}/two/a.fq"]
    assert [x.rsplit("/", 1)[1] for x in reads.resolved(spark, "b*.fq", places)] == ["b1.fq", "b2.fq"] and reads.resolved(spark, "hdfs://a", places) == ["hdfs://a"]
    with pytest.raises(FileNotFoundError):
        reads.resolved(spark, "c.fq", places)
    assert reads.merged([("k", "a"), ("l", "b"), ("k", "c")]) == {"k": ["a", "c"], "l": ["b"]}


def test_control_files(spark):
    n = ncbi.nodes(lines(spark, "1\t|\t1\t|\tno rank\t|\t\t|", "2\t|\t1\t|\tspecies\t|"))
    assert [(r.tax_id, r.parent_id, r["rank"]) for r in n.orderBy("ord").collect()] == [("1", "1", "no rank"), ("2", "1", "species")]
    names = ncbi.names(lines(spark, "1\t|\tfirst\t|\t\t|\tsynonym\t|", "1\t|\tright\t|\t\t|\tscientific name\t|", "1\t|\tlast\t|\t\t|\tsynonym\t|", "2\t|\tonly\t|\t\t|\tsynonym\t|", "2\t|\tmore\t|\t\t|\tsynonym\t|"))
    assert {r.tax_id: r.name for r in names.collect()} == {"1": "right", "2": "only"}
    c = lines(spark, "9\tx\tNC_1\tcomplete|vertebrate_other\tREVIEWED", "9\tx\tNM_1\tcomplete|other\tREVIEWED", "8\tx\tNZ_1\tother\tMODEL", "bad")
    take = lambda **k: sorted(r.accession for r in ncbi.catalog(c, **k).collect())
    assert take(categories=("other",)) == ["NZ_1"] and take(categories=("other",), substring=True) == ["NC_1", "NZ_1"] and take(seq_type="M_RNA") == ["NM_1"] and take(statuses=("REVIEWED",)) == ["NC_1"]
    w = ncbi.wanted_taxa(lines(spark, "# c", "11 # x", "name\t-12", "", "13"))
    assert [(r.tax_id, r.exclude) for r in w.collect()] == [("11", False), ("12", True), ("13", False)]
    assert [r.category for r in ncbi.wanted_categories(lines(spark, "viral # v", "nonsense", "#bacteria")).collect()] == ["viral"]
    assert [(r.tax_id, r.file, r.url, r.md5) for r in ncbi.additional_files(lines(spark, "9 a.fa", "8 b.fa http://u m # c")).collect()] == [("9", "a.fa", None, None), ("8", "b.fa", "http://u", "m")]
    assert [tuple(r) for r in ncbi.checksums(lines(spark, "abc\tf.gz")).collect()] == [("f.gz", "abc")]
    assert [r.file for r in ncbi.installed_files(lines(spark, "x\tviral.2.genomic.fna.gz", "x\tviral.1.genomic.fna", "x\tviral.1.rna.fna", "x\tfungi.1.genomic.fna"), ("viral",)).collect()] == ["viral.1.genomic.fna", "viral.2.genomic.fna.gz"]
    assert ncbi.release_state("1", "1 ") == "CURRENT" and ncbi.release_state("1", "2") == "OUTDATED" and ncbi.release_state(None, "2") == "UNKNOWN"


def test_third_party_lines(spark):
    rows = kraken.per_read(lines(spark, "C\tr1\t7\t100\t0:2 7:5 A:3 8:1", "U\tr2\t0\t50\t0:20", "C\tr3\t8\t50\t8:4 7:1 "))
    assert [(r.pos, r.label, r.n) for r in kraken.segments(rows).where("read = 'r1'").orderBy("pos").collect()] == [(0, "0", 2), (2, "7", 5), (10, "8", 1)]
    assert {r.tax_id: (r.reads, r.kmers, r.kmers_in_matching_reads) for r in kraken.result_counts(rows).collect()} == {"7": (1, 6, 0), "0": (1, 22, 20), "8": (1, 5, 4)}


def test_settings():
    c = config({"kMerSize": "21", "maxDust": "x", "stepSize": "99"}, read_properties("# c\nkMerSize = 25\nclassifyReads=false\nmaxReadTaxErrorCount=0.5"), {"seqType": "nonsense"})
    assert (c["kMerSize"], c["maxDust"], c["stepSize"], c["classifyReads"], c["maxReadTaxErrorCount"], c["seqType"]) == (25, -1, 1, False, 0.5, "GENOMIC")


def test_goals_are_made_once(spark, tmp_path):
    made = []
    g = Graph(spark, str(tmp_path))
    g.add(Goal("a", lambda: made.append("a") or spark.range(3), kept=True))
    g.add(Goal("b", lambda a: made.append("b") or a.where("id > 0"), ("a",)))
    assert g.table("b").count() == 2 and g.table("b").count() == 2 and made == ["a", "b"]
    again = Graph(spark, str(tmp_path), dict(g.goals))
    assert again.table("b").count() == 2 and made == ["a", "b", "b"] and again.dependents("a") == ["b"]
    again.clean_all("b")
    assert again.table("b").count() == 2 and made == ["a", "b", "b", "a", "b"]
    with pytest.raises(KeyError):
        g.add(Goal("c", lambda x: x, ("missing",)))


@pytest.fixture
def project(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("".join(f"{a}\t|\t{p}\t|\t{r}\t|\n" for a, p, r in (("1", "1", "no rank"), ("2", "1", "genus"), ("3", "2", "species"), ("4", "2", "species"))))
    (tmp_path / "names.dmp").write_text("".join(f"{a}\t|\tname{a}\t|\t\t|\tscientific name\t|\n" for a in "1234"))
    one, two = "ACGTTGCAAGTCCGATTACAGGCATCGATTGCA", "TTGACCGGATACCATGCAAGTCTTGCAGGACTA"
    (tmp_path / "g.fasta").write_text(f">NC_1 one\n{one[:20]}\n{one[20:]}\n>NC_2 two\n{two}\n>XX_9 none\nAAAA\n")
    (tmp_path / "catalog.txt").write_text("3\tn\tNC_1\tviral\tREVIEWED\n4\tn\tNC_2\tviral\tREVIEWED\n77\tn\tNC_3\tviral\tREVIEWED\n")
    (tmp_path / "r.fastq").write_text(f"@a x\n{one[2:28]}\n+\n{'~' * 26}\n@b\n{two[1:25]}\n+\n{'~' * 24}\n@c\n{'A' * 25}\n+\n{'~' * 25}\n")
    p = Project(spark, "proj", str(tmp_path), str(tmp_path / "nodes.dmp"), str(tmp_path / "names.dmp"), [str(tmp_path / "g.fasta")], str(tmp_path / "catalog.txt"), settings={"kMerSize": 15, "writeKrakenStyleOut": True, "writeFilteredFastq": True})
    return p, p.inputs([("k", str(tmp_path / "r.fastq"))])


def test_project_from_files(spark, tmp_path, project):
    p, rows = project
    made = p.match(rows)
    assert {r.read_no: r.class_id for r in made["classes"].collect()} == {0: "3", 1: "4", 2: None}
    rep = {r.tax_id: r for r in made["report"].collect()}
    assert rep["3"].kmers == 12 and rep["2"].acc_kmers == 22 and rep["1"].acc_reads == 2 and rep[None].kmers == 12 + 10 + 11
    kept, dumped = p.filter(rows)
    assert sorted(r.read_no for r in kept.collect()) == [0, 1] and [r.read_no for r in dumped.collect()] == [2]
    path = p.write_match(rows, "k")
    assert spark.read.option("sep", ";").option("header", True).csv(path).count() == 5
    assert spark.read.text(f"{tmp_path}/proj_match_k.out").count() == 3
    assert reads.read_fastq(spark, [f"{tmp_path}/proj_match_k.fastq/part*"]).count() == 2
    assert p.table("dbinfo").where("pos = 0").first().stored_kmers == p.table("db").count() == 38
    assert {r.tax_id: (r.tp, r.tp_fn) for r in p.table("dbquality").where("rank = 'species'").collect()} == {"3": (19, 19), "4": (19, 19)}
    assert {r.tax_id: r.db_kmers for r in p.table("filldb").groupBy("tax_id").agg(F.count("*").alias("db_kmers")).collect()} == {"3": 19, "4": 19}
    sinks.save_database(p.table("db"), p.table("taxtree"), {"k": "15"}, f"{tmp_path}/saved")
    db, tax = sinks.load_database(spark, f"{tmp_path}/saved")
    assert db.count() == 38 and tax.count() == 4 and sinks.load_config(spark, f"{tmp_path}/saved")["k"] == "15"


def test_project_with_artificial_nodes(spark, tmp_path, project):
    """K-mers are stored at accessions, those of two accessions at their file's node."""
    one, two = "ACGTTGCAAGTCCGATTACAGGCATCGATTGCA", "TTGACCGGATACCATGCAAGTCTTGCAGGACTA"
    (tmp_path / "h.fasta").write_text(f">NC_1 one\n{one}\n>NC_3 one\n{one[:20]}\n>NC_2 two\n{two}\n")
    (tmp_path / "catalog.txt").write_text("3\tn\tNC_1\tviral\tREVIEWED\n3\tn\tNC_3\tviral\tREVIEWED\n4\tn\tNC_2\tviral\tREVIEWED\n")
    (tmp_path / "taxids.txt").write_text("3\n")
    given = {"kMerSize": 15, "dataNodes": True, "fileNodes": True, "idNodes": True, "maxGenomesPerTaxid": 2}
    p = Project(spark, "grown", str(tmp_path), str(tmp_path / "nodes.dmp"), str(tmp_path / "names.dmp"), [str(tmp_path / "h.fasta")], str(tmp_path / "catalog.txt"), str(tmp_path / "taxids.txt"), settings=given)
    tax = {r.tax_id: r for r in p.table("taxtree").collect()}
    stored = {(tax[r.tax_id]["rank"], tax[r.tax_id].name): r.db_kmers for r in p.table("dbkmers").collect()}
    assert stored == {("ID", "NC_1"): 13, ("FILE", "h.fasta"): 6}, "taxon 4 is not asked for; k-mers of both accessions lie at their file"
    assert sorted(r["rank"] for r in tax.values() if r.tax_id.startswith("00")) == ["DATA", "FILE", "ID", "ID"]
    assert {r.natural_id: r.tax_id for r in p.table("regions").where("natural_id = '4'").collect()} == {"4": "4"}
    made = p.match(project[1])
    classes = {r.read_no: r.class_id for r in made["classes"].collect()}
    assert tax[classes[0]].name == "NC_1" and classes[1] is None
    assert {r.tax_id: r.acc_kmers for r in made["report"].collect()}["3"] == 12


@pytest.mark.parametrize("listed, want", [("bacteria\nviral # these\n", {"NC_1", "NC_2"}), ("bacteria\n", {"NC_2"}), ("# none\nmartian\n", set())])
def test_project_takes_the_listed_categories(spark, tmp_path, project, listed, want):
    (tmp_path / "catalog.txt").write_text("3\tn\tNC_1\tviral\tREVIEWED\n4\tn\tNC_2\tbacteria|complete\tREVIEWED\n")
    (tmp_path / "categories.txt").write_text(listed)
    old = project[0]
    p = Project(spark, "listed", old.folder, old.nodes, old.names, old.genomes, old.catalog, settings={"kMerSize": 15}, categories=str(tmp_path / "categories.txt"))
    assert {r.accession for r in p.table("accmap").collect()} == {r.accession for r in p.table("regions").collect()} == want


def test_command_line(spark, tmp_path, project, capsys):
    out = tmp_path / "out"
    run = lambda *args: main([str(tmp_path), "-d", str(out), "-C", "kMerSize=15", "-C", "gzipFastqOutput=false", *args])
    lines = lambda name: [r.value for r in spark.read.text(f"{out}/{tmp_path.name}_{name}").collect()]
    (tmp_path / "map.txt").write_text("m r.fastq\n")
    assert run("match", "matchlr", "-k", "k", "-f", "r.fastq", "-m", str(tmp_path / "map.txt")) == 0
    assert len(lines("match_k.csv")) == len(lines("match_m.csv")) == len(lines("matchlr_k.csv")) == 6
    run("filter", "extract", "fasta2fastq", "-k", "k", "-f", "r.fastq", "-C", "extractKey=a", "-C", "writeDumpedFastq=true")
    assert [len(lines(f"{n}_k.fastq")) for n in ("filter", "filter_dumped", "extract", "fasta2fastq")] == [8, 4, 4, 12]
    run("db2fastq", "-tx", "3")
    run("db2fastq", "dbinfo", "-tx", "2+")
    assert len(lines("db2fastq_3.fastq")) == 4 * 19 and len(lines("db2fastq_2%2B.fastq")) == 4 * 38 and len(lines("dbinfo.csv")) == 6
    capsys.readouterr()
    run("show")
    shown = capsys.readouterr().out
    run("showall")
    assert "dbconf" in capsys.readouterr().out and "dbconf" not in shown and "db:" in shown
    run("match", "-t", "clean", "-k", "k", "-f", "r.fastq")
    run("db", "-t", "cleanall")
    assert not (out / f"{tmp_path.name}_match_k.csv").exists() and not (out / tmp_path.name / "db").exists() and not (out / tmp_path.name / "taxtree").exists()


def test_stream_equals_batch(spark, tmp_path, project):
    p, rows = project
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    db = p.table("db")
    rows.where("read_no = 0").write.parquet(folder)
    match_stream.start(match_stream.read_stream(spark, folder, 1), db, 15, state).awaitTermination()
    rows.where("read_no > 0").unionByName(rows.where("read_no = 0").withColumn("read_no", F.lit(9).cast("long"))).write.mode("append").parquet(folder)
    match_stream.start(match_stream.read_stream(spark, folder, 1), db, 15, state).awaitTermination()  # goes on after the first
    every = rows.unionByName(rows.where("read_no = 0").withColumn("read_no", F.lit(9).cast("long")))
    w = m.lookup(every, db, 15)
    cols = ["key", "tax_id", "kmers", "contigs", "squared_sum", "max_len", "reads_1kmer", "unique_kmers"]
    batch = m.contig_stats(m.segments(w), every).join(m.unique_kmers(w), ["key", "tax_id"]).select(cols)
    assert sorted(map(tuple, match_stream.counts(spark, state).select(cols).collect())) == sorted(map(tuple, batch.collect()))
    match_stream.compact(spark, state, str(tmp_path / "small"))
    assert sorted(map(tuple, match_stream.counts(spark, str(tmp_path / "small")).select(cols).collect())) == sorted(map(tuple, batch.collect()))


def test_membership_filter(spark):
    keys = spark.range(0, 40_000, 2).withColumnRenamed("id", "k")
    f = membership.build(keys, "k", 0.01)
    got = membership.probe(spark.range(40_000).withColumnRenamed("id", "k"), "k", f).groupBy((F.col("k") % 2).alias("odd")).agg(F.avg(F.col("maybe").cast("int")).alias("share")).collect()
    share = {r.odd: r.share for r in got}
    assert share[0] == 1 and share[1] < 0.02


def test_limits_and_assemblies(spark):
    rows = [("f", i, "2" if i < 6 else "3", "ACGT" * 10) for i in range(9)]
    regions = spark.createDataFrame(rows, "file string, region_no long, tax_id string, seq string")
    count = lambda **k: {r.tax_id: r["count"] for r in b.within_limits(regions, b.Plan(k=15, **k)).groupBy("tax_id").count().collect()}
    assert count(max_genomes=2) == {"2": 2, "3": 2} and count(max_kmers=30) == {"2": 2, "3": 2}
    cut = b.within_limits(regions, b.Plan(k=15, max_kmers=30)).where("tax_id = '2'").agg(F.sum(F.length("seq") - 14)).first()[0]
    assert cut == 30
    a = spark.createDataFrame([("2", "CHROMOSOME_LATEST", 1, False), ("2", "COMPLETE_LATEST", 2, True), ("2", "COMPLETE_LATEST", 3, False), ("2", "CONTIG", 4, True)], "tax_id string, quality string, line long, is_reference boolean")
    taxa = spark.createDataFrame([("2",)], "tax_id string")
    assert [r.line for r in b.chosen_assemblies(a, taxa, 2).orderBy("line").collect()] == [2, 3] and [r.line for r in b.chosen_assemblies(a, taxa, 2, reference_only=True).collect()] == [2]
    assert canonical("CC") == canonical("GG")


@pytest.mark.parametrize("name, value", [("refseq.updateWithCompleteGenomesOnly", "true"), ("withProbs", "true"), ("genbank.maxPerTaxid", "3"), ("bloomFpp", "0.01")])
def test_a_setting_that_nothing_reads_is_an_error(spark, tmp_path, name, value):
    make = lambda given: Project(spark, "p", str(tmp_path), "nodes.dmp", "names.dmp", [], settings=given)
    with pytest.raises(ValueError, match=name):
        make({name: value})
    assert make({"kMerSize": 21}).k == 21


def test_large_fastq_comes_as_lines(spark, tmp_path):
    """Wrapped records, CRLF, gzip and several splits: as lines and as whole files."""
    r = random.Random(1)
    letters = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    wrap = lambda t, n, end: end.join(t[i : i + n] for i in range(0, len(t), n))
    want = {}
    for name, end in (("a.fastq", "\n"), ("b.fastq", "\r\n"), ("c.fastq.gz", "\n")):
        out, want[name] = [], []
        for k in range(300):
            seq, qual = letters(r.randint(1, 90)), ""
            qual = "".join(r.choice("@+IJ~") for _ in seq)  # quality lines may begin like a record
            want[name].append((k, f"@{name}{k}", seq, qual))
            out.append(f"@{name}{k}{end}{wrap(seq, 30, end)}{end}+{end}{wrap(qual, 25, end)}{end}")
        text = "".join(out).encode()
        (tmp_path / name).write_bytes(gzip.compress(text) if name.endswith("gz") else text)
    paths = [str(tmp_path / n) for n in want]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for whole in (1 << 28, 0):
            got = {n: [] for n in want}
            for x in reads.read_fastq(spark, paths, "k", whole).collect():
                got[x.file.rsplit("/", 1)[1]].append((x.read_no, x.descriptor, x.seq, x.qual))
            assert {n: sorted(v) for n, v in got.items()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_hold_over_several_splits(spark, tmp_path):
    for name, n in (("x.fna", 500), ("y.fna", 3), ("z.fna", 300)):
        (tmp_path / name).write_text("".join(f">{name}_{k} d\n{'ACGT' * (k % 9 + 1)}\nAC\n" for k in range(n)))
    (tmp_path / "lines.txt").write_text("".join(f"line {k}\n" for k in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = reads.read_fasta(spark, [str(tmp_path / "*.fna")]).collect()
        assert len(rows) == 803 and all(x.info == f"{x.file.rsplit('/', 1)[1]}_{x.region_no} d" and x.seq == "ACGT" * (x.region_no % 9 + 1) + "AC" for x in rows)
        rows = ncbi.lines(spark, str(tmp_path / "lines.txt")).orderBy("line").collect()
        assert [x.value for x in rows] == [f"line {k}" for k in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_are_numbered_over_ranges(spark):
    d = spark.range(1000).selectExpr("id % 7 as a", "id * 37 % 1000 as b").repartition(9)
    got = with_number(d, ["a", "b"], "n").collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.n)] == sorted((x.a, x.b) for x in got) and sorted(x.n for x in got) == list(range(1, 1001))
