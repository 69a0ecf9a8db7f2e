"""A project: control files, genomes and settings in; database, reports and filtered reads out."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build as b
from ..operators import filtering as fl
from ..operators import match as m
from ..operators import quality, taxonomy
from ..operators import report as rp
from ..sources import ncbi, reads, sinks
from .config import BIG, config, reject_not_built
from .dag import Goal, Graph


@dataclass
class Project:
    """Goals over one folder. Inputs are paths that Spark reads; any of the optional ones may be missing."""

    spark: SparkSession
    name: str
    folder: str
    nodes: str
    names: str
    genomes: list[str]
    catalog: str | None = None
    taxids: str | None = None
    #: Files whose regions all belong to one taxon: `taxid file` lines.
    additional: str | None = None
    settings: dict[str, Any] = field(default_factory=dict)
    #: The catalog's categories to take, a line each; all without it.
    categories: str | None = None

    def __post_init__(self) -> None:
        self.config = c = config(self.settings)
        reject_not_built(c)
        self.k = c["kMerSize"]
        self.graph = g = Graph(self.spark, f"{self.folder}/{self.name}")
        limit = lambda n: None if c[n] == BIG else c[n]
        self.plan = b.Plan(
            self.k, c["stepSize"], c["maxDust"], c["lowerCaseBases"], c["minUpdate"], limit("maxGenomesPerTaxid"), limit("maxKMersPerTaxid"), c["maxPerTaxidRank"]
        )
        self.rules = m.Rules(self.k, c["maxReadTaxErrorCount"], c["maxReadClassErrorCount"], c["minKMersForClass"], c["maxClassificationPaths"])
        lines = lambda path: ncbi.lines(self.spark, path)
        #: The levels of artificial nodes; with one of them the taxonomy of the goals below is a grown one, and these names are its natural parts.
        self.levels = {"data": c["dataNodes"], "files": c["fileNodes"], "ids": c["idNodes"]}
        grows = any(self.levels.values())
        natural = {n: f"natural{n}" if grows else n for n in ("taxtree", "taxnodes", "regions")}
        g.add(Goal(natural["taxtree"], lambda: taxonomy.numbered(ncbi.taxonomy_rows(ncbi.nodes(lines(self.nodes)), ncbi.names(lines(self.names)))), kept=True, about="the numbered taxonomy"))
        g.add(Goal(natural["taxnodes"], self._requested, (natural["taxtree"],), kept=True, about="the requested taxa"))
        if self.categories:
            g.add(Goal("categories", lambda: ncbi.wanted_categories(lines(self.categories)), about="the categories to take"))
        g.add(Goal("accmap", self._accessions, (natural["taxtree"],), about="accessions of the catalog"))
        g.add(Goal(natural["regions"], self._regions, ("accmap",), about="genome regions with their taxon"))
        if grows:
            g.add(Goal("artificialnodes", self._artificial, (natural["regions"], natural["taxtree"], natural["taxnodes"]), kept=True, about="nodes for data, files and accessions of requested taxa"))
            g.add(Goal("taxtree", taxonomy.grown, (natural["taxtree"], "artificialnodes"), kept=True, about="the taxonomy with artificial nodes"))
            g.add(Goal("taxnodes", lambda n, a: n.unionByName(a.select("tax_id")), (natural["taxnodes"], "artificialnodes"), kept=True, about="the requested taxa and their artificial nodes"))
            g.add(Goal("regions", lambda r, a: taxonomy.with_artificial_node(self._named(r), a, **self.levels), (natural["regions"], "artificialnodes"), about="genome regions at their artificial nodes"))
        g.add(Goal("closure", taxonomy.closure, ("taxtree",), kept=True, about="nodes with their ancestors"))
        g.add(Goal("fillsize", lambda r: b.size_estimate(r, self.plan), ("regions",), about="windows to be stored, and a sketch of the distinct ones"))
        g.add(Goal("filldb", lambda r, t: b.first_values(b.within_limits(r.join(t, "tax_id", "left_semi"), self.plan), self.plan), ("regions", "taxnodes"), about="k-mers with the first taxon that has them"))
        g.add(Goal("db", lambda r, t, u, n: b.build(r, t, u, n, self.plan, buckets=True), ("regions", "taxtree", "closure", "taxnodes"), kept=True, about="k-mers with the common ancestor of their taxa"))
        g.add(Goal("dbkmers", b.kmers_per_taxon, ("db",), kept=True, about="stored k-mers of each taxon"))
        g.add(Goal("dbinfo", lambda t, u, n, r: rp.db_info(t, u, n, self.k, r), ("taxtree", "closure", "dbkmers", "taxnodes"), about="the database by taxon, with distances"))
        g.add(Goal("index", b.filter_index, ("db", "taxnodes"), kept=True, about="k-mers of requested taxa"))
        g.add(Goal("db2fastq", lambda d, u: fl.database_reads(d, self.k, self.name, self._asked(u)), ("db", "closure"), about="a read for each stored k-mer, of the setting taxids if given"))
        g.add(Goal("dbconf", lambda: self.spark.createDataFrame(sorted((k, str(v)) for k, v in self.config.items()), "name string, value string"), about="the settings"))
        g.add(Goal("accmapsize", lambda: self._catalog().agg(F.count("*").alias("accessions")), about="catalog rows that are taken"))
        g.add(Goal("dbqualcounts", lambda r, d, u: quality.leaf_counts(r, d, u, self.k), ("regions", "db", "closure"), about="how well leaves are told apart"))
        g.add(Goal("dbquality", lambda q, t: quality.quality(q, t, ("cellular root", "acellular root", "species", "genus")), ("dbqualcounts", "taxtree"), about="the same, by rank"))
        g.add(Goal("extractrefseqfasta", fl.extracted_regions, (natural["regions"],), about="the regions as a classifier's library"))
        g.add(Goal("extractrefseqcsv", lambda r: r.select("accession", "tax_id"), (natural["regions"],), about="accession and taxon of each region"))

    def _requested(self, tax: DataFrame) -> DataFrame:
        if not self.taxids:
            return tax.select("tax_id")
        wanted = ncbi.wanted_taxa(ncbi.lines(self.spark, self.taxids)).join(tax.select("tax_id"), "tax_id", "left_semi")
        return taxonomy.requested(tax, wanted, self.config["rankCompletionDepth"])

    def _named(self, regions: DataFrame) -> DataFrame:
        """Regions whose header has no space go by the whole header."""
        return regions.withColumn("accession", F.coalesce("accession", F.regexp_replace("info", "^>", "")))

    def _artificial(self, regions: DataFrame, tax: DataFrame, requested: DataFrame) -> DataFrame:
        known = tax.join(requested, "tax_id", "left_semi")
        return taxonomy.artificial_nodes(known, self._named(regions).join(known.select("tax_id"), "tax_id", "left_semi"), **self.levels)

    def _asked(self, up: DataFrame) -> DataFrame | None:
        """The taxa of the setting taxids; + after one adds its descendants."""
        ids = self.config["taxids"]
        if not ids:
            return None
        own = self.spark.createDataFrame([(t.rstrip("+"), t.endswith("+")) for t in ids], "asked string, below boolean")
        found = up.join(own, F.col("anc") == F.col("asked")).where(F.col("below") | (F.col("node") == F.col("anc")))
        return found.select(F.col("node").alias("tax_id")).distinct()

    def _catalog(self) -> DataFrame:
        if not self.catalog:
            return self.spark.createDataFrame([], "accession string, tax_id string, categories string, status string")
        rows = ncbi.lines(self.spark, self.catalog)
        if not self.categories:
            return ncbi.catalog(rows, self.config["seqType"], (), self.config["refseq.status"])
        wanted = tuple(r.category for r in self.table("categories").collect())  # at most the fixed list
        found = ncbi.catalog(rows, self.config["seqType"], wanted, self.config["refseq.status"])
        return found if wanted else found.where(F.lit(False))

    def _accessions(self, tax: DataFrame) -> DataFrame:
        if not self.catalog:
            return self.spark.createDataFrame([], "accession string, tax_id string")
        rows = self._catalog()
        return ncbi.accession_map(rows, tax)

    def _regions(self, accessions: DataFrame) -> DataFrame:
        fasta = reads.read_fasta(self.spark, self.genomes).withColumn("file", F.element_at(F.split("file", "/"), -1))
        files = ncbi.additional_files(ncbi.lines(self.spark, self.additional)).select("file", "tax_id") if self.additional else None
        r = b.with_taxon(fasta, accessions, files)
        return r.where(b.is_complete(F.col("accession"))) if self.config["refseq.completeGenomesOnly"] else r

    def table(self, goal: str) -> DataFrame:
        return self.graph.table(goal)

    def inputs(self, files: list[tuple[str, str]]) -> DataFrame:
        """Reads of (key, path) pairs."""
        return reads.read_any(self.spark, files)

    def match(self, rows: DataFrame, classify: bool | None = None) -> dict[str, DataFrame]:
        """segments, classes and report of reads; without classification the report has no read columns filled."""
        classify = self.config["classifyReads"] if classify is None else classify
        tax, up = self.table("taxtree"), self.table("closure")
        windows = m.lookup(rows, self.table("db"), self.k)
        segs = m.read_segments(rows, self.table("db"), self.k)
        out = {"windows": windows, "segments": segs}
        stats = None
        if classify:
            out["classes"] = m.classify(rows, segs, tax, up, self.rules)
            stats = m.class_stats(out["classes"])
            out["lines"] = m.per_read_lines(rows, segs, out["classes"], self.k, self.config["writeAll"])
        unique = m.unique_kmers(windows) if self.config["countUniqueKMers"] else None
        report = rp.report(rp.taxon_rows(m.contig_stats(segs, rows), unique, stats), tax, up, self.table("dbkmers"), rp.totals(rows, self.k))
        if n := self.config["maxKMerResCounts"]:
            report = report.join(m.top_frequencies(windows, n).withColumnRenamed("counts", "max_kmer_counts"), ["key", "tax_id"], "left")
        return out | {"report": report}

    def filter(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Reads that the index keeps, and the others."""
        verdict = fl.accepted(rows, self.table("index"), self.k, self.config["minPosCountFilter"], self.config["posRatioFilter"])
        return fl.kept(rows, verdict), fl.dumped(rows, verdict)

    def result(self, goal: str, key: str = "", suffix: str = "") -> str:
        """Where a goal's result for a key goes."""
        return f"{self.folder}/{sinks.file_name(self.name, goal, key, suffix)}"

    def clean_results(self, goal: str, key: str = "") -> None:
        """Deletes what `match`, `matchlr` or `filter` wrote for a key."""
        for name in (goal, f"{goal}_dumped"):
            for suffix in (".csv", ".out", ".fastq"):
                sinks.delete(self.spark, self.result(name, key, suffix))

    def extract(self, rows: DataFrame) -> DataFrame:
        """Reads whose descriptor begins with the setting extractKey."""
        return fl.extracted(rows, self.config["extractKey"])

    def write_match(self, rows: DataFrame, key: str = "", classify: bool | None = None) -> str:
        """Writes the report and what else the settings ask for; returns the report's folder. Without classification it is the goal matchlr."""
        made = self.match(rows, classify)
        path = self.result("match" if classify is None else "matchlr", key, ".csv")
        sinks.write_csv(made["report"].orderBy("key", "pos"), path)
        if self.config["writeKrakenStyleOut"] and "lines" in made:
            sinks.write_lines(made["lines"].orderBy(*m.READ), f"{self.folder}/{sinks.file_name(self.name, 'match', key, '.out')}")
        if self.config["writeFilteredFastq"] and "classes" in made:
            found = rows.join(made["classes"].where("found"), m.READ, "left_semi")
            sinks.write_fastq(found, f"{self.folder}/{sinks.file_name(self.name, 'match', key, '.fastq')}", self.config["gzipFastqOutput"])
        return path
