"""The engine's settings: one typed registry, with ranges and defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Setting:
    name: str
    default: Any
    #: Inclusive range of numbers, or the values allowed.
    allowed: tuple = ()
    about: str = ""

    def parse(self, text: Any) -> Any:
        """The value of text; the default if it does not parse or is out of range."""
        kind = type(self.default) if self.default is not None else str
        try:
            if kind is bool:
                value = {"true": True, "false": False}[str(text).strip().lower()]
            elif kind is tuple:
                value = tuple(x.strip() for x in str(text).split(",") if x.strip())
            else:
                value = kind(str(text).strip())
        except (KeyError, ValueError):
            return self.default
        if self.allowed and kind in (int, float) and not self.allowed[0] <= value <= self.allowed[1]:
            return self.default
        if self.allowed and kind is str and value not in self.allowed:
            return self.default
        return value


BIG = 2**63 - 1
SETTINGS = {
    s.name: s
    for s in (
        Setting("kMerSize", 31, (15, 31), "length of a k-mer"),
        Setting("seqType", "GENOMIC", ("GENOMIC", "RNA", "M_RNA", "ALL_RNA", "ALL"), "accession prefixes and file suffixes"),
        Setting("rankCompletionDepth", None, (), "rank down to which descendants are requested"),
        Setting("maxGenomesPerTaxid", BIG, (1, BIG), "regions of a taxon"),
        Setting("maxKMersPerTaxid", BIG, (1, BIG), "windows of a taxon"),
        Setting("maxPerTaxidRank", None, (), "rank whose nodes the limits count by"),
        Setting("refseq.filldb", True, (), "take catalog genomes"),
        Setting("refseq.completeGenomesOnly", False, (), "take complete records only"),
        Setting("refseq.status", (), (), "catalog statuses taken; none: all"),
        Setting("refseq.limitForGenbankAccess", 0, (0, BIG), "regions under which a taxon needs further assemblies"),
        Setting("refseq.limitForGenbankRank", "species", (), "rank of the taxa so checked"),
        Setting("genbank.maxPerTaxid", 1, (0, BIG), "assemblies of a taxon"),
        Setting("genbank.fastaQualities", ("COMPLETE_LATEST", "CHROMOSOME_LATEST"), (), "qualities taken"),
        Setting("genbank.referenceOnly", False, (), "reference assemblies only"),
        Setting("maxDust", -1, (-1, 32767), "greatest low-complexity score; off under 0"),
        Setting("minUpdate", False, (), "only requested regions lift k-mers"),
        Setting("refseq.updateWithCompleteGenomesOnly", False, (), "only complete records lift k-mers"),
        Setting("stepSize", 1, (1, 31), "keep every n-th window of a genome"),
        Setting("dataNodes", False, (), "artificial nodes for a taxon's own data"),
        Setting("fileNodes", False, (), "artificial nodes for files"),
        Setting("idNodes", False, (), "artificial nodes for accessions"),
        Setting("lowerCaseBases", True, (), "take lower-case bases of genomes"),
        Setting("classifyReads", True, (), "classify reads, not only k-mers"),
        Setting("countUniqueKMers", True, (), "count distinct k-mers"),
        Setting("writeFilteredFastq", False, (), "write matched reads"),
        Setting("writeDumpedFastq", False, (), "write rejected reads"),
        Setting("writeKrakenStyleOut", False, (), "write a line for each read"),
        Setting("writeAll", True, (), "lines also of unclassified reads"),
        Setting("withProbs", False, (), "keep qualities"),
        Setting("gzipFastqOutput", True, (), "compress written reads"),
        Setting("maxReadTaxErrorCount", -1.0, (-1.0, float(BIG)), "errors of a read: a count from 1 on, a share below, off under 0"),
        Setting("maxReadClassErrorCount", -1.0, (-1.0, float(BIG)), "errors against a read's class"),
        Setting("minKMersForClass", 1, (1, BIG), "k-mers that a class needs"),
        Setting("maxKMerResCounts", 0, (0, 65536), "greatest frequencies of k-mers reported"),
        Setting("maxClassificationPaths", 10, (1, 128), "unrelated nodes of a read"),
        Setting("minPosCountFilter", 1, (0, 1024), "hits that a kept read needs"),
        Setting("posRatioFilter", 0.2, (0.0, 1.0), "share of hits that a kept read needs if the count is 0"),
        Setting("extractKey", "", (), "beginning of the descriptors extracted"),
        Setting("taxids", (), (), "taxa whose k-mers become reads; + after one for its descendants"),
        Setting("bloomFpp", 0.001, (1e-12, 0.5), "false positives of a membership filter"),
    )
}

#: Settings that nothing reads yet.
NOT_BUILT = (
    "refseq.updateWithCompleteGenomesOnly", "refseq.filldb", "refseq.limitForGenbankAccess", "refseq.limitForGenbankRank", "genbank.maxPerTaxid", "genbank.fastaQualities",
    "genbank.referenceOnly", "withProbs", "bloomFpp",
)


def reject_not_built(values: Mapping[str, Any]) -> None:
    """Raises where a setting that nothing reads differs from its default."""
    if wrong := [n for n in NOT_BUILT if values[n] != SETTINGS[n].default]:
        raise ValueError(f"not built, leave at the default: {', '.join(wrong)}")


def read_properties(text: str) -> dict[str, str]:
    """name=value lines; # and ! begin comments."""
    pairs = [line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith(("#", "!"))]
    return {k.strip(): v.strip() for k, v in pairs}


def config(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """All settings; later layers win over earlier ones: base file, project file, command line."""
    given: dict[str, Any] = {}
    for layer in layers:
        given |= layer
    return {n: s.parse(given[n]) if n in given else s.default for n, s in SETTINGS.items()}


def settings_table() -> str:
    """Markdown of all settings."""
    rows = [f"| {s.name} | {s.default} | {s.allowed or ''} | {s.about}{' (not built)' if s.name in NOT_BUILT else ''} |" for s in SETTINGS.values()]
    return "\n".join(["| name | default | allowed | meaning |", "|-|-|-|-|", *rows])
