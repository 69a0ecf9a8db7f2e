"""Readers of taxonomy dumps, catalogs and the small control files.

Every reader takes lines as a DataFrame (value), as `lines` reads them from text files, so
that the same expressions parse files, streams and test rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accession prefixes by the type of sequence.
PREFIXES = {"GENOMIC": ("AC_", "NC_", "NG_", "NT_", "NW_", "NZ_"), "RNA": ("NR_", "XR_"), "M_RNA": ("NM_", "XM_")}
PREFIXES["ALL_RNA"] = PREFIXES["RNA"] + PREFIXES["M_RNA"]
PREFIXES["ALL"] = PREFIXES["GENOMIC"] + PREFIXES["ALL_RNA"]
#: The catalog's categories.
CATEGORIES = (
    "archaea", "bacteria", "complete", "fungi", "invertebrate", "mitochondrion", "other", "plant", "plasmid", "plastid", "protozoa",
    "vertebrate_mammalian", "vertebrate_other", "viral",
)
#: Assembly levels as the summary names them.
LEVELS = {"Complete Genome": "COMPLETE", "Chromosome": "CHROMOSOME", "Scaffold": "SCAFFOLD", "Contig": "CONTIG"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the text lines of a file and what orders them: file, start of the split, place in it."""
    place = [F.lpad(x.cast("string"), 20, "0") for x in (F.col("_metadata.file_block_start"), F.monotonically_increasing_id())]
    return spark.read.text(path).select("value", F.concat_ws(" ", F.col("_metadata.file_path"), *place).alias("line"))


def _fields(value: Column) -> Column:
    """Fields of a dump line, which end with a tab and a bar."""
    return F.split(F.regexp_replace(value, r"\t\|\s*$", ""), r"\t\|\t", -1)


def nodes(dump: DataFrame) -> DataFrame:
    """(tax_id, parent_id, rank, ord) of lines (value, line); the root is its own parent."""
    f = _fields(F.col("value"))
    return dump.where("trim(value) <> ''").select(F.trim(f[0]).alias("tax_id"), F.trim(f[1]).alias("parent_id"), F.trim(f[2]).alias("rank"), F.col("line").alias("ord"))


def names(dump: DataFrame) -> DataFrame:
    """(tax_id, name): the last scientific name of an id, the first name of any kind if it has none."""
    f = _fields(F.col("value"))
    n = dump.where("trim(value) <> ''").select(F.trim(f[0]).alias("tax_id"), F.trim(f[1]).alias("name"), F.col("value").contains("scientific name").alias("sci"), "line")
    last = F.max_by("name", F.when(F.col("sci"), F.col("line")))
    return n.groupBy("tax_id").agg(F.coalesce(last, F.min_by("name", "line")).alias("name"))


def taxonomy_rows(node_rows: DataFrame, name_rows: DataFrame) -> DataFrame:
    """(tax_id, parent_id, name, rank, ord), the input of `taxonomy.numbered`."""
    return node_rows.join(name_rows, "tax_id", "left").select("tax_id", "parent_id", "name", "rank", "ord")


def catalog(rows: DataFrame, seq_type: str = "GENOMIC", categories: tuple[str, ...] = (), statuses: tuple[str, ...] = (), substring: bool = False) -> DataFrame:
    """(accession, tax_id, categories, status) of catalog lines: accessions of the type, in any of the categories, with any of the statuses.

    Categories are names between bars; with `substring` a category or status matches
    anywhere in its field, so that `other` also takes `vertebrate_other`.
    """
    f = F.split("value", "\t", -1)
    r = rows.where(F.size(f) >= 5).select(f[2].alias("accession"), f[0].alias("tax_id"), f[3].alias("categories"), f[4].alias("status"))
    r = r.where(F.col("accession").rlike(f"^({'|'.join(PREFIXES[seq_type])})"))
    for column, wanted in (("categories", categories), ("status", statuses)):
        if wanted:
            hit = F.lit(False)
            for w in wanted:
                hit = hit | (F.col(column).contains(w) if substring else F.array_contains(F.split(column, r"\|"), w))
            r = r.where(hit)
    return r


def accession_map(catalog_rows: DataFrame, tax: DataFrame) -> DataFrame:
    """(accession, tax_id) of the catalog rows whose id is in the taxonomy."""
    return catalog_rows.join(tax.select("tax_id"), "tax_id", "left_semi").select("accession", "tax_id")


def checksums(rows: DataFrame) -> DataFrame:
    """(file, md5) of `md5<tab>file` lines."""
    f = F.split("value", "\t", -1)
    return rows.where(F.size(f) >= 2).select(F.trim(f[1]).alias("file"), F.trim(f[0]).alias("md5"))


def installed_files(rows: DataFrame, categories: tuple[str, ...], seq_type: str = "GENOMIC") -> DataFrame:
    """(category, file), sorted: files of the wanted categories with the type's suffix, from lines whose second column is a file name."""
    kinds = {"GENOMIC": "genomic", "RNA": "rna", "M_RNA": "rna", "ALL_RNA": "rna", "ALL": "(genomic|rna)"}
    f = F.split("value", "\t", -1)
    r = rows.where(F.size(f) >= 2).select(F.substring_index(f[1], ".", 1).alias("category"), f[1].alias("file"))
    return r.where(F.col("category").isin(*categories) & F.col("file").rlike(rf"[.]{kinds[seq_type]}[.]fna([.]gz)?$")).orderBy("file")


def assemblies(rows: DataFrame) -> DataFrame:
    """(tax_id, species_id, is_reference, quality, path, line) of assembly summary lines (value, line)."""
    f = F.split("value", "\t", -1)
    r = rows.where(~F.col("value").startswith("#") & (F.size(f) >= 20))
    latest = f[10] == "latest"
    level = F.lit(None).cast("string")
    for name, short in LEVELS.items():
        level = F.when(f[11] == name, F.when(latest, f"{short}_LATEST").otherwise(short)).otherwise(level)
    quality = F.coalesce(level, F.when(latest, "LATEST").otherwise("NONE"))
    return r.select(f[5].alias("tax_id"), f[6].alias("species_id"), F.col("value").isNotNull().__and__(f[4] == "reference genome").alias("is_reference"), quality.alias("quality"), f[19].alias("path"), "line")


def wanted_taxa(rows: DataFrame) -> DataFrame:
    """(tax_id, exclude) of a list of ids: # begins a comment, the last tab field counts, - before an id excludes it."""
    v = F.trim(F.substring_index("value", "#", 1))
    last = F.trim(F.element_at(F.split(v, "\t"), -1))
    r = rows.select(last.alias("_t")).where("_t <> ''")
    return r.select(F.trim(F.regexp_replace("_t", "^-", "")).alias("tax_id"), F.col("_t").startswith("-").alias("exclude"))


def wanted_categories(rows: DataFrame) -> DataFrame:
    """(category) of a list of categories; unknown ones go."""
    v = F.trim(F.substring_index("value", "#", 1))
    return rows.select(v.alias("category")).where(F.col("category").isin(*CATEGORIES)).distinct()


def additional_files(rows: DataFrame) -> DataFrame:
    """(tax_id, file, url, md5) of `taxid file [url [md5]]` lines; # begins a comment."""
    f = F.split(F.trim(F.substring_index("value", "#", 1)), r"\s+")
    return rows.where(F.size(f) >= 2).select(f[0].alias("tax_id"), f[1].alias("file"), F.get(f, 2).alias("url"), F.get(f, 3).alias("md5"))


def release_state(installed: str | None, current: str | None) -> str:
    """CURRENT, OUTDATED or UNKNOWN."""
    if not installed or not current:
        return "UNKNOWN"
    return "CURRENT" if installed.strip() == current.strip() else "OUTDATED"
