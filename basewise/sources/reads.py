"""FASTQ and FASTA files as rows.

A task parses whole FASTQ files, record by record, up to `whole` bytes. Larger plain ones are
parsed split by split (fastq_splits.py). Larger zipped ones, which nothing can split, come
as lines that a task parses as they stream by. FASTA can be split: its text is
split at line breaks before >, and large plain files spread over tasks; regions are
numbered by adding up the splits, so sequences stay where they were read. Gzip is told by
the content for FASTQ (large files: by the suffix .gz) and by the suffix .gz for FASTA.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from itertools import groupby
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fastq_splits import read_splits

#: The suffixes of both formats.
FASTA_SUFFIXES, FASTQ_SUFFIXES, GZIP_SUFFIXES = ("fasta", "fa", "fna", "fas"), ("fastq", "fq"), ("gz", "gzip")
READ_SCHEMA = "key string, file string, read_no long, descriptor string, seq string, qual string"


def format_of(path: Column) -> Column:
    """fasta, fastq or null, by suffix."""
    zipped = f"([.]({'|'.join(GZIP_SUFFIXES)}))?$"
    return F.when(path.rlike(f"(?i)[.]({'|'.join(FASTA_SUFFIXES)}){zipped}"), "fasta").when(path.rlike(f"(?i)[.]({'|'.join(FASTQ_SUFFIXES)}){zipped}"), "fastq")


def parse_fastq(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """(descriptor, seq, qual). Sequence lines end at a line with +; quality lines follow until they are as long as the sequence."""
    for line in lines:
        descriptor = line.rstrip("\r\n")
        if not descriptor.startswith("@"):
            continue
        parts = []
        for s in lines:
            if s.startswith("+"):
                break
            parts.append(s.rstrip("\r\n"))
        seq, qual = "".join(parts), ""
        while len(qual) < len(seq):
            q = next(lines, None)
            if q is None:
                break
            qual += q.rstrip("\r\n")
        yield descriptor, seq, qual


def read_fastq(spark: SparkSession, paths: list[str], key: str = "", whole: int = 1 << 28) -> DataFrame:
    """Rows of READ_SCHEMA; read_no counts from 0 in each file. Files of up to `whole` bytes are parsed as one value each."""
    files = spark.read.format("binaryFile").load(paths)
    large = [r["path"] for r in files.where(F.col("length") > whole).where("not path like '%.gzip'").select("path").collect()]  # names of files
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = io.BytesIO(content.as_py())
                packed = raw.getbuffer()[:2] == b"\x1f\x8b"
                lines = io.TextIOWrapper(gzip.open(raw) if packed else raw, "utf-8", "replace", newline="\n")
                yield from _parsed(key, path, lines)

    found = files.where((F.col("length") <= whole) | F.col("path").like("%.gzip")).select("path", "content").mapInArrow(run, READ_SCHEMA)
    plain, packed = [p for p in large if not p.endswith(".gz")], [p for p in large if p.endswith(".gz")]
    if plain:
        found = found.unionByName(read_splits(spark, plain).select(F.lit(key).alias("key"), "file", "read_no", "descriptor", "seq", "qual"))
    if not packed:
        return found
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.option("lineSep", "\n").text(packed).select("value", *place)
    lines = lines.repartition("file").sortWithinPartitions("file", "split", "at").select("file", "value")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for path, own in groupby(rows, key=lambda r: r[0]):
            yield from _parsed(key, path, (v for _, v in own))

    return found.unionByName(lines.mapInArrow(stream, READ_SCHEMA))


def _parsed(key: str, path: str, lines: Iterator[str]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for n, (d, s, q) in enumerate(parse_fastq(iter(lines))):
        rows.append((key, path, n, d, s, q))
        if len(rows) == 10_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "file", "read_no", "descriptor", "seq", "qual"])


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, region_no, info, seq): region_no orders a file's regions; info is the line after >."""
    text = spark.read.option("lineSep", "\n>").text(paths)
    t = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.regexp_replace("value", "^>", "").alias("_v"))
    t = t.where(F.trim("_v") != "").withColumn("_at", F.monotonically_increasing_id())
    splits = t.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row for each split
    by = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    shift = splits.select(F.col("file").alias("_f"), F.col("_split").alias("_s"), (F.coalesce(F.sum("_n").over(by), F.lit(0)) - F.col("_first")).alias("_shift"))
    if shift.count() <= 200_000:
        shift = F.broadcast(shift)
    t = t.join(shift, (F.col("file") == F.col("_f")) & (F.col("_split") == F.col("_s")))
    info = F.regexp_replace(F.substring_index("_v", "\n", 1), "\r$", "")
    body = F.when(F.instr("_v", "\n") > 0, F.expr("substring(_v, instr(_v, '\n') + 1)")).otherwise("")
    number = (F.col("_at") + F.col("_shift")).cast("long")
    return t.select("file", number.alias("region_no"), info.alias("info"), F.translate(body, "\r\n", "").alias("seq"))


def fasta_as_reads(fasta: DataFrame, key: str = "") -> DataFrame:
    """FASTA regions as reads: the descriptor gets an @, there is no quality."""
    return fasta.select(F.lit(key).alias("key"), "file", F.col("region_no").alias("read_no"), F.concat(F.lit("@"), "info").alias("descriptor"), "seq", F.lit(None).cast("string").alias("qual"))


def read_any(spark: SparkSession, inputs: list[tuple[str, str]]) -> DataFrame:
    """All reads of (key, path) pairs, each in the format of its suffix; one scan for each key and format."""
    found = None
    for key, paths in merged(inputs).items():
        is_fasta = lambda path: re.sub(r"[.](gz|gzip)$", "", path.lower()).rpartition(".")[2] in FASTA_SUFFIXES
        fasta, fastq = [p for p in paths if is_fasta(p)], [p for p in paths if not is_fasta(p)]
        own = ([fasta_as_reads(read_fasta(spark, fasta), key)] if fasta else []) + ([read_fastq(spark, fastq, key)] if fastq else [])
        for rows in own:
            found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], READ_SCHEMA)


def map_file(text: str) -> list[tuple[str, str]]:
    """(key, path) pairs of a map file: `key path` lines, # comments; keys may repeat, their order stays."""
    pairs = [line.split("#")[0].split(None, 1) for line in text.splitlines()]
    return [(p[0], p[1].strip()) for p in pairs if len(p) == 2]


def resolved(spark: SparkSession, path: str, folders: list[str]) -> list[str]:
    """The files that a path names: itself if it is there or a URL, else in the first folder that has it; then as a pattern in the same places. An error if none has."""
    if "://" in path:
        return [path]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    places = [path] if PurePosixPath(path).is_absolute() else [path, *(f"{f.rstrip('/')}/{path}" for f in folders)]
    for pattern in (False, True):
        for place in places:
            p = jvm.org.apache.hadoop.fs.Path(place)
            fs = p.getFileSystem(conf)
            if not pattern and fs.exists(p):
                return [place]
            if pattern and (found := fs.globStatus(p)):
                return sorted(x.getPath().toString() for x in found)
    raise FileNotFoundError(f"{path} is in none of {', '.join(places)}")


def merged(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Paths by key, equal keys merged, in the order in which they first occur."""
    out: dict[str, list[str]] = {}
    for key, path in pairs:
        out.setdefault(key, []).append(path)
    return out
