"""FASTQ by splits: any cut of a file gives the records of the whole."""

import random

import pandas as pd
import pyarrow as pa
import pytest

from basewise.plans.queries import small_splits
from basewise.sources import fastq_splits as fs
from basewise.sources import reads

KINDS = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())


def text(r, n):
    """Records wrapped anywhere, with CRLF, empty sequences, junk between them, and qualities that look like records; sometimes cut short."""
    out = []
    for i in range(n):
        size, width, end = r.choice([0, 1, 5, 12, 40]), r.choice([3, 5, 100]), r.choice(["\n", "\n", "\r\n"])
        seq, qual = ("".join(r.choice(x) for _ in range(size)) for x in ("CGAT", "@+IF~"))
        out += ["junk" + end] * (r.random() < 0.1) + [f"@r{i} x{end}"] + [seq[k : k + width] + end for k in range(0, max(size, 1), width)] + [r.choice(["+", "+x"]) + end] + [qual[k : k + width] + end for k in range(0, size, width)]
    whole = "".join(out)
    return whole[: r.randint(0, len(whole))] if r.random() < 0.3 else whole


def rows_of(table, n):
    return iter([pa.RecordBatch.from_arrays([pa.array([x[j] for x in table], KINDS[j]) for j in range(n)], [f"c{j}" for j in range(n)])] if table else [])


@pytest.mark.parametrize("seed", range(200))
def test_any_cut(seed):
    r = random.Random(seed)
    whole = text(r, r.randint(0, 12))
    lines = whole.split("\n")[: -1 if whole.endswith("\n") or not whole else None]
    want = list(reads.parse_fastq(iter(lines)))
    cuts = sorted({0, *(r.randint(0, len(lines)) for _ in range(r.randint(0, 6)))})
    table = [(x, "f", lo) for lo, hi in zip(cuts, [*cuts[1:], len(lines)], strict=True) for x in lines[lo:hi]]
    made = [b.to_pylist()[0] for b in fs._transitions(rows_of(table, 3))]
    if not made:
        assert not want
        return
    state = {x.split: (x.kind, x.number) for x in fs._product(pd.DataFrame(made)).itertuples()}
    table = [(*x, *state[x[2]]) for x in table]
    counts = {x["split"]: x["n"] for b in fs._counts(rows_of(table, 5)) for x in b.to_pylist()}
    table = [(*x, sum(n for s, n in counts.items() if s < x[2])) for x in table]
    got = {}
    for p in sorted((x for b in fs._parsed(rows_of(table, 6)) for x in b.to_pylist()), key=lambda p: (p["read_no"], p["split"])):
        own = got.setdefault(p["read_no"], [p["descriptor"], "", ""])
        own[1] += p["seq"]
        own[2] += p["qual"]
    assert [tuple(got[k]) for k in sorted(got)] == want and sorted(got) == list(range(len(want)))


def test_files_of_many_splits_equal_whole_files(spark, tmp_path):
    r = random.Random(5)
    paths = []
    for k in range(3):
        paths.append(str(tmp_path / f"r{k}.fastq"))
        with open(paths[-1], "w", newline="") as f:
            f.write("".join(text(r, 400).rstrip("\r\n") + "\n" for _ in range(4)) if k else f"@one\n{'ACGT' * 9000}\n+\n{'@' * 36000}\n@two\nAC\n+\n@@\n")
    whole = sorted(map(tuple, reads.read_fastq(spark, paths).collect()))
    with small_splits(spark, "4k"):
        by_split = reads.read_fastq(spark, paths, whole=0)
        assert sorted((x[0], x[1].replace("file:///", "file:/"), *x[2:]) for x in map(tuple, by_split.collect())) == [(x[0], x[1].replace("file:///", "file:/"), *x[2:]) for x in whole]
        assert spark.read.text(paths).rdd.getNumPartitions() > 20
