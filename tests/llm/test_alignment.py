"""Token alignment, against whole texts encoded and aligned one by one."""

import collections
import hashlib
import json
import random
import subprocess
import sys
from bisect import bisect_right
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from basewise.llm import alignment, queries
from basewise.llm.bpe_tree import _byte_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, wid long, piece string, groups string, n int"


def plainly(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    with open(A, encoding="utf-8") as f:
        vocabulary = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    byte_of = _byte_of()
    a_bytes = lambda i: bytes(byte_of[c] for c in vocabulary[i])
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], collections.Counter()
    for t in texts:
        tokens = []
        for ids, of in ((a.encode(" " + t, add_special_tokens=False).ids if t else [], a_bytes), (b.encode(t) if t else [], b_bytes)):
            at, ends = 0, []
            for i in ids:
                at += len(of(i))
                ends.append((at, i))
            tokens.append((b"".join(map(of, ids)), ends))
        if not t or any(x[0] != (" " + t).encode() for x in tokens):
            found.append(None)
            continue
        (_, own), (_, other) = tokens
        by_end = dict(own), dict(other)
        cuts = sorted(by_end[0].keys() & by_end[1].keys())
        links = [(by_end[0][c], by_end[1][c]) for c in cuts]
        counts.update(links)
        ends = [[e for e, _ in x] for x in (own, other)]
        part = lambda x, e, lo, hi: ",".join(str(i) for _, i in x[bisect_right(e, lo) : bisect_right(e, hi)])
        groups = [part(own, ends[0], lo, hi) + "|" + part(other, ends[1], lo, hi) for lo, hi in zip([0, *cuts], cuts)]
        found.append((len(own), len(other), len(cuts), links, ";".join(groups)))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(*x[:3], len(x[3]), sum(counts[p] == most[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) if x else (0, 0, 0, 0, 0, 0, "") for x in found]


def both(spark, texts, p=alignment.Params(A, B)):
    docs = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in enumerate(texts)], SCHEMA).repartition(2)
    got = sorted(tuple(r) for r in alignment.align(docs, p).collect())
    return [r[1:] for r in got], plainly(texts)


TEXTS = [
    None, "", " ", "\n", "a", " leading", "trailing ", "two  blanks\n\nand lines\nof text", "Hello world, hello World! don't it's", "日本語のテキスト mixed with words", "émigré naïve space  em　wide",
    "under▁score", "clean under score", "<s> </s> <unk> <0x0A> <|endoftext|> end", "\x00control\x1f chars\x7f here", "tab\tand\rreturn \x0b\x0c x", "😀 emoji 👩‍👩‍👧 family", "x" * 3000, "ab" * 20_000, "12345678 9 10 3.14159", "a\n b \nc \n d",
    "repeat the words repeat the words", "repeat the words repeat the words",
]


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_equals_whole_texts(spark, block):
    got, expected = both(spark, TEXTS, alignment.Params(A, B, block))
    assert got == expected


def test_documents_with_inexact_pieces_count_nowhere(spark):
    got, expected = both(spark, ["some words here", "some words ▁ here", "some words here too"])
    assert got == expected and got[1] == (0, 0, 0, 0, 0, 0, "") and got[0][5] == 6


def test_empty_table(spark):
    assert both(spark, []) == ([], [])


def test_ids_without_value_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a word"), (1, "a word"), (1, "a word"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.digests(docs, alignment.Params(A, B)).collect()), key=repr)
    assert [r[0] for r in got] == [1, 1, None, None] and got[0][6] == 6 and got[3][1:] == (0, 0, 0, 0, 0, 0, "") or got[2][1:] == (0, 0, 0, 0, 0, 0, "")


def test_registered_query_equals_whole_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((d.doc_id, *x[:-1], x[-1] and hashlib.sha256(x[-1].encode()).hexdigest()) for d, x in zip(docs, plainly([d.text for d in docs]), strict=True))
    assert sorted(tuple(r) for r in queries.queries()["op13_token_alignment"](spark, small).collect()) == expected


def invented(n, words, seed=1):
    """Texts of words that hardly occur twice."""
    r = random.Random(seed)
    return [" ".join("".join(r.choice("abcdeiklmnorstu") for _ in range(r.randint(2, 9))) for _ in range(words)) for _ in range(n)]


def test_tables_are_no_larger_than_invented_words(spark, monkeypatch):
    """What is written before the result, of texts nearly all of whose words are distinct."""
    written, stash = [], alignment.stash

    def weighed(df, name):
        made = stash(df, name)
        written.append(sum(Path(f.removeprefix("file:")).stat().st_size for f in made.inputFiles()))
        return made

    monkeypatch.setattr(alignment, "stash", weighed)
    texts = invented(100, 1_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert alignment.digests(docs, alignment.Params(A, B)).count() == 100
    assert sum(written) < 2 * sum(map(len, texts))


PEAK = """
import sys
import pyarrow as pa
from basewise.llm import alignment
p = alignment.Params(*sys.argv[1:3])
words = [f" {i * 7919 % 90001:x}z{i % 1013}" for i in range(300_000)]
texts = ["".join(words[(k * 311 + i * 17) % 300_000] for i in range(400)) for k in range(6_000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(6_000)), pa.array(texts)], ["id", "text"])
del words, texts
def most():
    return next(int(x.split()[1]) >> 10 for x in open("/proc/self/status") if x.startswith("VmHWM"))
alignment.kept(p, lambda: alignment.Pair(p))
before = most()
n = sum(x.num_rows for x in alignment.block_rows(iter([batch]), p))
print(n, batch.nbytes, most() - before)
"""


def test_a_block_takes_few_times_its_bytes():
    """A worker's peak over one block, beyond the tokenizers and the text."""
    done = subprocess.run([sys.executable, "-c", PEAK, A, B], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    rows, size, peak = map(int, done.stdout.split())
    assert rows == 1 and size > 20_000_000 and peak < 14 * size / 1e6


@pytest.mark.parametrize(("cut", "written"), [(4_000_000, 500_000), (7, 3), (1, 1)])
def test_texts_cut_and_written_a_few_at_a_time(monkeypatch, cut, written):
    monkeypatch.setattr(alignment, "CUT", cut)
    monkeypatch.setattr(alignment, "WRITTEN", written)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array([t and " " + t for t in TEXTS])], ["id", "text"])
    (made,) = alignment.block_rows(iter([rows]), alignment.Params(A, B))
    n = len(made["counts"][0])
    values = pa.array([np.ones(n, np.int64)])
    whole = pa.RecordBatch.from_arrays([*made.columns, values, values], [*made.schema.names, "best", "count"])
    got = [tuple(r.values()) for b in alignment._documents(iter([whole])) for r in b.to_pylist()]
    assert got == [(i, *x[:4], x[3], x[3], x[6]) for i, x in enumerate(plainly(TEXTS))]
