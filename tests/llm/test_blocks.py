"""Blocks of codes: what they hold gives the texts back."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basewise.llm import blocks

TEXTS = st.lists(st.none() | st.text(alphabet="abAZ \n\t\r\x0b\x0c\x1c\x1f\x85\xa0     　é日#\U0001f600"), max_size=6)


def split(cut, texts):
    pieces, offsets = cut(pa.array(texts, pa.string()).slice(1) if texts else pa.array([], pa.string()))
    return [pieces.slice(lo, hi - lo).to_pylist() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words(texts):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    assert split(blocks.words_cut, texts) == [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts[1:]]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_cuts_at_blanks(texts):
    solid = r"[^\s\x00-\x20\x7f]"
    assert split(blocks.blank_cut, texts) == [[x for x in re.split(f"(?<={solid})(?=[ \n]{solid})", t or "") if x] for t in texts[1:]]


@pytest.mark.parametrize("size", [1, 20, 1 << 20])
def test_values_come_back_by_code(spark, size):
    texts = ["a b a", None, "", "b c " * 5, "d"]
    rows = spark.createDataFrame([(i, i != 3, t) for i, t in enumerate(texts)], "id long, flag boolean, text string")
    made = blocks.blocks(rows, blocks.words_cut, size, "test")
    counts = {r.piece: r.n for r in blocks.pieces_of(made).groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    assert counts == {"a": 2, "b": 1, "c": 0, "d": 1}
    values = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "piece string, v int")
    got = {}
    for r in blocks.attached(made, ["ids", "offsets", "codes"], values, ["v"], in_task=1).collect():
        for k, i in enumerate(r.ids):
            got[i] = [r.v[c] for c in r.codes[r.offsets[k] : r.offsets[k + 1]]]
    assert got == {0: [1, 2, 1], 1: [], 2: [], 3: [2, 3] * 5, 4: [None]}
