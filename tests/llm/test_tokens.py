"""BPE by tree concatenation, Re-Pair and token files against the library and exact round trips."""

import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basewise.llm import bpe_tree, repair, token_files
from basewise.llm.common import vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def encoders():
    return [bpe_tree.Encoder(bpe_tree.Params(BYTE, leaf=leaf, window=4)) for leaf in (5, 17, 8192)]


LETTERS = st.text(alphabet=st.sampled_from("abtheing éß漢字 \n'sdl12½.,-=_²\x1c\x85\xa0\u0301😀"), max_size=200)


@settings(max_examples=400, deadline=None)
@given(LETTERS)
def test_trees_give_the_library_ids(byte_library, encoders, text):
    want = byte_library.encode(text, add_special_tokens=False).ids
    for e in encoders:
        got = e.encode(text)
        assert got == want
        assert e.decode(got) == byte_library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(6))
def test_long_unsplit_text(byte_library, encoders, seed):
    r = random.Random(seed)
    text = "".join(r.choice(["the", "ing", "a", "ß", "=", "12", "'s", "'", "x"][: 2 + seed]) for _ in range(4000))
    want = byte_library.encode(text, add_special_tokens=False).ids
    assert all(e.encode(text) == want for e in encoders)


def test_special_strings_are_special(byte_library, encoders):
    text = "a<|endoftext|>b <|endoftext|><|endoftext| >"
    want = byte_library.encode(text, add_special_tokens=False).ids
    assert 50256 in want and all(e.encode(text) == want for e in encoders)
    assert encoders[0].decode(want) == byte_library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [" " * 90_001, "\n" * 50_000 + "x", "a" * 70_003, "é" * 30_001 + "e" * 20_000, "x" + "ab" * 20_000 + "a" * 33_333 + " y", "\n " * 20_000, "=" * 40_001 + " " * 30_000 + "z", "漢" * 25_000, "7" * 20_001 + "'s" * 9_000])
def test_long_runs(byte_library, encoders, text):
    assert encoders[-1].encode(text) == byte_library.encode(text, add_special_tokens=False).ids


EVEN = st.lists(st.sampled_from(["a", "the", "it's", "x1", "é漢", "漢字!", "😀", "don't", "\0", "b" * 60]), max_size=60)


@settings(max_examples=200, deadline=None)
@given(EVEN, st.sampled_from([" ", "\n", "  ", "\t", " \n"]))
def test_chained_words_and_a_small_cache_give_the_library_ids(byte_library, encoders, words, gap):
    small = bpe_tree.Encoder(bpe_tree.Params(BYTE, leaf=64, cache=1_000, cached_chars=6)) if not hasattr(encoders[0], "small") else encoders[0].small
    encoders[0].small = small
    texts = [" ".join(words), "\n".join(words), gap.join(words), " " + " ".join(words), "x " + gap.join(words)]
    want = [e.ids for e in byte_library.encode_batch(texts, add_special_tokens=False)]
    assert small.encode_all(texts) == want and encoders[2].encode_all(texts) == want


def test_new_words_go_to_the_library_in_rows():
    e, sent = bpe_tree.Encoder(bpe_tree.Params(BYTE)), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **options)

    library, e.library = e.library, Counting()
    text = " ".join(f"{random.Random(k).getrandbits(40):x}" for k in range(5_000))
    assert e.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(sent) < 200


def test_ten_million_blanks_newlines_and_letters_take_seconds(encoders):
    began = time.time()
    for c in " \na":
        ids = encoders[-1].encode(c * 10_000_000)
        assert encoders[-1].decode(ids) == c * 10_000_000
    assert time.time() - began < 30


def test_parts_of_long_texts_are_encoded_apart_and_joined(spark, byte_library):
    r = random.Random(3)
    texts = ["".join(r.choice(["the", " ", "ing", "ß", "\n", "12", "'s", "漢"]) for _ in range(3000)), " " * 3000 + "x", "a" * 2500, "ab<|endoftext|>" * 300, "short", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[2]), (0, texts[1])]
    p = bpe_tree.Params(BYTE, leaf=100, part=701)
    got = bpe_tree.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    want = [(i, tuple(byte_library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(((x.doc_id, tuple(x.ids)) for x in got), key=repr) == sorted(want, key=repr)


def test_round_trip_of_rows(spark, byte_library):
    rows = [(1, None, "z"), (2, "", "z"), (3, "some text " * 3000, "z"), (None, "null id", "z"), (3, "again", "z")]
    got = bpe_tree.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"), bpe_tree.Params(BYTE)).collect()
    assert sorted(((r.doc_id or 0), r.decoded) for r in got) == sorted(((i or 0), t or "") for i, t, _ in rows)
    assert all(list(r.ids) == byte_library.encode(r.decoded, add_special_tokens=False).ids for r in got)
    assert bpe_tree.digests(spark.createDataFrame([], "doc_id long, text string"), bpe_tree.Params(BYTE)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300), st.data())
def test_grammars_round_trip_and_allow_random_access(ids, data):
    x = np.array(ids, np.int64)
    g = repair.grammar_of(x, repair.Params(4, least=2, step=3))
    assert g.expanded(g.sequence).tolist() == ids
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert g.ids(a, b).tolist() == ids[a:b]


def test_grammar_compresses_repeats_and_stops_at_the_last_symbol():
    x = np.tile(np.arange(50), 400)
    g = repair.grammar_of(x, repair.Params(50))
    assert len(g.sequence) + 2 * len(g.rules) < len(x) / 20
    full = repair.grammar_of(np.random.default_rng(0).integers(0, 30, 20_000), repair.Params(30, symbols=40, least=2))
    assert len(full.rules) <= 10
    with pytest.raises(ValueError):
        repair.grammar_of(np.array([9]), repair.Params(5))


WORDY = st.text(alphabet=st.sampled_from("abTHEing éÀßİ漢 \n\t'sdl12½²_.,-<|>\x1c\x85\xa0\u0301😀Σσ"), max_size=80)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def small_cache():
    return token_files.Words(token_files.Params(WORD, cache=1_000, cached_chars=6))


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDY, max_size=4))
def test_words_give_the_library_ids(word_library, small_cache, texts):
    library, words = word_library, small_cache
    for _ in range(2):
        assert words.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in words.encode_all(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_very_long_words(word_library, small_cache):
    texts = ["x" * 300_000, "ab1" * 50_000 + "?!" * 9_000, "é漢" * 20_000, " " * 100_000]
    assert [x.tolist() for x in small_cache.encode_all(texts)] == [e.ids for e in word_library.encode_batch(texts, add_special_tokens=False)]


def test_special_strings_in_word_texts():
    library, texts = Tokenizer.from_file(WORD), ["x <|endoftext|> Y<|startoftext|>", "<|ENDOFTEXT|>", "a <| b"]
    words = token_files.Words(token_files.Params(WORD))
    assert [x.tolist() for x in words.encode_all(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_files_hold_every_document(spark, tmp_path):
    rows = [(i * 7 % 101, f"Document number {i} " * (i % 13)) for i in range(101)] + [(None, "no id"), (5, None), (5, "again")]
    path, p = f"file://{tmp_path}/ids", token_files.Params(WORD, shard=300)
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", __import__("pyspark").sql.functions.lit(1)), path, p)
    library = Tokenizer.from_file(WORD)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id or -1 for r in got] == sorted((i or -1) if i is not None else -1 for i, _ in rows) or len(got) == len(rows)
    want = sorted((zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()), -1 if i is None else i) for i, t in rows)
    assert sorted((r.ids_crc32, -1 if r.doc_id is None else r.doc_id) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    shards = [token_files.Shard.of(r.asDict()) for r in spark.read.parquet(path).collect()]
    assert len(shards) > 3
    by_id = {i: t or "" for i, t in rows if i not in (None, 5)}
    for s in shards:
        for k, i in enumerate(s.doc_ids):
            if i in by_id:
                assert s.document(k).tolist() == [*library.encode(by_id[i], add_special_tokens=False).ids, 1]


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path, token_files.Params(WORD))
    assert token_files.read(spark, path).count() == 0
