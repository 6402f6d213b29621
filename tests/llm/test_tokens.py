"""Own byte-level BPE and spliced token counts against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hinloom.llm import bpe
from hinloom.llm import token_counts as counting
from hinloom.llm.vocabularies import ids_of, public_path, read_ranks

RANK_FILE = public_path("byte_bpe_multi_50k.tiktoken")
COUNTER = public_path("byte_bpe_50k.json")
ODD = ["", " ", "  \n\n x", "\x1c\x1f\x85　y", "it's 12 o'clock!!", "日本語テキスト", "a​🙂̈", "x" * 4000, " " * 3000, "'s 't"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(read_ranks(RANK_FILE), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANK_FILE), special_tokens={})


def test_every_entry_is_found_in_its_own_slot(codec):
    slots = {codec.hash.find(key) for key in codec.ranks}
    assert slots == set(range(len(codec.ranks)))
    assert all(codec.id_at[codec.hash.find(key)] == rank.to_bytes(4, "little") for key, rank in codec.ranks.items())
    assert codec.hash.find(b"no such entry of the vocabulary") == -1


def test_small_perfect_hashes():
    for count in (0, 1, 2, 3, 17):
        keys = [b"k%d" % i for i in range(count)]
        table = bpe.PerfectHash(keys)
        assert sorted(table.find(k) for k in keys) == list(range(count))
        assert table.find(b"other") == -1


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_as_the_library_does(codec, library, text):
    ids = np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()
    assert ids == library.encode_ordinary(text)
    assert codec.decode(np.array(ids, "<u4").tobytes()).decode() == text


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(codec, library, text):
    assert np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist() == library.encode_ordinary(text)


def test_forgetting_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "STRETCH", 20)
    text = "some words, more words; ünd nöch mehr wörter\n" * 5
    assert np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist() == library.encode_ordinary(text)


def test_table_of_texts(spark, library):
    texts = [None, *ODD, "long text " * 3000, "long text " * 3000]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_and_decode(df, RANK_FILE, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_and_decode(df.limit(0), RANK_FILE, public_tokenizers.PATTERN).count() == 0


def long_texts():
    draw = random.Random(4)
    pieces = ["the", " of", "\n", "  ", "été", "'s", "12", "日本", "<|endoftext|>", "\t", "zzzz", "　", "!?"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(10, 900))) for _ in range(40)]
    return [*texts, "x" * 2000, " " * 1500, "日本語" * 400, "a " + "y" * 700 + " b" * 200, None, "", "short"]


def test_spliced_counts_equal_whole_ones(spark):
    texts = long_texts()
    texts += texts[:3]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, uid int")
    got = {r.doc_id: r for r in counting.count_tokens(df, COUNTER, limit=50, size=100, overlap=8).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        count = len(ids_of(COUNTER).library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), count, count > 50)


def test_overlaps_are_widened_only_where_nothing_aligns(spark):
    rows = [(0, "word " * 100), (1, "x" * 500)]
    chunks = counting.chunked(spark.createDataFrame(rows, "uid long, text string"), 100, 20)
    found = counting.spliced(counting.encoded_ends(chunks, COUNTER, 100, 20)).collect()
    assert {r.uid: r.n_tokens for r in found} == {0: len(ids_of(COUNTER)("word " * 100)), 1: None}


def test_no_texts(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert counting.count_tokens(df.limit(0), COUNTER).count() == 0


def test_starts_of_tokens_equal_the_library():
    encoder = ids_of(COUNTER)
    for text in [*ODD, *long_texts()]:
        if text:
            offsets = encoder.library.encode(text, add_special_tokens=False).offsets
            assert encoder.spans(text).tolist() == [start for start, _ in offsets], text[:80]
