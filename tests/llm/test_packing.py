"""Best-fit packing against its own rules and a direct best fit over documents."""

import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hinloom.llm import packing
from hinloom.llm.vocabularies import ids_of, public_path

TOKENIZER = public_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, rank string, bucket int, length string"


def plain_best_fit(lengths, capacity):
    free = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, length)
        left = free.pop(at) if at < len(free) else capacity
        bisect.insort(free, left - length)
    return len(free)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=200))))
def test_plan_is_the_best_fit_over_single_items(case):
    capacity, lengths = case
    histogram = defaultdict(int)
    for length in lengths:
        histogram[length] += 1
    plan = packing.best_fit(dict(histogram), capacity)
    content = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, end, sequence, offset in plan:
        ranks[length] += range(first, end)
        for i in range(end - first):
            content[sequence + i].append((offset, length))
    assert {length: sorted(r) for length, r in ranks.items()} == {l: list(range(n)) for l, n in histogram.items()}
    for items in content.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(content) == plain_best_fit(lengths, capacity)


def check(rows, texts, capacity):
    """Pieces put together are the ids; offsets in a sequence are gapless."""
    whole = defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
    for doc, text in texts.items():
        ids = np.append(ids_of(TOKENIZER)(text or ""), np.uint32(0)).astype("<u4")
        pieces = sorted(whole[doc], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.length == capacity for p in pieces[1:])
        assert pieces[0].start == 0 and sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity


def test_texts_of_all_kinds(spark):
    draw = random.Random(5)
    texts = {i: " ".join(draw.choice(["the", "of", "xyzzy", "été", "<|endoftext|>"]) for _ in range(draw.randrange(60))) for i in range(80)}
    texts |= {100: None, 101: "", 102: "word " * 5000, 103: "x" * 3000}
    df = spark.createDataFrame([(i, t, "r", 1, "l") for i, t in texts.items()], SCHEMA)
    rows = packing.pack(df, TOKENIZER, 64).collect()
    check(rows, texts, 64)
    lengths = [r.length for r in rows]
    assert len({r.sequence_id for r in rows}) == plain_best_fit(lengths, 64)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "r", 1, "l")] * 7, SCHEMA)
    rows = packing.pack(df, TOKENIZER, 16).collect()
    assert len(rows) == 7 and len({(r.sequence_id, r.offset) for r in rows}) == 7
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


def test_ranks_are_gapless(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "if(id % 3 = 0, 7, id % 5) as length")
    rows = packing.ranked(df, "length", ["doc_id", "piece"], 16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.length].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "  \n\n x\t", "\x1c\x85\u3000é", "it's 12 o'clock!!  ", "日本語 テキスト"])
def test_ids_are_those_of_the_library(text):
    encode = ids_of(TOKENIZER)
    assert encode(text).tolist() == encode.library.encode(text, add_special_tokens=False).ids
