"""Alignment of two tokenizers against a plain count over all documents."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hinloom.llm import alignment
from hinloom.llm.vocabularies import public_path

A, B = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string"


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(rows, libraries):
    """Loops over tokens, links and documents."""
    one, two = libraries
    letters = alignment._byte_letters()
    counts, of_doc = Counter(), []
    for doc, text in rows:
        links, groups, n_a, n_b = [], [], 0, 0
        data = (" " + text).encode() if text else None
        if data:
            x = one.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(letters[c] for c in t)) for i, t in zip(x.ids, x.tokens)]
            b = [
                (i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode())
                for i, p in ((i, two.id_to_piece(i)) for i in two.encode(text))
            ]
            if b"".join(t for _, t in a) == data and b"".join(t for _, t in b) == data:
                n_a, n_b = len(a), len(b)
                i = j = end_a = end_b = 0
                group = ([], [])
                while i < len(a):
                    links.append((a[i][0], b[j][0]))
                    next_a, next_b = end_a + len(a[i][1]), end_b + len(b[j][1])
                    if next_a <= next_b:
                        group[0].append(a[i][0])
                        i, end_a = i + 1, next_a
                    if next_b <= next_a:
                        group[1].append(b[j][0])
                        j, end_b = j + 1, next_b
                    if end_a == end_b:
                        groups.append(group)
                        group = ([], [])
        counts.update(links)
        of_doc.append((doc, links, groups, n_a, n_b))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc, links, groups, n_a, n_b in of_doc:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        best = sum(counts[p] == most[p[1]] for p in links)
        out.append((doc, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def odd_texts(count, seed):
    draw = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", " ", "　", "▁", "a", "B", "word", "ing", "<s>", "<unk>", "<0x41>", "<|endoftext|>"]
    bits += ["é", "é", "ﬁ", "中文", "\U0001f600", "12", "'s", "...", "\x00", "​"]
    return ["".join(draw.choice(bits) for _ in range(draw.randrange(1, 30))) for _ in range(count)]


def test_words_alone_have_the_ids_of_the_whole_text(libraries):
    side_a, side_b, _ = alignment.sides(A, B)
    for text in odd_texts(3000, 1):
        assert side_b(text).tolist() == libraries[1].encode(text), text
        assert side_a(text).tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("group_runs", [32, 2])
def test_alignment_equals_a_plain_count(spark, libraries, monkeypatch, group_runs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = rows[:60] + [(1000 + k, t) for k, t in enumerate(odd_texts(100, 2))]
    rows += [(2000 + k, rows[0][1]) for k in range(50)]  # a group of copies
    rows += [(1, None), (2, ""), rows[3], (None, "a text without an id"), (3, " "), (4, "▁"), (5, "x" * 3000), (6, "many words " * 5000)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA).repartition(7)
    got = alignment.align(df, A, B, group_runs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, libraries)


def test_no_documents(spark):
    df = spark.createDataFrame([(1, None, "")], SCHEMA)
    assert alignment.align(df.limit(0), A, B).count() == 0
    assert list(map(tuple, alignment.align(df, A, B).collect())) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_frames_and_merged_runs(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 7)
    draw = np.random.default_rng(5)
    runs, want = [], Counter()
    for _ in range(6):
        keys = np.sort(draw.integers(0, 40, draw.integers(1, 60)).astype(np.uint64))
        numbers = draw.integers(1, 2**40, len(keys)).astype(np.uint64)
        others = draw.integers(0, 9, len(keys)).astype(np.uint32)
        parts = alignment.frames(keys, others, numbers)
        assert [x.tolist() for x in map(np.concatenate, zip(*map(alignment.unframe, parts)))] == [keys.tolist(), others.tolist(), numbers.tolist()]
        runs.append(parts)
        for k, n in zip(keys.tolist(), numbers.tolist()):
            want[k] += n
    windows = list(alignment.counted(runs))
    keys = np.concatenate([w[0] for w in windows])
    assert keys.tolist() == sorted(want) and np.concatenate([w[1] for w in windows]).tolist() == [want[k] for k in sorted(want)]
    marked = list(alignment.with_best(iter(windows), 10))
    best = {int(k) for w in marked for k, flag in zip(w[0], w[1]) if flag}
    assert best == {k for k, n in want.items() if n == max(m for j, m in want.items() if j // 10 == k // 10)}
    assert sum(len(w[0]) for w in marked) == len(want)


def test_a_spilled_run_keeps_every_link():
    draw = np.random.default_rng(6)
    pair, doc = draw.integers(0, 500, 4000), draw.integers(0, 30, 4000)
    bucket = pair % alignment.BUCKETS
    packed = ((bucket << alignment.KEY_BITS | pair) << alignment.DOC_BITS | doc).astype(np.uint64)
    got = Counter()
    for number, parts in alignment.spilled(packed):
        for data in parts:
            for k, d, n in zip(*(x.tolist() for x in alignment.unframe(data))):
                assert k % alignment.BUCKETS == number
                got[k, d] += n
    assert got == Counter(zip(pair.tolist(), doc.tolist()))
