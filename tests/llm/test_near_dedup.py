"""Near-duplicate components against a plain comparison of all pairs."""

import random
import re

import numpy as np
import pytest

from hinloom.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, node string, a int, pair int"


def plain_sets(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    out = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        if len(words) < 5:
            out.append({tuple(words)} if words else set())
        else:
            out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    label = [doc for doc, _ in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            least = min(label[i], label[j])
            if label[i] != least or label[j] != least:
                label[i] = label[j] = least
                changed = True
    return [(doc, len(s), c, doc == c) for (doc, _), s, c in zip(rows, sets, label, strict=True)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def words(draw, count, size=400):
    return [f"w{draw.randrange(size)}" for _ in range(count)]


def edited(draw, base, edits):
    out = list(base)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10**6)}"
    return out


def corpus():
    """Copies, near copies around the threshold, a chain, shared passages, short and odd texts."""
    draw = random.Random(11)
    rows = [words(draw, draw.randrange(1, 120)) for _ in range(40)]
    base = words(draw, 150)
    rows += [edited(draw, base, draw.randrange(1, 8)) for _ in range(60)]
    step = words(draw, 120)
    for _ in range(12):
        step = edited(draw, step, 2)
        rows.append(step)
    passage = words(draw, 60)
    rows += [words(draw, 90) + passage for _ in range(30)]
    texts = [" ".join(r) for r in rows] + [" ".join(base)] * 25
    texts += [None, "", " \n\t ", "one", "One", "a b c d", "A B  c\td", "a b c d e", "\u00a0x y", "É é", "é é"]
    texts.append(" ".join(words(draw, 6000, 10**6)))
    texts.append("z" * 9000 + " tail of one long word")
    draw.shuffle(texts)
    return [(1000 - 3 * i, t) for i, t in enumerate(texts)]


def test_components_equal_all_pairs(spark):
    rows = corpus()
    got = nd.near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(rows))


def test_a_template_group_without_links(spark):
    """All share four fifths of their text and none is linked: nothing may be lost or merged."""
    draw = random.Random(3)
    template = words(draw, 100)
    rows = [(i, " ".join(template + [f"u{i}_{k}" for k in range(22)])) for i in range(150)]
    rows += [(200 + i, " ".join(template + [f"v{k}" for k in range(8 + i)])) for i in range(8)]
    got = nd.near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(rows))


def test_repeated_and_missing_ids(spark):
    text = "some words that make up one text of more than five"
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (3, "other text")]
    got = nd.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [
        (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True),
    ]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = nd.without_near_duplicates(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "node", "a", "pair"]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (0, text), (1, text), (3, ""), (3, "other text"),
    ]


def test_empty_table(spark):
    empty = table(spark, [(1, "x")]).limit(0)
    assert nd.near_duplicates(empty).count() == 0
    assert nd.without_near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.range(200).selectExpr("cast(lpad(id, 5, '0') as binary) as a", "cast(lpad(id + 1, 5, '0') as binary) as b")
    found = nd.components(edges).collect()
    assert len(found) == 201 and {bytes(r.component) for r in found} == {b"00000"}


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(f"word{i % 97}" * (i % 5 + 1) for i in range(3000)).encode()
    whole = nd.word_hashes(text)
    monkeypatch.setattr(nd, "BLOCK", 64)
    assert np.array_equal(nd.word_hashes(text), whole)
    assert len(set(whole.tolist())) == len(set(text.split()))


@pytest.mark.parametrize("share", [0.75, 0.9])
def test_linked_sets_share_enough_coordinates(share):
    draw = np.random.default_rng(1)
    worst = nd.COORDINATES
    for _ in range(200):
        both = draw.integers(0, 2**63, 300).astype(np.uint64)
        rest = draw.integers(0, 2**63, 2 * int(300 / share - 300) // 2).astype(np.uint64)
        half = len(rest) // 2
        a = nd.signature(np.unique(np.concatenate([both, rest[:half]])))
        b = nd.signature(np.unique(np.concatenate([both, rest[half:]])))
        worst = min(worst, int((a == b).sum()))
    assert worst >= nd.matches_for(10**6)


def test_lost_links_stay_below_the_bound_at_any_size():
    from math import comb

    below = lambda m: sum(comb(64, k) * 0.75**k * 0.25 ** (64 - k) for k in range(m))
    asked = [nd.matches_for(n) for n in (0, 1, 10**3, 10**6, 10**9, 10**12)]
    for n, m in zip((1, 1, 10**3, 10**6, 10**9, 10**12), asked, strict=True):
        assert below(m) * n <= nd.LOST_LINKS < below(m + 1) * n
    assert asked == sorted(asked, reverse=True) and asked[-1] > 10
