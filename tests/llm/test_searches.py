"""Hamming search against all pairs; graph search by its recall."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinloom.llm import ann, hamming


def plain_hamming(rows, queries, k, bits):
    full = (1 << bits) - 1
    rows = sorted({(i, c) for i, c in rows if i is not None and c is not None})
    out = []
    for q, code in sorted({(i, c) for i, c in queries if i is not None and c is not None}):
        near = sorted((bin((c ^ code) & full).count("1"), i) for i, c in rows if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("bits", "segments", "k"), [(64, None, 5), (64, 4, 3), (12, 3, 4), (8, 1, 300)])
def test_hamming_equals_all_pairs(spark, bits, segments, k):
    draw = random.Random(bits)
    low, high = (-(2**63), 2**63) if bits == 64 else (0, 2**bits)
    rows = [(i, draw.randrange(low, high)) for i in range(200)]
    rows += [(i, rows[0][1]) for i in range(200, 260)]  # a third of some table is one code
    rows += [(i, rows[1][1] ^ (1 << draw.randrange(8))) for i in range(260, 290)]
    rows += [(None, 1), (400, None), rows[5]]
    df = spark.createDataFrame(rows, "id long, code long")
    queries = [r for r in rows if r[0] is None or r[0] % 20 == 0]
    got = hamming.nearest(df, spark.createDataFrame(queries, "id long, code long"), k, bits, segments).collect()
    assert sorted(map(tuple, got)) == plain_hamming(rows, queries, k, bits)


def test_hamming_without_rows(spark):
    df = spark.createDataFrame([(1, 5)], "id long, code long")
    assert hamming.nearest(df.limit(0), df, 3).count() == 0
    assert hamming.nearest(df, df.limit(0), 3).count() == 0
    assert hamming.nearest(df, df, 3).count() == 0


def test_every_distance_is_covered_by_the_steps_before():
    for bits, segments in ((64, 4), (12, 5), (7, 2)):
        widths = hamming._widths(bits, segments)
        done = [-1] * segments
        for until, steps in hamming._schedule(widths, bits):
            for segment, radius in steps:
                assert radius == done[segment] + 1
                done[segment] = radius
            # The nearest code that no segment search has met.
            missed = sum(d + 1 for d in done)
            assert missed > until or any(d >= w for d, (_, w) in zip(done, widths, strict=True))


def test_sign_codes(spark):
    vectors = [[1.0, -1.0, 0.0, 2.0], None, [1.0, None, 1.0, 1.0], [1.0], [math.nan, 1.0, 1.0, 1.0], [math.inf, 1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<double>")
    assert [r[0] for r in df.select(hamming.sign_code(F.col("v"), 4)).collect()] == [0b1001, None, None, None, None, None]


def exact(rows, queries, k):
    out = {}
    for q, v in queries.items():
        scored = []
        for i, w in rows.items():
            if i != q and len(w) == len(v):
                a, b = np.array(v, float), np.array(w, float)
                scored.append((-(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)), i))
        out[q] = sorted(scored)[:k]
    return out


def test_graph_search_finds_nearly_all(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(20, 24))
    vectors = np.concatenate([draw.normal(size=(1500, 24)), centres[draw.integers(0, 20, 1500)] + 0.05 * draw.normal(size=(1500, 24))])
    rows = {i: v.tolist() for i, v in enumerate(vectors)}
    df = spark.createDataFrame([(i, v, 3) for i, v in rows.items()], "id long, vector array<double>, dim int")
    got = ann.nearest(df, df.where("id % 50 = 0"), 5, shard_rows=700).collect()
    want = exact(rows, {i: v for i, v in rows.items() if i % 50 == 0}, 5)
    found = {q: {r.id for r in got if r.query_id == q} for q in want}
    assert np.mean([len(found[q] & {i for _, i in w}) / 5 for q, w in want.items()]) >= 0.95
    assert len(got) == 5 * len(want)
    for r in got:
        a, b = vectors[r.query_id], vectors[r.id]
        assert abs(r.score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12


def test_a_hot_direction_over_several_shards(spark):
    """A third of the rows point the same way at many lengths: the smallest ids come, whatever the beam."""
    draw = np.random.default_rng(9)
    vectors = draw.normal(size=(900, 16))
    vectors[600:] = vectors[7] * 2.0 ** draw.integers(-8, 9, (300, 1))
    order = draw.permutation(900)
    rows = {int(i): v.tolist() for i, v in zip(order, vectors)}
    hot = sorted(int(i) for i in [order[7], *order[600:]])
    df = spark.createDataFrame(list(rows.items()), "id long, vector array<double>")
    got = ann.nearest(df, df.where(F.col("id").isin(hot[:3] + hot[-2:])), 6, beam=8, shard_rows=200).collect()
    for q in hot[:3] + hot[-2:]:
        mine = sorted((r["rank"], r.id) for r in got if r.query_id == q)
        assert [i for _, i in mine] == [i for i in hot if i != q][:6]


def test_odd_vectors_and_copies(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]),
        (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e-200, 0.0]), (11, [1e200, 1e200]),
        (0, [1.0, 0.0]), (12, []),
    ]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = ann.nearest(df, df.where("id in (0, 4, 5, 9, 12)"), 3).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 10)]
    many = ann.nearest(df, df.where("id = 0"), 20).collect()
    assert [r.id for r in sorted(many, key=lambda r: r["rank"])] == [1, 2, 10, 3, 11]


def test_graph_search_without_rows(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, vector array<double>")
    assert ann.nearest(df.limit(0), df, 3).count() == 0
    assert ann.nearest(df, df.limit(0), 3).count() == 0


def test_the_same_graph_is_built_again():
    unit = ann._unit(np.random.default_rng(1).normal(size=(600, 8)))
    first, again = ann.build(unit), ann.build(unit)
    assert all(np.array_equal(a, b) for x, y in zip(first, again, strict=True) for a, b in zip(x, y, strict=True))
    assert sum(len(n) for n in first[1][:1]) == 600
