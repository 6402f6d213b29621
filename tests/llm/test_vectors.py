"""Hard negatives and linked vectors against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinloom.llm import grid_join, negatives


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows, is_anchor, positives=5, negatives_=5):
    rows = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if None not in (i, label) and usable(v)}
    anchors = {}
    for i, label, v in sorted(rows):
        if is_anchor(i):
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = {(-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in rows if i != a}
        best = sorted((s, i) for s, i, same in scored if same)[:positives]
        for ps, p in best:
            window = sorted((s, i) for s, i, same in scored if not same and 80 * -ps <= 100 * -s <= 100 * -ps)
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i) in enumerate(window[:negatives_])]
    return sorted(out)


def vectors(count, dim, seed, spread=0.3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(4, dim))
    points = centres[draw.integers(0, 4, count)] + spread * draw.normal(size=(count, dim))
    return [[float(x) for x in np.float32(p)] for p in points]


ROWS = "id long, label int, vector array<double>, rank int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 65, 47), (64, 64, 64), (100, 37, 130), (0, 5, 3), (50, 0, 50)])
def test_recursive_products_are_exact(shape):
    m, k, n = shape
    draw = np.random.default_rng(m)
    a, b = draw.integers(-(2**28), 2**28, (m, k)), draw.integers(-(2**28), 2**28, (n, k))
    for leaf in (1, 4, 16):
        assert (negatives.product(a, b, leaf) == a @ b.T).all()


def test_merged_heaps_do_not_depend_on_the_order():
    draw = np.random.default_rng(1)
    slot, score, ids = draw.integers(0, 4, 300), draw.integers(0, 9, 300), draw.integers(0, 60, 300)
    want = [t for s in range(4) for t in sorted({(s, -c, i) for s_, c, i in zip(slot, score, ids) if s_ == s})[:5]]
    for cuts in ([300], [10, 150, 300], [1, 2, 3, 300]):
        heaps, start = negatives.Heaps(5), 0
        for end in cuts:
            heaps.merge(slot[start:end], score[start:end], ids[start:end])
            start = end
        assert list(zip(heaps.slot.tolist(), (-heaps.score).tolist(), heaps.id.tolist())) == want


@pytest.mark.parametrize("round_bytes", [1 << 24, 8 * 7 * 3])
def test_negatives_equal_all_pairs(spark, round_bytes):
    rows = [(i, i % 3, v) for i, v in enumerate(vectors(200, 7, 3))]
    rows += [(i, i % 3, rows[0][2]) for i in range(200, 300)]  # a third has one vector: ties
    rows += [rows[5], rows[10], (10, 0, rows[11][2]), (301, None, rows[1][2]), (None, 1, rows[1][2]), (310, 1, None)]
    rows += [(320, 1, [1.0, None]), (330, 2, [math.nan] * 7), (340, 2, [math.inf] * 7), (350, 1, []), (360, 2, rows[3][2][:4]), (370, 0, [0.0] * 7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], ROWS).repartition(3)
    got = negatives.mine(df, F.col("id") % 10 == 0, round_bytes=round_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_without_rows(spark):
    df = spark.createDataFrame([(10, 1, [1.0], 0), (20, 1, [2.0], 0)], ROWS)
    anchor = F.col("id") % 10 == 0
    assert negatives.mine(df.limit(0), anchor).count() == 0
    assert negatives.mine(df, anchor).count() == 0  # no other label
    assert negatives.mine(df.where("id = 10"), anchor).count() == 0


def test_scores_that_leave_the_range_are_an_error(spark):
    df = spark.createDataFrame([(10, 1, [1e15], 0), (20, 1, [2.0], 0)], ROWS)
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(df, F.col("id") % 10 == 0).count()


def plain_links(rows, cosine=0.9):
    dim = max((len(v) for _, v in rows if v), default=0)
    good = [k for k, (_, v) in enumerate(rows) if v is not None and usable(v) and any(v)]
    unit = np.array([list(rows[k][1]) + [0.0] * (dim - len(rows[k][1])) for k in good]).reshape(-1, dim)
    if len(good):
        unit = unit / np.abs(unit).max(1, keepdims=True)
        unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
    linked = unit @ unit.T >= cosine
    label = list(range(len(good)))
    for _ in good:
        label = [min([label[i]] + [label[j] for j in np.flatnonzero(linked[i])]) for i in range(len(good))]
    result = []
    for k, (i, _) in enumerate(rows):
        if k not in good:
            result.append((i, 0, i, True))
            continue
        at = good.index(k)
        reach = [rows[good[j]][0] for j in range(len(good)) if label[j] == label[at]]
        least = min((r for r in reach if r is not None), default=None)
        others = int(linked[at].sum()) - 1
        result.append((i, others, None if i is None else least, i is None or i == least))
    return sorted(result, key=str)


LINKS = "id long, vector array<double>, n_links int"


@pytest.mark.parametrize(("block", "fan"), [(256, 16), (4, 2), (3, 4)])
def test_links_equal_all_pairs(spark, block, fan):
    draw = np.random.default_rng(7)
    rows = list(enumerate(vectors(80, 6, 5, 0.4)))
    rows += [(i, rows[0][1]) for i in range(80, 110)]  # equal
    rows += [(i, [2.0 * x for x in rows[0][1]]) for i in range(110, 113)]  # of the same direction
    rows += [(i, [x + 0.01 * float(draw.normal()) for x in rows[1][1]]) for i in range(113, 160)]  # near
    rows += [rows[3], (200, None), (201, []), (202, [0.0] * 6), (203, [math.nan] * 6), (204, [1.0, None]), (205, [1.0, 2.0])]
    rows += [(None, rows[4][1]), (None, None), (206, [1e300] * 6), (207, [1e-300] * 6)]
    df = spark.createDataFrame([(*r, 0) for r in rows], LINKS).repartition(3)
    got = grid_join.link(df, block=block, fan=fan)
    assert got.columns == ["id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_links(rows)


def test_blocks_meet_in_rounds_that_move_bounded_bytes(spark, monkeypatch):
    """The tiles of all pairs are not on disk at once, a tile grows with the blocks, and vectors are kept once."""
    rows = [(i, v, 0) for i, v in enumerate(vectors(300, 6, 9, 0.4))]
    df = spark.createDataFrame(rows, LINKS).repartition(3)
    want = plain_links([r[:2] for r in rows])
    written, write = [], grid_join.materialize
    monkeypatch.setattr(grid_join, "materialize", lambda df, label: written.append((label, out := write(df, label))) or out)
    monkeypatch.setattr(grid_join, "ROUND_BYTES", 1)
    monkeypatch.setattr(grid_join, "LEAST_TILES", 5)
    got = grid_join.link(df, block=4, fan=2)
    assert sorted(map(tuple, got.collect()), key=str) == want
    steps = dict(written)
    assert len([1 for label, _ in written if label == "block-links"]) > 1
    most = steps["tile-pairs"].agg(F.max(F.floor(F.col("tile_b")))).first()[0]
    assert 2 <= most <= 8  # 75 blocks: tiles of 14, not of 2
    for gone in ("classes", "sequence"):
        with pytest.raises(Exception, match="(?i)not.?exist|no such file|not_exist"):
            steps[gone].count()


def test_links_without_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 0), (2, None, 0)], LINKS)
    assert grid_join.link(df.limit(0)).count() == 0
    assert sorted(map(tuple, grid_join.link(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert grid_join.link(df.where("id = 2")).collect()[0].n_links == 0


def test_a_narrow_group_is_linked_without_products(spark, monkeypatch):
    """Blocks of near copies of one vector lie within epsilon of each other as a whole."""
    draw = np.random.default_rng(2)
    rows = [(i, [1.0, *(0.01 * draw.normal(size=5)).tolist()], 0) for i in range(200)]
    seen = []
    plain = grid_join.descend

    def watched(levels, epsilon, fan):
        whole, pairs = plain(levels, epsilon, fan)
        seen.append(pairs.count())
        return whole, pairs

    monkeypatch.setattr(grid_join, "descend", watched)
    got = grid_join.link(spark.createDataFrame(rows, LINKS), block=8, fan=4).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(199, 0)} and seen == [0]


def test_labels_of_a_chain():
    n = 50
    order = np.random.default_rng(3).permutation(n)
    assert (grid_join.labels_of(n, order[:-1], order[1:]) == 0).all()
    assert grid_join.labels_of(4, np.array([3]), np.array([1])).tolist() == [0, 1, 2, 1]
