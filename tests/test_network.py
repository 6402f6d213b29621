import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinloom import runtime
from hinloom.operators import matrix
from hinloom.plans import affinity, hin, pathsim, rankclass, rankstill
from hinloom.sources import models


def cells(df):
    return {(r["i"], r["j"]): r["value"] for r in df.collect()}


def coo(spark, rows):
    return spark.createDataFrame([(i, j, float(v)) for i, j, v in rows], "i long, j long, value double")


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (2, "c")], "r long, m string")


def test_pathsim_by_hand(spark, small):
    got = cells(pathsim.pathsim(pathsim.incidence(small, "r", "m")))
    assert got[(0, 1)] == 0.5 and got[(1, 2)] == pytest.approx(2 / 3)
    assert all(got[(i, i)] == 1.0 for i in range(3))
    assert all(got[(j, i)] == v for (i, j), v in got.items())
    assert (0, 2) not in got


def test_both_forms_agree_and_hot_keys_change_nothing(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(60), 0 if rng.random() < 0.4 else rng.randrange(30)) for _ in range(400)}
    w = pathsim.incidence(spark.createDataFrame(list(edges), "r long, m long"), "r", "m")
    plain = cells(pathsim.pathsim(w, cell=None))
    assert cells(pathsim.pathsim(w, cell=5)) == plain
    assert cells(pathsim.normalize_commuting(pathsim.commuting_matrix(w, cell=5))) == pytest.approx(plain)
    rows = {}
    for r, m in edges:
        rows.setdefault(r, set()).add(m)
    brute = {
        (a, b): 2 * len(x & y) / (len(x) + len(y)) for a, x in rows.items() for b, y in rows.items() if x & y
    }
    assert plain == pytest.approx(brute)


@pytest.mark.parametrize("cell", [None, 5])
def test_products_by_blocks_move_lists(spark, monkeypatch, cell):
    rng = random.Random(5)
    edges = {(rng.randrange(60), 0 if rng.random() < 0.3 else rng.randrange(40)) for _ in range(300)}
    w = spark.createDataFrame([(i, k, float(1 + (i + k) % 3), i * 1.0) for i, k in edges], "i long, _k long, value double, d double")
    w = runtime.materialize(w)
    odd, even = w.where("i % 2 = 1"), w.where("i % 2 = 0")
    found = lambda df: {(r.i, r.j): (r.value, r.di, r.dj) for r in df.collect()}
    plain = [found(matrix.row_products(*sides, cell=cell, ends=["d"])) for sides in ((w,), (odd, even))]
    monkeypatch.setattr(matrix, "BLOCK_PRODUCTS", 50)
    for sides, want in zip(((w,), (odd, even)), plain, strict=True):
        by_blocks = matrix.row_products(*sides, cell=cell, ends=["d"])
        rows = by_blocks.collect()
        assert len(rows) == len(want) and {(r.i, r.j): (r.value, r.di, r.dj) for r in rows} == want
        if cell is None:
            plan = by_blocks._jdf.queryExecution().executedPlan().toString()
            after_lists = plan[: plan.index("REPARTITION_BY_NUM")]
            assert "hashpartitioning(i" not in after_lists and "SortMergeJoin" not in after_lists


@pytest.mark.parametrize("dense", [0, 1 << 24])
@pytest.mark.parametrize("signs", [False, True])
def test_block_products_of_nulls_and_signs(spark, monkeypatch, dense, signs):
    rng = random.Random(11)
    value = lambda: rng.choice([None, -1.0, 0.0, 1.0] if signs else [1.0, 2.0])
    edges = {(rng.randrange(50), rng.randrange(30)): value() for _ in range(400)}
    w = spark.createDataFrame([(i, k, v, i / 2) for (i, k), v in edges.items()], "i int, _k long, value double, d double")
    w = runtime.materialize(w)
    sides = [(w,), (w.where("i % 3 = 1"), w.where("i % 2 = 0"))]
    plain = [sorted(map(tuple, matrix.row_products(*s, cell=None, ends=["d"]).collect())) for s in sides]
    monkeypatch.setattr(matrix, "BLOCK_PRODUCTS", 700)
    monkeypatch.setattr(matrix, "DENSE_CELLS", dense)
    monkeypatch.setattr(matrix, "CHUNK", 50)
    for s, want in zip(sides, plain, strict=True):
        by_blocks = matrix.row_products(*s, cell=None, ends=["d"])
        assert "FlatMapGroupsInArrow" in by_blocks._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, by_blocks.collect())) == want


def test_rows_of_a_block_move_once(spark, monkeypatch):
    """A list goes to a block once, its own rows first, and not those rows beside it."""
    w = spark.createDataFrame([(i, k, 1.0) for i in range(40) for k in range(20)], "i long, _k long, value double")
    monkeypatch.setattr(matrix, "BLOCK_PRODUCTS", 4000)
    plan = matrix.row_products(runtime.materialize(w), cell=None)._jdf.queryExecution().executedPlan().toString()
    moved = next(line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line)
    below = plan[plan.index(moved) + len(moved) :]
    assert "_r#" in below and " AS i#" not in below[: below.index("Generate")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_k_with_a_third_of_equal_rows(spark, k):
    """120 rows hang on one middle node only, others share a few patterns."""
    rng = random.Random(k)
    edges = {(r, 0) for r in range(0, 360, 3)}
    edges |= {(r, m) for r in range(1, 360, 3) for m in ((0, 1) if r % 2 else (1, 2, 3))}
    edges |= {(r, rng.randrange(6)) for r in range(2, 360, 3) for _ in range(4)}
    rows = {}
    for r, m in edges:
        rows.setdefault(r, set()).add(m)
    want = {}
    for a, x in rows.items():
        scored = sorted((-2 * len(x & y) / (len(x) + len(y)), b) for b, y in rows.items() if b != a and x & y)
        want[a] = [(b, -v) for v, b in scored[:k]]
    w = pathsim.incidence(spark.createDataFrame(list(edges), "r long, m long"), "r", "m")
    got = {}
    for r in pathsim.pathsim_top_k(w, k).orderBy("i", "rank").collect():
        got.setdefault(r["i"], []).append((r["j"], r["value"]))
    assert got == want
    assert pathsim.row_classes(w).select("class").distinct().count() < 70


def test_duplicate_policies(spark):
    edges = spark.createDataFrame([(0, 1), (0, 1), (0, 2)], "r long, m long")
    assert cells(pathsim.incidence(edges, "r", "m"))[(0, 1)] == 1.0
    assert cells(pathsim.incidence(edges, "r", "m", "sum"))[(0, 1)] == 2.0
    with pytest.raises(Exception, match="duplicate"):
        pathsim.incidence(edges, "r", "m", "error").collect()
    with pytest.raises(ValueError):
        pathsim.incidence(edges, "r", "m", "other")


def test_relation_normalize_by_hand(spark):
    edges = spark.createDataFrame(
        [("r", 0, 0, 1, 0, 1.0), ("r", 0, 0, 1, 1, 1.0), ("r", 0, 1, 1, 1, 1.0)],
        "rel string, i int, row long, j int, col long, w double",
    )
    got = rankclass.normalize_relations(rankclass.relation_table(edges, 1), 1).collect()
    s = {(r["row"], r["col"]): r["s0"] for r in got}
    assert s == pytest.approx({(0, 0): 1 / math.sqrt(2), (0, 1): 0.5, (1, 1): 1 / math.sqrt(2)})


def test_rank_update_by_hand(spark):
    """(0.5 * 0.4 + 0.1 * 1) / (4 * 0.2 + 0.1) = 1/3."""
    edge = spark.createDataFrame([("r", 0, 0, 1, 0, 1.0, 0.5)], "rel string, i int, row long, j int, col long, w0 double, s0 double")
    ranks = spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.4)], "m int, x long, p0 double")
    start = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.0)], "m int, x long, p0 double")
    got = {r["m"]: r["p0"] for r in rankclass.update_ranks(edge, ranks, start, 1, 4).collect()}
    assert got[0] == pytest.approx(1 / 3) and got[1] == 0.0
    weighted = rankclass.update_ranks(edge, ranks, start, 1, 4, lambda_weighted=True).where("m = 0").first()["p0"]
    assert weighted == pytest.approx((0.2 * 0.5 * 0.4 + 0.1) / 0.9)


def random_network(spark, seed):
    """Two relations over types 0 and 1; item 0 of type 0 is an end of a third of all edges."""
    rng = random.Random(seed)
    near = lambda n: 0 if rng.random() < 0.33 else rng.randrange(n)
    edges = spark.createDataFrame(
        [("r", 0, near(9), 1, rng.randrange(40), 1.0) for _ in range(120)]
        + [("s", 0, near(9), 0, rng.randrange(9), 2.0) for _ in range(30)],
        "rel string, i int, row long, j int, col long, w double",
    )
    items = [(0, x) for x in range(9)] + [(1, x) for x in range(40)]
    ranks = spark.createDataFrame([(m, x, rng.random(), 0.0) for m, x in items], "m int, x long, p0 double, p1 double")
    return runtime.materialize(rankclass.relation_table(edges, 2), "edges"), ranks


def state_of(relations, ranks, cell):
    lanes = rankclass.Lanes.of(relations)
    return rankclass.State(2, 2, ranks, ranks, rankclass.arc_table(relations, lanes, 2, cell), lanes)


def by_key(df, n):
    return {tuple(r)[:n]: tuple(r)[n:] for r in df.collect()}


@pytest.mark.parametrize("cell", [5, 1 << 20])
def test_a_round_on_arcs_equals_a_round_on_edges(spark, cell):
    relations, ranks = random_network(spark, 9)
    state = state_of(relations, ranks, cell)
    assert state.arcs.count() == 2 * relations.count()
    largest = state.arcs.groupBy(*rankclass.NEAR).count().agg(F.max("count")).first()[0]
    assert (state.arcs.agg(F.max("part")).first()[0] > 0) == (cell == 5) and (cell > 5 or largest < 4 * cell)
    for _ in range(2):
        want = rankclass.update_ranks(rankclass.normalize_relations(relations, 2), state.ranks, ranks, 2, 2)
        weights = rankclass.reweight(relations, want, 2, state.round + 1)
        state = rankclass.step(state)
        for got, wanted, n in ((state.ranks, want, 2), (state.relations, weights, 5)):
            got, wanted = by_key(got, n), by_key(wanted, n)
            assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k]) for k in wanted)
        relations = runtime.materialize(weights, "weights")


def test_one_relation_updates_ranks_and_all_get_new_weights(spark):
    relations, ranks = random_network(spark, 4)
    state = rankclass.step(state_of(relations, ranks, 7), only_relations=["s"])
    only = rankclass.normalize_relations(relations.where("rel = 's'"), 2)
    want = by_key(rankclass.update_ranks(only, ranks, ranks, 2, 2), 2)
    got = by_key(state.ranks, 2)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {r["rel"] for r in state.relations.select("rel").distinct().collect()} == {"r", "s"}


def test_arcs_move_once_in_a_round(spark):
    """Join by shuffle: arcs lie still for degrees and ranks, and move once for new weights."""
    relations, ranks = random_network(spark, 2)
    state = state_of(relations, ranks, 1 << 20)
    arcs = state.arcs
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        ends = rankclass.end_table(arcs, state.lanes, ranks, 2)
        written = runtime.materialize(ends, "ends")
        passed = rankclass.pass_ranks(arcs, written, ranks, 2, 2)
        weighed = rankclass.reweight_arcs(arcs, written, ranks, 2, 1)
        plans = [plan(df) for df in (ends, passed, weighed)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    for text in plans:
        lines = text.splitlines()
        at = next(n for n, line in enumerate(lines) if "FileScan" in line and "buckets_arcs" in line)
        first = next(line for line in reversed(lines[:at]) if any(w in line for w in ("Join", "Aggregate", "Exchange")))
        assert "Exchange" not in first
    # `passed` moves sums per end, made where the arcs lie; `weighed` the arcs themselves, to where they are written.
    assert [text.count("REPARTITION_BY_NUM") for text in plans] == [0, 0, 1]
    assert plans[1].count("Exchange") == 5


def test_bucketed_step_is_dropped_with_its_files(spark):
    kept = runtime.materialize_buckets(spark.range(50), ["id"], "x")
    name = runtime._table(kept.inputFiles()[0].rsplit("/", 2)[1])
    assert kept.count() == 50 and spark.catalog.tableExists(name)
    plan = kept.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runtime.discard(kept)
    assert not spark.catalog.tableExists(name)


def test_reweight_by_hand(spark):
    """w = 2 and both ends at the maximum: 2 * (1 + 1/2) = 3; no rank at all: ratio 0."""
    edge = spark.createDataFrame([("r", 0, 0, 1, 0, 2.0, 2.0)], "rel string, i int, row long, j int, col long, w0 double, w1 double")
    ranks = spark.createDataFrame([(0, 0, 0.3, 0.0), (1, 0, 0.7, 0.0)], "m int, x long, p0 double, p1 double")
    row = rankclass.reweight(edge, ranks, 2, 1).first()
    assert row["w0"] == pytest.approx(3.0) and row["w1"] == pytest.approx(1.0)


def test_label_rows_given_twice_start_from_zero(spark):
    items = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "m int, x long")
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (0, 2, 0)], "m int, x long, k int")
    got = {r["x"]: r["p0"] for r in rankclass.initial_ranks(items, labels, 1).collect()}
    assert got == {1: 0.0, 2: pytest.approx(1 / 3), 3: 0.0}
    assert rankclass.ambiguous_labels(labels).count() == 1


def test_isolated_items_and_saved_state(spark, tmp_path):
    items = spark.createDataFrame([(0, 1), (1, 1), (1, 2)], "m int, x long")
    labels = spark.createDataFrame([(0, 1, 0)], "m int, x long, k int")
    edges = spark.createDataFrame([("r", 0, 1, 1, 1, 1.0)], "rel string, i int, row long, j int, col long, w double")
    state = rankclass.run(items, labels, edges, classes=2, types=2)
    ranks = {(r["m"], r["x"]): r["p0"] for r in state.ranks.collect()}
    assert ranks[(1, 2)] == 0.0 and ranks[(1, 1)] > 0
    assert rankclass.assign_classes(state.ranks, 2).count() == 2
    models.save_rank_state(state, str(tmp_path / "m"))
    back = models.load_rank_state(spark, str(tmp_path / "m"))
    assert back.round == 2 and back.ranks.exceptAll(state.ranks).count() == 0
    with pytest.raises(ValueError, match="not a naive_bayes"):
        models.load_naive_bayes(spark, str(tmp_path / "m"))


def test_network_reports_unresolved_edges(spark):
    people = spark.createDataFrame([("1", "Ann"), ("2", "Bo")], "id string, name string")
    papers = spark.createDataFrame([("1", "P")], "id string, name string")
    known = spark.createDataFrame([("2", 7)], "id string, class int")
    links = spark.createDataFrame([("1", "1"), ("9", "1")], "a string, p string")
    net = hin.build(
        {"A": hin.Entity(people, "id", "name", known), "P": hin.Entity(papers, "id", "name")},
        [hin.Relation(links, "A", "a", "P", "p", "write")],
    )
    vertices = {(r["type"], r["id"]): (r["vid"], r["label"]) for r in net.vertices.collect()}
    assert vertices == {("A", "1"): (0, "L00"), ("A", "2"): (1, "L7"), ("P", "1"): (2, "L00")}
    assert [(r["src"], r["dst"]) for r in net.edges.collect()] == [(0, 2)]
    assert [(r["end"], r["src"]) for r in net.unresolved.collect()] == [("src", "9")]


def test_divide_policies(spark):
    a, b = coo(spark, [(0, 0, 6), (0, 1, 5)]), coo(spark, [(0, 0, 2)])
    assert cells(matrix.divide(a, b)) == {(0, 0): 3.0, (0, 1): None}
    with pytest.raises(Exception, match="division by a zero cell"):
        matrix.divide(a, b, "error").collect()


def test_row_segments_reject_duplicates_and_split_wide_rows(spark):
    wide = spark.range(5000).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value"))
    segments = matrix.to_row_segments(wide, 1024)
    assert segments.count() == 5 and segments.agg(F.max(F.size("cols"))).first()[0] == 1024
    assert matrix.from_row_segments(segments).exceptAll(wide).count() == 0
    with pytest.raises(Exception, match="occurs twice"):
        matrix.to_row_segments(coo(spark, [(0, 1, 1), (0, 1, 2)])).collect()


def test_sampled_similarity_is_close_and_exact_at_zero(spark):
    rng = random.Random(5)
    rows = [(i, j, 1.0) for i in range(3000) for j in range(4) if rng.random() < 0.3 + 0.1 * j]
    a = coo(spark, rows)
    exact = cells(matrix.column_similarity(a))
    near = cells(matrix.sampled_column_similarity(a, 0.1, 4))
    assert all(abs(near[k] - v) < 0.2 for k, v in exact.items())
    assert cells(matrix.sampled_column_similarity(a, 0.0, 4)) == exact


def test_preview_is_capped(spark):
    with pytest.raises(ValueError):
        matrix.preview(coo(spark, [(0, 0, 1)]), 200, 200)


def test_affinity_rules(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 1, 5.0)], "src long, dst long, weight double")
    assert cells(affinity.symmetric_edges(edges)) == {(0, 1): 1.0, (1, 0): 1.0}
    bad = spark.createDataFrame([(0, 1, -1.0)], "src long, dst long, weight double")
    with pytest.raises(Exception, match="negative"):
        affinity.symmetric_edges(bad).collect()
    start = affinity.random_vector(affinity.symmetric_edges(edges))
    assert start.agg(F.sum("value")).first()[0] == pytest.approx(1.0)


def test_two_cliques_are_told_apart(spark):
    pairs = [(a, b, 1.0) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(4, 5, 0.01)]
    found = affinity.cluster(spark.createDataFrame(pairs, "src long, dst long, weight double"), 2, 15)
    groups = {r["id"]: r["cluster"] for r in found.collect()}
    assert len({groups[i] for i in range(5)}) == 1 and groups[0] != groups[9]


@pytest.mark.parametrize("k", [1, 4])
def test_top_k_asks_few_bands_of_degrees(spark, monkeypatch, k):
    """Unequal rows on one hub, of many degrees, each with near copies: far bands are not asked."""
    draw = random.Random(k)
    rows, formed = {}, []
    for group in range(12):
        base = {f"g{group}m{n}" for n in range(int(4 * 1.6**group))}
        for copy in range(8):
            rows[group * 10 + copy] = {"hub"} | {m for m in base if draw.random() < 0.98} | {f"own{group}_{copy}"}
    w = spark.createDataFrame([(r, m, 1.0) for r, mids in rows.items() for m in mids], "i long, j string, value double")
    plain = pathsim.band_pairs

    def counting(*args):
        pairs = plain(*args)
        formed.append(pairs.count())
        return pairs

    monkeypatch.setattr(pathsim, "band_pairs", counting)
    got = {}
    for r in pathsim.pathsim_top_k(w, k).collect():
        got.setdefault(r.i, {})[r["rank"]] = (r.j, r.value)
    for a, x in rows.items():
        scored = sorted((-2 * len(x & y) / (len(x) + len(y)), b) for b, y in rows.items() if b != a)[:k]
        assert [(j, pytest.approx(v)) for j, v in (got[a][n + 1] for n in range(k))] == [(b, pytest.approx(-s)) for s, b in scored]
    assert sum(formed) < 0.5 * len(rows) * (len(rows) - 1) / 2


def test_top_k_of_like_degrees_is_one_pass_of_few_pairs(spark, monkeypatch):
    draw = random.Random(8)
    rows = {r: set(draw.sample(range(60), draw.randrange(14, 27))) for r in range(120)}
    w = spark.createDataFrame([(r, m, 1.0) for r, mids in rows.items() for m in mids], "i long, j long, value double")
    plain, formed = pathsim.band_pairs, []

    def counting(*args):
        pairs = plain(*args)
        formed.append(pairs.count())
        return pairs

    monkeypatch.setattr(pathsim, "band_pairs", counting)
    monkeypatch.setattr(matrix, "BLOCK_PRODUCTS", 30_000)
    got = {}
    for r in pathsim.pathsim_top_k(w, 2).collect():
        got.setdefault(r.i, []).append((r["rank"], r.j, r.value))
    for a, x in rows.items():
        scored = sorted((-2 * len(x & y) / (len(x) + len(y)), b) for b, y in rows.items() if b != a)[:2]
        assert sorted(got[a]) == [(n + 1, b, pytest.approx(-s)) for n, (s, b) in enumerate(scored)]
    assert len(formed) == 1 and formed[0] < 0.5 * len(rows) * (len(rows) - 1) / 2


def test_classes_share_a_weight_until_they_differ(spark):
    """One weight per arc before the first new ones; made one way they are those of every edge, and no round follows."""
    relations, _ = random_network(spark, 6)
    edges = relations.select("rel", "i", "row", "j", "col", F.col("w0").alias("w"))
    items = spark.createDataFrame([(0, x) for x in range(9)] + [(1, x) for x in range(40)], "m int, x long")
    labels = spark.createDataFrame([(0, 0, 0), (1, 3, 1), (1, 4, 1)], "m int, x long, k int")
    state = rankclass.start(items, labels, edges, 2, 2)
    assert [c for c in state.arcs.columns if c.startswith("w")] == ["w0"] and not state.parted
    ranks = rankclass.update_ranks(rankclass.normalize_relations(relations, 2), state.ranks, state.ranks, 2, 2)
    weights = by_key(rankclass.reweight(relations, ranks, 2, 1), 5)
    state = rankclass.step(state, one_way=True)
    got, lanes = by_key(state.relations, 5), {r["lane"] for r in state.arcs.select("lane").distinct().collect()}
    assert got.keys() == weights.keys() and all(got[k] == pytest.approx(weights[k]) for k in weights) and lanes == {0, 2}
    with pytest.raises(ValueError, match="no round can follow"):
        rankclass.step(state)


def test_equal_edges_meet_in_tasks_of_bounded_rows(spark):
    rows = spark.range(2000).select(F.col("id") % 700)
    assert runtime.spread(rows, rows.columns, 5000).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    moved = runtime.spread(rows, rows.columns, 100)
    assert moved.rdd.getNumPartitions() == 20
    plan = moved.groupBy(*moved.columns).count()
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and plan.count() == 700


@pytest.mark.parametrize("hot", [False, True])
def test_dimensions_take_tasks_of_bounded_rows(spark, monkeypatch, hot):
    """Few partitions of the session leave the number of tasks as it is; the cells of a hot end go to several."""
    monkeypatch.setattr(rankclass, "END_ROWS", 50 if hot else 5000)
    rng = random.Random(5)
    rows = [("r", 0, rng.choice([None, "7", *map(str, range(60))]), 1, rng.randrange(300), 1.0) for _ in range(9000)]
    rows += [("s", 0, str(x), 1, 7, 1.0) for x in range(2000)] + [("s", 0, str(x), 1, None, 1.0) for x in (3, 3, 4)]
    edges = spark.createDataFrame(rows, "rel string, i int, row string, j int, col long, w double")
    want = []
    for rel in ("r", "s"):
        found = {(r[2], r[4]) for r in rows if r[0] == rel}
        want.append((rel, *[len({c[k] for c in found} - {None}) for k in (0, 1)], len(found)))
    assert bool(rankclass._hot_slots(edges)[1]) == hot
    table = rankclass.relation_table(edges, 2)
    for got in (rankclass.relation_dimensions(table), rankclass.relation_dimensions(table, edges)):
        assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "at_row" in line and "row" in line]
    assert sum("REPARTITION_BY_NUM" in m and (", 441)" if hot else ", 5)") in m.replace(", REPARTITION", ")") for m in moves) == 1


@pytest.mark.parametrize(
    "rounds,first,case",
    [(1, None, "still"), (2, None, "still"), (2, "s", "still"), (2, None, "hot"), (2, None, "missing"), (1, None, "negative")],
)
def test_run_equals_rounds_on_edges(spark, monkeypatch, rounds, first, case):
    """Edges stay with one weight for all classes; hot ends, ends that are no items and negative weights go the other way."""
    rng = random.Random(rounds)
    edges = [("r", 0, rng.randrange(9), 1, rng.randrange(20), 1.0) for _ in range(120)]
    edges += [("s", 0, rng.randrange(9), 0, rng.randrange(9), 2.0) for _ in range(30)] + [("u", 1, 3, 2, 0, 1.0)]
    edges += [("r", 0, 50, 1, 3, 1.0)] if case == "missing" else [("s", 0, 2, 0, 3, -0.01)] if case == "negative" else []
    edges = spark.createDataFrame(edges, "rel string, i int, row long, j int, col long, w double")
    items = spark.createDataFrame([(0, x) for x in range(9)] + [(1, x) for x in range(20)] + [(2, 0), (2, 1)], "m int, x long")
    labels = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 3, 1), (1, 4, 1)], "m int, x long, k int")
    if case == "hot":
        monkeypatch.setattr(rankclass, "HOT_ARCS", 4)
    state = rankclass.run(items, labels, edges, classes=2, types=3, rounds=rounds, first_relation=first)
    assert ("part" not in state.arcs.columns) == (case == "still")
    if case == "still":
        assert [c for c in state.arcs.columns if c.startswith("w")] == ["w0"] and state.arcs.count() == 2 * edges.count()
    relations, start = rankclass.relation_table(edges, 2), rankclass.initial_ranks(items, labels, 2)
    ranks = start
    for t in range(1, rounds + 1):
        if t > 1:
            relations = runtime.materialize(rankclass.reweight(relations, ranks, 2, t - 1), "weights")
        used = relations.where(F.col("rel") == first) if first and t == 1 else relations
        normal = rankclass.normalize_relations(used, 2)
        ranks = runtime.materialize(rankclass.update_ranks(normal, ranks, start, 2, 3), "ranks")
    for got, want, n in ((state.ranks, ranks, 2), (state.relations, relations, 5)):
        got, want = by_key(got, n), by_key(want, n)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    if case == "still" and rounds == 2 and first is None:
        onward = rankclass.step(state, reweighted=False)
        again = rankclass.run(items, labels, edges, classes=2, types=3, rounds=3)
        weights = rankclass.reweight(relations, ranks, 2, 2)
        want = by_key(rankclass.update_ranks(rankclass.normalize_relations(weights, 2), ranks, start, 2, 3), 2)
        got = by_key(again.ranks, 2)
        assert all(got[k] == pytest.approx(want[k]) for k in want) and onward.round == again.round == 3


def test_sums_of_many_arcs_move_in_turns(spark, monkeypatch):
    """A turn moves the sums of its own ends, and its shuffle is gone before the next one."""
    rng = random.Random(4)
    edges = [("r", 0, rng.randrange(30), 1, rng.randrange(40), 1.0) for _ in range(300)] + [("s", 1, x, 1, x + 1, 2.0) for x in range(20)]
    edges = spark.createDataFrame(edges, "rel string, i int, row long, j int, col long, w double")
    items = spark.createDataFrame([(0, x) for x in range(30)] + [(1, x) for x in range(41)], "m int, x long")
    labels = spark.createDataFrame([(0, x, x % 3) for x in range(9)] + [(1, 3, 1), (1, 4, 2)], "m int, x long, k int")
    plain = rankclass.run(items, labels, edges, classes=3, types=2)
    seen, write = [], runtime.materialize_rounds

    def counting(part, rounds, keys, label, *more):
        seen.append((label, rounds))
        return write(part, rounds, keys, label, *more)

    for module in (rankclass, rankstill):
        monkeypatch.setattr(module, "materialize_rounds", counting)
    monkeypatch.setattr(rankstill, "ARCS_OF_TURNS", 100)
    turned = rankclass.run(items, labels, edges, classes=3, types=2)
    assert seen == [("arcs", 2), ("ranks", 2), ("ends", 2), ("ranks", 3)]
    for got, want, n in ((turned.ranks, plain.ranks, 2), (turned.relations, plain.relations, 5)):
        got, want = by_key(got, n), by_key(want, n)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_best_class_is_the_lowest_of_equals(spark):
    ranks = spark.createDataFrame([(0, 1, 0.2, 0.5, 0.5), (0, 2, 0.0, 0.0, 0.0), (1, 1, 0.3, 0.1, 0.3)], "m int, x long, p0 double, p1 double, p2 double")
    assert by_key(rankclass.assign_classes(ranks, 3), 2) == {(0, 1): (1, 0.5), (1, 1): (0, 0.3)}


def test_similarities_lie_by_their_source(spark, monkeypatch):
    """Power iteration sends a vertex to each task with an edge of it: a source has one task."""
    from pyspark.ml.clustering import PowerIterationClustering

    given = []
    monkeypatch.setattr(affinity, "spread", lambda df, keys: runtime.spread(df, keys, 50))
    monkeypatch.setattr(PowerIterationClustering, "assignClusters", lambda self, df: given.append(df))
    edges = spark.range(400).select((F.col("id") % 20).alias("src"), (F.col("id") + 1000).alias("dst"), F.lit(1.0).alias("weight"))
    affinity.cluster(edges.repartition(6), 2)
    lying = given[0].withColumn("task", F.spark_partition_id())
    placed = lying.groupBy("src").agg(F.countDistinct("task").alias("n"), F.count("dst").alias("k"))
    assert given[0].rdd.getNumPartitions() == 8 and {(r["n"], r["k"]) for r in placed.collect()} == {(1, 20)}


@pytest.mark.parametrize("edges_of_block", [1_000_000, 40])
def test_power_iteration_by_blocks(spark, monkeypatch, edges_of_block):
    """Steps from the degrees equal dense ones; loops do not count, equal edges add up, and Spark's graph is not built."""
    from pyspark.ml.clustering import PowerIterationClustering

    rng = random.Random(6)
    rows = [(rng.randrange(12), rng.randrange(12), float(rng.randrange(1, 5))) for _ in range(120)]
    rows += [(rng.randrange(100, 130), rng.randrange(100, 130), 3.0) for _ in range(300)] + [(3, 105, 0.01), (500, 500, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    ids = sorted({e for a, b, _ in rows if a != b for e in (a, b)})
    w = np.zeros((len(ids), len(ids)))
    for a, b, x in rows:
        if a != b:
            w[ids.index(a), ids.index(b)] += x
            w[ids.index(b), ids.index(a)] += x
    v = w.sum(1) / w.sum()
    for _ in range(5):
        v = w @ v / w.sum(1)
        v /= np.abs(v).sum()
    monkeypatch.setattr(affinity, "BLOCK_EDGES", edges_of_block)
    got = {r["id"]: r["value"] for r in affinity.power_iterate(edges, 5).collect()}
    assert sorted(got) == ids and [got[i] for i in ids] == pytest.approx(v.tolist(), rel=1e-9)

    def pairs(found):
        by = {r["id"]: r["cluster"] for r in found.collect()}
        return sorted(by), {(a, b) for a in by for b in by if by[a] == by[b]}

    spark_ids, together = pairs(PowerIterationClustering(k=2, maxIter=5, initMode="degree", weightCol="weight").assignClusters(edges))
    monkeypatch.setattr(PowerIterationClustering, "assignClusters", None)
    assert pairs(affinity.cluster(edges, 2, 5, "degree")) == (spark_ids, together)
    with pytest.raises(Exception, match="negative"):
        affinity.cluster(edges.withColumn("weight", F.col("weight") - 2), 2, 5, "degree").collect()
