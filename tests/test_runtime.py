import math
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hinloom import runtime
from hinloom.operators import ordering


class Session:
    """The parts of a session `working_dir` reads."""

    def __init__(self, setting=None, master="yarn"):
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: setting})()
        self.sparkContext = type(
            "Context", (), {"master": master, "applicationId": "a", "getCheckpointDir": lambda _: None}
        )()


def test_working_dir_follows_the_session():
    assert runtime.working_dir(Session("hdfs://shared/steps/")) == "hdfs://shared/steps"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.working_dir(Session())
    assert runtime.working_dir(Session(master="local[2]")).startswith("/tmp/run-")


def test_discard_deletes_the_written_step(spark):
    kept = runtime.materialize(spark.range(5), "x")
    folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert kept.count() == 5 and folder.exists()
    runtime.discard(kept)
    assert not folder.exists() and folder.parent.exists()


def test_discard_leaves_other_tables_alone(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    mine = spark.read.parquet(str(tmp_path / "mine"))
    runtime.discard(mine)
    assert mine.count() == 3


def test_written_step_has_a_flat_plan(spark):
    df = spark.range(10)
    for _ in range(6):
        df = runtime.materialize(df.groupBy("id").count().select("id"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and len(plan.splitlines()) == 1


def test_ordered_ids_are_consecutive_over_ranges(spark):
    keys = [f"k{i:05d}" for i in range(5000)]
    shuffled = random.Random(1).sample(keys, len(keys))
    df = spark.createDataFrame([(k,) for k in shuffled], "k string").repartition(8)
    rows = runtime.ordered_ids(df, ["k"], "n", start=3).orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(3, 5003))
    assert [r["k"] for r in rows] == keys


def test_running_sums_match_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(-5, 9), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, a long, b double").repartition(7)
    got = runtime.running_sums(df, [F.col("k").desc()], ["a", "b"]).orderBy(F.desc("k")).collect()
    a = b = 0
    for row, (_, x, y) in zip(got, sorted(rows, reverse=True)):
        a, b = a + x, b + y
        assert row["a_cum"] == a and math.isclose(row["b_cum"], b, abs_tol=1e-9)


@pytest.mark.parametrize("cell", [None, 3, 50, 100_000])
def test_hot_key_join_equals_the_plain_join(spark, cell):
    left = [(0 if i % 3 == 0 else i, f"l{i}") for i in range(300)]
    right = [(0 if i % 4 == 0 else i, f"r{i}") for i in range(200)]
    l = spark.createDataFrame(left, "k long, l string")
    r = spark.createDataFrame(right, "k long, r string")
    want = sorted((k, a, b) for k, a in left for q, b in right if k == q)
    got = sorted(tuple(x) for x in runtime.hot_key_join(l, r, "k", cell).select("k", "l", "r").collect())
    assert got == want


def test_hot_parts_stay_below_the_cell(spark):
    """The largest join group is bounded although one key holds all rows."""
    rows = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    other = rows.withColumnRenamed("v", "w")
    joined = runtime.hot_key_join(rows, other, "k", 100)
    assert joined.count() == 1_000_000
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "_pl" in plan and "_pr" in plan


def test_sliding_crosses_chunks_and_stops_at_keys(spark):
    rows = [("a" if i < 70 else "b", i, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(5)
    for chunk in (4, 7, 1000):
        got = ordering.sliding(df, ["t"], 4, ["v"], key="k", chunk=chunk).collect()
        starts = sorted(r["v_0"] for r in got)
        assert starts == [float(i) for i in range(97) if i <= 66 or i >= 70]
        assert all(r["v_3"] == r["v_0"] + 3 for r in got)


def test_sliding_edges(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "t int, v double")
    assert ordering.sliding(df, ["t"], 3, ["v"]).count() == 0
    assert ordering.sliding(df, ["t"], 1, ["v"]).count() == 2
    with pytest.raises(ValueError):
        ordering.sliding(df, ["t"], 0, ["v"])


@pytest.mark.parametrize("k", [3, 1200])
def test_top_k_of_a_hot_key(spark, k):
    df = spark.range(5000).select(F.lit("x").alias("key"), F.col("id"), (F.col("id") % 1777).alias("v"))
    got = ordering.top_k_per_key(df, ["key"], [F.desc("v"), F.col("id")], k).orderBy("rank").collect()
    want = sorted(((i % 1777, i) for i in range(5000)), key=lambda p: (-p[0], p[1]))[:k]
    assert [(r["v"], r["id"]) for r in got] == want


def test_trimming_happens_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("key"), "id")
    plan = ordering.top_k_per_key(df, ["key"], [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(v,) for v in [5.0, 1.0, 5.0, 2.0, 5.0]], "v double")
    got = {r["value"]: r["rank"] for r in ordering.average_ranks(df, "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 5.0: 4.0}


def test_few_scores_are_not_merged(spark):
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(10)], "s double, y double")
    assert ordering.downsample_scores(df, "s", "y", 8).count() == 10
    assert ordering.downsample_scores(df, "s", "y", 5).count() == 5


def test_intermediates_go_with_their_block(spark):
    from pathlib import Path

    from hinloom import runtime

    outside = runtime.materialize(spark.range(3), "outside")
    with runtime.intermediates(spark):
        inside = runtime.materialize(spark.range(5), "inside")
        assert inside.count() == 5
        folder = Path(inside.inputFiles()[0].removeprefix("file://")).parent
    assert not folder.exists() and outside.count() == 3


@pytest.mark.parametrize("write", ["materialize", "materialize_buckets"])
def test_a_written_step_leaves_no_shuffle_files(spark, write):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
        return {f for f in files.split(",") if "/shuffle_" in f}

    before = held()
    df = spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    step = runtime.materialize(df) if write == "materialize" else runtime.materialize_buckets(df, ["k"])
    end = time.time() + 20
    while held() - before and time.time() < end:
        time.sleep(0.2)
    assert not held() - before
    assert step.count() == 10 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
