import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinloom.streaming.kmeans import StreamingKMeans, decay_for_half_life, merge
from hinloom.streaming.linear import StreamingLogisticRegression, StreamingRegression


def points(spark, rows):
    return spark.createDataFrame([([float(v) for v in r],) for r in rows], "features array<double>")


def test_batches_fold_in_once(spark, tmp_path):
    model = StreamingKMeans(spark, str(tmp_path / "s"), decay=0.5)
    model.start([[0.0], [10.0]], [2.0, 2.0])
    model.update(points(spark, [[2.0], [2.0]]), 0)
    centres, weights = model.model()
    assert centres[:, 0].tolist() == pytest.approx([(0 * 1 + 4) / 3, 10.0]) and weights.tolist() == [3.0, 1.0]
    model.update(points(spark, [[9.0]]), 0)  # a replayed batch id
    assert model.model()[1].tolist() == [3.0, 1.0]
    model.update(points(spark, []), 1)
    assert model.state.versions() == [0, 1]
    model.start([[5.0]], [1.0])
    assert len(model.model()[0]) == 2


def test_a_torn_version_is_not_read(spark, tmp_path):
    model = StreamingKMeans(spark, str(tmp_path / "s"))
    model.start([[0.0]], [1.0])
    (tmp_path / "s" / "version=000000000001,run=,batch=0").mkdir()
    (tmp_path / "s" / "version=000000000001,run=,batch=0" / "part-junk.parquet").write_text("x")
    assert model.state.versions() == [0]
    model.update(points(spark, [[1.0]]), 0)
    assert model.model()[0].tolist() == [[0.5]]


def test_points_unit_and_half_life(spark, tmp_path):
    assert decay_for_half_life(3.0) ** 3 == pytest.approx(0.5)
    model = StreamingKMeans(spark, str(tmp_path / "s"), decay=0.5, unit="points")
    model.start([[0.0]], [8.0])
    model.update(points(spark, [[1.0], [1.0]]), 0)
    assert model.model()[1].tolist() == [8.0 * 0.25 + 2]


def test_a_dying_cluster_splits_the_heaviest():
    centres, weights = merge(
        np.array([[1.0], [50.0]]), np.array([100.0, 1e-9]), np.array([10.0, 0.0]), np.array([[10.0], [0.0]]), 1.0
    )
    assert weights[0] == weights[1] == pytest.approx(55.0)
    assert centres[0, 0] == pytest.approx(1.0) and centres[0, 0] > centres[1, 0]


def test_stream_and_restart(spark, tmp_path):
    source = str(tmp_path / "in")
    points(spark, [[0.0], [1.0]]).coalesce(1).write.parquet(source)
    model = StreamingKMeans(spark, str(tmp_path / "s"))
    model.start([[0.0]], [0.0])
    stream = lambda: spark.readStream.schema("features array<double>").parquet(source)
    model.train_on(stream(), str(tmp_path / "c")).awaitTermination()
    points(spark, [[4.0]]).coalesce(1).write.mode("append").parquet(source)
    again = StreamingKMeans(spark, str(tmp_path / "s"))
    again.train_on(stream(), str(tmp_path / "c")).awaitTermination()
    assert again.model()[0].tolist() == [[pytest.approx(5 / 3)]] and again.model()[1].tolist() == [3.0]
    again.predict_on(stream(), str(tmp_path / "o"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_a_new_checkpoint_loses_no_batch(spark, tmp_path):
    """Batch numbers start anew with another checkpoint folder; the model goes on."""
    model = StreamingKMeans(spark, str(tmp_path / "s"))
    model.start([[0.0]], [0.0])
    for n, value in enumerate([0.0, 3.0, 6.0]):
        source = str(tmp_path / f"in{n}")
        points(spark, [[value]]).coalesce(1).write.parquet(source)
        stream = spark.readStream.schema("features array<double>").parquet(source)
        model.train_on(stream, str(tmp_path / f"c{n}")).awaitTermination()
    assert model.model()[0].tolist() == [[pytest.approx(3.0)]] and model.model()[1].tolist() == [3.0]
    for n in range(2):
        stream = spark.readStream.schema("features array<double>").parquet(str(tmp_path / "in0"))
        model.predict_on(stream, str(tmp_path / "o"), str(tmp_path / f"p{n}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_old_versions_go(spark, tmp_path):
    model = StreamingKMeans(spark, str(tmp_path / "s"))
    model.state.kept = 3
    model.start([[0.0]], [0.0])
    for i in range(6):
        model.update(points(spark, [[float(i)]]), i)
    assert model.state.versions() == [4, 5, 6] and model.model()[1].tolist() == [6.0]


def test_a_replay_after_many_versions_of_another_run_changes_nothing(spark, tmp_path):
    model = StreamingKMeans(spark, str(tmp_path / "s"))
    model.state.kept = 2
    model.start([[0.0]], [0.0])
    model.update(points(spark, [[6.0]]), 0, run="failed before its commit")
    for i in range(4):
        model.update(points(spark, [[0.0]]), i, run="other")
    model.update(points(spark, [[6.0]]), 0, run="failed before its commit")
    assert model.model()[1].tolist() == [5.0] and model.state.versions() == [1, 4, 5]


def test_random_start(spark, tmp_path):
    model = StreamingKMeans(spark, str(tmp_path / "s"))
    with pytest.raises(RuntimeError):
        model.model()
    model.start_random(3, 2, 1.0)
    assert model.model()[0].shape == (3, 2)


def test_regression_continues_from_the_newest_weights(spark, tmp_path):
    model = StreamingRegression(spark, str(tmp_path / "s"), step=1.0, iterations=60)
    with pytest.raises(RuntimeError):
        model.weights()
    model.start([0.0])
    rows = spark.range(100).select(F.array((F.col("id") % 10) / 10).alias("features"), (F.col("id") % 10 * 0.3).alias("label"))
    model.update(rows, 0)
    first = model.weights()[0]
    model.update(rows, 1)
    second = model.weights()[0]
    assert abs(second - 3.0) < abs(first - 3.0) < 1.0
    model.update(rows.withColumn("label", F.lit(0.0)), 1)
    model.update(rows.where("false"), 2)
    assert model.weights()[0] == second and model.state.versions() == [0, 1, 2]


def test_logistic_learns_the_sign(spark, tmp_path):
    model = StreamingLogisticRegression(spark, str(tmp_path / "s"))
    model.start([0.0, 0.0])
    rows = spark.range(200).select(
        F.array(F.lit(1.0), (F.col("id") % 20 - 9.5) / 10).alias("features"), (F.col("id") % 20 >= 10).cast("double").alias("label")
    )
    model.update(rows, 0)
    assert model.weights()[1] > 0.1
    assert model.predict(rows).where("prediction <> label").count() == 0
    assert not math.isnan(model.weights()[0])


def test_queries_stream_a_table_of_many_files(spark, tmp_path):
    from hinloom.catalog.learning import streaming_kmeans_batch, streaming_kmeans_predict, streaming_linear

    given = "/root/testdata/sf0.001"
    for name in ("embeddings", "lineitem"):
        spark.read.parquet(f"{given}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in (streaming_kmeans_predict, streaming_kmeans_batch, streaming_linear):
        one, many = ([tuple(r) for r in query(spark, sf).collect()] for sf in (given, str(tmp_path)))
        assert one and sorted(one) == sorted(many)
