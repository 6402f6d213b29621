import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinloom.functions import vectors as v
from hinloom.operators import dense, dictionary, evaluation, features, statistics
from hinloom.sources import generators as gen
from hinloom.sources import jdbc, libsvm, text


def write(path, body):
    path.write_text(body)
    return str(path)


def test_text_scans(spark, tmp_path):
    labels = text.read_labels(spark, write(tmp_path / "l.txt", '36\t2\tAA"AI\t\n597\t3\tCIKM\t\n')).collect()
    assert [tuple(r) for r in labels] == [("36", 2, 'AA"AI'), ("597", 3, "CIKM")]
    coo = text.read_coo(spark, write(tmp_path / "m.csv", "1,2,3.5\n2,1,4\n")).collect()
    assert {tuple(r) for r in coo} == {(0, 1, 3.5), (1, 0, 4.0)}
    ratings = text.read_ratings(spark, write(tmp_path / "r.txt", "0::2::3::142\n0::3::1\n")).collect()
    assert [tuple(r) for r in ratings] == [(0, 2, 3.0, 142), (0, 3, 1.0, None)]
    vecs = text.read_vectors(spark, write(tmp_path / "v.txt", "1.0  2.0\n\n3 4e-1\n")).collect()
    assert [r["features"] for r in vecs] == [[1.0, 2.0], [3.0, 0.4]]


def test_literal_scans(spark, tmp_path):
    path = write(tmp_path / "p.txt", "[1.0,2.0]\n(3,[0,2],[1.5,-2.0])\n(2,[],[])\n")
    assert [r["features"] for r in text.read_vector_literals(spark, path).collect()] == [
        [1.0, 2.0], [1.5, 0.0, -2.0], [0.0, 0.0]
    ]
    path = write(tmp_path / "q.txt", "(1.0,[2.0,3.0])\n(0.0,(3,[1],[4.0]))\n-0.5,1 2\n")
    rows = [(r["label"], r["features"]) for r in text.read_labeled_literals(spark, path).collect()]
    assert rows == [(1.0, [2.0, 3.0]), (0.0, [0.0, 4.0, 0.0]), (-0.5, [1.0, 2.0])]


def test_matrix_text(spark, tmp_path):
    path = write(tmp_path / "e.txt", "MatrixEntry(3,4,1.5E-3)\n")
    assert [tuple(r) for r in text.read_matrix_entries(spark, path).collect()] == [(3, 4, 0.0015)]
    path = write(tmp_path / "r.txt", "IndexedRow(7,(9,[1,8],[0.5,2.0]))\nIndexedRow(8,(9,[],[]))\n")
    assert [tuple(r) for r in text.read_indexed_rows(spark, path).collect()] == [(7, 1, 0.5), (7, 8, 2.0)]


def test_libsvm_width(spark, tmp_path):
    path = write(tmp_path / "s.txt", "# note\n1 1:2.0 3:4.0\n\n0 2:1.0\n")
    assert [len(r["features"]) for r in libsvm.read(spark, path).collect()] == [3, 3]
    assert [len(r["features"]) for r in libsvm.read(spark, path, 5).collect()] == [5, 5]


def test_jdbc_options_carry_no_secrets():
    t = jdbc.JdbcTable("jdbc:x://host/db", "pap", {"user": "u"}, "id", 0, 100, 8)
    assert t.reader_options() == {
        "url": "jdbc:x://host/db", "dbtable": "pap", "user": "u",
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8",
    }


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_vector_edges(spark):
    zero = v.array_of([0.0, 0.0])
    assert one(spark, v.normalize(zero)) == [0.0, 0.0]
    assert one(spark, v.argmax(v.array_of([1.0, 3.0, 3.0]))) == 1
    assert one(spark, v.log1p_exp(F.lit(1000.0))) == 1000.0
    assert one(spark, v.log1p_exp(F.lit(-1000.0))) == 0.0
    assert one(spark, v.to_dense(v.to_sparse(v.array_of([0.0, 2.0, 0.0])), 3)) == [0.0, 2.0, 0.0]
    long = [float(i) for i in range(300)]
    assert one(spark, v.dot_constant(v.array_of(long), long)) == sum(i * i for i in long)
    assert one(spark, v.diagonal_gaussian_logpdf(v.array_of([1.0, 9.0]), [0.0, 0.0], [1.0, 0.0])) == pytest.approx(
        -0.5 * math.log(2 * math.pi) - 0.5
    )
    with pytest.raises(ValueError):
        v.norm(zero, 0.5)
    with pytest.raises(Exception, match="size 3"):
        one(spark, v.hadamard(zero, [1.0, 2.0, 3.0]))


def test_dense_algebra(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 5)) @ np.diag([5, 4, 3, 2, 1])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "f array<double>").repartition(6)
    s, basis = dense.svd(df, "f", 3)
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:3])
    u = np.array([r["u"] for r in dense.left_singular(df, "f", s, basis).collect()])
    assert np.allclose(u.T @ u, np.eye(3), atol=1e-8)
    r = dense.qr_r(df, "f")
    assert np.allclose(r.T @ r, x.T @ x) and np.allclose(r, np.triu(r))
    pcs = dense.principal_components(df, "f", 2)
    want = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs(pcs.T @ want), np.eye(2), atol=1e-8)
    big = rng.standard_normal((5, 90))
    wide = dense.multiply_local(df.withColumn("id", F.monotonically_increasing_id()), "f", big.tolist())
    for row in wide.collect():
        assert np.allclose(row["product"], np.array(row["f"]) @ big)
    low = df.select(F.transform("f", lambda e: e * 0).alias("f"))
    assert all(math.isnan(c["value"]) for c in dense.pearson(low, "f").collect() if c["i"] != c["j"])
    with pytest.raises(ValueError, match="two rows"):
        dense.covariance(df.limit(1), "f").collect()


def test_statistics(spark):
    counts = spark.createDataFrame([(10,), (20,), (30,)], "n long")
    row = statistics.chi_square_fit(counts, "n").first()
    assert row["statistic"] == pytest.approx(10.0) and row["df"] == 2
    assert row["p_value"] == pytest.approx(math.exp(-5.0))
    scaled = statistics.chi_square_fit(counts.withColumn("e", F.col("n") * 3), "n", "e").first()
    assert scaled["statistic"] == pytest.approx(0.0) and scaled["p_value"] == pytest.approx(1.0)
    many = spark.range(10_001).select("id", F.lit(1).alias("y"))
    with pytest.raises(Exception, match="10,000"):
        statistics.chi_square_independence(many, ["id"], "y").collect()
    assert statistics.ks_p_value(0.01, 50) > 0.999 and statistics.ks_p_value(0.5, 100) < 1e-10
    with pytest.raises(ValueError):
        statistics.kernel_density(counts, "n", [1.0], 0.0)


def test_p_values_match_the_built_in_test(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import ChiSquareTest

    df = spark.range(500).select(
        (F.col("id") % 3).cast("double").alias("a"), F.floor(F.col("id") / 7 % 4).cast("double").alias("b"), (F.col("id") % 5 % 2).alias("y")
    )
    ours = statistics.chi_square_independence(df, ["a", "b"], "y").orderBy("feature").collect()
    vec = df.select(array_to_vector(F.array("a", "b")).alias("f"), "y")
    theirs = ChiSquareTest.test(vec, "f", "y").first()
    assert [r["statistic"] for r in ours] == pytest.approx(list(theirs["statistics"]))
    assert [r["p_value"] for r in ours] == pytest.approx(list(theirs["pValues"]))


def test_idf_and_auc_by_hand(spark):
    docs = spark.createDataFrame([(0, ["a", "b"]), (1, ["b"]), (2, ["b", "b"])], "d long, w array<string>")
    tf = features.term_counts(docs, "d", "w")
    got = {r["term"]: r["idf"] for r in features.idf(tf, 3).collect()}
    assert got == {"a": pytest.approx(math.log(4 / 2)), "b": pytest.approx(0.0)}
    assert features.idf(tf, 3, 2).where("term = 'a'").first()["idf"] == 0.0
    scored = spark.createDataFrame([(0.9, 1.0), (0.8, 0.0), (0.7, 1.0), (0.6, 0.0)], "s double, y double")
    curve = evaluation.binary_curve(scored, "s", "y")
    assert evaluation.area(evaluation.roc(curve)).first()["area"] == pytest.approx(0.75)


def test_word_count_of_the_sample(spark):
    lines = ["pizza pasta panini", "pizza pasta", "pizza panini"]
    df = spark.createDataFrame([(line,) for line in lines], "t string")
    assert {r["word"]: r["count"] for r in features.word_count(df, "t").collect()} == {"pizza": 3, "pasta": 2, "panini": 2}


def test_ranking_edges(spark):
    df = spark.createDataFrame([([1, 2], [1, 3, 4]), ([5], [])], "p array<int>, t array<int>")
    short, empty = evaluation.ranking_rows(df, "p", "t", 5).collect()
    assert short["precision_at"] == pytest.approx(0.2) and short["average_precision"] == pytest.approx(1 / 3)
    ideal = sum(1 / math.log(i + 2) for i in range(3))
    assert short["ndcg_at"] == pytest.approx(1 / math.log(2) / ideal)
    assert empty["precision_at"] == empty["average_precision"] == empty["ndcg_at"] == 0.0


def test_labels_and_folds(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "y double")
    assert not dictionary.labels_are_valid(df, "y") and dictionary.labels_are_valid(df.where("y <> 0.5"), "y")
    keys = spark.range(3000)
    folds = dictionary.k_folds(keys, "id", 3)
    sizes = [valid.count() for _, valid in folds]
    assert sum(sizes) == 3000 and all(800 < s < 1200 for s in sizes)
    assert all(train.intersect(valid).isEmpty() for train, valid in folds)


@pytest.mark.parametrize(
    "name, params, mean, variance",
    [
        ("uniform", (), 0.5, 1 / 12), ("normal", (), 0.0, 1.0), ("poisson", (4.0,), 4.0, 4.0),
        ("exponential", (2.0,), 2.0, 4.0), ("gamma", (2.0, 3.0), 6.0, 18.0),
        ("log_normal", (0.0, 0.5), math.exp(0.125), (math.exp(0.25) - 1) * math.exp(0.25)),
    ],
)
def test_random_values(spark, name, params, mean, variance):
    df = gen.random_values(spark, 40_000, name, *params, partitions=4)
    m = df.agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.countDistinct("id").alias("n")).first()
    assert m["n"] == 40_000 and m["m"] == pytest.approx(mean, abs=0.1) and m["v"] == pytest.approx(variance, rel=0.1, abs=0.02)
    assert df.exceptAll(gen.random_values(spark, 40_000, name, *params, partitions=4)).isEmpty()
    wide = gen.random_values(spark, 100, name, *params, cols=7, partitions=2)
    assert {len(r["features"]) for r in wide.collect()} == {7}


@pytest.mark.parametrize(
    "generator, mean",
    [(gen.uniform, 0.5), (gen.standard_normal, 0.0), (gen.exponential(2.0), 2.0), (gen.poisson(3.0), 3.0),
     (gen.log_normal(0.0, 0.5), math.exp(0.125)), (lambda seed: F.rand(seed) * 10, 5.0)],
)
def test_column_generators(spark, generator, mean):
    got = gen.random_column(spark, 40_000, generator, 4).agg(F.avg("value")).first()[0]
    assert got == pytest.approx(mean, abs=0.1)
    rows = gen.random_vectors(spark, 50, 3, generator, 2).collect()
    assert all(len(r["features"]) == 3 and len(set(r["features"])) >= 1 for r in rows)


def test_sample_data(spark):
    assert gen.load_test_vectors(spark, 20, 100).agg(F.max(F.size("features"))).first()[0] == 100
    blobs = gen.blobs(spark, 300, 3, 2, 50.0)
    means = blobs.groupBy(F.pmod("id", F.lit(3)).alias("c")).agg(F.stddev(F.col("features")[0]).alias("s")).collect()
    assert all(0.7 < r["s"] < 1.3 for r in means)
    assert gen.svm_points(spark, 500, 3).select("label").distinct().count() == 2
    x = gen.logistic_points(spark, 2000, 2, 3.0).groupBy("label").agg(F.avg(F.col("features")[0]).alias("m"))
    assert {r["label"]: round(r["m"]) for r in x.collect()} == {0.0: 0, 1.0: 3}
    ratings = gen.low_rank_ratings(spark, 100, 50, 3, 0.2)
    n = ratings.count()
    assert 700 < n <= 1000 and ratings.select("user", "item").distinct().count() == n
