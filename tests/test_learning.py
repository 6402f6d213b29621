import math
import random
import re

import numpy as np
import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.fpm import PrefixSpan
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from hinloom.catalog import learning
from hinloom.functions.losses import LOSSES
from hinloom.operators import bayes, clustering, evaluation, linear, mining, recommend, trees
from hinloom.runtime import materialize
from hinloom.sources import generators as gen
from hinloom.sources import models


def sequences(spark, rows):
    flat = [(s, p, x) for s, elements in enumerate(rows) for p, e in enumerate(elements) for x in e]
    return spark.createDataFrame(flat, "s long, p long, x string")


@pytest.mark.parametrize("support, length, local_rows", [(0.5, 5, 0), (0.25, 4, 0), (0.25, 4, 30), (0.25, 10, 100_000), (0.25, 1, 30)])
def test_sequential_patterns_match_the_built_in_miner(spark, support, length, local_rows):
    rng = random.Random(11)
    rows = [[rng.sample("abcde", rng.randint(1, 3)) for _ in range(rng.randint(1, 4))] for _ in range(12)]
    ours = {
        (tuple(map(tuple, r["pattern"])), r["freq"])
        for r in mining.sequential_patterns(sequences(spark, rows), "s", "p", "x", support, length, local_rows).collect()
    }
    table = spark.createDataFrame([([sorted(e) for e in r],) for r in rows], "sequence array<array<string>>")
    miner = PrefixSpan(minSupport=support, maxPatternLength=length)
    theirs = {
        (tuple(tuple(sorted(e)) for e in r["sequence"]), r["freq"])
        for r in miner.findFrequentSequentialPatterns(table).collect()
    }
    assert ours == theirs and len(ours) > 4


def test_patterns_of_numbers_with_nulls_and_repeats(spark):
    rows = [(1, 1, 7), (1, 1, 7), (1, 2, 8), (2, 5, 7), (2, 6, 8), (2, 6, 9), (3, None, 7), (None, 1, 7), (4, 1, None)]
    events = spark.createDataFrame(rows, "s long, p int, x int")
    for local_rows in (0, 1000):
        got = mining.sequential_patterns(events, "s", "p", "x", 1.0, 3, local_rows)
        assert {(str(r["pattern"]), r["freq"]) for r in got.collect()} == {("[[7]]", 2), ("[[8]]", 2), ("[[7], [8]]", 2)}
    empty = mining.sequential_patterns(events.limit(0), "s", "p", "x")
    assert empty.isEmpty()


def test_only_positions_of_frequent_patterns_are_written(spark, monkeypatch):
    rng = random.Random(3)
    rows = [[["a"], ["b"]] + [[rng.choice("cdefghij")] for _ in range(6)] for _ in range(40)]
    counts = {}

    def noted(df, label="step"):
        written = materialize(df, label)
        counts.setdefault(label, []).append(written.count())
        return written

    monkeypatch.setattr(mining, "materialize", noted)
    found = {str(r["pattern"]): r["freq"] for r in mining.sequential_patterns(sequences(spark, rows), "s", "p", "x", 0.9, 3, 0).collect()}
    assert found == {"[['a']]": 40, "[['b']]": 40, "[['a'], ['b']]": 40}
    assert counts["patterns"] == [40] and counts["support"] == [1, 0]


def test_the_query_mines_more_than_two_items(spark, tmp_path):
    rows = [(c, day, p, "O") for c in range(3) for day, p in ((1, "1-A"), (1, "2-B"), (2, "3-C"), (3, "1-A"))]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderdate int, o_orderpriority string, o_orderstatus string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["pattern"]: r["freq"] for r in learning.sequential_patterns(spark, str(tmp_path)).collect()}
    firsts, rest = ["", "<1O>", "<2O>", "<1O,2O>"], ["", "<3O>", "<1O>", "<3O><1O>"]
    assert got == {a + b: 3 for a in firsts for b in rest if a + b} and len(got) == 14


def test_repeated_items_are_an_error(spark):
    with pytest.raises(Exception, match="unique"):
        mining.frequent_itemsets(spark.createDataFrame([(["a", "a"],)], "items array<string>"), "items").collect()


def test_rules_by_hand(spark):
    baskets = [["a", "b"], ["a", "b"], ["a", "b", "c"], ["b"], ["a"]]
    itemsets = mining.frequent_itemsets(spark.createDataFrame([(b,) for b in baskets], "items array<string>"), "items", 0.4)
    got = {(tuple(r["antecedent"]), r["consequent"]): r["confidence"] for r in mining.association_rules(itemsets, 0.7).collect()}
    assert got == {(("a",), "b"): 0.75, (("b",), "a"): 0.75}


def test_gradients_match_differences(spark):
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((50, 3)), rng.integers(0, 2, 50).astype(float)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "f array<double>, y double")
    w = np.array([0.3, -0.2, 0.5])
    for name in ("squared", "logistic"):
        _, g, n = linear.gradient(df, "f", "y", w, LOSSES[name])
        for i in range(3):
            e = np.eye(3)[i] * 1e-5
            up, down = (linear.gradient(df, "f", "y", w + s * e, LOSSES[name])[0] for s in (1, -1))
            assert g[i] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-4)
        assert n == 50


def test_wide_gradient_agrees_with_the_narrow_one(spark, monkeypatch):
    df = gen.linear_points(spark, 200, [1.0, -2.0], 0.5, 0.1)
    narrow = linear.gradient(df, "features", "label", [0.1, 0.2], LOSSES["squared"])
    monkeypatch.setattr(linear.vectors, "UNROLLED", 1)
    wide = linear.gradient(df, "features", "label", [0.1, 0.2], LOSSES["squared"])
    assert narrow[0] == pytest.approx(wide[0]) and narrow[1] == pytest.approx(wide[1])


def test_descent_reaches_least_squares(spark):
    df = gen.linear_points(spark, 2000, [1.5, -0.5], 0.0, 0.01).persist()
    w, history = linear.sgd(df, "features", "label", [0.0, 0.0], "squared", 1.0, 60, tolerance=1e-5)
    model = linear.least_squares(df, "features", "label")
    assert w == pytest.approx([1.5, -0.5], abs=0.05) and history[-1] < history[0]
    assert list(model.coefficients) == pytest.approx([1.5, -0.5], abs=0.01)
    shrunk = linear.lasso(df, "features", "label", 0.3)
    assert abs(shrunk.coefficients[0]) < 1.5 and np.linalg.norm(linear.ridge(df, "features", "label", 0.5).coefficients) < 1.5
    same, _ = linear.sgd_step(df.where("false"), "features", "label", [1.0, 2.0])
    assert same.tolist() == [1.0, 2.0]


def test_fitted_models_survive_saving(spark, tmp_path):
    df = gen.linear_points(spark, 300, [1.0], 0.0, 0.1)
    model = linear.least_squares(df, "features", "label")
    models.save_fitted(model, str(tmp_path / "lr"))
    assert models.load_fitted(LinearRegressionModel, str(tmp_path / "lr")).coefficients == model.coefficients
    means = clustering.k_means(df, "features", 2)
    models.save_fitted(means, str(tmp_path / "km"))
    assert len(models.load_fitted(KMeansModel, str(tmp_path / "km")).clusterCenters()) == 2


def test_separable_classes(spark):
    df = gen.logistic_points(spark, 400, 2, 6.0).persist()
    for model, link, cut in ((linear.logistic(df, "features", "label", 0.01), "logistic", 0.5), (linear.svm(df, "features", "label"), "margin", 0.0)):
        scored = linear.predict_class(df, "features", list(model.coefficients), model.intercept, cut, link)
        assert scored.where("prediction <> label").count() < 8
    raw = linear.predict_class(df, "features", [1.0, 1.0], 0.0, None).agg(F.min("prediction"), F.max("prediction")).first()
    assert 0 <= raw[0] < raw[1] <= 1


def test_isotonic_is_monotone_and_keeps_the_mean(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(float(i), i + rng.gauss(0, 20)) for i in range(100)], "x double, y double")
    model = linear.isotonic(df, "x", "y")
    steps = list(model.predictions)
    assert steps == sorted(steps)
    fitted = model.transform(df.select(F.col("x").alias("features"))).agg(F.avg("prediction")).first()[0]
    assert fitted == pytest.approx(df.agg(F.avg("y")).first()[0])
    assert list(linear.isotonic(df, "x", "y", increasing=False).predictions) == sorted(
        linear.isotonic(df, "x", "y", increasing=False).predictions, reverse=True
    )


def test_naive_bayes_rules(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "y string, f array<double>")
    for kind in ("multinomial", "bernoulli"):
        model = bayes.train(df, "f", "y", kind)
        assert bayes.predict(df, model, "f").where("prediction <> y").count() == 0
        total = bayes.predict_probabilities(df, model, "f").select(F.aggregate("probabilities", F.lit(0.0), lambda a, v: a + v).alias("t"))
        assert all(r["t"] == pytest.approx(1.0) for r in total.collect())
    with pytest.raises(Exception, match="invalid multinomial"):
        bayes.train(df.withColumn("f", F.array(F.lit(-1.0))), "f", "y")
    with pytest.raises(Exception, match="invalid bernoulli"):
        bayes.train(df.withColumn("f", F.array(F.lit(2.0))), "f", "y", "bernoulli")


def test_best_split_is_the_clean_one(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("a"), (F.col("id") % 7).alias("b")).withColumn("y", (F.col("a") > 20).cast("int"))
    for impurity, gain in (("gini", None), ("entropy", None), ("variance", None)):
        splits = trees.thresholds(df, ["a", "b"], 64)
        best = trees.best_split(trees.split_gains(df, splits, "y", impurity)).first()
        assert (best["feature"], best["threshold"], best["n_left"]) == ("a", 20.0, 420)
    assert len(trees.thresholds(df, ["a"], 8)["a"]) <= 8
    none = trees.split_gains(df, splits, "y", min_instances=501)
    assert none.isEmpty()


def test_bagging(spark):
    w = trees.bagging_weight(F.col("id"), 3, 1.5)
    m = spark.range(20_000).agg(F.avg(w).alias("m"), F.var_samp(w).alias("v")).first()
    assert m["m"] == pytest.approx(1.5, abs=0.05) and m["v"] == pytest.approx(1.5, abs=0.1)
    part = spark.range(20_000).agg(F.avg(trees.bagging_weight(F.col("id"), 1, 0.3, replacement=False))).first()[0]
    assert part == pytest.approx(0.3, abs=0.02)


def test_trees_fit_and_stop(spark):
    df = spark.range(600).select(
        F.array((F.col("id") % 10).cast("double"), (F.col("id") % 3).cast("double")).alias("features"),
        (F.col("id") % 10 > 4).cast("double").alias("label"), (F.col("id") % 4 == 0).alias("held"),
    )
    for model in (
        trees.tree_classifier(df, "features", "label", categorical=4), trees.forest_classifier(df, "features", "label", 5),
        trees.boosted_classifier(df, "features", "label", 3), trees.tree_regressor(df, "features", "label"),
    ):
        assert trees.predict(model, df, "features").where("abs(prediction - label) > 0.3").count() == 0
    stopped = trees.boosted_regressor(df, "features", "label", 30, validation="held")
    assert stopped.getNumTrees < 30
    errors = trees.error_by_iteration(trees.boosted_regressor(df, "features", "label", 4, loss="absolute"), df, "features", "label", "squared")
    assert len(errors) == 4 and max(errors) < 0.1
    row = spark.range(1).select(
        *[trees.combine([F.lit(1.0), F.lit(0.0), F.lit(1.0)], [1.0, 3.0, 1.0], how).alias(how) for how in ("sum", "average", "vote")]
    ).first()
    assert tuple(row) == (2.0, 0.4, 0.0)


def test_k_means_finds_blobs(spark):
    df = gen.blobs(spark, 600, 3, 2, 40.0).persist()
    centres = clustering.centres_of(clustering.k_means(df, "features", 3, runs=2))
    found = clustering.assign(df.select("id", "features"), "features", centres)
    pairs = found.select((F.col("id") % 3).alias("c"), "cluster").distinct().count()
    assert pairs == 3
    cost = clustering.within_cost(df, "features", centres).first()
    assert cost["n"] == 600 and cost["cost"] < 600 * 4
    kept = clustering.lloyd_step(df, "features", centres + [[1e9, 1e9]]).where("cluster = 3").first()
    assert kept["n"] == 0 and kept["centre"] == [1e9, 1e9]


def test_nearest_far_from_the_origin_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 3)) + 1e6
    centres = x[:5].tolist() + [x[0].tolist()]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, f array<double>")
    d = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
    for row in clustering.assign(df, "f", centres).collect():
        assert row["cluster"] == d[row["id"]].argmin() and row["sq_distance"] == pytest.approx(d[row["id"]].min())


def test_degenerate_gaussian(spark):
    df = spark.createDataFrame([([1.0, 1.0],)], "f array<double>")
    got = clustering.gaussian_logpdf(df, "f", [0.0, 0.0], [[1.0, 1.0], [1.0, 1.0]]).first()["logpdf"]
    assert got == pytest.approx(-np.log(2 * np.pi) - 0.5 * np.log(2.0) - 0.5)
    with pytest.raises(ValueError, match="non-zero"):
        clustering.gaussian_logpdf(df, "f", [0.0, 0.0], [[0.0, 0.0], [0.0, 0.0]])


def test_word_vectors_are_trained_in_more_tasks_for_more_words(spark, monkeypatch):
    from hinloom.operators import features

    docs = spark.range(60).select(F.array(*[F.concat(F.lit("w"), ((F.col("id") * n) % 7).cast("string")) for n in range(1, 11)]).alias("words"))
    monkeypatch.setattr(features, "PARTITION_WORDS", 100)
    assert features.word2vec(docs, "words", 4, min_count=1, partitions=2).getNumPartitions() == 6
    assert features.word2vec(docs, "words", 4, min_count=1, partitions=8).getNumPartitions() == 8
    assert features.synonyms(features.word2vec(docs, "words", 4, min_count=1), "w1", 3).count() == 3


@pytest.mark.parametrize("optimizer", ["em", "online"])
def test_topic_quality_is_the_models_own_bound(spark, monkeypatch, optimizer):
    from pyspark.ml.linalg import SparseVector, Vectors

    rng = random.Random(4)
    rows = [(SparseVector(500, {w: float(rng.randint(1, 5)) for w in rng.sample(range(500), 20)}),) for _ in range(60)]
    docs = spark.createDataFrame([*rows, (SparseVector(500, {}),), (Vectors.dense([0.0] * 500),), (Vectors.dense([1.0] * 500),)], ["counts"])
    model = clustering.topics(docs, "counts", 3, 5, optimizer, batch=0.5)
    own = model.logLikelihood(docs), model.logPerplexity(docs)
    monkeypatch.setattr(type(model), "logLikelihood", None)
    monkeypatch.setattr(type(model), "logPerplexity", None)
    found = clustering.topic_quality(model, docs).first()
    assert (found.log_likelihood, found.log_perplexity) == pytest.approx(own, rel=1e-4)


def test_topics_in_both_ways(spark):
    from pyspark.ml.functions import array_to_vector

    docs = spark.range(40).select(
        "id", F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, [5.0, 4.0, 0.0, 0.0]))).otherwise(F.array(*map(F.lit, [0.0, 0.0, 6.0, 5.0]))).alias("a")
    ).select("id", array_to_vector("a").alias("counts"))
    for optimizer in ("em", "online"):
        model = clustering.topics(docs, "counts", 2, 20, optimizer, batch=0.5)
        mix = clustering.topic_mix(model, docs, "id")
        assert mix.groupBy("id").agg(F.sum("weight").alias("w")).where("abs(w - 1) > 1e-6").isEmpty()
        main = clustering.top_topics(mix, "id", 1).select((F.col("id") % 2).alias("half"), "topic").distinct().count()
        assert main == 2
        assert clustering.top_terms(model, 2).count() == 4


def test_recommendations_match_brute_force(spark):
    rng = np.random.default_rng(8)
    u, i = rng.standard_normal((70, 4)), rng.standard_normal((45, 4))
    users = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(u)], "id int, factors array<double>")
    items = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(i)], "id int, factors array<double>")
    want = {(a, int(b), rank + 1) for a in range(70) for rank, b in enumerate(np.argsort(-(u[a] @ i.T))[:6])}
    for block in (7, 1000):
        got = {(r["user"], r["item"], r["rank"]) for r in recommend.recommend_all(users, items, 6, block).collect()}
        assert got == want
    one = recommend.recommend_for(recommend.factor_row(users, 3), items, 6)
    assert {(3, r["id"]) for r in one.collect()} == {(a, b) for a, b, _ in want if a == 3}


def test_recommendations_copy_rows_per_stripe_and_not_per_block(spark, monkeypatch):
    rng = np.random.default_rng(9)
    u, i = rng.integers(-3, 4, (300, 4)).astype(float), rng.integers(-3, 4, (200, 4)).astype(float)
    users = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(u)], "id long, factors array<double>")
    items = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(i)], "id long, factors array<double>")
    scores = u @ i.T
    want = {(a, int(b), r + 1) for a in range(300) for r, b in enumerate(np.lexsort((np.arange(200), -scores[a]))[:5])}
    for values in (recommend.STRIPE_VALUES, 80):
        monkeypatch.setattr(recommend, "STRIPE_VALUES", values)
        found = recommend.recommend_all(users, items, 5, 3)
        assert {(r["user"], r["item"], r["rank"]) for r in found.collect()} == want
        copies = re.findall(r"sequence\(cast\(0 as bigint\), cast\((\d+) as bigint", found._jdf.queryExecution().analyzed().toString())
        # Of 300 users and 200 items in blocks of 3; 15 and 10 stripes of 80 values, else by the 8 cores.
        assert sorted(int(c) + 1 for c in copies) == ([10, 15] if values == 80 else [6, 6])


@pytest.mark.parametrize("implicit", [False, True])
def test_factorization_learns(spark, implicit):
    ratings = gen.low_rank_ratings(spark, 60, 40, 2, 0.6).withColumn("rating", F.abs("rating") if implicit else F.col("rating")).persist()
    model = recommend.factorize(ratings, 4, 8, 0.01, implicit=implicit, nonnegative=implicit)
    users, items = recommend.factors_of(model)
    scored = recommend.predict_pairs(ratings, users, items).join(ratings, ["user", "item"])
    summary = evaluation.regression_summary(scored, "rating", "score").first()
    assert summary["rmse"] < (1.0 if implicit else 0.3)


def test_large_offsets_leave_the_variance(spark):
    import numpy as np

    from hinloom.operators import dense, evaluation, statistics

    base = 1e9
    rows = [([base + (i % 2), base - (i % 2)], base + (i % 2), i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "x array<double>, y double, k int")
    cov = {(r["i"], r["j"]): r["value"] for r in dense.covariance(df, "x").collect()}
    assert cov[0, 0] == pytest.approx(0.25012506, rel=1e-6) and cov[0, 1] == pytest.approx(-0.25012506, rel=1e-6)
    corr = {(r["i"], r["j"]): r["value"] for r in dense.pearson(df, "x").collect()}
    assert corr[0, 1] == pytest.approx(-1.0)
    cells = spark.createDataFrame([(i, 0, base + (i == 1)) for i in range(3)], "i long, j long, value double")
    assert statistics.sparse_column_summary(cells, 3).first()["variance"] == pytest.approx(1 / 3)
    zeros = np.var([base, base + 1, base, 0, 0], ddof=1)
    assert statistics.sparse_column_summary(cells, 5).first()["variance"] == pytest.approx(zeros, rel=1e-9)
    fit = evaluation.regression_summary(df.withColumn("p", F.col("y")), "y", "p").first()
    assert fit["explained_variance"] == pytest.approx(0.25) and fit["r2"] == 1.0
    split = trees.best_split(trees.split_gains(df, {"k": [0.0]}, "y", "variance")).first()
    assert split["gain"] == pytest.approx(0.25)


def test_more_classes_than_a_hundred(spark):
    import math

    df = spark.range(3000).select((F.col("id") % 150).alias("y"), (F.col("id") % 150 < 75).cast("int").alias("f"))
    for impurity, gain in (("gini", 1 / 75 - 1 / 150), ("entropy", 1.0)):
        found = trees.split_gains(df, {"f": [0.0]}, "y", impurity).first()
        assert found["gain"] == pytest.approx(gain) and found["n_left"] == 1500
    assert math.isfinite(found["gain"])


def test_a_product_with_a_constant_checks_its_length(spark):
    from hinloom.functions import vectors

    df = spark.range(1).select(F.array_repeat(F.lit(1.0), 300).alias("x"))
    for size in (200, 260, 400):
        with pytest.raises(Exception, match="vectors of size"):
            df.select(vectors.dot_constant(F.col("x"), [1.0] * size)).collect()
    assert df.select(vectors.dot_constant(F.col("x"), [1.0] * 300)).first()[0] == 300.0


def test_votes_and_kept_columns(spark):
    votes = [F.lit(2.0), F.lit(5.0), F.lit(2.0), F.lit(7.0)]
    row = spark.range(1).select(
        trees.combine(votes, [1, 1, 1, 1], "vote").alias("a"), trees.combine(votes, [1, 3, 1, 1], "vote").alias("b"),
        trees.combine([F.lit(4.0), F.lit(3.0)], [1, 1], "vote").alias("c"),
    ).first()
    assert tuple(row) == (2.0, 5.0, 3.0)
    df = spark.range(200).select(F.array((F.col("id") % 10).cast("double")).alias("x"), (F.col("id") % 10 > 4).cast("int").alias("y"))
    df = df.withColumn("features", F.lit("mine"))
    model = trees.forest_classifier(df, "x", "y", trees=3, bins=8, impurity="entropy", min_instances=2)
    scored = trees.predict(model, df, "x")
    assert scored.columns == ["x", "y", "features", "prediction"] and scored.where("prediction <> y").isEmpty()


def test_large_poisson_means_are_refused():
    with pytest.raises(ValueError, match="means up to"):
        trees.poisson_from_uniform(F.lit(0.5), 800)


def test_wide_rows_go_by_blocks(spark, monkeypatch):
    import numpy as np

    from hinloom.operators import dense

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 7)) + 5
    x[:, 3] = 2.0
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(40)
    cells = lambda table: {(r["i"], r["j"]): r["value"] for r in table.collect()}
    narrow = [cells(f(df, "x")) for f in (dense.gramian, dense.covariance, dense.pearson)]
    assert narrow[0] == pytest.approx({(i, j): v for (i, j), v in np.ndenumerate(x.T @ x)})
    assert narrow[1] == pytest.approx({(i, j): v for (i, j), v in np.ndenumerate(np.cov(x.T))}, abs=1e-12)
    s, v = dense.svd(df, "x", 3)
    main = dense.principal_components(df, "x", 3)
    monkeypatch.setattr(dense, "PASS_BYTES", 8 * 9 * 2)  # two blocks a pass
    for want, f in zip(narrow, (dense.gramian, dense.covariance, dense.pearson)):
        got = cells(f(df, "x", edge=3))
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9, nan_ok=True) for k in want)
    monkeypatch.setattr(dense, "MAX_WIDTH", 4)
    monkeypatch.setattr(dense, "_local", None)  # no matrix of products comes to the driver
    wide_s, wide_v = dense.svd(df, "x", 3)
    assert wide_s == pytest.approx(s) and np.abs((wide_v * v).sum(0)) == pytest.approx(np.ones(3))
    wide = dense.principal_components(df, "x", 3)
    assert np.abs((wide * main).sum(0)) == pytest.approx(np.ones(3))
    r = dense.qr_r(df.repartition(70), "x")
    assert r.T @ r == pytest.approx(x.T @ x)


def test_partial_sums_are_added_in_levels(spark):
    import numpy as np

    from hinloom.operators import packed

    rows = [(p % 3, 7 * p, np.array([p, 1.0]).tobytes()) for p in range(60)]
    parts = spark.createDataFrame(rows, "key int, part long, sums binary")
    got = {r.key: np.frombuffer(r.sums).tolist() for r in packed.added(parts, ["key"], fan=4).collect()}
    assert got == {k: [sum(range(k, 60, 3)), 20.0] for k in range(3)}
    assert packed.added(parts.limit(0), ["key"]).count() == 0


def sparse_rows(spark):
    """Nine rows over a few of a million slots, one without cells, one without a label, a hot slot."""
    rows = [(r, (r % 3 == 0) * 1, {5: 1.0 + r, 100 * r % 700: 2.0, 999_999: 0.5 * (r % 2)}) for r in range(8)]
    labels = spark.createDataFrame([(r, y) for r, y, _ in rows] + [(8, 1)], "row long, label int")
    cells = [(r, s, v) for r, _, c in rows for s, v in c.items()] + [(77, 5, 3.0)]
    return rows + [(8, 1, {})], labels, spark.createDataFrame(cells, "row long, slot long, value double")


def test_sparse_models_agree_with_dense_ones(spark):
    import numpy as np

    from hinloom.operators import bayes, linear, sparse

    rows, labels, cells = sparse_rows(spark)
    slots = sorted({s for _, _, c in rows for s in c})
    array = spark.createDataFrame([(r, y, [c.get(s, 0.0) for s in slots]) for r, y, c in rows], "row long, label int, x array<double>")
    for kind in ("multinomial", "bernoulli"):
        some = cells if kind == "multinomial" else cells.where("value != 0").withColumn("value", F.lit(1.0))
        x = array if kind == "multinomial" else array.withColumn("x", F.transform("x", lambda e: F.when(e != 0, 1.0).otherwise(0.0)))
        names, scored = sparse.bayes_scores(some, labels, sparse.train_bayes(some, labels, len(slots), kind))
        want_names, column = bayes.scores(bayes.train(x, "x", "label", kind), "x")
        want = {r.row: r.s for r in x.select("row", column.alias("s")).collect()}
        got = {r.row: r.scores for r in scored.collect()}
        assert names == want_names and all(got[r] == pytest.approx(want[r]) for r in want)
    history = linear.sgd(array, "x", "label", [0.0] * len(slots), "logistic", 0.1, 4, 0.01, "l1", tolerance=0.0)
    weights, losses = sparse.sgd(cells, labels, None, "logistic", 0.1, 4, 0.01, "l1", tolerance=0.0)
    found = {r.slot: r.weight for r in weights.collect()}
    assert losses == pytest.approx(history[1])
    assert [found.get(s, 0.0) for s in slots] == pytest.approx(list(history[0])) and set(found) <= set(slots)
    assert np.all(np.diff(losses) < 0)


def test_sparse_plans_hold_no_long_vector(spark):
    from hinloom.operators import sparse

    _, labels, cells = sparse_rows(spark)
    model = sparse.train_bayes(cells, labels, 1 << 40)  # a vector of this length could not be made
    assert sparse.predict_bayes(cells, labels, model).count() == 9
    by_slot, _, n = sparse.gradient(cells, labels, spark.createDataFrame([], "slot long, weight double"), "hinge")
    assert n == 9 and by_slot.count() <= 10
    with pytest.raises(Exception, match="invalid multinomial"):
        sparse.train_bayes(cells.withColumn("value", -F.col("value")), labels, 10)


def test_sparse_libsvm_files(spark, tmp_path):
    from hinloom.sources import libsvm

    (tmp_path / "rows.txt").write_text("# note\n1 1:2.5 900000:1\n\n0\n-1 3:0.5\n")
    rows, cells = libsvm.read_cells(spark, str(tmp_path / "rows.txt"))
    by_row = {r.row: r.label for r in rows.collect()}
    got = sorted((by_row[c.row], c.slot, c.value) for c in cells.collect())
    assert sorted(by_row.values()) == [-1.0, 0.0, 1.0] and got == [(-1.0, 2, 0.5), (1.0, 0, 2.5), (1.0, 899999, 1.0)]
    libsvm.write_cells(rows, cells, str(tmp_path / "out"))
    again, cells_again = libsvm.read_cells(spark, str(tmp_path / "out"))
    assert again.count() == 3 and cells_again.count() == 3
    (tmp_path / "bad.txt").write_text("1 3:1 2:1\n")
    with pytest.raises(Exception, match="not ascending"):
        libsvm.read_cells(spark, str(tmp_path / "bad.txt"))[1].count()


@pytest.mark.parametrize("shape", ["rising", "falling", "noise", "steps"])
@pytest.mark.parametrize("increasing", [True, False])
def test_pooled_blocks_equal_the_largest_least_mean(spark, shape, increasing):
    import numpy as np

    from hinloom.operators import isotonic

    draw = np.random.default_rng(4)
    x = draw.integers(0, 40, 300)
    y = {"rising": x * 1.0, "falling": -x * 1.0, "noise": draw.normal(size=300), "steps": (x // 10) * 3.0 + draw.normal(size=300)}[shape]
    w = draw.integers(1, 4, 300)
    rows = [(float(a), float(b), int(c)) for a, b, c in zip(x, y, w)] + [(None, 1.0, 1), (1.0, None, 1), (1.0, 5.0, 0)]
    df = spark.createDataFrame(rows, "x double, y double, w int").repartition(5)
    blocks = sorted(map(tuple, isotonic.isotonic_blocks(df, "x", "y", "w", increasing).collect()))
    values = np.unique(x)
    sums = np.array([(w[x == v] * y[x == v]).sum() for v in values]) * (1 if increasing else -1)
    sizes = np.array([w[x == v].sum() for v in values])
    mean = lambda a, b: sums[a : b + 1].sum() / sizes[a : b + 1].sum()
    n = len(values)
    fitted = [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
    got = [next(v for low, high, v, _ in blocks if low <= value <= high) for value in values]
    assert got == pytest.approx(np.array(fitted) * (1 if increasing else -1))
    assert sum(b[3] for b in blocks) == w.sum()


def test_no_rows_give_no_blocks(spark):
    from hinloom.operators import isotonic

    assert isotonic.isotonic_blocks(spark.createDataFrame([], "x double, y double"), "x", "y").count() == 0


def test_a_given_contingency_table(spark):
    from hinloom.operators import statistics

    table = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 20.0), ("b", 0, 30.0), ("b", 1, 5.0), ("c", 1, 15.0)], "r string, c int, n double")
    row = statistics.chi_square_contingency(table, "r", "c", "n").first()
    seen = {("a", 0): 10, ("a", 1): 20, ("b", 0): 30, ("b", 1): 5, ("c", 0): 0, ("c", 1): 15}
    rows, columns = {"a": 30, "b": 35, "c": 15}, {0: 40, 1: 40}
    want = sum((o - rows[r] * columns[c] / 80) ** 2 / (rows[r] * columns[c] / 80) for (r, c), o in seen.items())
    assert row.statistic == pytest.approx(want) and row.df == 2 and row.p_value == pytest.approx(math.exp(-want / 2))
    for bad in ((("d", 0, -1.0)), (("d", 0, 0.0)), (("d", 0, None))):
        with pytest.raises(Exception, match="count"):
            statistics.chi_square_contingency(table.union(spark.createDataFrame([bad], table.schema)), "r", "c", "n").collect()


def test_thresholds_of_many_features_come_from_one_aggregate(spark):
    draw = random.Random(8)
    rows = [(draw.random(), float(draw.randrange(5)), float(draw.randrange(100)), None) for _ in range(20000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    found = trees.thresholds(df, ["a", "b", "c", "d"], 16)
    assert found["b"] == [0.0, 1.0, 2.0, 3.0] and found["d"] == []
    for f, values in (("a", sorted(r[0] for r in rows)), ("c", sorted(r[2] for r in rows))):
        assert len(found[f]) == 15
        for k, v in enumerate(found[f]):
            below, upto = sum(x < v for x in values), sum(x <= v for x in values)
            assert below - 40 <= (k + 1) * 20000 / 16 <= upto + 40


def test_ranks_of_all_columns_with_ties(spark):
    import numpy as np

    from hinloom.operators import statistics

    draw = np.random.default_rng(2)
    x = np.stack([draw.integers(0, 5, 200), draw.normal(size=200), draw.integers(-3, 3, 200)], 1).astype(float)
    ranks = np.stack([[(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c] for c in x.T], 1)
    want = np.corrcoef(ranks.T)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(6)
    got = {(r.i, r.j): r.value for r in statistics.spearman(df, ["a", "b", "c"]).collect()}
    assert got == pytest.approx({k: v for k, v in np.ndenumerate(want)})


def test_runs_share_passes_and_drop_out(spark):
    from hinloom.operators import clustering

    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(size=(50, 3)) + 8 * np.eye(3)[k] for k in range(3)])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(4)
    starts = [x[[0, 50, 100]], x[[0, 1, 2]], x[[3]]]
    centres, costs, passes = clustering.lloyd_runs(df, "x", starts, 30, 1e-9)
    longest = 0
    for start, found, cost in zip(starts, centres, costs):
        own, rounds, last = start.copy(), 0, None
        while last is None or np.abs(own - last).max() > 0:
            last = own.copy()
            d = ((x[:, None] - own) ** 2).sum(2)
            best = d.argmin(1)
            own = np.array([x[best == c].mean(0) if (best == c).any() else own[c] for c in range(len(own))])
            rounds += 1
        assert found == pytest.approx(own) and cost == pytest.approx(d.min(1).sum())
        longest = max(longest, rounds)
    assert passes <= longest + 1


def test_mixture_from_a_start_model_rises(spark):
    from hinloom.operators import clustering

    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(size=(200, 2)) * [1, 0.3] + [1e6, 0], draw.normal(size=(100, 2)) + [1e6 + 9, 4]])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    eye = np.eye(2)
    w, m, s, history = clustering.fit_mixture(df, "x", [0.5, 0.5], [[1e6 + 1, 1], [1e6 + 7, 3]], [eye, eye], 1e-6, 30)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    assert w == pytest.approx([2 / 3, 1 / 3], abs=0.02)
    assert m == pytest.approx(np.array([x[:200].mean(0), x[200:].mean(0)]), abs=0.1)
    assert s[0] == pytest.approx(np.cov(x[:200].T, bias=True), abs=0.1)


def test_rejection_draws_are_the_keys_own(spark):
    from hinloom.sources import generators

    df = spark.range(3000).select("id", generators.keyed_gamma(F.col("id"), 0.5).alias("g"), generators.keyed_poisson(F.col("id"), 5e6).alias("p"))
    first = {r.id: (r.g, r.p) for r in df.collect()}
    again = {r.id: (r.g, r.p) for r in df.repartition(7).collect()}
    assert first == again and all(g > 0 and p == int(p) for g, p in first.values())
    p = np.array([v[1] for v in first.values()])
    assert abs(p.mean() - 5e6) < 6 * (5e6 / 3000) ** 0.5 and abs(p.var() / 5e6 - 1) < 0.2
    with pytest.raises(ValueError):
        generators.keyed_gamma(F.col("id"), 0.0)


@pytest.mark.parametrize("held", [7, 1 << 20])
def test_pair_scores_in_stripes_equal_the_joins_and_move_no_factors(spark, monkeypatch, held):
    """Repeated pairs, unknown and null ids, and an id given twice; at most a copy of a row per stripe moves, not one per pair."""
    rng = random.Random(5)
    factors = lambda n: spark.createDataFrame(
        [(k, [rng.uniform(-1, 1) for _ in range(3)]) for k in [*range(n), 4]], "id int, factors array<double>"
    )
    users, items = factors(30), factors(20)
    rows = [(rng.randrange(33), 3 if rng.random() < 0.3 else rng.randrange(22)) for _ in range(900)] + [(None, 1), (2, None)]
    pairs = spark.createDataFrame(rows, "user int, item long")
    want = recommend.predict_pairs(pairs, users, items)
    monkeypatch.setattr(recommend, "STRIPE_VALUES", 40)
    got = recommend.predict_pairs(pairs, users, items, small=0, held=held)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "CoGroup" not in want._jdf.queryExecution().executedPlan().toString()
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    few = recommend.predict_pairs(pairs.limit(5), users, items, small=0)
    assert "CoGroup" not in few._jdf.queryExecution().executedPlan().toString()


def test_tree_fits_take_tasks_of_bounded_rows(spark, monkeypatch):
    df = spark.range(4000, numPartitions=1).select(
        F.array(F.col("id").cast("double")).alias("features"), (F.col("id") > 2500).cast("double").alias("label")
    )
    assert trees._dealt(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(trees, "FIT_ROWS", 500)
    seen = []
    fit = trees.DecisionTreeClassifier.fit
    monkeypatch.setattr(trees.DecisionTreeClassifier, "fit", lambda self, rows: seen.append(rows) or fit(self, rows))
    model = trees.tree_classifier(df, "features", "label", depth=1)
    sizes = [len(part) for part in seen[0].rdd.glom().collect()]
    assert len(sizes) == 8 and max(sizes) <= 600 and sum(sizes) == 4000 and model.numNodes == 3


def test_positions_of_patterns_carry_no_pattern(spark, monkeypatch):
    written = {}
    keep = mining.materialize
    monkeypatch.setattr(mining, "materialize", lambda df, label="step": written.setdefault(label, []).append(df.dtypes) or keep(df, label))
    events = spark.createDataFrame([(s, p, x) for s in range(6) for p, x in enumerate("abcd")], "s long, p int, x string")
    found = mining.sequential_patterns(events, "s", "p", "x", 1.0, 4, 0).collect()
    assert len(found) == 15 and {r["freq"] for r in found} == {6}
    moved = [kinds for label in ("starts", "support", "patterns") for kinds in written[label]]
    assert moved and not any(kind.startswith("array") for kinds in moved for _, kind in kinds)


def test_fits_and_predictions_share_rows_made_once(spark, monkeypatch):
    monkeypatch.setattr(trees, "FIT_ROWS", 500)
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return float(x % 20)

    ids = spark.range(2000, numPartitions=2)
    rows = ids.select(F.array(counted("id")).alias("features"), (F.col("id") % 20 > 12).cast("double").alias("label"))
    monkeypatch.setattr(learning, "noisy_rows", lambda spark, sf: rows)
    found = {tuple(r) for r in learning.tree_classifiers(spark, "").collect()}
    # Each row is made once, for three fits and three predictions.
    assert made.value == 2000
    assert found == {(m, y, y, n) for m in ("tree", "forest", "boosted") for y, n in ((0.0, 1300), (1.0, 700))}
    with trees.shared_rows(rows, "features", "label") as kept:
        shared = trees.tree_regressor(kept, "features", "label", depth=2)
        assert kept.is_cached and kept.rdd.getNumPartitions() == 4 and kept.columns == ["features", "label"]
        assert trees.predict(shared, kept, "features").where("prediction <> label").count() == 0
    alone = trees.tree_regressor(rows, "features", "label", depth=2)
    # Below the line with its name, the model is the same.
    assert not kept.is_cached and alone.toDebugString.split("\n")[1:] == shared.toDebugString.split("\n")[1:]


def test_ids_given_twice_score_twice_in_stripes(spark):
    pairs = spark.createDataFrame([(n % 7, n % 11) for n in range(400)], "user long, item long")
    factors = lambda n: spark.createDataFrame([(k % n, [1.0 * k, 2.0]) for k in range(n + 2)], "id long, factors array<double>")
    users, items = factors(6), factors(11)
    want = sorted(map(tuple, recommend.predict_pairs(pairs, users, items).collect()))
    got = recommend.predict_pairs(pairs, users, items, small=0, held=20)
    assert "FlatMapCoGroups" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("rows", [(5_400_000, 360_000), (300_000, 300_000), (10, 2_000_000)])
def test_stripes_follow_the_pairs_with_few_copies_of_factors(rows):
    """Pairs of stripes hold bounded pairs, and no stripe goes whole to each of many parts of a pair."""
    users, items = recommend._stripes(212_000_000, rows, 5, 500_000)
    assert 212_000_000 / (users * items) <= 500_000
    assert rows[0] * 5 / users <= 1_000_000 and rows[1] * 5 / items <= 1_000_000
    copies = rows[0] * items + rows[1] * users
    least = min(rows[0] * -(-424 // u) + rows[1] * u for u in range(1, 425))
    assert copies < 1.5 * least


def test_blocks_of_a_factorization_follow_the_ratings(spark, monkeypatch):
    """A block of ratings is held and sorted in one task."""
    ratings = spark.createDataFrame([(u, i, float(u + i)) for u in range(20) for i in range(10)], "user int, item int, rating float")
    fit = lambda: recommend.factorize(ratings, rank=2, iterations=1).userFactors.rdd.getNumPartitions()
    assert fit() == 10
    monkeypatch.setattr(recommend, "RATINGS_OF_BLOCK", 9)
    assert fit() == 23
