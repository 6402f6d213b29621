"""Decision trees: split search, bagging and fitted ensembles."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinloom.operators.ordering import top_k
from hinloom.runtime import double_array, materialize


def _square(n: Column) -> Column:
    return n * n


def _n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def _gini(total: Column, squares: Column) -> Column:
    return 1.0 - squares / (total * total)


def _entropy(total: Column, logs: Column) -> Column:
    return F.log2(total) - logs / total


def _variance(sums: Sequence[Column], total: Column) -> Column:
    s, q = sums
    return F.when(total == 0, F.lit(0.0)).otherwise((q - s * s / total) / total)


# Per class impurity: what is summed over the classes, and the impurity from that sum.
CLASS_IMPURITIES = {"gini": (_square, _gini), "entropy": (_n_log_n, _entropy)}


def thresholds(df: DataFrame, features: Sequence[str], max_bins: int = 32, error: float = 0.001) -> dict[str, list[float]]:
    """Candidate split points per feature: a row goes left when it is not above one.

    A feature with at most ``max_bins`` values splits between all of them,
    another at approximate quantiles.  All features go through one aggregate
    of mergeable sketches; the values of those that may have few of them come
    from one more job.
    """
    shares = [i / max_bins for i in range(1, max_bins)]
    values = {f: F.col(f).cast("double") for f in features}
    sketches = [
        c
        for k, f in enumerate(features)
        for c in (
            F.percentile_approx(values[f], shares or [0.5], int(1 / error)).alias(f"q{k}"),
            F.approx_count_distinct(values[f], 0.02).alias(f"n{k}"),
        )
    ]
    found = df.agg(*sketches).first()
    splits = {f: sorted(set(found[f"q{k}"] or [])) for k, f in enumerate(features)}
    # The estimate is off by a few percent.
    maybe = [k for k in range(len(features)) if found[f"n{k}"] <= 2 * max_bins + 8]
    if maybe:
        cells = F.array(*[F.struct(F.lit(k).alias("k"), values[features[k]].alias("v")) for k in maybe])
        distinct = df.select(F.inline(cells)).where("v is not null").distinct()
        few: dict[int, list[float]] = {}
        for r in distinct.collect():  # some times `max_bins` per feature
            few.setdefault(r["k"], []).append(r["v"])
        splits |= {features[k]: sorted(v)[:-1] for k, v in few.items() if len(v) <= max_bins}
    return splits


def split_gains(
    df: DataFrame,
    splits: Mapping[str, Sequence[float]],
    label: str,
    impurity: str = "gini",
    min_instances: int = 1,
    node: str | None = None,
) -> DataFrame:
    """``([node,] feature, threshold, n_left, n_right, gain)`` of every candidate.

    Rows are reduced to one row of sums per (node, feature, bin), or per class of it, before the shuffle; the
    running sums then cover at most ``max_bins`` rows.  Any number of classes is taken.
    """
    keys = [node] if node else []
    y = F.col(label).cast("double")
    bins = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.coalesce(
                    *[F.when(F.col(f) <= t, F.lit(float(t))) for t in points], F.lit(float("inf"))
                ).alias("threshold"),
            )
            for f, points in splits.items()
        ]
    )
    rows = df.select(*keys, y.alias("_y"), F.inline(bins))
    whole = Window.partitionBy(*keys, "feature")
    running = whole.orderBy("threshold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if impurity == "variance":
        # Shifted by the overall mean, so that no large squares are subtracted.
        shift = df.agg(F.avg(y)).first()[0] or 0.0
        centred = F.col("_y") - float(shift)
        per_bin = rows.groupBy(*keys, "feature", "threshold").agg(
            F.count("_y").cast("double").alias("_n"), F.sum(centred).alias("_s0"), F.sum(centred * centred).alias("_s1")
        )
        names = ["_n", "_s0", "_s1"]
    elif impurity in CLASS_IMPURITIES:
        part, _ = CLASS_IMPURITIES[impurity]
        own = Window.partitionBy(*keys, "feature", "_y")
        before = F.coalesce(
            F.sum("_k").over(own.orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
        )
        total = F.sum("_k").over(own)
        # Sums over the classes change from bin to bin only by the classes in it.
        per_class = (
            rows.where(F.col("_y").isNotNull())
            .groupBy(*keys, "feature", "_y", "threshold")
            .agg(F.count(F.lit(1)).cast("double").alias("_k"))
            .withColumn("_b", before)
            .withColumn("_t", total)
        )
        seen, rest = F.col("_b") + F.col("_k"), F.col("_t") - F.col("_b")
        per_bin = per_class.groupBy(*keys, "feature", "threshold").agg(
            F.sum("_k").alias("_n"),
            F.sum(part(seen) - part(F.col("_b"))).alias("_s0"),
            F.sum(part(rest - F.col("_k")) - part(rest)).alias("_s1"),
        )
        names = ["_n", "_s0", "_s1"]
    else:
        raise ValueError("impurity is 'gini', 'entropy' or 'variance'")
    for name in names:
        per_bin = per_bin.withColumn(f"{name}l", F.sum(name).over(running)).withColumn(
            f"{name}t", F.sum(name).over(whole)
        )
    n_left, n = F.col("_nl"), F.col("_nt")
    n_right = n - n_left
    some = lambda count: F.when(count == 0, 1.0).otherwise(count)
    if impurity == "variance":
        at_left = _variance([F.col("_s0l"), F.col("_s1l")], n_left)
        at_right = _variance([F.col("_s0t") - F.col("_s0l"), F.col("_s1t") - F.col("_s1l")], n_right)
        at_all = _variance([F.col("_s0t"), F.col("_s1t")], n)
    else:
        _, measure = CLASS_IMPURITIES[impurity]
        at_left, at_all = measure(n_left, F.col("_s0l")), measure(n, F.col("_s0t"))
        at_right = measure(some(n_right), F.col("_s0t") + F.col("_s1l"))
    gain = at_all - at_left * n_left / n - at_right * n_right / n
    return per_bin.where((n_left >= min_instances) & (n_right >= min_instances)).select(
        *keys, "feature", "threshold", n_left.cast("long").alias("n_left"), n_right.cast("long").alias("n_right"), gain.alias("gain")
    )


def best_split(gains: DataFrame, min_gain: float = 0.0) -> DataFrame:
    """The candidate of largest gain, ties by feature and threshold."""
    useful = gains.where(F.col("gain") >= min_gain)
    return top_k(useful, [F.desc("gain"), F.col("feature"), F.col("threshold")], 1)


def bagging_weight(key: Column, tree: int, rate: float = 1.0, replacement: bool = True, seed: int = 42) -> Column:
    """How often a row is used by a tree: Poisson(rate), or 0/1 with the rate.

    The draw is a hash of the row's key, so every attempt agrees.
    """
    draw = F.pmod(F.xxhash64(key, F.lit(seed), F.lit(tree)), F.lit(1 << 52)) / float(1 << 52)
    if not replacement:
        return F.when(draw < rate, 1).otherwise(0)
    return poisson_from_uniform(draw, rate)


# The table of bounds has some ten times as many entries as the mean.
LARGEST_MEAN = 100


def poisson_from_uniform(draw: Column, mean: float) -> Column:
    """Smallest count whose cumulative probability exceeds the draw; means above `LARGEST_MEAN` are an error."""
    import math

    if mean > LARGEST_MEAN:
        raise ValueError(f"counts are drawn for means up to {LARGEST_MEAN}")
    if mean <= 0:
        return F.lit(0)
    probability = cumulative = math.exp(-mean)
    bounds = [cumulative]
    while cumulative < 1 - 1e-12 and len(bounds) < 10 * mean + 50:
        probability *= mean / len(bounds)
        cumulative += probability
        bounds.append(cumulative)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= draw))


# --- fitted trees --------------------------------------------------------------------


def _vector(df: DataFrame, features: str) -> Column:
    """The features of an array column, or of one that has vectors already."""
    made = isinstance(df.select(features).schema[0].dataType, VectorUDT)
    return F.col(features) if made else array_to_vector(double_array(features))


def _rows(df: DataFrame, features: str, label: str, *more: str) -> DataFrame:
    return df.select(_vector(df, features).alias("features"), F.col(label).cast("double").alias("label"), *more)


# Rows of one task of a fit.
FIT_ROWS = 500_000


def _dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows in as many tasks as their number asks for.

    A fit holds the rows of a task, larger than in their file, and reads them again for every level; a file split of
    a column format has many millions.
    """
    tasks = -(-df.count() // (rows or FIT_ROWS))
    return df if tasks <= df.rdd.getNumPartitions() else df.repartition(tasks)


@contextlib.contextmanager
def shared_rows(df: DataFrame, features: str, label: str, *more: str) -> Iterator[DataFrame]:
    """``(features, label, ..)`` for several fits and predictions, made and dealt once, until the end of the block.

    A fit reads its rows some five times before it has its own copy, and alone would make, sort and move them each
    time.  They are kept on disk, as the copies of the fits want the memory.  Write or collect predictions inside.
    """
    kept = _dealt(_rows(df, features, label, *more)).persist(StorageLevel.DISK_ONLY)
    try:
        yield kept
    finally:
        kept.unpersist()


def _fit(estimator, df: DataFrame, categorical: int):
    """Fit directly, or behind an indexer that treats features of few values as categories."""
    df = _dealt(df)
    if categorical < 2:
        return estimator.fit(df)
    from pyspark.ml import Pipeline

    indexer = VectorIndexer(inputCol="features", outputCol="_indexed", maxCategories=categorical)
    return Pipeline(stages=[indexer, estimator.setFeaturesCol("_indexed")]).fit(df)


def tree_classifier(df: DataFrame, features: str, label: str, depth: int = 5, bins: int = 32,
                    impurity: str = "gini", min_instances: int = 1, min_gain: float = 0.0, categorical: int = 0):
    estimator = DecisionTreeClassifier(
        maxDepth=depth, maxBins=bins, impurity=impurity, minInstancesPerNode=min_instances, minInfoGain=min_gain
    )
    return _fit(estimator, _rows(df, features, label), categorical)


def tree_regressor(df: DataFrame, features: str, label: str, depth: int = 5, bins: int = 32,
                   min_instances: int = 1, min_gain: float = 0.0, categorical: int = 0):
    estimator = DecisionTreeRegressor(
        maxDepth=depth, maxBins=bins, minInstancesPerNode=min_instances, minInfoGain=min_gain
    )
    return _fit(estimator, _rows(df, features, label), categorical)


def forest_classifier(df: DataFrame, features: str, label: str, trees: int = 20, depth: int = 5,
                      subset: str = "auto", rate: float = 1.0, seed: int = 42, bins: int = 32, impurity: str = "gini",
                      min_instances: int = 1, min_gain: float = 0.0, categorical: int = 0):
    estimator = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy=subset, subsamplingRate=rate, seed=seed, maxBins=bins,
        impurity=impurity, minInstancesPerNode=min_instances, minInfoGain=min_gain,
    )
    return _fit(estimator, _rows(df, features, label), categorical)


def forest_regressor(df: DataFrame, features: str, label: str, trees: int = 20, depth: int = 5,
                     subset: str = "auto", rate: float = 1.0, seed: int = 42, bins: int = 32,
                     min_instances: int = 1, min_gain: float = 0.0, categorical: int = 0):
    estimator = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy=subset, subsamplingRate=rate, seed=seed, maxBins=bins,
        minInstancesPerNode=min_instances, minInfoGain=min_gain,
    )
    return _fit(estimator, _rows(df, features, label), categorical)


def boosted_classifier(df: DataFrame, features: str, label: str, iterations: int = 100, rate: float = 0.1,
                       depth: int = 3, validation: str | None = None, tolerance: float = 1e-5, bins: int = 32,
                       min_instances: int = 1, min_gain: float = 0.0, categorical: int = 0):
    """Log loss; with a boolean ``validation`` column training stops early."""
    estimator = GBTClassifier(
        maxIter=iterations, stepSize=rate, maxDepth=depth, validationTol=tolerance, maxBins=bins,
        minInstancesPerNode=min_instances, minInfoGain=min_gain,
    )
    if validation:
        estimator = estimator.setValidationIndicatorCol(validation)
    return _fit(estimator, _rows(df, features, label, *([validation] if validation else [])), categorical)


def boosted_regressor(df: DataFrame, features: str, label: str, iterations: int = 100, rate: float = 0.1,
                      depth: int = 3, loss: str = "squared", validation: str | None = None, tolerance: float = 1e-5,
                      bins: int = 32, min_instances: int = 1, min_gain: float = 0.0, categorical: int = 0):
    estimator = GBTRegressor(
        maxIter=iterations, stepSize=rate, maxDepth=depth, lossType=loss, validationTol=tolerance, maxBins=bins,
        minInstancesPerNode=min_instances, minInfoGain=min_gain,
    )
    if validation:
        estimator = estimator.setValidationIndicatorCol(validation)
    return _fit(estimator, _rows(df, features, label, *([validation] if validation else [])), categorical)


def predict(model, df: DataFrame, features: str, name: str = "prediction") -> DataFrame:
    """Add the model's prediction; all columns of ``df`` stay, one called ``features`` too."""
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    scored = model.transform(df.select(kept, _vector(df, features).alias("features")))
    return scored.select("_row.*", F.col("prediction").alias(name))


def combine(predictions: Sequence[Column], weights: Sequence[float], how: str) -> Column:
    """Ensemble output from tree outputs: weighted sum, average, or the class with most weight.

    A vote takes any number of classes; a tie goes to the smallest class.
    """
    total = F.lit(0.0)
    for p, w in zip(predictions, weights):
        total = total + p * float(w)
    if how == "sum":
        return total
    if how == "average":
        return total / float(sum(weights))
    if how == "vote":
        cast = F.array(*[F.struct(p.cast("double").alias("c"), F.lit(float(w)).alias("w")) for p, w in zip(predictions, weights)])
        classes = F.array_sort(F.array_distinct(F.transform(cast, lambda v: v["c"])))
        weight_of = lambda c: F.aggregate(
            F.filter(cast, lambda v: v["c"] == c), F.lit(0.0), lambda acc, v: acc + v["w"]
        )
        counted = F.transform(classes, lambda c: F.struct(weight_of(c).alias("w"), (-c).alias("c")))
        return -F.array_max(counted)["c"]
    raise ValueError("how is 'sum', 'average' or 'vote'")


def error_by_iteration(model, df: DataFrame, features: str, label: str, loss: str | None = None) -> list[float]:
    """Loss of a boosted model after each of its trees."""
    rows = materialize(_rows(df, features, label), "rows")
    return list(model.evaluateEachIteration(rows, loss) if loss else model.evaluateEachIteration(rows))
