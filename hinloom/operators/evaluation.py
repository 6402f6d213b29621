"""Model quality metrics as queries over predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.operators.ordering import area_under_curve, cumulative_counts, downsample_scores
from hinloom.runtime import materialize, running_sums


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def binary_curve(scored: DataFrame, score: str, label: str, bins: int = 0) -> DataFrame:
    """Counts and rates at every threshold (distinct score).

    ``threshold, tp, fp, precision, recall, fpr`` with ``precision`` 1 where
    nothing is predicted.  Positive totals of zero give recall 0.
    """
    if bins > 0:
        merged = downsample_scores(scored, score, label, bins)
        counts = running_sums(merged, [F.col("score").desc()], ["pos", "neg"])
    else:
        counts = cumulative_counts(scored, score, label)
    counts = materialize(counts, "curve")
    # One row of totals.
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    positives, negatives = F.lit(totals["p"] or 0), F.lit(totals["n"] or 0)
    tp, fp = F.col("pos_cum"), F.col("neg_cum")
    return counts.select(
        F.col("score").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        _share(tp, tp + fp, 1.0).alias("precision"),
        _share(tp, positives, 0.0).alias("recall"),
        _share(fp, negatives, 0.0).alias("fpr"),
    )


def f_measure(curve: DataFrame, beta: float = 1.0) -> DataFrame:
    """``(threshold, f)``."""
    b2 = beta * beta
    p, r = F.col("precision"), F.col("recall")
    return curve.select(
        "threshold", _share((1 + b2) * p * r, b2 * p + r, 0.0).alias("f")
    )


def _with_ends(curve: DataFrame, x: str, y: str, first: tuple[float, float], last: tuple[float, float] | None) -> DataFrame:
    """``(ord, negated threshold, x, y)`` with fixed points at the ends."""
    spark = curve.sparkSession
    body = curve.select(
        F.lit(1).alias("ord"), (-F.col("threshold").cast("double")).alias("place"), F.col(x).alias("x"), F.col(y).alias("y")
    )
    ends = [(0, 0.0, first[0], first[1])] + ([(2, 0.0, last[0], last[1])] if last else [])
    return body.unionByName(spark.createDataFrame(ends, "ord int, place double, x double, y double"))


def roc(curve: DataFrame) -> DataFrame:
    """From (0, 0) to (1, 1)."""
    return _with_ends(curve, "fpr", "recall", (0.0, 0.0), (1.0, 1.0))


def precision_recall(curve: DataFrame) -> DataFrame:
    """Starts at recall 0 with precision 1."""
    return _with_ends(curve, "recall", "precision", (0.0, 1.0), None)


def area(points: DataFrame) -> DataFrame:
    return area_under_curve(points, "x", "y", ["ord", "place"])


def areas(scored: DataFrame, score: str, label: str) -> DataFrame:
    """``roc, pr``: the areas of both curves, as one plain aggregate.

    A row of the curve knows the point before it (its cumulative counts less its own), so no curve is sorted again.
    """
    tp, fp = F.col("pos_cum"), F.col("neg_cum")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    precision, precision0 = _share(tp, tp + fp, 1.0), _share(tp0, tp0 + fp0, 1.0)
    sums = cumulative_counts(scored, score, label).agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("p"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n"),
        F.sum(F.col("neg") * (tp + tp0) / 2.0).alias("under_roc"),
        F.sum(F.col("pos") * (precision + precision0) / 2.0).alias("under_pr"),
    )
    p, n = F.col("p"), F.col("n")
    # Without negatives the curve rises at 0 and then runs to (1, 1); without any rows it is that line alone.
    without = F.when(p > 0, 1.0).when(n > 0, 0.0).otherwise(0.5)
    return sums.select(
        F.when((p > 0) & (n > 0), F.col("under_roc") / p / n).otherwise(without).alias("roc"),
        F.when(p > 0, F.col("under_pr") / p).otherwise(0.0).alias("pr"),
    )


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, prediction, n)``."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_label(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Rates of every true label from a confusion table."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    truth = counts.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    predicted = counts.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("_predicted"))
    # One row.
    rows = counts.agg(F.sum("n").alias("n")).first()["n"]
    joined = truth.join(predicted, "label", "left").withColumn(
        "fp", F.coalesce(F.col("_predicted"), F.lit(0)) - F.col("tp")
    )
    tp, fp, support = F.col("tp"), F.col("fp"), F.col("support")
    b2 = beta * beta
    rates = joined.withColumn("precision", _share(tp, tp + fp, 0.0)).withColumn("recall", _share(tp, support, 0.0))
    p, r = F.col("precision"), F.col("recall")
    return rates.select(
        "label",
        "support",
        r.alias("tpr"),
        _share(fp, F.lit(rows) - support, 0.0).alias("fpr"),
        "precision",
        "recall",
        _share((1 + b2) * p * r, b2 * p + r, 0.0).alias("f"),
    )


def multiclass_summary(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Accuracy and support-weighted averages; one row."""
    labels = per_label(counts, beta)
    weighted = [
        (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
        for c in ("tpr", "fpr", "precision", "recall", "f")
    ]
    hits = F.sum(F.col("recall") * F.col("support"))
    return labels.agg((hits / F.sum("support")).alias("accuracy"), *weighted)


def multilabel_summary(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Per-row set metrics averaged, and the micro averages; one row.

    Both columns are arrays without repeats.  A row with an empty array adds
    0 to the averages it would divide by zero in.
    """
    p, t = F.col(predicted), F.col(truth)
    both = F.size(F.array_intersect(p, t)).cast("double")
    only_p = F.size(F.array_except(p, t)).cast("double")
    only_t = F.size(F.array_except(t, p)).cast("double")
    rows = df.select(
        both.alias("b"),
        only_p.alias("op"),
        only_t.alias("ot"),
        F.size(p).cast("double").alias("np"),
        F.size(t).cast("double").alias("nt"),
    )
    labels = df.select(F.explode(t).alias("l")).agg(F.countDistinct("l").alias("c")).first()["c"]
    b, op, ot = F.col("b"), F.col("op"), F.col("ot")
    return rows.agg(
        F.avg(F.when((op == 0) & (ot == 0), 1.0).otherwise(0.0)).alias("subset_accuracy"),
        F.avg(_share(b, b + op + ot, 0.0)).alias("accuracy"),
        (F.avg(op + ot) / F.lit(labels)).alias("hamming_loss"),
        F.avg(_share(b, F.col("np"), 0.0)).alias("precision"),
        F.avg(_share(b, F.col("nt"), 0.0)).alias("recall"),
        F.avg(_share(b * 2.0, F.col("np") + F.col("nt"), 0.0)).alias("f1"),
        _share(F.sum(b), F.sum(b) + F.sum(op), 0.0).alias("micro_precision"),
        _share(F.sum(b), F.sum(b) + F.sum(ot), 0.0).alias("micro_recall"),
        _share(F.sum(b) * 2.0, F.sum(b) * 2.0 + F.sum(op) + F.sum(ot), 0.0).alias("micro_f1"),
    )


def multilabel_per_label(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Precision, recall and F1 of each label that occurs."""
    p, t = F.col(predicted), F.col(truth)
    tagged = F.concat(
        F.transform(F.array_intersect(p, t), lambda v: F.struct(v.alias("label"), F.lit("tp").alias("kind"))),
        F.transform(F.array_except(p, t), lambda v: F.struct(v.alias("label"), F.lit("fp").alias("kind"))),
        F.transform(F.array_except(t, p), lambda v: F.struct(v.alias("label"), F.lit("fn").alias("kind"))),
    )
    counts = (
        df.select(F.inline(tagged))
        .groupBy("label")
        .agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("tp", "fp", "fn")])
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "label",
        _share(tp, tp + fp, 0.0).alias("precision"),
        _share(tp, tp + fn, 0.0).alias("recall"),
        _share(2.0 * tp, 2.0 * tp + fp + fn, 0.0).alias("f1"),
    )


def ranking_rows(df: DataFrame, predicted: str, relevant: str, k: int) -> DataFrame:
    """Add ``precision_at``, ``average_precision`` and ``ndcg_at`` per row.

    Positions past the end of a list count as misses; an empty truth gives 0.
    ``precision_at`` always divides by ``k``.
    """
    p, t = F.col(predicted), F.col(relevant)
    hits = F.transform(p, lambda v: F.when(F.array_contains(t, v), 1.0).otherwise(0.0))
    top_hits = F.slice(hits, 1, k)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    so_far = F.transform(
        hits, lambda h, i: h * total(F.slice(hits, 1, i + 1)) / (i + 1)
    )
    gains = F.transform(top_hits, lambda h, i: h / F.log(i + 2.0))
    ideal_size = F.least(F.size(t), F.lit(k))
    ideal = total(F.transform(F.sequence(F.lit(1), F.greatest(ideal_size, F.lit(1))), lambda i: 1.0 / F.log(i + 1.0)))
    empty = F.size(t) == 0
    zero = F.lit(0.0)
    return (
        df.withColumn("precision_at", F.when(empty, zero).otherwise(total(top_hits) / k))
        .withColumn("average_precision", F.when(empty, zero).otherwise(total(so_far) / F.size(t)))
        .withColumn("ndcg_at", F.when(empty, zero).otherwise(total(gains) / ideal))
    )


def ranking_summary(df: DataFrame, predicted: str, relevant: str, k: int) -> DataFrame:
    rows = ranking_rows(df, predicted, relevant, k)
    return rows.agg(
        F.avg("precision_at").alias("precision_at"),
        F.avg("average_precision").alias("mean_average_precision"),
        F.avg("ndcg_at").alias("ndcg_at"),
    )


def regression_summary(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Explained variance, MAE, MSE, RMSE and R2 in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    error = y - p
    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("mean"),
        F.avg(p).alias("mean_p"),
        F.var_pop(p).alias("vp"),
        F.var_pop(y).alias("vy"),
        F.sum(F.abs(error)).alias("ae"),
        F.sum(error * error).alias("se"),
    )
    n = F.col("n")
    shift = F.col("mean_p") - F.col("mean")
    return sums.select(
        (F.col("vp") + shift * shift).alias("explained_variance"),
        (F.col("ae") / n).alias("mae"),
        (F.col("se") / n).alias("mse"),
        F.sqrt(F.col("se") / n).alias("rmse"),
        (1.0 - F.col("se") / (F.col("vy") * n)).alias("r2"),
    )
