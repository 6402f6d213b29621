"""Linear models: distributed gradient steps and fitted estimators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    IsotonicRegression,
    IsotonicRegressionModel,
    LinearRegression,
    LinearRegressionModel,
)
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.functions import vectors
from hinloom.functions.losses import LOSSES, Loss
from hinloom.runtime import double_array


def margin(features: str | Column, weights: Sequence[float], intercept: float = 0.0) -> Column:
    return vectors.dot_constant(double_array(features), weights) + F.lit(float(intercept))


def gradient(
    df: DataFrame, features: str, label: str, weights: Sequence[float], loss: Loss
) -> tuple[float, np.ndarray, int]:
    """``(loss sum, gradient sum, rows)`` in one pass with partial sums.

    Only a vector as long as the weights comes back.
    """
    x = double_array(features)
    m, y = margin(x, weights), F.col(label).cast("double")
    rows = df.select(x.alias("_x"), loss.value(m, y).alias("_loss"), loss.slope(m, y).alias("_slope"))
    sums = [F.sum("_loss").alias("loss"), F.count(F.lit(1)).alias("n")]
    if len(weights) <= vectors.UNROLLED:
        parts = [F.sum(F.col("_slope") * F.col("_x")[i]).alias(f"_g{i}") for i in range(len(weights))]
        row = rows.agg(*sums, *parts).first()
        g = [row[f"_g{i}"] for i in range(len(weights))]
    else:
        scaled = array_to_vector(F.transform("_x", lambda v: v * F.col("_slope")))
        total = Summarizer.metrics("sum").summary(scaled).alias("s")
        row = rows.agg(*sums, total).select("loss", "n", vector_to_array(F.col("s.sum")).alias("g")).first()
        g = row["g"]
    if not row["n"]:
        return 0.0, np.zeros(len(weights)), 0
    return row["loss"], np.array(g), row["n"]


def updated_weights(
    weights: np.ndarray, mean_gradient: np.ndarray, step: float, t: int, reg: float, penalty: str
) -> np.ndarray:
    """One update with step ``step / sqrt(t)``; penalty none, l2 or l1."""
    size = step / math.sqrt(t)
    if penalty == "none":
        return weights - size * mean_gradient
    if penalty == "l2":
        return weights * (1.0 - size * reg) - size * mean_gradient
    if penalty == "l1":
        moved = weights - size * mean_gradient
        return np.sign(moved) * np.maximum(0.0, np.abs(moved) - size * reg)
    raise ValueError("penalty is 'none', 'l2' or 'l1'")


def sgd_step(
    df: DataFrame,
    features: str,
    label: str,
    weights: Sequence[float],
    loss: str | Loss = "squared",
    step: float = 1.0,
    t: int = 1,
    reg: float = 0.0,
    penalty: str = "none",
    fraction: float = 1.0,
) -> tuple[np.ndarray, float]:
    """``(new weights, mean loss)``; an empty batch changes nothing.

    A fraction below 1 takes the batch of round ``t`` by a seeded sample.
    """
    chosen = LOSSES[loss] if isinstance(loss, str) else loss
    batch = df if fraction >= 1.0 else df.sample(fraction, seed=42 + t)
    total, g, n = gradient(batch, features, label, weights, chosen)
    current = np.asarray(weights, dtype=float)
    if n == 0:
        return current, 0.0
    return updated_weights(current, g / n, step, t, reg, penalty), total / n


def sgd(
    df: DataFrame,
    features: str,
    label: str,
    initial: Sequence[float],
    loss: str | Loss = "squared",
    step: float = 1.0,
    iterations: int = 100,
    reg: float = 0.0,
    penalty: str = "none",
    fraction: float = 1.0,
    tolerance: float = 0.001,
) -> tuple[np.ndarray, list[float]]:
    """Gradient descent until the weights move less than ``tolerance`` (relative).

    Keep ``df`` persisted or written: every round is one pass over it.
    """
    weights, history = np.asarray(initial, dtype=float), []
    for t in range(1, iterations + 1):
        new, mean_loss = sgd_step(df, features, label, weights, loss, step, t, reg, penalty, fraction)
        history.append(mean_loss)
        moved = np.linalg.norm(new - weights)
        weights = new
        if t > 1 and moved < tolerance * max(np.linalg.norm(weights), 1.0):
            break
    return weights, history


# --- fitted models -------------------------------------------------------------------


def _vectors(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.select(
        array_to_vector(double_array(features)).alias("features"), F.col(label).cast("double").alias("label")
    )


def least_squares(df: DataFrame, features: str, label: str) -> LinearRegressionModel:
    return LinearRegression(regParam=0.0).fit(_vectors(df, features, label))


def ridge(df: DataFrame, features: str, label: str, reg: float = 0.01) -> LinearRegressionModel:
    """Least squares with ``reg / 2`` times the squared weights added to half the mean squared error."""
    # The estimator divides an L2 penalty by the deviation of the labels.
    spread = df.agg(F.stddev_pop(F.col(label).cast("double"))).first()[0] or 1.0
    estimator = LinearRegression(regParam=reg * spread, elasticNetParam=0.0, standardization=False)
    return estimator.fit(_vectors(df, features, label))


def lasso(df: DataFrame, features: str, label: str, reg: float = 0.01) -> LinearRegressionModel:
    """Least squares with ``reg`` times the absolute weights added to half the mean squared error."""
    estimator = LinearRegression(regParam=reg, elasticNetParam=1.0, standardization=False, tol=1e-10, maxIter=1000)
    return estimator.fit(_vectors(df, features, label))


def logistic(
    df: DataFrame, features: str, label: str, reg: float = 0.0, family: str = "auto", iterations: int = 100
) -> LogisticRegressionModel:
    return LogisticRegression(regParam=reg, family=family, maxIter=iterations).fit(
        _vectors(df, features, label)
    )


def svm(df: DataFrame, features: str, label: str, reg: float = 0.01, iterations: int = 100) -> LinearSVCModel:
    return LinearSVC(regParam=reg, maxIter=iterations).fit(_vectors(df, features, label))


def isotonic(df: DataFrame, feature: str, label: str, increasing: bool = True, weight: str | None = None) -> IsotonicRegressionModel:
    rows = df.select(
        F.col(feature).cast("double").alias("features"),
        F.col(label).cast("double").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
    )
    return IsotonicRegression(isotonic=increasing, weightCol="weight").fit(rows)


def predict_linear(
    df: DataFrame, features: str, weights: Sequence[float], intercept: float = 0.0, name: str = "prediction"
) -> DataFrame:
    return df.withColumn(name, margin(features, weights, intercept))


def predict_class(
    df: DataFrame,
    features: str,
    weights: Sequence[float],
    intercept: float = 0.0,
    threshold: float | None = 0.5,
    link: str = "logistic",
    name: str = "prediction",
) -> DataFrame:
    """0/1 above the threshold; without a threshold the raw score.

    ``link`` 'logistic' scores probabilities, 'margin' the margin itself.
    """
    score = margin(features, weights, intercept)
    if link == "logistic":
        score = vectors.sigmoid(score)
    value = score if threshold is None else F.when(score > threshold, 1.0).otherwise(0.0)
    return df.withColumn(name, value)
