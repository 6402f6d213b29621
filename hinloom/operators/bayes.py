"""Naive Bayes from one grouped pass."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.functions import vectors
from hinloom.runtime import double_array, materialize


@dataclass(frozen=True)
class NaiveBayesModel:
    """``priors(label, log_prior)`` and ``likelihoods(label, pos, log_prob)``."""

    kind: str
    priors: DataFrame
    likelihoods: DataFrame


def train(df: DataFrame, features: str, label: str, kind: str = "multinomial", smoothing: float = 1.0) -> NaiveBayesModel:
    """Smoothed log priors and log likelihoods per class.

    Multinomial features must not be negative; Bernoulli features are 0 or 1.
    """
    if kind not in ("multinomial", "bernoulli"):
        raise ValueError("kind is 'multinomial' or 'bernoulli'")
    x = double_array(features)
    bad = (
        F.exists(x, lambda v: v < 0)
        if kind == "multinomial"
        else F.exists(x, lambda v: (v != 0) & (v != 1))
    )
    checked = F.when(~bad, x).otherwise(F.raise_error(F.lit(f"invalid {kind} feature value")))
    per_label = df.select(F.col(label).alias("label"), array_to_vector(checked).alias("_v")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.metrics("sum").summary(F.col("_v")).alias("_s")
    )
    # One row per class.
    sums = materialize(per_label.select("label", "n", vector_to_array(F.col("_s.sum")).alias("sums")), "classes")
    totals = sums.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).first()
    log_total = F.log(F.lit(totals["n"] + smoothing * totals["c"]))
    priors = sums.select("label", (F.log(F.col("n") + smoothing) - log_total).alias("log_prior"))
    if kind == "multinomial":
        denominator = F.log(vectors.total(F.col("sums")) + smoothing * F.size("sums"))
    else:
        denominator = F.log(F.col("n") + 2.0 * smoothing)
    likelihoods = sums.select("label", denominator.alias("_d"), F.posexplode("sums").alias("pos", "_s")).select(
        "label", "pos", (F.log(F.col("_s") + smoothing) - F.col("_d")).alias("log_prob")
    )
    return NaiveBayesModel(kind, priors, likelihoods)


def scores(model: NaiveBayesModel, features: str | Column) -> tuple[list[object], Column]:
    """The class labels and an array column of their log scores.

    The model's size is classes times features; it becomes constants.
    """
    x = double_array(features)
    per_class = (
        model.likelihoods.groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "log_prob")))["log_prob"].alias("theta"))
        .join(model.priors, "label")
        .orderBy("label")
        .collect()
    )
    columns = []
    for row in per_class:
        theta, constant = row["theta"], row["log_prior"]
        if model.kind == "bernoulli":
            absent = [math.log1p(-math.exp(t)) for t in theta]
            constant += sum(absent)
            theta = [t - a for t, a in zip(theta, absent)]
        score = F.lit(constant) + vectors.dot_constant(x, theta)
        columns.append(score)
    return [row["label"] for row in per_class], F.array(*columns)


def predict(df: DataFrame, model: NaiveBayesModel, features: str, name: str = "prediction") -> DataFrame:
    """The class of highest score, the smallest label on a tie."""
    labels, score = scores(model, features)
    choices = F.array(*[F.lit(label) for label in labels])
    return df.withColumn("_scores", score).withColumn(
        name, F.element_at(choices, vectors.argmax(F.col("_scores")) + 1)
    ).drop("_scores")


def predict_probabilities(df: DataFrame, model: NaiveBayesModel, features: str, name: str = "probabilities") -> DataFrame:
    """Class probabilities in label order."""
    _, score = scores(model, features)
    shifted = F.transform("_scores", lambda s: F.exp(s - F.array_max("_scores")))
    return (
        df.withColumn("_scores", score)
        .withColumn("_e", shifted)
        .withColumn(name, F.transform("_e", lambda e: e / vectors.total(F.col("_e"))))
        .drop("_scores", "_e")
    )
