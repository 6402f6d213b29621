"""Seeded random columns and labelled sample data, generated by Spark tasks.

A generator is a function from a seed to a column, so any column expression
can be plugged in.  Values depend on the seed and the partitioning; draws made
from a key (`keyed_uniform`) depend on the key alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.functions import vectors
from hinloom.operators.trees import LARGEST_MEAN, poisson_from_uniform

Generator = Callable[[int], Column]


def uniform(seed: int) -> Column:
    return F.rand(seed)


def standard_normal(seed: int) -> Column:
    return F.randn(seed)


def exponential(mean: float) -> Generator:
    return lambda seed: -F.log1p(-F.rand(seed)) * mean


def log_normal(mean: float, std: float) -> Generator:
    """``exp`` of a normal with the given mean and deviation."""
    return lambda seed: F.exp(F.randn(seed) * std + mean)


def poisson(mean: float) -> Generator:
    """Of any mean; a seed's draws above a mean of 100 are those of its row numbers."""
    if mean <= LARGEST_MEAN:
        return lambda seed: poisson_from_uniform(F.rand(seed), mean).cast("double")
    return lambda seed: keyed_poisson(F.monotonically_increasing_id(), mean, seed)


def gamma(shape: float, scale: float = 1.0) -> Generator:
    return lambda seed: keyed_gamma(F.monotonically_increasing_id(), shape, scale, seed)


# Draws a rejection may take; it accepts far more than half of them, so the last one is never reached.
TRIES = 64


def _stream(key: Column, seed: int, place: Column) -> Column:
    """The uniform number in (0, 1) at a place of a key's own stream."""
    return (F.pmod(F.xxhash64(key, F.lit(seed), place), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _first_accepted(key: Column, seed: int, each: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The first accepted draw of a key; ``each`` gives (accepted, value) of two uniform numbers.

    The walk over the stream is a fold that stands still once a draw is accepted.
    """

    def walk(found: Column, place: Column) -> Column:
        good, value = each(_stream(key, seed, place * 2), _stream(key, seed, place * 2 + 1))
        return F.when(found.isNotNull(), found).otherwise(F.when(good, value))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), walk)


def keyed_gamma(key: Column, shape: float, scale: float = 1.0, seed: int = 42) -> Column:
    """Gamma draws of any shape above 0, equal on every attempt for a key.

    A cube of a shifted normal number under a squeeze; a shape below 1 is drawn one higher and scaled down by a power of one
    more uniform number.
    """
    if shape <= 0 or scale <= 0:
        raise ValueError("shape and scale are above 0")
    higher = shape if shape >= 1 else shape + 1
    d = higher - 1 / 3
    c = 1 / math.sqrt(9 * d)

    def each(u: Column, v: Column) -> tuple[Column, Column]:
        # A normal number from the first; the second decides.
        normal = F.sqrt(F.log(u) * -2.0) * F.cos(_stream(key, seed + 1, (u * 1e15).cast("long")) * (2 * math.pi))
        cube = F.pow(normal * c + 1.0, F.lit(3.0))
        limit = normal * normal * 0.5 + d - cube * d + F.log(cube) * d
        return (cube > 0) & (F.log(v) < limit), cube * d

    drawn = _first_accepted(key, seed, each)
    if shape < 1:
        drawn = drawn * F.pow(_stream(key, seed + 2, F.lit(0)), F.lit(1 / shape))
    return drawn * scale


def _log_factorial(n: Column) -> Column:
    """By its series, which is exact to 12 digits from 10 upwards."""
    x = n + 1.0
    series = 1.0 / (12.0 * x) - 1.0 / (360.0 * F.pow(x, F.lit(3.0))) + 1.0 / (1260.0 * F.pow(x, F.lit(5.0)))
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def keyed_poisson(key: Column, mean: float, seed: int = 42) -> Column:
    """Poisson draws of any mean, equal on every attempt for a key.

    Small means by the inverse of the distribution; above `trees.LARGEST_MEAN` by rejection from a transformed pair of uniform
    numbers, whose cost does not grow with the mean.
    """
    if mean <= LARGEST_MEAN:
        return poisson_from_uniform(_stream(key, seed, F.lit(0)), mean).cast("double")
    root = math.sqrt(mean)
    b = 0.931 + 2.53 * root
    a = -0.059 + 0.02483 * b
    inverse = 1.1239 + 1.1328 / (b - 3.4)

    def each(u: Column, v: Column) -> tuple[Column, Column]:
        half = u - 0.5
        us = F.lit(0.5) - F.abs(half)
        value = F.floor((2 * a / us + b) * half + mean + 0.43).cast("double")
        bound = value * math.log(mean) - mean - _log_factorial(value)
        return (value >= 0) & (us > 0) & (F.log(v * inverse / (a / (us * us) + b)) <= bound), value

    return _first_accepted(key, seed, each)


def random_column(spark: SparkSession, n: int, generator: Generator, partitions: int | None = None, seed: int = 42) -> DataFrame:
    """``(id, value)``, independent draws."""
    return _ids(spark, n, partitions).withColumn("value", generator(seed))


def random_vectors(
    spark: SparkSession, rows: int, cols: int, generator: Generator, partitions: int | None = None, seed: int = 42
) -> DataFrame:
    """``(id, features)``; up to a few hundred columns (wider: `random_values`)."""
    columns = [generator(seed + c * 7919) for c in range(cols)]
    return _ids(spark, rows, partitions).withColumn("features", F.array(*columns))


def _ids(spark: SparkSession, n: int, partitions: int | None) -> DataFrame:
    return spark.range(0, n, 1, partitions) if partitions else spark.range(n)


# What numpy calls the six distributions.
_SAMPLERS: dict[str, Callable[..., np.ndarray]] = {
    "uniform": lambda rng, shape: rng.random(shape),
    "normal": lambda rng, shape: rng.standard_normal(shape),
    "poisson": lambda rng, shape, mean: rng.poisson(mean, shape).astype(float),
    "exponential": lambda rng, shape, mean: rng.exponential(mean, shape),
    "gamma": lambda rng, shape, k, scale: rng.gamma(k, scale, shape),
    "log_normal": lambda rng, shape, mean, std: rng.lognormal(mean, std, shape),
}


def random_values(
    spark: SparkSession, rows: int, distribution: str, *parameters: float, cols: int = 0,
    partitions: int | None = None, seed: int = 42,
) -> DataFrame:
    """Draws from a named distribution, one stream per partition.

    The partition's first id seeds its stream, wherever the task runs.
    ``(id, value)``, or ``(id, features)`` when ``cols`` is positive.
    """
    if distribution not in _SAMPLERS:
        raise ValueError(f"unknown distribution {distribution}")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = None
        for pdf in frames:
            if len(pdf) and rng is None:
                rng = np.random.default_rng([seed, int(pdf["id"].iloc[0])])
            shape = (len(pdf), cols) if cols else len(pdf)
            values = _SAMPLERS[distribution](rng, shape, *parameters)
            if cols:
                yield pd.DataFrame({"id": pdf["id"], "features": list(values)})
            else:
                yield pd.DataFrame({"id": pdf["id"], "value": values})

    schema = "id long, features array<double>" if cols else "id long, value double"
    return _ids(spark, rows, partitions).mapInPandas(draw, schema)


def keyed_uniform(key: Column, seed: int = 42) -> Column:
    """A uniform draw that is a function of the key."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def keyed_normal(key: Column, seed: int = 42) -> Column:
    """A standard normal from two uniform draws of the key."""
    radius = F.sqrt(-2.0 * F.log(keyed_uniform(key, seed)))
    return radius * F.cos(2.0 * math.pi * keyed_uniform(key, seed + 1))


def load_test_vectors(spark: SparkSession, rows: int, cols: int = 10_000, partitions: int | None = None, seed: int = 42) -> DataFrame:
    """Uniform vectors for a clustering load test."""
    return random_values(spark, rows, "uniform", cols=cols, partitions=partitions, seed=seed)


# --- labelled data ---------------------------------------------------------------------


def blobs(spark: SparkSession, n: int, k: int, dims: int, r: float, partitions: int = 2, seed: int = 42) -> DataFrame:
    """``centre(id mod k) + N(0, 1)`` with centres drawn from ``r * N(0, 1)``."""
    centres = np.random.default_rng(seed).standard_normal((k, dims)) * r
    table = F.array(*[vectors.array_of(c) for c in centres])
    noise = F.array(*[F.randn(seed + 1 + d) for d in range(dims)])
    centre = F.element_at(table, (F.pmod("id", F.lit(k)) + 1).cast("int"))
    return _ids(spark, n, partitions).withColumn("features", vectors.axpy(1.0, centre, noise))


def linear_points(
    spark: SparkSession, n: int, weights: Sequence[float], intercept: float, eps: float, partitions: int = 2, seed: int = 42
) -> DataFrame:
    """``label = x . w + b + eps * N(0, 1)`` with ``x`` uniform in [-1, 1)."""
    x = F.array(*[F.rand(seed + d) * 2.0 - 1.0 for d in range(len(weights))])
    rows = _ids(spark, n, partitions).withColumn("features", x)
    label = vectors.dot(F.col("features"), vectors.array_of(weights)) + intercept + F.randn(seed + 999) * eps
    return rows.withColumn("label", label)


def logistic_points(spark: SparkSession, n: int, dims: int, eps: float, probability_one: float = 0.5, partitions: int = 2, seed: int = 42) -> DataFrame:
    """Alternating labels; ``x = N(0, 1) + label * eps``.

    ``probability_one`` other than one half draws the labels instead.
    """
    label = (
        F.pmod("id", F.lit(2)).cast("double")
        if probability_one == 0.5
        else F.when(F.rand(seed + 999) < probability_one, 1.0).otherwise(0.0)
    )
    rows = _ids(spark, n, partitions).withColumn("label", label)
    return rows.withColumn("features", F.array(*[F.randn(seed + d) + F.col("label") * eps for d in range(dims)]))


def svm_points(spark: SparkSession, n: int, dims: int, partitions: int = 2, seed: int = 42) -> DataFrame:
    """Label 1 where ``w . x + 0.1 N(0, 1)`` is positive; ``x`` uniform in [-1, 1)."""
    weights = np.random.default_rng(seed).standard_normal(dims)
    x = F.array(*[F.rand(seed + d) * 2.0 - 1.0 for d in range(dims)])
    rows = _ids(spark, n, partitions).withColumn("features", x)
    score = vectors.dot(F.col("features"), vectors.array_of(weights)) + F.randn(seed + 999) * 0.1
    return rows.withColumn("label", F.when(score > 0, 1.0).otherwise(0.0))


def low_rank_ratings(
    spark: SparkSession, users: int, items: int, rank: int, fraction: float, noise: float = 0.0, partitions: int = 2, seed: int = 42
) -> DataFrame:
    """About ``fraction * users * items`` cells of a low-rank product over ``sqrt(rank)``.

    Pairs are drawn by hash from a range of draws (repeats fall together), so
    the work follows the sample and not the full grid.
    """
    wanted = int(users * items * fraction)
    draws = spark.range(0, wanted, 1, partitions)
    pairs = draws.select(
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(users)).cast("int").alias("user"),
        F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(items)).cast("int").alias("item"),
    ).distinct()

    def factors(key: str, salt: int) -> Column:
        return F.array(*[keyed_normal(F.col(key), seed + salt + 2 * r) for r in range(rank)])

    score = vectors.dot(factors("user", 1000), factors("item", 2000)) / math.sqrt(rank)
    error = keyed_normal(F.struct("user", "item"), seed + 3000) * noise
    return pairs.select("user", "item", (score + error).cast("double").alias("rating"))
