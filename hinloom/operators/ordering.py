"""Sorting, top-k, sliding windows and other order-based operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinloom.runtime import ordered_ids, row_hash, running_sums

# Spark trims groups before the shuffle for row numbers below this limit
# (`spark.sql.optimizer.windowGroupLimitThreshold`).
_TRIMMED_LIMIT = 1000


def global_sort(df: DataFrame, *order: str | Column) -> DataFrame:
    """Range-partitioned total order."""
    return df.orderBy(*order)


def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each key, numbered from 1.

    Each partition keeps at most ``k`` rows of a key before the shuffle, so a
    hot key reaches its task trimmed.  Above Spark's limit for that rewrite
    the trimming is done in parts of the key.
    """
    rows = df
    if k >= _TRIMMED_LIMIT:
        parts = df.withColumn("_part", F.pmod(row_hash(df), F.lit(64)))
        local = Window.partitionBy(*keys, "_part").orderBy(*order)
        rows = parts.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k)
        rows = rows.drop("_part", "_r")
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top ``k``; every partition sends at most ``k`` rows."""
    return df.orderBy(*order).limit(k)


def sliding(
    df: DataFrame,
    order: Sequence[str],
    n: int,
    values: Sequence[str],
    key: str | None = None,
    chunk: int = 65_536,
) -> DataFrame:
    """Every run of ``n`` consecutive rows as one row, no partial runs.

    Rows are numbered in sort order and cut into chunks; only the ``n - 1``
    rows at a chunk's start are copied to the chunk before it.  A hot key is
    therefore spread over as many tasks as it has chunks.  Output columns are
    ``<value>_0 .. <value>_{n-1}`` and ``position``, the run's first row.
    """
    if n < 1:
        raise ValueError("a window has at least one row")
    if n > chunk:
        raise ValueError("the chunk must hold a whole window")
    keys = [key] if key else []
    numbered = ordered_ids(df.select(*dict.fromkeys([*keys, *order, *values])), [*keys, *order], "position")
    own = F.floor(F.col("position") / chunk).cast("long")
    at_start = (F.pmod("position", F.lit(chunk)) < n - 1) & (own > 0)
    homes = F.when(at_start, F.array(own, own - 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_chunk", F.explode(homes))
    window = Window.partitionBy("_chunk").orderBy("position")
    result = spread
    for step in range(n):
        for value in values:
            ahead = F.col(value) if step == 0 else F.lead(value, step).over(window)
            result = result.withColumn(f"{value}_{step}", ahead)
    last = F.col("position") if n == 1 else F.lead("position", n - 1).over(window)
    result = result.withColumn("_last", last)
    complete = F.col("_last").isNotNull() & (own == F.col("_chunk"))
    if key:
        far_key = F.col(key) if n == 1 else F.lead(key, n - 1).over(window)
        result = result.withColumn("_far_key", far_key)
        complete = complete & (F.col("_far_key") == F.col(key))
    columns = [f"{value}_{step}" for step in range(n) for value in values]
    return result.where(complete).select(*keys, "position", *columns)


def cumulative_counts(
    scored: DataFrame, score: str, label: str, threshold: float = 0.5
) -> DataFrame:
    """Running positives and negatives by descending score.

    One row per distinct score: ``score, pos, neg, pos_cum, neg_cum``.
    """
    per_score = scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) > threshold, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) > threshold, 0).otherwise(1)).alias("neg"),
    )
    return running_sums(per_score, [F.col("score").desc()], ["pos", "neg"])


def downsample_scores(
    scored: DataFrame, score: str, label: str, bins: int, threshold: float = 0.5
) -> DataFrame:
    """Merge runs of consecutive distinct scores into about ``bins`` rows.

    A run keeps its first (highest) score and the sums of its counts.  With
    fewer than two scores per bin nothing is merged.
    """
    per_score = scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) > threshold, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) > threshold, 0).otherwise(1)).alias("neg"),
    )
    if bins <= 0:
        return per_score
    ranked = ordered_ids(per_score, [F.col("score").desc()], "_rn")
    grouping = ranked.count() // bins
    if grouping < 2:
        return per_score
    return (
        ranked.groupBy(F.floor(F.col("_rn") / grouping).alias("_bin"))
        .agg(F.max("score").alias("score"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .drop("_bin")
    )


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """``(value, n, rank)``: 1-based ranks, ties share their mean rank."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = running_sums(counts, ["value"], ["n"])
    return placed.select(
        "value", "n", (F.col("n_cum") - (F.col("n") - 1) / 2.0).alias("rank")
    )


def area_under_curve(points: DataFrame, x: str, y: str, order: Sequence[str]) -> DataFrame:
    """Trapezoid area of a curve whose points follow ``order``."""
    pairs = sliding(points, order, 2, [x, y])
    step = (F.col(f"{x}_1") - F.col(f"{x}_0")) * (F.col(f"{y}_1") + F.col(f"{y}_0")) / 2.0
    return pairs.agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("area"))
