"""Isotonic regression by pooling in ranges.

Rows are reduced to one sum per feature value and sorted into ranges.  Every range is pooled for itself; then only
ranges whose neighbour begins below their end are pooled together, until no two are out of order.  So data that rise
stay where they are, and data that fall are a few blocks by the time they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hinloom.runtime import materialize

_BLOCKS = "part long, low double, high double, weight double, total double"


def pooled(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbours pooled until the means rise: blocks ``low, high, weight, total`` in order of ``low``."""
    stack: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist(), strict=True):
        stack.append(list(block))
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, end, w, t = stack.pop()
            stack[-1][1] = end
            stack[-1][2] += w
            stack[-1][3] += t
    return tuple(np.array(stack, float).reshape(-1, 4).T)


def _batch(part: int, blocks: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    columns = [pa.array([part] * len(blocks[0]), pa.int64()), *map(pa.array, blocks)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "low", "high", "weight", "total"])


def _floats(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy()
                 for c in ("low", "high", "weight", "total"))


def isotonic_blocks(df: DataFrame, feature: str, label: str, weight: str | None = None, increasing: bool = True) -> DataFrame:
    """``low, high, value, weight``: the fitted value on each range of feature values, neither falling (or rising).

    Rows with a null feature or label, or a weight that is null or not above 0, do not count; no rows give no blocks.
    """
    sign = 1.0 if increasing else -1.0
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(feature).cast("double").alias("low"), (F.col(label).cast("double") * sign).alias("y"), w.alias("w"))
    sums = rows.where("low is not null and y is not null and w > 0").groupBy("low").agg(
        F.sum("w").alias("weight"), F.sum(F.col("y") * F.col("w")).alias("total")
    )

    def of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = tuple(np.empty(0) for _ in range(4))
        for batch in batches:
            blocks = pooled(*(np.concatenate(x) for x in zip(blocks, _floats(batch), strict=True)))
        yield _batch(TaskContext.get().partitionId(), blocks)

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("low")
        return pa.Table.from_batches([_batch(table.column("part")[0].as_py(), pooled(*_floats(table)))])

    ordered = sums.orderBy("low").select("low", F.col("low").alias("high"), "weight", "total")
    blocks = materialize(ordered.mapInArrow(of_range, _BLOCKS), "blocks")
    mean = F.col("total") / F.col("weight")
    while True:
        # One row per range of the sort.
        ends = blocks.groupBy("part").agg(
            F.min("low").alias("low"), F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last")
        )
        order = Window.orderBy("low")
        apart = F.coalesce(F.lag("last").over(order) < F.col("first"), F.lit(True))
        groups = ends.withColumn("new", apart.cast("long")).withColumn("group", F.sum("new").over(order))
        groups = materialize(groups.select("part", "new", "group"), "range-groups")
        if groups.where("new = 0").isEmpty():
            return blocks.select("low", "high", (mean * sign).alias("value"), "weight")
        # Ranges in order with both neighbours stay as they are.
        sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("ranges"))
        named = blocks.join(F.broadcast(groups.join(sizes, "group").drop("new")), "part")
        alone = named.where("ranges = 1").select(blocks.columns)
        merged = named.where("ranges > 1").select(F.col("group").alias("part"), "low", "high", "weight", "total")
        pooled_ = merged.groupBy("part").applyInArrow(together, _BLOCKS)
        # Names of pooled ranges must not meet those of the others.
        blocks = materialize(
            alone.withColumn("part", F.col("part") * 2).unionByName(pooled_.withColumn("part", F.col("part") * 2 + 1)), "blocks"
        )
