"""Exact k nearest binary codes by incremental multi-index hashing.

A code is cut into segments, each about as wide as the logarithm of the number of codes.  Two codes within
distance t = radius * segments + j agree, in one of the segments 0 to j, up to ``radius`` bits, or up to
``radius - 1`` bits in a later one.  So segment searches are widened in that order, one step per t, and after step t
every code within t has been found.  A query stops as soon as its k-th verified distance is at most t.

Equal codes are one entry with their smallest ids, so a code shared by a third of the rows costs no more than
another one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinloom.runtime import materialize

# Steps run together while the masks of a radius are few; above it each step stops the queries it can.
MASKS_TOGETHER = 150

# Probes a task holds at once.
PROBES_AT_ONCE = 1 << 18


def sign_code(vector: Column, bits: int) -> Column:
    """A vector's signs as a long, first component highest (bit set where it is above 0).

    Null for a null vector, one of another length, or one with null or not finite components.
    """
    numbers = vector.cast("array<double>")
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    code = F.aggregate(
        numbers,
        F.lit(0).cast("long"),
        lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x > 0).cast("long")),
    )
    return F.when((F.size(numbers) == bits) & ~bad, code)


def _widths(bits: int, segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [bits * s // segments for s in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(width), radius)]


def _segment(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _smallest_ids(rows: DataFrame, count: int) -> DataFrame:
    """``code, ids, size``: equal codes with their smallest ids; each task keeps but ``count`` ids of a code."""
    first = Window.partitionBy("code").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= count)
    return kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def nearest(
    rows: DataFrame, queries: DataFrame, k: int, bits: int = 64, segments: int | None = None
) -> DataFrame:
    """The ``k`` rows nearest to each query by Hamming distance, ties to the smaller id.

    ``rows`` and ``queries`` have ``id, code`` (a long of up to 64 bits); a query's own id is no candidate for it.
    Null ids and codes take no part; repeated (id, code) rows count once; with fewer candidates than ``k`` all are
    returned; empty tables give no rows.  Returns query_id, rank (from 1), id, distance.
    """
    rows = rows.select("id", "code").where("id is not null and code is not null").distinct()
    # One more than k, since the query's own row may be among them.
    classes = materialize(_smallest_ids(rows, k + 1), "codes")
    asked = queries.select("id", "code").where("id is not null and code is not null").distinct()
    asked = materialize(asked, "queries")
    count = classes.count()
    if segments is None:
        segments = max(1, min(bits, int(bits // max(1.0, log2(max(count, 2))))))
    widths = _widths(bits, segments)
    index = None
    for number, (low, width) in enumerate(widths):
        part = classes.select(
            F.lit(number).alias("segment"), _segment(F.col("code"), low, width).alias("value"), "code", "ids"
        )
        index = part if index is None else index.unionByName(part)
    index = materialize(index, "segments")
    # What a query can find at all: k others and its own row, or all there are.
    available = classes.agg(F.sum(F.size("ids"))).first()[0] or 0
    wanted = min(k + 1, available)

    # A row without a code stands for each query that goes on.
    nothing = [F.lit(None).cast("long").alias("code"), F.array().cast("array<long>").alias("ids")]
    going = asked.select(F.col("code").alias("query")).distinct().select(
        "query", *nothing, F.lit(None).cast("int").alias("distance"), F.lit(bits).alias("bound")
    )
    finished: list[DataFrame] = []
    for until, steps in _schedule(widths, bits):
        active = going.where(F.col("code").isNull()).select("query", "bound")
        probes = _probes(active, [(s, *widths[s], r) for s, r in steps])
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        # A code beyond the k-th distance known so far never leaves the join.  Each query has many probes, which the
        # planner does not know: without the hint it would broadcast them.
        part = index.where(F.col("segment").isin([s for s, _ in steps])).hint("merge")
        hits = probes.join(part, ["segment", "value"]).where(distance <= F.col("bound"))
        found = going.drop("bound").unionByName(hits.select("query", "code", "ids", distance.alias("distance")))
        going = materialize(_best(found, k, wanted, until, bits), "nearest")
        finished.append(going.where(F.col("covered") & F.col("code").isNotNull()).select("query", "ids", "distance"))
        going = going.where(~F.col("covered")).drop("covered")
        if going.isEmpty():
            break
    else:
        finished.append(going.where(F.col("code").isNotNull()).select("query", "ids", "distance"))  # all was searched
    result = finished[0]
    for more in finished[1:]:
        result = result.unionByName(more)
    last = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        asked.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
        .join(result, "query")
        .select("query_id", F.explode("ids").alias("id"), "distance")
        .where(F.col("id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "distance")
    )


def _probes(active: DataFrame, searches: list[tuple[int, int, int, int]]) -> DataFrame:
    """The segment values at a distance from each query's, for (segment, lowest bit, width, radius) searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, low, width, radius in searches:
                masks = np.array(_masks(width, radius), np.int64)
                whole = np.int64((1 << width) - 1)
                step = max(1, PROBES_AT_ONCE // len(masks))
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    query, bound = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                    own = (query.view(np.uint64) >> np.uint64(low)).view(np.int64) & whole
                    values = (own[:, None] ^ masks).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(query, len(masks))),
                            pa.array(np.repeat(bound, len(masks))),
                            pa.array(np.full(len(values), segment, np.int32)),
                            pa.array(values),
                        ],
                        names=["query", "bound", "segment", "value"],
                    )

    return active.mapInArrow(run, "query long, bound int, segment int, value long")


def _best(found: DataFrame, k: int, wanted: int, until: int, bits: int) -> DataFrame:
    """The ``k + 1`` nearest codes of each query, whether they are proven, and the distance still to beat."""
    own = Window.partitionBy("query")
    order = own.orderBy(F.col("distance").asc_nulls_last(), F.get("ids", F.lit(0)), "code")
    so_far = F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A code met in several segments is one candidate; each task keeps but the best of a query.
    ranked = found.dropDuplicates(["query", "code"]).withColumn("n", F.row_number().over(order))
    kept = ranked.where((F.col("n") <= k + 1) | F.col("code").isNull()).withColumn("so_far", so_far)
    covered = F.max((F.col("so_far") >= wanted) & (F.col("distance") <= until)).over(own)
    bound = F.min(F.when(F.col("so_far") >= wanted, F.col("distance"))).over(own)
    return kept.select(
        "query", "code", "ids", "distance", F.coalesce(bound, F.lit(bits)).alias("bound"),
        F.coalesce(covered, F.lit(False)).alias("covered"),
    )


def _schedule(widths: list[tuple[int, int]], bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(distance covered after it, (segment, radius) searches) for each round."""
    count, widest = len(widths), max(w for _, w in widths)
    rounds: list[tuple[int, list[tuple[int, int]]]] = []
    for radius in range(widest + 1):
        steps = [(s, radius) for s, (_, width) in enumerate(widths) if radius <= width]
        if radius == 1:
            rounds[-1] = (2 * count - 1, rounds[-1][1] + steps)
        elif comb(widest, radius) <= MASKS_TOGETHER:
            rounds.append(((radius + 1) * count - 1, steps))
        else:
            rounds += [(radius * count + segment, [(segment, radius)]) for segment, _ in steps]
    return [(min(until, bits), steps) for until, steps in rounds]
