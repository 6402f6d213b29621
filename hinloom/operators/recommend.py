"""Matrix factorisation and recommendation from factor tables.

Factors are tables ``(id, factors array<double>)`` of one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.functions import vectors
from hinloom.operators.dense import rows_of
from hinloom.operators.ordering import top_k, top_k_per_key
from hinloom.runtime import double_array, materialize


# Ratings of one block of `factorize`, and Spark's own number of blocks.
RATINGS_OF_BLOCK = 2_000_000
LEAST_BLOCKS = 10


def factorize(
    ratings: DataFrame,
    rank: int = 10,
    iterations: int = 10,
    reg: float = 0.01,
    implicit: bool = False,
    alpha: float = 1.0,
    nonnegative: bool = False,
    blocks: int | None = None,
    seed: int = 42,
) -> ALSModel:
    """Alternating least squares over ``(user, item, rating)``.

    Without ``blocks`` there are as many as the ratings ask for: a task holds and sorts all of a block.  They are
    counted first: give a table or a short lineage.  Start factors are drawn per block.
    """
    blocks = blocks or max(LEAST_BLOCKS, -(-ratings.count() // RATINGS_OF_BLOCK))
    als = ALS(
        rank=rank, maxIter=iterations, regParam=reg, implicitPrefs=implicit, alpha=alpha,
        nonnegative=nonnegative, seed=seed, userCol="user", itemCol="item", ratingCol="rating",
    )
    return als.setNumBlocks(blocks).fit(ratings)


def factors_of(model: ALSModel) -> tuple[DataFrame, DataFrame]:
    """User and item factor tables of a fitted model."""
    return tuple(
        f.select("id", double_array("features").alias("factors"))
        for f in (model.userFactors, model.itemFactors)
    )


# Pairs that one task of `predict_pairs` holds, and values of its factors of either side.
PAIR_ROWS = 500_000
PAIR_VALUES = 1_000_000

# Factor tables of so many values are broadcast.
BROADCAST_VALUES = 1_000_000


def predict_pairs(
    pairs: DataFrame, users: DataFrame, items: DataFrame, small: int = BROADCAST_VALUES, held: int = PAIR_ROWS
) -> DataFrame:
    """``(user, item, score)`` for given pairs; unknown ids are left out.

    Factors are many times as wide as a pair.  Where pairs are many, they go to the stripes of both factor tables, of
    at most about `PAIR_VALUES` values, and no factor goes along with a pair.  Stripes are as many as pairs of them
    with ``held`` pairs each need; one with more pairs than that is dealt to several tasks.  Few pairs, ids that are not whole numbers, and factors of unequal length or with
    nulls take two joins.  Pairs are counted first: give a table or a short lineage.
    """
    pairs = pairs.select("user", "item")
    shapes = [
        df.agg(
            F.count(F.lit(1)),
            F.coalesce(F.max(F.size("factors")), F.lit(0)),
            F.coalesce(F.min(F.size("factors")), F.lit(0)),
            F.coalesce(F.max(F.exists("factors", F.isnull).cast("int")), F.lit(0)),
        ).first()
        for df in (users, items)
    ]
    rows, wide, narrow, nulls = zip(*shapes)
    whole = {"tinyint", "smallint", "int", "bigint"}
    kinds = {*dict(pairs.dtypes).values(), dict(users.dtypes)["id"], dict(items.dtypes)["id"]}
    plain = kinds - whole or {*wide} != {*narrow} or len({*wide}) > 1 or min(wide) < 1 or any(nulls)
    if max(n * w for n, w in zip(rows, wide)) <= small:
        users, items = F.broadcast(users), F.broadcast(items)
    elif not plain:
        number = pairs.count()
        stripes = _stripes(number, rows, wide[0], held)
        if number > rows[0] * stripes[1] + rows[1] * stripes[0]:
            return _predict_in_stripes(pairs, users, items, stripes, held)
    u = users.select(F.col("id").alias("user"), F.col("factors").alias("_u"))
    i = items.select(F.col("id").alias("item"), F.col("factors").alias("_i"))
    joined = pairs.join(u, "user").join(i, "item")
    return joined.select("user", "item", vectors.dot(F.col("_u"), F.col("_i")).alias("score"))


def _stripes(number: int, rows: Sequence[int], width: int, held: int) -> list[int]:
    """Stripes of users and items: enough for ``held`` pairs in a pair of stripes, with few copies of factors."""
    users, items = (max(1, -(-n * width // PAIR_VALUES)) for n in rows)
    while users * items * held < number:
        # A stripe more on one side is a copy more of the other side.
        if rows[1] * users <= rows[0] * items:
            users *= 2
        else:
            items *= 2
    return [users, items]


def _predict_in_stripes(pairs: DataFrame, users: DataFrame, items: DataFrame, stripes: list[int], held: int) -> DataFrame:
    """Scores of pairs at the pair of stripes they belong to; sums run in order of the factors, as in `vectors.dot`."""
    cell, kinds = ["_us", "_is", "_part"], dict(pairs.dtypes)

    def stripe(key: str, count: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(count)).cast("int")

    at = pairs.dropna().select(
        stripe("user", stripes[0]).alias("_us"),
        stripe("item", stripes[1]).alias("_is"),
        F.col("user").cast("long").alias("user"),
        F.col("item").cast("long").alias("item"),
    )
    # One row per pair of stripes.
    sizes = materialize(
        at.groupBy("_us", "_is").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("_parts")), "stripe-pairs"
    )
    tasks = int(sizes.agg(F.sum("_parts")).first()[0] or 1)
    # Equal pairs are scored once.
    dealt = (
        at.join(F.broadcast(sizes), ["_us", "_is"])
        .withColumn("_part", F.pmod(F.xxhash64("user", "item"), F.col("_parts")).cast("int"))
        .select(*cell, "user", "item")
        .repartition(tasks, *cell)
        .groupBy(*cell, "user", "item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cells = sizes.select("_us", "_is", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))

    def copies_of(df: DataFrame, own: str, count: int, side: int) -> DataFrame:
        rows = df.dropna(subset=["id"]).select(stripe("id", count).alias(own), F.col("id").cast("long").alias("id"), "factors")
        return rows.join(F.broadcast(cells), own).select(*cell, F.lit(side).alias("side"), "id", "factors")

    factors = copies_of(users, "_us", stripes[0], 0).unionByName(copies_of(items, "_is", stripes[1], 1))
    factors = factors.repartition(tasks, *cell)

    def score(some: pa.Table, held_factors: pa.Table) -> pa.Table:
        found = {c: some.column(c).to_numpy() for c in ("user", "item", "n")} if len(some) else {}
        found = found or {c: np.zeros(0, np.int64) for c in ("user", "item", "n")}
        at, by_side = {}, {}
        for side, key in ((0, "user"), (1, "item")):
            rows = held_factors.filter(pc.equal(held_factors.column("side"), side)) if len(held_factors) else held_factors
            if not len(rows):
                found = {c: v[:0] for c, v in found.items()}
                return pa.table({"user": found["user"], "item": found["item"], "score": np.zeros(0), "n": found["n"]})
            ids = rows.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            flat = pa.concat_arrays(rows.column("factors").chunks).flatten().to_numpy(zero_copy_only=False)
            by_side[side] = flat.reshape(len(ids), -1)
            # An id that is given twice scores twice.
            ids = ids[order]
            first = np.searchsorted(ids, found[key])
            times = np.searchsorted(ids, found[key], "right") - first
            of = np.repeat(np.arange(len(times)), times)
            place = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + first[of]
            found, at = ({c: v[of] for c, v in d.items()} for d in (found, at))
            at[side] = order[place]
        scores = np.zeros(len(at[0]))
        for start in range(0, len(scores), 65536):
            u, i = (by_side[side][at[side][start : start + 65536]] for side in (0, 1))
            for place in range(u.shape[1]):
                scores[start : start + 65536] += u[:, place] * i[:, place]
        return pa.table({"user": found["user"], "item": found["item"], "score": scores, "n": found["n"]})

    scored = dealt.groupBy(*cell).cogroup(factors.groupBy(*cell)).applyInArrow(
        score, "user long, item long, score double, n long"
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return scored.select("user", "item", "score", copies.alias("_copy")).select(
        F.col("user").cast(kinds["user"]).alias("user"), F.col("item").cast(kinds["item"]).alias("item"), "score"
    )


def recommend_for(factors: list[float], items: DataFrame, n: int) -> DataFrame:
    """Top ``n`` items ``(id, score)`` for one factor vector."""
    score = vectors.dot(F.col("factors"), vectors.array_of(factors))
    return top_k(items.select("id", score.alias("score")), [F.desc("score"), F.col("id")], n)


def factor_row(factors: DataFrame, key: object) -> list[float]:
    row = factors.where(F.col("id") == key).first()
    if row is None:
        raise KeyError(key)
    return list(row["factors"])


# Rows of factors one task holds of either side, in values.
STRIPE_VALUES = 4_000_000


def recommend_all(users: DataFrame, items: DataFrame, n: int, block: int = 4096) -> DataFrame:
    """Top ``n`` items of every user: ``(user, item, score, rank)``.

    Both tables are packed into stripes of about `STRIPE_VALUES` values, of at least ``block`` rows, by a hash of the
    id; a row is copied once per stripe of the other side.  Each pair of stripes is one row of an equi join, scored in
    products of ``block`` rows by ``block`` that keep the ``n`` best items per user so far; a second top ``n`` merges
    the stripes.  No table is broadcast or gathered.
    """
    spark = users.sparkSession
    widths, tasks = [], spark.sparkContext.defaultParallelism
    for df in (users, items):
        count, width = df.agg(F.count(F.lit(1)), F.max(F.size("factors"))).first()
        blocks, held = -(-count // block), -(-count * max(1, width or 1) // STRIPE_VALUES)
        # Stripes enough to keep all cores busy where there are blocks enough.
        widths.append(max(1, held, min(blocks, math.ceil(math.sqrt(4 * tasks)))))
    user_stripes, item_stripes = widths

    def packed(df: DataFrame, own: str, count: int, other: str, other_count: int, prefix: str) -> DataFrame:
        stripes = df.select("id", "factors", F.pmod(F.xxhash64("id"), F.lit(count)).alias(own)).groupBy(own).agg(
            F.collect_list(F.struct("id", "factors")).alias("_rows")
        )
        return stripes.select(
            own,
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_count - 1).cast("long"))).alias(other),
            F.col("_rows.id").alias(f"{prefix}_ids"),
            F.flatten(F.col("_rows.factors")).alias(f"{prefix}_flat"),
        )

    pairs = packed(users, "_us", user_stripes, "_is", item_stripes, "u").join(
        packed(items, "_is", item_stripes, "_us", user_stripes, "i"), ["_us", "_is"]
    )
    # Stripes are few and large: a task takes few pairs, whatever their bytes.
    pairs = pairs.repartition(user_stripes * item_stripes, "_us", "_is")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                column = lambda name: batch.column(batch.schema.get_field_index(name))[row].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                u_ids, i_ids = column("u_ids"), column("i_ids")
                u = column("u_flat").reshape(len(u_ids), -1)
                i = column("i_flat").reshape(len(i_ids), -1)
                # Items in order of their id: among equal scores the first place is the smaller id.
                order = np.argsort(i_ids, kind="stable")
                i_ids, i = i_ids[order], i[order]
                for start in range(0, len(u_ids), block):
                    yield best_of_block(u_ids[start : start + block], u[start : start + block], i_ids, i)

    def best_of_block(u_ids: np.ndarray, u: np.ndarray, i_ids: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        rows = np.arange(len(u_ids))
        places, scores = np.empty((len(u_ids), 0), dtype=np.int64), np.empty((len(u_ids), 0))
        for start in range(0, len(i_ids), block):
            found = u @ i[start : start + block].T
            if scores.shape[1] < n:
                who, at = np.repeat(rows, found.shape[1]), np.tile(np.arange(found.shape[1]), len(rows))
            else:
                # A later item with the score of the last one kept has a larger id.  NaN sorts first, as in Spark.
                who, at = np.nonzero(~(found <= scores[:, -1:]))
                if not len(who):
                    continue
            who, at, value = (
                np.concatenate([np.repeat(rows, scores.shape[1]), who]),
                np.concatenate([places.ravel(), at + start]),
                np.concatenate([scores.ravel(), found[who, at]]),
            )
            sorted_by = np.lexsort((at, -value, ~np.isnan(value), who))
            who, at, value = who[sorted_by], at[sorted_by], value[sorted_by]
            first = np.searchsorted(who, rows)
            kept = np.arange(len(who)) - first[who] < n
            width = min(n, scores.shape[1] + found.shape[1])
            places, scores = at[kept].reshape(len(rows), width), value[kept].reshape(len(rows), width)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(u_ids, scores.shape[1])), pa.array(i_ids[places].ravel()), pa.array(scores.ravel())],
            names=["user", "item", "score"],
        )

    kinds = [dict(df.dtypes)["id"] for df in (users, items)]
    scored = pairs.select("u_ids", "u_flat", "i_ids", "i_flat").mapInArrow(
        best, f"user {kinds[0]}, item {kinds[1]}, score double"
    )
    return top_k_per_key(scored, ["user"], [F.desc("score"), F.col("item")], n)
