"""Rows with a few of very many features, as cells ``(row, slot, value)`` from the scan to the model.

No vector is as long as the feature space: a model is a table of weights by slot, and a row meets it by a join on the
slot.  A slot that most rows have is skew on the side of the cells alone, which the adaptive planner splits; the
weights have one row per slot.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.functions.losses import LOSSES, Loss
from hinloom.runtime import broadcast_if_small, materialize

# Default number of hashed slots.
SLOTS = 1 << 20


def cells(rows: DataFrame, row: str, slots: str, values: str) -> DataFrame:
    """Cells of rows that hold their slots and values as arrays."""
    return rows.select(F.col(row).alias("row"), F.inline(F.arrays_zip(F.col(slots).alias("slot"), F.col(values).alias("value")))).select(
        "row", F.col("slot").cast("long").alias("slot"), F.col("value").cast("double").alias("value")
    )


def hashed_slot(term: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.hash(term), F.lit(slots)).cast("long")


def hashed_terms(df: DataFrame, row: str, words: str, slot: Callable[[Column], Column] = hashed_slot) -> DataFrame:
    """Term counts in hashed slots; terms of one slot add up."""
    terms = df.select(F.col(row).alias("row"), F.explode(words).alias("term"))
    return terms.groupBy("row", slot(F.col("term")).alias("slot")).agg(F.count(F.lit(1)).cast("double").alias("value"))


# --- naive Bayes -----------------------------------------------------------------


@dataclass(frozen=True)
class SparseBayes:
    """Score of a class: its constant, and for each cell the value times the weight of its slot.

    ``classes(label, constant, unseen)`` has a row per class, ``weights(slot, label, weight)`` one per class and slot
    that was seen with it; ``unseen`` is the weight of the others.
    """

    classes: DataFrame
    weights: DataFrame


def train_bayes(
    cells: DataFrame, labels: DataFrame, num_features: int, kind: str = "multinomial", smoothing: float = 1.0
) -> SparseBayes:
    """Smoothed naive Bayes from ``cells`` and ``labels(row, label)``.

    Multinomial values must not be negative, Bernoulli values are 0 or 1; zeros need no cells.  Rows without cells
    count for the priors; cells of rows without a label do not count.
    """
    if kind not in ("multinomial", "bernoulli"):
        raise ValueError("kind is 'multinomial' or 'bernoulli'")
    value = F.col("value")
    bad = value < 0 if kind == "multinomial" else (value != 0) & (value != 1)
    checked = F.when(~bad, value).otherwise(F.raise_error(F.lit(f"invalid {kind} feature value")))
    sums = materialize(
        cells.join(labels, "row").groupBy("label", "slot").agg(F.sum(checked).alias("s")).where("s > 0"), "slot-sums"
    )
    per_label = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    seen = sums.groupBy("label").agg(F.sum("s").alias("total"), F.count(F.lit(1)).alias("seen"))
    known = per_label.join(seen, "label", "left").fillna({"total": 0.0, "seen": 0})
    rows = known.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).first()
    log_rows = math.log((rows["n"] or 0) + smoothing * rows["c"]) if rows["c"] else 0.0
    prior = F.log(F.col("n") + smoothing) - log_rows
    if kind == "multinomial":
        below = F.log(F.col("total") + smoothing * num_features)
    else:
        below = F.log(F.col("n") + 2.0 * smoothing)
    known = materialize(known.select("label", "n", "seen", prior.alias("prior"), below.alias("below")), "classes")
    unseen = F.lit(math.log(smoothing)) - F.col("below")
    logs = sums.join(broadcast_if_small(known), "label").withColumn("p", F.log(F.col("s") + smoothing) - F.col("below"))
    if kind == "multinomial":
        classes = known.select("label", F.col("prior").alias("constant"), unseen.alias("unseen"))
        return SparseBayes(classes, logs.select("slot", "label", F.col("p").alias("weight")))
    # Every absent feature counts: their sum is a constant that a present one takes itself out of.
    absent = lambda p: F.log1p(-F.exp(p))
    taken = logs.groupBy("label").agg(F.sum(absent(F.col("p"))).alias("taken"))
    others = (num_features - F.col("seen")) * absent(unseen)
    constant = F.col("prior") + F.coalesce("taken", F.lit(0.0)) + others
    classes = known.join(taken, "label", "left").select("label", constant.alias("constant"), (unseen - absent(unseen)).alias("unseen"))
    return SparseBayes(classes, logs.select("slot", "label", (F.col("p") - absent(F.col("p"))).alias("weight")))


def bayes_scores(cells: DataFrame, rows: DataFrame, model: SparseBayes) -> tuple[list, DataFrame]:
    """The labels, and ``row, scores`` in their order, for every row of ``rows(row)``.

    The classes are few and come to the driver; the weights stay a table with one row per slot.
    """
    classes = model.classes.orderBy("label").collect()
    labels = [r["label"] for r in classes]
    defaults = dict(zip(labels, (r["unseen"] for r in classes), strict=True))
    # A class adds what its slot weighs more than an unseen one.
    more = [
        F.sum(F.when(F.col("label") == label, F.col("weight") - defaults[label]).otherwise(0.0)).alias(f"more_{k}")
        for k, label in enumerate(labels)
    ]
    by_slot = broadcast_if_small(materialize(model.weights.groupBy("slot").agg(*more), "slot-weights"))
    sums = [F.sum(F.col("value") * F.coalesce(f"more_{k}", F.lit(0.0))).alias(f"sum_{k}") for k in range(len(labels))]
    summed = cells.join(by_slot, "slot", "left").groupBy("row").agg(F.sum("value").alias("size"), *sums)
    size = F.coalesce("size", F.lit(0.0))
    scores = [
        F.lit(c["constant"]) + size * c["unseen"] + F.coalesce(f"sum_{k}", F.lit(0.0)) for k, c in enumerate(classes)
    ]
    return labels, rows.select("row").join(summed, "row", "left").select("row", F.array(*scores).alias("scores"))


def predict_bayes(cells: DataFrame, rows: DataFrame, model: SparseBayes) -> DataFrame:
    """``row, prediction, scores``: the class of the highest score, the smallest label on a tie."""
    labels, scored = bayes_scores(cells, rows, model)
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    return scored.select("row", F.element_at(F.array(*map(F.lit, labels)), best).alias("prediction"), "scores")


# --- linear models ----------------------------------------------------------------


def margins(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """``row, margin`` of the rows that share a slot with ``weights(slot, weight)``."""
    return (
        cells.join(weights, "slot").groupBy("row").agg(F.sum(F.col("value") * F.col("weight")).alias("margin"))
    )


def gradient(
    cells: DataFrame, labels: DataFrame, weights: DataFrame, loss: str | Loss
) -> tuple[DataFrame, float, int]:
    """``(slot, gradient)`` summed over the rows of ``labels(row, label)``, the loss sum, and the number of rows.

    One join by slot and one by row; what both send on are sums.
    """
    chosen = LOSSES[loss] if isinstance(loss, str) else loss
    m, y = F.coalesce("margin", F.lit(0.0)), F.col("label").cast("double")
    scored = materialize(
        labels.join(margins(cells, weights), "row", "left").select(
            "row", chosen.value(m, y).alias("loss"), chosen.slope(m, y).alias("slope")
        ),
        "slopes",
    )
    total = scored.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss"), F.count(F.lit(1)).alias("n")).first()
    sums = cells.join(scored.where("slope != 0").select("row", "slope"), "row")
    by_slot = sums.groupBy("slot").agg(F.sum(F.col("value") * F.col("slope")).alias("gradient"))
    return by_slot, total["loss"], total["n"]


def updated(weights: DataFrame, mean_gradient: DataFrame, size: float, reg: float = 0.0, penalty: str = "none") -> DataFrame:
    """Weights after one step of ``size``; a slot is in the result where its weight is not 0."""
    w, g = F.coalesce("weight", F.lit(0.0)), F.coalesce("gradient", F.lit(0.0))
    moved = {
        "none": w - size * g,
        "l2": w * (1.0 - size * reg) - size * g,
        "l1": F.signum(w - size * g) * F.greatest(F.lit(0.0), F.abs(w - size * g) - size * reg),
    }
    if penalty not in moved:
        raise ValueError("penalty is 'none', 'l2' or 'l1'")
    new = weights.join(mean_gradient, "slot", "full_outer").select("slot", moved[penalty].alias("weight"))
    return new.where("weight != 0")


def sgd(
    cells: DataFrame,
    labels: DataFrame,
    weights: DataFrame | None = None,
    loss: str | Loss = "logistic",
    step: float = 1.0,
    iterations: int = 100,
    reg: float = 0.0,
    penalty: str = "none",
    tolerance: float = 0.001,
) -> tuple[DataFrame, list[float]]:
    """Gradient descent from ``weights`` (all 0 by default): the weight table and the mean loss of every round.

    It ends when the weights move less than ``tolerance`` of their length.  Give written tables: a round reads the
    cells twice.
    """
    if weights is None:
        weights = cells.sparkSession.createDataFrame([], "slot long, weight double")
    history: list[float] = []
    for t in range(1, iterations + 1):
        by_slot, total, n = gradient(cells, labels, weights, loss)
        if not n:
            break
        history.append(total / n)
        mean = by_slot.select("slot", (F.col("gradient") / n).alias("gradient"))
        new = materialize(updated(weights, mean, step / math.sqrt(t), reg, penalty), "weights")
        gap = F.coalesce(new["weight"], F.lit(0.0)) - F.coalesce(weights["weight"], F.lit(0.0))
        moved = new.join(weights, "slot", "full_outer").agg(
            F.sqrt(F.sum(gap * gap)).alias("moved"), F.sqrt(F.sum(new["weight"] * new["weight"])).alias("length")
        ).first()
        weights = new
        if t > 1 and (moved["moved"] or 0.0) < tolerance * max(moved["length"] or 0.0, 1.0):
            break
    return weights, history
