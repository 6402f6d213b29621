"""Streaming k-means with forgetting."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hinloom.operators.clustering import assign, cluster_sums
from hinloom.streaming.state import ModelState, query_run

_SCHEMA = "cluster int, weight double, centre array<double>"
# Run and batch of the first version.
INITIAL = ("start", -1)


def decay_for_half_life(half_life: float) -> float:
    """The decay at which a point counts half after ``half_life`` time units."""
    return math.exp(math.log(0.5) / half_life)


def merge(
    centres: np.ndarray, weights: np.ndarray, counts: np.ndarray, sums: np.ndarray, discount: float
) -> tuple[np.ndarray, np.ndarray]:
    """New centres and weights from a batch's counts and sums.

    Old weight fades by ``discount``.  A cluster that has all but lost its
    weight is replaced by half of the heaviest one, the two set slightly apart.
    """
    faded = weights * discount
    updated = faded + counts
    share = counts / np.maximum(updated, 1e-16)
    means = np.divide(sums, counts[:, None], out=centres.copy(), where=counts[:, None] > 0)
    moved = centres * (1 - share[:, None]) + means * share[:, None]
    heavy, light = int(updated.argmax()), int(updated.argmin())
    if updated[light] < 1e-8 * updated[heavy]:
        half = (updated[heavy] + updated[light]) / 2
        updated[heavy] = updated[light] = half
        shift = 1e-14 * np.maximum(np.abs(moved[heavy]), 1.0)
        moved[light] = moved[heavy] - shift
        moved[heavy] = moved[heavy] + shift
    return moved, updated


class StreamingKMeans:
    """Centres live in a state folder; nothing is kept in the driver process."""

    def __init__(self, spark: SparkSession, path: str, decay: float = 1.0, unit: str = "batches") -> None:
        if unit not in ("batches", "points"):
            raise ValueError("unit is 'batches' or 'points'")
        self.spark, self.state, self.decay, self.unit = spark, ModelState(spark, path), decay, unit

    def start(self, centres: Sequence[Sequence[float]], weights: Sequence[float]) -> None:
        """Set the first centres; an existing model is kept."""
        if not self.state.versions():
            self._save(*INITIAL, np.asarray(centres, dtype=float), np.asarray(weights, dtype=float))

    def start_random(self, k: int, dims: int, weight: float, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.start(rng.standard_normal((k, dims)), [weight] * k)

    def _save(self, run: str, batch: int, centres: np.ndarray, weights: np.ndarray) -> None:
        rows = [(c, float(w), [float(v) for v in x]) for c, (x, w) in enumerate(zip(centres, weights))]
        self.state.write(run, batch, self.spark.createDataFrame(rows, _SCHEMA))

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """``(centres, weights)``: k rows."""
        table = self.state.latest()
        if table is None:
            raise RuntimeError("set the initial centres first")
        rows = sorted(table.collect(), key=lambda r: r["cluster"])
        return np.array([r["centre"] for r in rows]), np.array([r["weight"] for r in rows])

    def update(self, batch: DataFrame, batch_id: int, features: str = "features", run: str = "") -> None:
        """Fold one batch in.  An empty batch and one that this run replays change nothing."""
        if self.state.has(run, batch_id):
            return
        centres, weights = self.model()
        found = cluster_sums(batch, features, centres.tolist()).collect()
        if not found:
            return
        counts, sums = np.zeros(len(centres)), np.zeros_like(centres)
        for row in found:
            counts[row["cluster"]] = row["n"]
            sums[row["cluster"]] = row["sums"]
        discount = self.decay if self.unit == "batches" else self.decay ** counts.sum()
        self._save(run, batch_id, *merge(centres, weights, counts, sums, discount))

    def train_on(self, stream: DataFrame, checkpoint: str, features: str = "features", **trigger: object) -> StreamingQuery:
        def fold(df: DataFrame, batch_id: int) -> None:
            self.update(df, batch_id, features, query_run(self.spark, checkpoint))

        return (
            stream.writeStream.foreachBatch(fold)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add the nearest ``cluster`` of the newest model; other columns stay."""
        centres, _ = self.model()
        return assign(df, features, centres.tolist()).drop("sq_distance")

    def predict_on(
        self, stream: DataFrame, sink: str, checkpoint: str, features: str = "features", **trigger: object
    ) -> StreamingQuery:
        """Each micro-batch is scored with the model that is newest then.

        A batch of a run has its own folder, so a replay replaces its rows and another run's stay.
        """

        def score(df: DataFrame, batch_id: int) -> None:
            run = query_run(self.spark, checkpoint)
            self.predict(df, features).write.mode("overwrite").parquet(f"{sink}/run={run}/batch={batch_id}")

        return (
            stream.writeStream.foreachBatch(score)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
