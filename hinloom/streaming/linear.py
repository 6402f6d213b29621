"""Streaming linear and logistic regression by gradient descent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hinloom.operators.linear import predict_class, predict_linear, sgd
from hinloom.streaming.state import ModelState, query_run

_SCHEMA = "weights array<double>"
# Run and batch of the first version.
INITIAL = ("start", -1)


class StreamingRegression:
    """Every non-empty batch continues from the newest weights."""

    loss = "squared"
    penalty = "none"

    def __init__(
        self, spark: SparkSession, path: str, step: float = 0.1, iterations: int = 50, fraction: float = 1.0, reg: float = 0.0
    ) -> None:
        self.spark, self.state = spark, ModelState(spark, path)
        self.step, self.iterations, self.fraction, self.reg = step, iterations, fraction, reg

    def start(self, weights: Sequence[float]) -> None:
        """Set the first weights; an existing model is kept."""
        if not self.state.versions():
            self._save(*INITIAL, weights)

    def _save(self, run: str, batch: int, weights: Sequence[float]) -> None:
        self.state.write(run, batch, self.spark.createDataFrame([([float(w) for w in weights],)], _SCHEMA))

    def weights(self) -> list[float]:
        table = self.state.latest()
        if table is None:
            raise RuntimeError("set the initial weights first")
        return list(table.first()["weights"])

    def update(
        self, batch: DataFrame, batch_id: int, features: str = "features", label: str = "label", run: str = ""
    ) -> None:
        if self.state.has(run, batch_id):
            return
        current = self.weights()
        rows = batch.select(features, label).persist()
        try:
            if rows.isEmpty():
                return
            new, _ = sgd(
                rows, features, label, current, self.loss, self.step, self.iterations, self.reg, self.penalty, self.fraction
            )
        finally:
            rows.unpersist()
        self._save(run, batch_id, new)

    def train_on(
        self, stream: DataFrame, checkpoint: str, features: str = "features", label: str = "label", **trigger: object
    ) -> StreamingQuery:
        self.weights()

        def fold(df: DataFrame, batch_id: int) -> None:
            self.update(df, batch_id, features, label, query_run(self.spark, checkpoint))

        return (
            stream.writeStream.foreachBatch(fold)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """A stateless column on a table or a stream; key columns stay."""
        return predict_linear(df, features, self.weights())


class StreamingLogisticRegression(StreamingRegression):
    loss = "logistic"
    penalty = "l2"

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        return predict_class(df, features, self.weights())
