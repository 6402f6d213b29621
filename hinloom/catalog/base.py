"""What a catalog entry is, and the helpers entries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    runs: dict[str, Run] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        """Register the decorated function, with its check where there is one."""

        def register(run: Run) -> Run:
            self.runs[name] = run
            if sql is not None:
                self.sql[name] = sql
            return run

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: Column | str, digits: int = 6) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, digits)
