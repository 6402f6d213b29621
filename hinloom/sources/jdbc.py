"""Relational tables, from a database or from files of the same shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class JdbcTable:
    """Where a table lives; credentials come with ``options``, never from code.

    With ``partition_column`` and its bounds the scan runs as
    ``num_partitions`` range queries, else as a single one.
    """

    url: str
    table: str
    options: Mapping[str, str] = field(default_factory=dict)
    partition_column: str | None = None
    lower: int = 0
    upper: int = 0
    num_partitions: int = 1

    def reader_options(self) -> dict[str, str]:
        found = {"url": self.url, "dbtable": self.table, **self.options}
        if self.partition_column:
            found.update(
                partitionColumn=self.partition_column,
                lowerBound=str(self.lower),
                upperBound=str(self.upper),
                numPartitions=str(self.num_partitions),
            )
        return found


def read_table(spark: SparkSession, source: JdbcTable | str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a database table or of a parquet path.

    The projection and later filters are pushed into the query or the scan.
    """
    if isinstance(source, JdbcTable):
        df = spark.read.format("jdbc").options(**source.reader_options()).load()
    else:
        df = spark.read.parquet(source)
    return df.select(*columns)
