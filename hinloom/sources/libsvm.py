"""``label index:value ...`` files."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.runtime import double_array, materialize


def read(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """``(label, features array<double>)``.

    Indices are 1-based and ascending.  Without ``num_features`` the width is
    the largest index found, at the cost of one more pass.
    """
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", num_features)
    rows = reader.load(path)
    return rows.select("label", vector_to_array("features").alias("features"))


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``rows(row, label)`` and ``cells(row, slot, value)``, slots from 0; no row is filled up with zeros.

    Blank lines and lines that start with ``#`` are skipped.  Indices are 1-based and ascending, or the job fails.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line != '' and not startswith(line, '#')")
    parts = F.split("line", "\\s+")
    entries = F.transform(
        F.slice(parts, 2, F.size(parts) - 1),
        lambda e: F.struct((F.split_part(e, F.lit(":"), F.lit(1)).cast("long") - 1).alias("slot"),
                           F.split_part(e, F.lit(":"), F.lit(2)).cast("double").alias("value")),
    )
    # The row numbers are fixed by writing them.
    parsed = materialize(
        lines.select(F.monotonically_increasing_id().alias("row"), parts[0].cast("double").alias("label"), entries.alias("e")),
        "libsvm",
    )
    before = F.slice("e", 1, F.greatest(F.size("e") - 1, F.lit(0)))
    after = F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0)))
    rising = F.zip_with(before, after, lambda a, b: a["slot"] < b["slot"])
    good = F.forall(rising, lambda x: x) & F.forall("e", lambda e: e["slot"] >= 0)
    checked = F.when(good, F.col("e")).otherwise(F.raise_error(F.lit("indices are not ascending from 1")))
    return parsed.select("row", "label"), parsed.select("row", F.inline(checked))


def write_cells(rows: DataFrame, cells: DataFrame, path: str) -> None:
    """``rows(row, label)`` with the ``cells`` of each, as text; zeros are not written."""
    entry = F.concat_ws(":", (F.col("slot") + 1).cast("string"), F.col("value").cast("string"))
    # A row's own entries.
    packed = cells.where("value != 0").groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("slot", entry.alias("entry")))), lambda e: e["entry"]).alias("entries")
    )
    joined = rows.join(packed, "row", "left")
    line = F.concat_ws(" ", F.col("label").cast("double").cast("string"), F.array_join("entries", " "))
    joined.select(line.alias("value")).write.text(path)


def write(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """Zeros are not written."""
    vectors = df.select(
        F.col(label).cast("double").alias("label"), array_to_vector(double_array(features)).alias("features")
    )
    vectors.write.format("libsvm").save(path)
