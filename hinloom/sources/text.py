"""Text scans with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.functions.vectors import to_dense


def _csv(spark: SparkSession, path: str, schema: str, sep: str) -> DataFrame:
    # Separated fields as they are: quotes and backslashes have no meaning here.
    return spark.read.schema(schema).option("sep", sep).option("quote", "").option("escape", "").csv(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """``id \\t name`` lines."""
    return _csv(spark, path, "id string, name string", "\t")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``id \\t class [\\t name]`` lines."""
    return _csv(spark, path, "id string, class int, name string", "\t")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``left \\t right`` lines, weight 1."""
    return _csv(spark, path, "left string, right string", "\t").withColumn("weight", F.lit(1.0))


def read_coo(spark: SparkSession, path: str) -> DataFrame:
    """``i,j,value`` lines with 1-based ids, as 0-based cells."""
    raw = _csv(spark, path, "i long, j long, value double", ",")
    return raw.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "value")


def read_ratings(spark: SparkSession, path: str, sep: str = "::") -> DataFrame:
    """``user::item::rating[::timestamp]`` lines."""
    return _csv(spark, path, "user int, item int, rating float, ts long", sep)


def _doubles(text: Column, pattern: str = r"\s+") -> Column:
    words = F.filter(F.split(F.trim(text), pattern), lambda w: w != "")
    return F.transform(words, lambda w: w.cast("double"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated numbers, one vector per line; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(_doubles(F.col("value")).alias("features"))


def read_vector_literals(spark: SparkSession, path: str) -> DataFrame:
    """``[1.0,2.0]`` or ``(3,[0,2],[1.0,2.0])`` lines as dense arrays."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(_parse_vector(F.trim("value")).alias("features"))


def _parse_vector(text: Column) -> Column:
    brackets = F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    dense = _doubles(brackets[0], ",")
    size = F.regexp_extract(text, r"^\((\d+)", 1).try_cast("long")
    indices = F.transform(
        F.filter(F.split(brackets[0], ","), lambda w: w != ""), lambda w: F.trim(w).cast("int")
    )
    values = _doubles(F.try_element_at(brackets, F.lit(2)), ",")
    sparse = F.zip_with(indices, values, lambda i, v: F.struct(i.alias("index"), v.alias("value")))
    return F.when(text.startswith("("), to_dense(sparse, size)).otherwise(dense)


def read_labeled_literals(spark: SparkSession, path: str) -> DataFrame:
    """``(label,[..])``, ``(label,(n,[..],[..]))`` or ``label,f1 f2`` lines."""
    line = F.trim("value")
    lines = spark.read.text(path).where(line != "").select(line.alias("line"))
    literal = F.col("line").startswith("(")
    inside = F.regexp_extract("line", r"^\(([^,]+),(.*)\)$", 2)
    label = F.when(literal, F.regexp_extract("line", r"^\(([^,]+),", 1)).otherwise(
        F.regexp_extract("line", r"^([^,]+),", 1)
    )
    plain = F.regexp_extract("line", r"^[^,]+,(.*)$", 1)
    return lines.select(
        label.cast("double").alias("label"),
        F.when(literal, _parse_vector(inside)).otherwise(_doubles(plain)).alias("features"),
    )


def read_labeled_csv(spark: SparkSession, path: str) -> DataFrame:
    """``label,f1 f2 ...`` lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), ",", 2)
    return lines.select(parts[0].cast("double").alias("label"), _doubles(parts[1]).alias("features"))


def write_labeled_csv(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """Inverse of `read_labeled_csv`."""
    numbers = F.concat_ws(" ", F.col(features).cast("array<string>"))
    df.select(F.concat_ws(",", F.col(label).cast("string"), numbers)).write.text(path)


def read_matrix_entries(spark: SparkSession, path: str) -> DataFrame:
    """``MatrixEntry(i,j,value)`` lines as cells."""
    pattern = r"^MatrixEntry\(([^,]+),([^,]+),([^)]+)\)$"
    part = lambda n: F.regexp_extract(F.trim("value"), pattern, n)
    return spark.read.text(path).where(F.trim("value") != "").select(
        part(1).cast("long").alias("i"), part(2).cast("long").alias("j"), part(3).cast("double").alias("value")
    )


def read_indexed_rows(spark: SparkSession, path: str) -> DataFrame:
    """``IndexedRow(i,(n,[cols],[vals]))`` lines as cells."""
    line = F.trim("value")
    lines = spark.read.text(path).where(line != "")
    brackets = F.regexp_extract_all(line, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    cols = F.transform(F.filter(F.split(brackets[0], ","), lambda w: w != ""), lambda w: w.cast("long"))
    cells = F.zip_with(cols, _doubles(brackets[1], ","), lambda j, v: F.struct(j.alias("j"), v.alias("value")))
    return lines.select(
        F.regexp_extract(line, r"^IndexedRow\((\d+),", 1).cast("long").alias("i"), F.inline(cells)
    )


def read_embeddings(
    spark: SparkSession, path: str, index: DataFrame, key: str, idx: str, prefix: str = "p_"
) -> DataFrame:
    """``token v1 v2 ...`` lines whose token has the prefix, keyed by ``index``.

    ``(index, vector)``; tokens the index does not know are left out.
    """
    lines = spark.read.text(path).where(F.col("value").startswith(prefix))
    words = F.split("value", " ")
    numbers = F.filter(words, lambda w: ~w.startswith(prefix) & (w != ""))
    rows = lines.select(
        words[0].alias("_token"), F.transform(numbers, lambda w: w.cast("double")).alias("vector")
    )
    known = index.select(F.col(key).alias("_token"), F.col(idx).cast("long").alias("index"))
    return rows.join(known, "_token").select("index", "vector")


def write_matrix(a: DataFrame, path: str) -> None:
    """Cells as parquet."""
    a.select("i", "j", "value").write.parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("i", "j", "value")


def write_rows(a: DataFrame, path: str, width: int = 1024) -> None:
    """Row segments as parquet."""
    from hinloom.operators.matrix import to_row_segments

    to_row_segments(a, width).write.parquet(path)
