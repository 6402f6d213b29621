"""Key dictionaries, lookups and edge resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.runtime import ordered_ids


def dictionary(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Distinct keys numbered from 0 in key order."""
    keys = df.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    return ordered_ids(keys, [key], name)


def encode(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, idx: str, name: str) -> DataFrame:
    """Replace a key by its position; rows without one are left out.

    Count them with `misses`.  A key the lookup has twice gets its smallest position, so no row doubles.  The join
    strategy is left to the optimizer, which broadcasts a lookup it has measured as small.
    """
    positions = lookup.groupBy(F.col(lookup_key).alias("_key")).agg(F.min(idx).alias(name))
    return df.join(positions, F.col(key) == F.col("_key")).drop("_key")


def misses(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str) -> DataFrame:
    """Rows whose key is not in the lookup."""
    known = lookup.select(F.col(lookup_key).alias("_key"))
    return df.join(known, F.col(key) == F.col("_key"), "left_anti")


def labelled(df: DataFrame, id_col: str, labels: DataFrame, label_id: str, label: str,
             prefix: str = "L", default: str = "L00") -> DataFrame:
    """Add ``label``: prefixed label, or the default where none is known.  Of several labels the smallest counts."""
    known = labels.groupBy(F.col(label_id).alias("_key")).agg(F.min(label).alias("_label"))
    text = F.concat(F.lit(prefix), F.col("_label").cast("string"))
    return (
        df.join(known, F.col(id_col) == F.col("_key"), "left")
        .withColumn("label", F.coalesce(text, F.lit(default)))
        .drop("_key", "_label")
    )


def resolve_edges(edges: DataFrame, src_type: str, dst_type: str, vertices: DataFrame) -> DataFrame:
    """Natural keys ``(src, dst, rel)`` to vertex ids on both ends."""
    sources = vertices.where(F.col("type") == src_type).select(
        F.col("id").alias("_s"), F.col("vid").alias("src_vid")
    )
    targets = vertices.where(F.col("type") == dst_type).select(
        F.col("id").alias("_d"), F.col("vid").alias("dst_vid")
    )
    return (
        edges.join(sources, F.col("src") == F.col("_s"))
        .join(targets, F.col("dst") == F.col("_d"))
        .select(F.col("src_vid").alias("src"), F.col("dst_vid").alias("dst"), "rel")
    )


def invalid_labels(df: DataFrame, label: str, classes: int = 2) -> DataFrame:
    """Rows whose label is not an integer in ``[0, classes)``."""
    value = F.col(label).cast("double")
    valid = (value >= 0) & (value < classes) & (value == F.floor(value))
    return df.where(~F.coalesce(valid, F.lit(False)))


def labels_are_valid(df: DataFrame, label: str, classes: int = 2) -> bool:
    """Stops at the first invalid row."""
    return invalid_labels(df, label, classes).isEmpty()


def fold_of(key: Column, folds: int, seed: int = 42) -> Column:
    """The fold (from 1) a row validates; a hash of the key, not a draw."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(draw * folds) + 1).cast("int")


def k_folds(df: DataFrame, key: str, folds: int, seed: int = 42) -> list[tuple[DataFrame, DataFrame]]:
    """``(training, validation)`` per fold: disjoint and exhaustive."""
    fold = fold_of(F.col(key), folds, seed)
    return [(df.where(fold != f), df.where(fold == f)) for f in range(1, folds + 1)]
