"""Shared plumbing: written intermediates, checked broadcasts, hot-key joins.

Nothing here depends on one machine keeping its state.  Intermediates are
parquet tables below the folder the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table handed to `broadcast()` has been counted and holds no more rows.
BROADCAST_ROWS = 100_000

# The same for tables of an id and a number.
NARROW_ROWS = 1_000_000

# Rows of one join key that one task may see on either side.
HOT_CELL = 4096

_local_dirs: dict[str, str] = {}


def working_dir(spark: SparkSession) -> str:
    """Shared folder for intermediates.

    The session setting wins.  Only a local session without the setting gets
    a temporary folder; a cluster without it is an error.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{working_dir(spark)}/hinloom/{label}-{uuid.uuid4().hex}"


# Paths written since each open `intermediates` block began, innermost last.
_open_blocks: list[list[str]] = []


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, every table that `materialize` wrote inside it.

    Results are lazy: write or collect them before the block ends.
    """
    written: list[str] = []
    _open_blocks.append(written)
    try:
        yield
    finally:
        _open_blocks.remove(written)
        for name in written:
            _delete(spark, name)


def _delete(spark: SparkSession, folder: str) -> None:
    name = folder.rsplit("/", 1)[1]
    if name.startswith(_BUCKETS):
        spark.sql(f"drop table if exists {_table(name)}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# Spark deletes the shuffle files of a finished write where this is set, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Steps are written once and read a few times.
_CODEC = "zstd"


@contextlib.contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside the block go with the end of the write."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and cached blocks of RDD code (Spark's own fits) that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little to do puts off.
    """
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Cuts the lineage, so later steps neither replan nor recompute it, and a
    lost executor costs a re-read instead of a replay of the whole history.
    What was shuffled for it is deleted.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if _open_blocks:
        _open_blocks[-1].append(path)
    with released_shuffles(spark):
        df.write.option("compression", _CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Bucketed steps are external tables of the session's catalog, named like their folder.
_BUCKETS = "buckets-"


def _table(folder: str) -> str:
    return "hinloom_" + folder.replace("-", "_")


def by_bucket(df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Move rows to where the buckets of `materialize_buckets` lie."""
    return df.repartition(buckets or by_default(df.sparkSession), *keys)


def materialize_buckets(
    df: DataFrame, keys: Sequence[str], label: str = "step", placed: bool = False, buckets: int | None = None
) -> DataFrame:
    """`materialize` in ``buckets`` by ``keys``, or in one bucket per shuffle partition.

    Aggregates by ``keys`` and joins on all of them read the table without a
    shuffle.  ``placed`` says that `by_bucket` has moved the rows already.
    Keep ``spark.sql.shuffle.partitions`` for as long as the table is in use,
    or joins move it again.
    """
    buckets = buckets or by_default(df.sparkSession)
    return materialize_rounds(lambda _: df, 1, keys, label, placed, buckets)


def materialize_rounds(
    part: Callable[[int], DataFrame],
    rounds: int,
    keys: Sequence[str],
    label: str,
    placed: bool,
    buckets: int,
    folders: Sequence[str] = (),
) -> DataFrame:
    """`materialize_buckets` of the union of ``part(0) ..``, each written before the next one is begun.

    Only one part's shuffles are on disk at a time.  Let the parts be those of `bucket_round`.  Rows with equal values
    of ``folders`` have files of their own, and a filter on these reads no others.
    """
    rows = part(0)
    spark = rows.sparkSession
    path = new_path(spark, _BUCKETS + label)
    if _open_blocks:
        _open_blocks[-1].append(path)
    name = _table(path.rsplit("/", 1)[1])
    for number in range(rounds):
        rows = rows if number == 0 else part(number)
        rows = rows if placed else by_bucket(rows, keys, buckets)
        writer = rows.write.bucketBy(buckets, *keys).option("compression", _CODEC).format("parquet")
        writer = writer.partitionBy(*folders) if folders else writer
        writer = writer.option("path", path) if number == 0 else writer.mode("append")
        with released_shuffles(spark):
            writer.saveAsTable(name)
    return spark.table(name)


def bucket_round(keys: Sequence[str | Column], buckets: int, rounds: int) -> Column:
    """The round, of ``rounds``, in which a row's bucket is written."""
    return F.pmod(F.pmod(F.hash(*keys), F.lit(buckets)), F.lit(rounds))


def discard(df: DataFrame) -> None:
    """Delete the files behind a table `materialize` wrote, and only those."""
    spark = df.sparkSession
    root = f"{working_dir(spark)}/hinloom/"
    folders = set()
    for name in df.inputFiles():
        if root.lstrip("/") in name:
            folders.add(name.rsplit("/", 1)[0])
    for folder in folders:
        _delete(spark, folder)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting; a larger table joins by shuffle.

    Call it on a table that is cheap to read twice (a written one).
    """
    return F.broadcast(df) if fits(df, rows) else df


# Rows of one task of `spread`.
TASK_ROWS = 500_000


def spread(df: DataFrame, keys: Sequence[str], rows: int = TASK_ROWS, number: int | None = None) -> DataFrame:
    """Move rows by ``keys`` into tasks of about ``rows`` rows, however many there are.

    An aggregate by ``keys`` then needs no shuffle of its own.  The rows are counted first: give a table or a short
    lineage, or a bound of their ``number``.  Few rows are left as they lie.
    """
    tasks = -(-(df.count() if number is None else number) // rows)
    return df if tasks < 2 else df.repartition(max(tasks, by_default(df.sparkSession)), *keys)


def by_default(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_hash(df: DataFrame) -> Column:
    """A value of the row's content: the same on every attempt of a task."""
    return F.xxhash64(*[F.col(c) for c in df.columns])


def hot_key_join(
    left: DataFrame, right: DataFrame, key: str, cell: int | None = HOT_CELL, hint: str | None = None
) -> DataFrame:
    """Inner join on ``key`` in which no task meets a whole hot key.

    A key with more than ``cell`` rows on a side is cut into parts of about
    ``cell`` rows, and the parts of the two sides meet as a grid.  Only hot
    keys are replicated.  Key counts use map-side combine; without hot keys
    (or with ``cell=None``) this is the plain equi join.  A ``hint`` names the
    join strategy; a table joined with itself does best with ``merge``, where
    both sides read one shuffle.
    """

    def joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        return a.join(b.hint(hint) if hint else b, keys)

    if cell is None:
        return joined(left, right, [key])
    counts_l = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l"))
    counts_r = right.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    hot = counts_l.join(counts_r, key).where((F.col("_l") > cell) | (F.col("_r") > cell))
    hot = materialize(
        hot.select(
            key,
            F.ceil(F.col("_l") / cell).cast("long").alias("_ls"),
            F.ceil(F.col("_r") / cell).cast("long").alias("_rs"),
        ),
        "hot-keys",
    )
    if hot.isEmpty():
        return joined(left, right, [key])
    hot = broadcast_if_small(hot)

    def cut(side: DataFrame, own: str, other: str, own_part: str, other_part: str) -> DataFrame:
        copies = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(other), F.lit(1)) - 1)
        return (
            side.withColumn("_part", row_hash(side))
            .join(hot, key, "left")
            .withColumn(own_part, F.pmod(F.col("_part"), F.coalesce(F.col(own), F.lit(1))))
            .withColumn(other_part, F.explode(copies))
            .drop("_part", "_ls", "_rs")
        )

    cut_left = cut(left, "_ls", "_rs", "_pl", "_pr")
    cut_right = cut(right, "_rs", "_ls", "_pr", "_pl")
    return joined(cut_left, cut_right, [key, "_pl", "_pr"]).drop("_pl", "_pr")


# `monotonically_increasing_id` keeps the partition number above this bit and
# the row's place in the partition below it.
_SLOT_BITS = 33


def ordered_ids(
    df: DataFrame, order: Sequence[str | Column], name: str = "id", start: int = 0
) -> DataFrame:
    """Consecutive ids in sort order without a single-partition window.

    A range sort spreads the rows; each row's place inside its range is kept
    with it in a written table, and one small offset per range is added.
    ``order`` must decide every tie for the ids to be reproducible.
    """
    placed = materialize(
        df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), "ordered"
    )
    in_range = F.shiftright(F.col("_slot"), _SLOT_BITS)
    sizes = placed.groupBy(in_range.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _exclusive_sums(sizes, ["_n"]).select("_range", F.col("_n_before").alias("_base"))
    place = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        placed.withColumn("_range", in_range)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_base") + place + F.lit(start).cast("long"))
        .drop("_range", "_slot", "_base")
    )


def _exclusive_sums(sizes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums over all earlier ranges.

    One row per range partition of a sort, so the table is bounded by
    ``spark.sql.shuffle.partitions`` and one task may order it.
    """
    from pyspark.sql import Window

    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    for column in columns:
        zero = F.lit(0).cast(sizes.schema[column].dataType)
        sizes = sizes.withColumn(
            f"{column}_before", F.coalesce(F.sum(column).over(earlier), zero)
        )
    return sizes


def running_sums(
    df: DataFrame, order: Sequence[str | Column], columns: Sequence[str]
) -> DataFrame:
    """Add ``<c>_cum`` (inclusive running sum in sort order) for each column.

    Meant for tables with one row per order key (pre-aggregate first).  Ranges
    are summed in parallel and shifted by the total of the ranges before them.
    """
    from pyspark.sql import Window

    placed = materialize(
        df.orderBy(*order).withColumn(
            "_range", F.shiftright(F.monotonically_increasing_id(), _SLOT_BITS)
        ),
        "ranges",
    )
    sizes = placed.groupBy("_range").agg(*[F.sum(c).alias(c) for c in columns])
    offsets = _exclusive_sums(sizes, columns).select(
        "_range", *[F.col(f"{c}_before") for c in columns]
    )
    inside = (
        Window.partitionBy("_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    shifted = placed.join(F.broadcast(offsets), "_range")
    for column in columns:
        shifted = shifted.withColumn(
            f"{column}_cum", F.sum(column).over(inside) + F.col(f"{column}_before")
        )
    return shifted.drop("_range", *[f"{c}_before" for c in columns])


def double_array(column: str | Column) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return col.cast(T.ArrayType(T.DoubleType()))
