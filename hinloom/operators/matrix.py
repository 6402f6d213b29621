"""Matrix algebra on coordinate tables ``(i, j, value)``.

A missing cell is zero.  Ids may be of any orderable type where no arithmetic
on them is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hinloom.runtime import HOT_CELL, NARROW_ROWS, broadcast_if_small, hot_key_join, materialize, running_sums

# Products of the rows of one block, but for a row that has more alone.
BLOCK_PRODUCTS = 8_000_000

# Cells of the dense sums of a block, and products that are made at once.
DENSE_CELLS = 1 << 24
CHUNK = 1 << 18

# Which cells of a block to keep: of ``i, j, value`` and the pairs of ends.
Trim = Callable[[np.ndarray, np.ndarray, np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]], np.ndarray]


def cells(df: DataFrame, i: str, j: str, value: str | None = None) -> DataFrame:
    """Rename columns to the coordinate layout; no value column means 1.0."""
    weight = F.lit(1.0) if value is None else F.col(value).cast("double")
    return df.select(F.col(i).alias("i"), F.col(j).alias("j"), weight.alias("value"))


def canonical(a: DataFrame, drop_zeros: bool = True) -> DataFrame:
    """One row per cell: duplicates are summed, zero sums dropped."""
    summed = a.groupBy("i", "j").agg(F.sum("value").alias("value"))
    return summed.where(F.col("value") != 0) if drop_zeros else summed


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("i", "j", "value").unionByName(b.select("i", "j", "value"))
    return both.groupBy("i", "j").agg(F.sum("value").alias("value"))


def multiply(a: DataFrame, b: DataFrame, cell: int | None = HOT_CELL) -> DataFrame:
    """``C[i,j] = sum_k A[i,k] B[k,j]``: one join on ``k``, one aggregate.

    Products are summed map side before the shuffle on ``(i, j)``; a hot ``k``
    is cut into a grid by `hot_key_join`.
    """
    left = a.select("i", F.col("j").alias("_k"), F.col("value").alias("_x"))
    right = b.select(F.col("i").alias("_k"), "j", F.col("value").alias("_y"))
    return (
        hot_key_join(left, right, "_k", cell)
        .groupBy("i", "j")
        .agg(F.sum(F.col("_x") * F.col("_y")).alias("value"))
    )


def row_products(
    left: DataFrame, right: DataFrame | None = None, cell: int | None = HOT_CELL, ends: Sequence[str] = (), trim: Trim | None = None
) -> DataFrame:
    """``(i, j, value)``: sums of products of the rows of two tables ``(i, _k, value)`` that share a ``_k``.

    Without ``right`` the rows of ``left`` meet each other, ``i <= j``.  The tables are written ones.  Columns named in
    ``ends`` belong to a row and come back as ``<c>i`` and ``<c>j``.

    Rows are cut in sort order into blocks of about `BLOCK_PRODUCTS` products.  A block gets the list of each ``_k`` of
    its rows once and adds up all it has, so what moves are lists and not products, and no sum is moved again.  A
    ``_k`` with more than ``cell`` rows on a side goes through `hot_key_join` instead, and so does all that fits one block.
    Whole numbers as ids meet in numpy, unless a row alone has far more products than a block.

    ``trim`` says which cells of a block a caller needs, who must ask again: cells are dropped where a block has whole
    sums in numpy, and nowhere else.
    """
    upper = right is None
    given = ["i", "_k", "value", *ends]
    rows = left.select(given).dropna(subset=["i", "_k"])
    others = rows if upper else right.select(given).dropna(subset=["i", "_k"])
    counts = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_l"))
    if upper:
        counts = counts.withColumn("_r", F.col("_l"))
    else:
        counts = counts.join(others.groupBy("_k").agg(F.count(F.lit(1)).alias("_r")), "_k")
    counts = materialize(counts, "keys")
    to = [("_l", "i", "_x", "i"), ("_r", "j", "_y", "j")]
    names = {side: [key, value, *[f"{e}{mark}" for e in ends]] for side, key, value, mark in to}
    carried = [n for side in names for n in names[side][2:]]
    minima = [F.min(c).alias(c) for c in carried]

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = (
            df.select("_k", *[F.col(c).alias(n) for c, n in zip(["i", "value", *ends], names[side], strict=True)])
            for side, df in (("_l", a), ("_r", b))
        )
        met = hot_key_join(a, b, "_k", cell, "merge" if upper else None)
        return added_up(met, [])

    def added_up(met: DataFrame, keys: list[str]) -> DataFrame:
        met = met.where(F.col("i") <= F.col("j")) if upper else met
        return met.groupBy(*keys, "i", "j").agg(F.sum(F.col("_x") * F.col("_y")).alias("value"), *minima).drop(*keys)

    total = counts.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0.0
    if total <= BLOCK_PRODUCTS:
        return joined(rows, others)
    is_hot = F.lit(False) if cell is None else (F.col("_l") > cell) | (F.col("_r") > cell)
    hot = counts.where(is_hot).select("_k")
    any_hot = cell is not None and not hot.isEmpty()

    work = rows.join(counts.where(~is_hot), "_k").groupBy("i").agg(F.sum("_r").alias("_work"))
    ends_at = running_sums(work, ["i"], ["_work"])
    block = F.floor((F.col("_work_cum") - 1) / BLOCK_PRODUCTS).cast("int")
    blocks = materialize(ends_at.select("i", block.alias("_block"), "_work"), "blocks")
    last = blocks.agg(F.max("_block")).first()[0]
    # At most one of four blocks.
    full = blocks.groupBy("_block").agg(F.sum("_work").alias("_n")).where(F.col("_n") > 4 * BLOCK_PRODUCTS)
    full = [r["_block"] for r in full.collect()]
    placed = rows.join(broadcast_if_small(blocks.drop("_work"), NARROW_ROWS), "i")
    if any_hot:
        hot = broadcast_if_small(hot)
        placed, others_left = placed.join(hot, "_k", "left_anti"), others.join(hot, "_k", "left_anti")
    else:
        others_left = others
    entry = F.struct("_block", "i", "value", *ends)
    if upper:
        lists = placed.groupBy("_k").agg(F.collect_list(entry).alias("_l")).withColumn("_r", F.col("_l"))
    else:
        own = F.col("_block").isNotNull()
        both = placed.unionByName(others_left.withColumn("_block", F.lit(None).cast("int")))
        lists = both.groupBy("_k").agg(
            F.collect_list(F.when(own, entry)).alias("_l"), F.collect_list(F.when(~own, entry)).alias("_r")
        )
    targets = lists.select(F.explode(F.array_distinct(F.col("_l._block"))).alias("_to"), "_l", "_r")
    own = F.filter("_l", lambda e: e["_block"] == F.col("_to"))
    # Rows of the block come first among those they meet, and move once.
    met_by = F.concat(own, F.filter("_r", lambda e: e["_block"] > F.col("_to"))) if upper else F.col("_r")
    near = targets.select("_to", (F.size(own) if upper else own).alias("_l"), met_by.alias("_r")).where(F.size("_r") > 0)

    def arrays(side: str) -> list[Column]:
        return [F.col(f"{side}.{c}").alias(n) for c, n in zip(["i", "value", *ends], names[side], strict=True)]

    moved = near.select("_to", *(["_l"] if upper else arrays("_l")), *arrays("_r"))
    packed = moved.repartition(1 if last is None else last + 1, "_to")

    def exploded(packed: DataFrame) -> DataFrame:
        if upper:
            first = [F.slice(r, F.lit(1), F.col("_l")).alias(n) for n, r in zip(names["_l"], names["_r"], strict=True)]
            packed = packed.select("_to", *first, *names["_r"])
        met = packed.select("_to", F.inline(F.arrays_zip(*names["_l"])), *names["_r"]).select(
            "_to", *names["_l"], F.inline(F.arrays_zip(*names["_r"]))
        )
        return added_up(met, ["_to"])

    kinds = [dict(df.dtypes) for df in (rows, others)]
    if {k["i"] for k in kinds} <= {"int", "bigint"} and {k["value"] for k in kinds} == {"double"}:
        schema = T.StructType(
            [T.StructField("i", rows.schema["i"].dataType), T.StructField("j", others.schema["i"].dataType), T.StructField("value", T.DoubleType())]
            + [T.StructField(n, rows.schema[e].dataType) for side in names for e, n in zip(ends, names[side][2:], strict=True)]
        )
        met = _meeting([names["_l"], names["_r"]], list(ends), upper, None if any_hot else trim)
        light = packed.where(~F.col("_to").isin(full)) if full else packed
        sums = light.groupBy("_to").applyInArrow(met, schema)
        if full:
            sums = sums.unionByName(exploded(packed.where(F.col("_to").isin(full))))
    else:
        sums = exploded(packed)
    if not any_hot:
        return sums
    dense = joined(rows.join(hot, "_k", "left_semi"), others.join(hot, "_k", "left_semi"))
    return sums.unionByName(dense).groupBy("i", "j").agg(F.sum("value").alias("value"), *minima)


def _meeting(names: list[list[str]], ends: list[str], upper: bool, trim: Trim | None) -> Callable[[pa.Table], pa.Table]:
    """What a block of `row_products` does with its lists: every entry of the left one meets all of the right one.

    With ``upper`` the left list is the start of the right one, ``_l`` entries long.
    """

    def lists(table: pa.Table, columns: list[str]) -> tuple[list[pa.Array], np.ndarray]:
        found = [pa.concat_arrays(table.column(c).chunks) for c in columns]
        return [a.flatten() for a in found], np.diff(found[0].offsets.to_numpy())

    def numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
        known = None if not values.null_count else values.is_valid().to_numpy(zero_copy_only=False)
        return values.fill_null(0.0).to_numpy(zero_copy_only=False), known

    def meet(table: pa.Table) -> pa.Table:
        right, many = lists(table, names[1])
        begins = np.cumsum(many) - many
        cols, col_at, col = np.unique(right[0].to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        y, y_known = numbers(right[1])
        if upper:
            few = table.column("_l").to_numpy()
            of = np.repeat(np.arange(len(few)), few)
            at = np.arange(len(of)) - np.repeat(np.cumsum(few) - few, few) + begins[of]
            left, x, x_known = right, y[at], None if y_known is None else y_known[at]
            own = np.unique(col[at])
            place = np.zeros(len(cols), dtype=np.int64)
            place[own] = np.arange(len(own))
            rows, row_at, row = cols[own], col_at[own], place[col[at]]
        else:
            left, few = lists(table, names[0])
            of = np.repeat(np.arange(len(few)), few)
            rows, row_at, row = np.unique(left[0].to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
            x, x_known = numbers(left[1])
        width, counts = len(cols), many[of]
        up_to = np.cumsum(counts)
        total = int(up_to[-1]) if len(up_to) else 0
        dense = len(rows) * width <= min(DENSE_CELLS, max(4 * total, 1 << 16))
        nulls = x_known is not None or y_known is not None
        # Products above 0 show by their sum that a cell has any.
        shown = not nulls and total > 0 and x.min() > 0 and y.min() > 0 and x.min() * y.min() > 0
        size = len(rows) * width if dense else 0
        sums, met, known, cells = np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64), []
        # Every chunk adds up all dense sums.
        step = max(CHUNK, size // 8)
        cuts = np.unique([0, *np.searchsorted(up_to, np.arange(step, total, step)), len(of)]) if total else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = counts[a:b]
            one = np.repeat(np.arange(a, b), n)
            two = np.arange(len(one)) + np.repeat(begins[of[a:b]] - (np.cumsum(n) - n), n)
            cell, product = row[one] * width + col[two], x[one] * y[two]
            both = None
            if nulls:
                both = np.ones(len(one), bool) if x_known is None else x_known[one]
                both = both if y_known is None else both & y_known[two]
                product = np.where(both, product, 0.0)
            if not dense:
                cells.append((cell, product, both))
                continue
            sums += np.bincount(cell, product, size)
            if not shown:
                met += np.bincount(cell, minlength=size)
            if nulls:
                known += np.bincount(cell[both], minlength=size)
        if dense:
            found = np.flatnonzero(sums if shown else met)
            sums, known = sums[found], known[found]
        else:
            found, cell = np.unique(np.concatenate([c[0] for c in cells]), return_inverse=True)
            sums = np.bincount(cell, np.concatenate([c[1] for c in cells]), len(found))
            known = np.bincount(cell, np.concatenate([c[2] for c in cells]), len(found)) if nulls else None
        r, c = found // width, found % width
        kept = rows[r] <= cols[c] if upper else np.ones(len(found), bool)
        r, c, sums, known = r[kept], c[kept], sums[kept], known[kept] if nulls else None
        at_row = [left[2 + n].take(pa.array(row_at)) for n in range(len(ends))]
        at_col = [right[2 + n].take(pa.array(col_at)) for n in range(len(ends))]
        if trim is not None:
            pairs = {
                e: (a.to_numpy(zero_copy_only=False)[r], b.to_numpy(zero_copy_only=False)[c])
                for e, a, b in zip(ends, at_row, at_col, strict=True)
            }
            kept = trim(rows[r], cols[c], sums, pairs)
            r, c, sums, known = r[kept], c[kept], sums[kept], known[kept] if nulls else None
        value = pa.array(sums, mask=known == 0) if nulls else pa.array(sums)
        carried = [a.take(pa.array(i)) for held, i in ((at_row, r), (at_col, c)) for a in held]
        return pa.table(
            [pa.array(rows[r]), pa.array(cols[c]), value, *carried], names=["i", "j", "value", *names[0][2:], *names[1][2:]]
        )

    return meet


def self_product(w: DataFrame, cell: int | None = HOT_CELL) -> DataFrame:
    """``W W^T`` from its upper triangle, mirrored at the end.

    ``W`` is written first: its key counts and its blocks read it.
    """
    w = materialize(w, "factor")
    return mirror(row_products(w.withColumnRenamed("j", "_k"), cell=cell))


def mirror(upper: DataFrame) -> DataFrame:
    """The full symmetric table from cells with ``i <= j``, in one pass."""
    rest = [c for c in upper.columns if c not in ("i", "j")]
    there = F.struct(F.col("i"), F.col("j"))
    back = F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    both = F.when(F.col("i") == F.col("j"), F.array(there)).otherwise(F.array(there, back))
    return upper.select(F.inline(both), *rest).select("i", "j", *rest)


def divide(a: DataFrame, b: DataFrame, on_zero: str = "null") -> DataFrame:
    """``A ./ B`` on the cells of ``A``; a zero divisor gives null or an error."""
    if on_zero not in ("null", "error"):
        raise ValueError("on_zero is 'null' or 'error'")
    divisor = F.coalesce(F.col("_d"), F.lit(0.0))
    zero = (
        F.lit(None).cast("double")
        if on_zero == "null"
        else F.raise_error(F.lit("division by a zero cell")).cast("double")
    )
    return a.join(
        b.select("i", "j", F.col("value").alias("_d")), ["i", "j"], "left"
    ).select(
        "i", "j", F.when(divisor == 0, zero).otherwise(F.col("value") / divisor).alias("value")
    )


def diagonal_scale(a: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``D1 A D2``; the diagonals are tables ``(i, value)``."""
    rows = left.select("i", F.col("value").alias("_l"))
    cols = right.select(F.col("i").alias("j"), F.col("value").alias("_r"))
    return (
        a.join(rows, "i")
        .join(cols, "j")
        .select("i", "j", (F.col("_l") * F.col("value") * F.col("_r")).alias("value"))
    )


def matvec(a: DataFrame, v: DataFrame) -> DataFrame:
    """``A v`` for a vector table ``(i, value)``."""
    vector = v.select(F.col("i").alias("j"), F.col("value").alias("_v"))
    return (
        a.join(vector, "j").groupBy("i").agg(F.sum(F.col("value") * F.col("_v")).alias("value"))
    )


def gramian_matvec(a: DataFrame, v: DataFrame) -> DataFrame:
    """``A^T (A v)`` without forming ``A^T A``."""
    return matvec(transpose(a), matvec(a, v))


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sum("value").alias("value"))


def col_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.sum("value").alias("value"))


def row_square_sums(a: DataFrame) -> DataFrame:
    """The diagonal of ``A A^T``."""
    return a.groupBy("i").agg(F.sum(F.col("value") * F.col("value")).alias("value"))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where(F.col("i") == F.col("j")).select("i", "value")


def dimensions(a: DataFrame) -> DataFrame:
    """One row: 0-based ids give rows and columns as largest id plus one."""
    return a.agg(
        (F.max("i") + 1).alias("num_rows"),
        (F.max("j") + 1).alias("num_cols"),
        F.count(F.lit(1)).alias("num_cells"),
    )


def duplicate_cells(a: DataFrame) -> DataFrame:
    """Cells stored more than once (empty for a valid matrix)."""
    return (
        a.groupBy("i", "j").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )


def check_duplicates(a: DataFrame, duplicates: str) -> DataFrame:
    """Apply the duplicate policy of a 0/1 incidence table."""
    if duplicates == "distinct":
        return a.select("i", "j").distinct().withColumn("value", F.lit(1.0))
    if duplicates == "sum":
        return canonical(a, drop_zeros=False)
    if duplicates == "error":
        once = a.groupBy("i", "j").agg(
            F.count(F.lit(1)).alias("_n"), F.sum("value").alias("value")
        )
        return once.select(
            "i",
            "j",
            F.when(F.col("_n") == 1, F.col("value"))
            .otherwise(F.raise_error(F.lit("duplicate cell")).cast("double"))
            .alias("value"),
        )
    raise ValueError("duplicates is 'distinct', 'sum' or 'error'")


def to_blocks(a: DataFrame, rows: int = 1024, cols: int = 1024) -> DataFrame:
    """Cells with block coordinates and the place inside the block."""
    return canonical(a).select(
        F.floor(F.col("i") / rows).cast("long").alias("block_row"),
        F.floor(F.col("j") / cols).cast("long").alias("block_col"),
        F.pmod("i", F.lit(rows)).cast("int").alias("row"),
        F.pmod("j", F.lit(cols)).cast("int").alias("col"),
        "value",
    )


def from_blocks(blocks: DataFrame, rows: int = 1024, cols: int = 1024) -> DataFrame:
    return blocks.select(
        (F.col("block_row") * rows + F.col("row")).alias("i"),
        (F.col("block_col") * cols + F.col("col")).alias("j"),
        "value",
    ).where(F.col("value") != 0)


def to_row_segments(a: DataFrame, width: int = 1024) -> DataFrame:
    """Sparse row vectors cut every ``width`` columns.

    ``(i, segment, cols, vals)``: a row of any length becomes arrays of at
    most ``width`` entries, so no group outgrows a task.  A cell given twice
    raises.
    """
    segment = F.floor(F.col("j") / width).cast("long")
    packed = a.groupBy("i", segment.alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("j", "value"))).alias("_c")
    )
    unique = F.size(F.array_distinct(F.col("_c.j"))) == F.size("_c")
    checked = F.when(unique, F.col("_c")).otherwise(
        F.raise_error(F.lit("a column index occurs twice in a row"))
    )
    return packed.select("i", "segment", checked.alias("_c")).select(
        "i", "segment", F.col("_c.j").alias("cols"), F.col("_c.value").alias("vals")
    )


def from_row_segments(rows: DataFrame) -> DataFrame:
    """Back to cells; stored zeros are dropped."""
    return (
        rows.select("i", F.inline(F.arrays_zip("cols", "vals")))
        .select("i", F.col("cols").alias("j"), F.col("vals").alias("value"))
        .where(F.col("value") != 0)
    )


def from_vectors(rows: DataFrame, index: str, vector: str) -> DataFrame:
    """Indexed dense rows to cells; zeros are dropped."""
    return (
        rows.select(F.col(index).alias("i"), F.posexplode(vector).alias("j", "value"))
        .select("i", F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value"))
        .where(F.col("value") != 0)
    )


def gramian(a: DataFrame, cell: int | None = HOT_CELL) -> DataFrame:
    """``A^T A`` of a sparse table."""
    return self_product(transpose(a), cell)


def column_similarity(a: DataFrame, cell: int | None = HOT_CELL) -> DataFrame:
    """Cosine of every pair of columns that share a row, ``i < j``."""
    return _pair_similarity(_unit_columns(a), cell)


def _unit_columns(a: DataFrame) -> DataFrame:
    norms = a.groupBy("j").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n"))
    return (
        a.join(norms, "j")
        .where(F.col("_n") > 0)
        .select("i", "j", (F.col("value") / F.col("_n")).alias("value"), "_n")
    )


def _pair_similarity(unit: DataFrame, cell: int | None) -> DataFrame:
    unit = materialize(unit, "unit-columns")
    left = unit.select(F.col("j").alias("_p"), F.col("i").alias("_k"), F.col("value").alias("_x"))
    right = unit.select(F.col("j").alias("_q"), F.col("i").alias("_k"), F.col("value").alias("_y"))
    return (
        hot_key_join(left, right, "_k", cell, "merge")
        .where(F.col("_p") < F.col("_q"))
        .groupBy(F.col("_p").alias("i"), F.col("_q").alias("j"))
        .agg(F.sum(F.col("_x") * F.col("_y")).alias("value"))
    )


def sampled_column_similarity(
    a: DataFrame, threshold: float, num_cols: int, seed: int = 42, cell: int | None = HOT_CELL
) -> DataFrame:
    """Cosine estimates from cells kept with probability ``min(1, s / norm)``.

    ``s = sqrt(10 ln(n) / threshold)``; a kept cell weighs
    ``value / min(s, norm)``.  The choice is a hash of the cell, so a retried
    task keeps the same cells.  ``threshold`` 0 is exact.
    """
    import math

    if threshold < 0:
        raise ValueError("threshold must not be negative")
    if threshold == 0:
        return column_similarity(a, cell)
    bound = math.sqrt(10 * math.log(num_cols) / threshold)
    with_norm = _unit_columns(a).withColumn("value", F.col("value") * F.col("_n"))
    draw = F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    kept = with_norm.where(draw < bound / F.col("_n"))
    scaled = kept.withColumn("value", F.col("value") / F.least(F.lit(bound), F.col("_n")))
    return _pair_similarity(scaled, cell)


def preview(a: DataFrame, rows: int = 20, cols: int = 20, most_cells: int = 10_000) -> DataFrame:
    """The top-left corner as a wide table, zeros filled in.

    A corner of more than ``most_cells`` is an error; ids must be 0-based.
    """
    if rows * cols > most_cells:
        raise ValueError(f"a preview holds at most {most_cells} cells")
    corner = a.where((F.col("i") < rows) & (F.col("j") < cols))
    wide = corner.groupBy("i").pivot("j", list(range(cols))).agg(F.sum("value"))
    return wide.select("i", *[F.coalesce(F.col(str(c)), F.lit(0.0)).alias(f"c{c}") for c in range(cols)])
