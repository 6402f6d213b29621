"""Near-duplicate vectors by an epsilon grid order join.

1. Equal vectors become one *class* with a count.  Unit vectors at a cosine of at least c lie within epsilon =
   sqrt(2 - 2c) of each other, and their projections on any directions as well.
2. Classes are sorted by their grid cells of width epsilon on the leading principal dimensions.  A place in that
   sequence is the class's number from here on, so an interval of the sequence is a range of numbers.
3. The sequence is cut into blocks, and intervals of 16 blocks, 256 blocks and so on.  Each has a bounding box in the
   rotated space.  The join of the sequence with itself descends from the whole one: a pair of intervals whose
   boxes are further apart than epsilon is skipped; a pair whose boxes lie within epsilon as a whole is linked
   without looking at its members; any other pair is taken apart.
4. Blocks that are left are multiplied in tasks that hold two tiles of 16 blocks or more, in rounds.  A task returns one row per linked
   class, its count of links and a class it can be reached from, never the pairs.

So a large group of near copies costs as many rows as it has members, and where it is narrow it is not multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.llm.ann import usable
from hinloom.llm.near_dedup import components
from hinloom.runtime import broadcast_if_small, discard, materialize, ordered_ids

COSINE = 0.9

# Leading principal dimensions that make up the grid.
GRID_DIMS = 8

# Classes of a block, blocks of a tile (and intervals of the next level).
BLOCK = 256
FAN = 16

# Bytes of a tile, where there are so many tiles at least, and the least that moves in one round.
TILE_BYTES = 8 << 20
LEAST_TILES = 16
ROUND_BYTES = 128 << 20

# Distances of unit vectors are known up to this; squares, as everywhere here.
SLACK = 1e-9

# Partial sums of the second moments that reach the driver.
MOMENT_PARTS = 32

_FOUND = "node long, links long, other long"


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows scaled to length 1, shorter ones filled up with zeros; scaled first, so that no square overflows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.zeros((len(vectors), dim))
    rows[np.arange(dim) < np.diff(vectors.offsets.to_numpy())[:, None]] = flat
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal axes as columns, by falling second moment of the unit vectors.

    One partial sum per task, added in `MOMENT_PARTS` tasks, so some matrices of ``dim`` squared reach the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            unit = _units(pa.concat_arrays([batch.column(0)]), dim)
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in table.column("sums"))
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    sums = vectors.select("vector").mapInArrow(partial, "sums binary")
    part = F.pmod(F.monotonically_increasing_id(), F.lit(MOMENT_PARTS))
    parts = sums.select("sums", part.alias("part")).groupBy("part").applyInArrow(add, "sums binary").collect()
    total = sum((np.frombuffer(r["sums"]) for r in parts), np.zeros(dim * dim)).reshape(dim, dim)
    return np.linalg.eigh(total)[1][:, ::-1]


def sequence(classes: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """Add ``place``, the number of a class in grid order; ``classes`` has ``key, vector``."""
    dim = len(axes)
    lead = axes[:, :GRID_DIMS]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor(_units(pa.concat_arrays([batch.column("vector")]), dim) @ lead / epsilon)
            flat = pa.array(at.astype(np.int32).ravel(), pa.int32())
            ends = np.arange(0, len(flat) + 1, lead.shape[1], dtype=np.int32) if len(at) else np.zeros(1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*batch.schema.names, "cells"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    placed = classes.mapInArrow(cells, f"{fields}, cells array<int>")
    return ordered_ids(placed, ["cells", "low", "high"], "place").drop("cells")


def _box(low: np.ndarray, high: np.ndarray) -> list[dict]:
    return [{"low": float(a), "high": float(b)} for a, b in zip(low, high, strict=True)]


def blocks(placed: DataFrame, axes: np.ndarray, block: int = BLOCK) -> DataFrame:
    """One row per block: its unit vectors, the sizes of its classes, and its box in the rotated space."""
    dim = len(axes)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        unit = _units(pa.concat_arrays(table.column("vector").chunks), dim)
        turned = unit @ axes
        sizes = table.column("n").to_numpy()
        return pa.table(
            {
                "interval": pa.array([table.column("place")[0].as_py() // block], pa.int64()),
                "weight": pa.array([int(sizes.sum())], pa.int64()),
                "sizes": pa.array([sizes.astype("<i8").tobytes()], pa.binary()),
                "units": pa.array([unit.astype("<f8").tobytes()], pa.binary()),
                "box": pa.array([_box(turned.min(0), turned.max(0))], _BOX),
            }
        )

    schema = "interval long, weight long, sizes binary, units binary, box array<struct<low:double,high:double>>"
    rows = placed.select("place", "n", "vector", F.floor(F.col("place") / block).alias("block"))
    return rows.groupBy("block").applyInArrow(pack, schema)


_BOX = pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64())]))


def _wider(intervals: DataFrame, fan: int) -> DataFrame:
    """Intervals of the next level: the boxes of ``fan`` neighbours as one."""

    def join(table: pa.Table) -> pa.Table:
        boxes = np.array([[(s["low"], s["high"]) for s in box] for box in table.column("box").to_pylist()])
        return pa.table(
            {
                "interval": pa.array([table.column("interval")[0].as_py() // fan], pa.int64()),
                "weight": pa.array([sum(table.column("weight").to_pylist())], pa.int64()),
                "box": pa.array([_box(boxes[:, :, 0].min(0), boxes[:, :, 1].max(0))], _BOX),
            }
        )

    schema = "interval long, weight long, box array<struct<low:double,high:double>>"
    up = intervals.select("interval", "weight", "box", F.floor(F.col("interval") / fan).alias("up"))
    return up.groupBy("up").applyInArrow(join, schema)


def _squares(gap) -> Column:
    parts = F.zip_with("box_a", "box_b", gap)
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x * x)


def _judged(pairs: DataFrame, intervals: DataFrame, epsilon: float) -> DataFrame:
    """``a, b, whole`` for the pairs that are not provably distant; ``whole`` where they are provably near."""
    a = intervals.select(F.col("interval").alias("a"), F.col("box").alias("box_a"))
    b = intervals.select(F.col("interval").alias("b"), F.col("box").alias("box_b"))
    zero = F.lit(0.0)
    least = _squares(lambda x, y: F.greatest(zero, y["low"] - x["high"], x["low"] - y["high"]))
    most = _squares(lambda x, y: F.greatest(y["high"] - x["low"], x["high"] - y["low"]))
    near = pairs.join(a, "a").join(b, "b").select("a", "b", least.alias("least"), most.alias("most"))
    square = epsilon * epsilon
    return near.where(F.col("least") <= square + SLACK).select("a", "b", (F.col("most") < square - SLACK).alias("whole"))


def _parts(pairs: DataFrame, fan: int) -> DataFrame:
    """The pairs of parts of pairs of intervals; the parts of an interval with itself once."""

    def inside(column: str) -> Column:
        first = F.col(column) * fan
        return F.explode(F.sequence(first, first + fan - 1))

    parts = pairs.select(inside("a").alias("part_a"), "b").select("part_a", inside("b").alias("part_b"))
    return parts.where("part_a <= part_b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))


def descend(levels: list[DataFrame], epsilon: float, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """Pairs that are near as a whole, by level (the last one first), and the pairs of blocks to look at."""
    spark = levels[0].sparkSession
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    whole: list[DataFrame] = []
    for depth in range(len(levels) - 1, -1, -1):
        # Parts beyond the end of the sequence have no box and fall out.
        judged = materialize(_judged(pairs, levels[depth], epsilon), "interval-pairs")
        whole.append(judged.where("whole").select("a", "b"))
        pairs = judged.where("not whole").select("a", "b")
        if depth:
            pairs = _parts(pairs, fan)
    return whole, pairs


def labels_of(count: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least number in the component of each of ``count`` numbers under links x-y."""
    label = np.arange(count)
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_KEPT_LINKS = 1 << 20


def _tile_links(
    blocks: list[dict], pairs: list[tuple[int, int]], dim: int, cosine: float, block: int
) -> dict[str, np.ndarray]:
    """Links between the blocks of two tiles: a row per linked class."""
    held = {r["interval"]: r for r in blocks}
    names = sorted(held)
    sizes = {i: np.frombuffer(held[i]["sizes"], "<i8") for i in names}
    units = {i: np.frombuffer(held[i]["units"], "<f8").reshape(-1, dim) for i in names}
    first = dict(zip(names, np.cumsum([0, *(len(sizes[i]) for i in names)])[:-1].tolist(), strict=True))
    total = sum(len(s) for s in sizes.values())
    links = np.zeros(total, np.int64)
    x, y, kept = [], [], 0
    for a, b in pairs:
        linked = units[a] @ units[b].T >= cosine
        if a == b:
            np.fill_diagonal(linked, True)
        at, to = np.nonzero(linked)
        if not len(at):
            continue
        links[first[a] : first[a] + len(sizes[a])] += (linked.astype(np.float64) @ sizes[b]).astype(np.int64)
        if a != b:
            links[first[b] : first[b] + len(sizes[b])] += (sizes[a] @ linked.astype(np.float64)).astype(np.int64)
        x.append(at + first[a])
        y.append(to + first[b])
        kept += len(at)
        if kept > _KEPT_LINKS:
            label = labels_of(total, np.concatenate(x), np.concatenate(y))
            x, y, kept = [np.flatnonzero(label != np.arange(total))], [label[label != np.arange(total)]], 0
    label = labels_of(total, np.concatenate(x), np.concatenate(y)) if x else np.arange(total)
    node = np.concatenate([i * block + np.arange(len(sizes[i])) for i in names])
    some = links > 0
    return {"node": node[some], "links": links[some], "other": node[label[some]]}


def _block_links(packed: DataFrame, pairs: DataFrame, dim: int, cosine: float, block: int, fan: int) -> DataFrame:
    """``node, links, other`` from the pairs of blocks, with all blocks of a pair of tiles in one task.

    A tile grows with the number of blocks up to `TILE_BYTES`, as a block moves once per pair of tiles that asks for it.
    Pairs of tiles meet in rounds, which move about as much as there is, and leave nothing but links.
    """
    block_bytes, count = 8 * block * dim, packed.count()
    span = fan * max(1, min(count // (fan * LEAST_TILES), TILE_BYTES // (fan * block_bytes)))

    def tile(column: str) -> Column:
        return F.floor(F.col(column) / span)

    key = ["tile_a", "tile_b"]
    pairs = pairs.select("a", "b", tile("a").alias("tile_a"), tile("b").alias("tile_b"))
    listed = pairs.groupBy(*key).agg(F.collect_list(F.struct("a", "b")).alias("pairs"))  # the square of `span` at most
    grouped = materialize(listed.withColumn("asked", F.array_union("pairs.a", "pairs.b")), "tile-pairs")
    number, asked = grouped.agg(F.count(F.lit(1)), F.sum(F.size("asked"))).first()
    rounds = max(1, -(-(asked or 0) * block_bytes // max(ROUND_BYTES, count * block_bytes)))
    tasks = max(1, 2 * number // rounds)

    def meet(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = wanted.column("pairs").to_pylist()
        return pa.table(_tile_links(blocks.to_pylist(), [(p["a"], p["b"]) for p in rows[0]] if rows else [], dim, cosine, block))

    found = None
    for turn in range(rounds):
        mine = grouped.where(F.pmod(F.xxhash64(*key), F.lit(rounds)) == turn)
        asking = mine.select(F.col("tile_a").alias("to_a"), F.col("tile_b").alias("to_b"), F.explode("asked").alias("interval"))
        blocks = packed.select("interval", "sizes", "units").join(asking, "interval").repartition(tasks, "to_a", "to_b")
        met = blocks.groupBy("to_a", "to_b").cogroup(mine.select(*key, "pairs").repartition(tasks, *key).groupBy(*key))
        links = materialize(met.applyInArrow(meet, _FOUND), "block-links")
        found = links if found is None else found.union(links)
    return found


def _whole_links(placed: DataFrame, intervals: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``node, links, other`` from pairs of intervals that are linked as a whole; ``size`` is that of an interval.

    Each class of an interval has the weight of all its partners; it is tied to the first class of its interval,
    and the first classes to each other.
    """
    both = pairs.union(pairs.where("a != b").select("b", "a"))
    weights = both.join(intervals.select(F.col("interval").alias("b"), "weight"), "b")
    sums = weights.groupBy("a").agg(F.sum("weight").alias("links"))
    mine = F.floor(F.col("place") / size).alias("a")
    nodes = placed.select("place", mine).join(broadcast_if_small(materialize(sums, "whole-sums")), "a")
    tied = nodes.select(F.col("place").alias("node"), "links", (F.col("a") * size).alias("other"))
    ends = pairs.where("a != b").select(
        (F.col("a") * size).alias("node"), F.lit(0).cast("long").alias("links"), (F.col("b") * size).alias("other")
    )
    return tied.union(ends)


def link(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Links, component and kept row of every row (``id, vector``) under pairs at a cosine of at least ``cosine``.

    Returns id, n_links (other rows linked directly), component_id (the smallest id that can be reached, itself
    included), kept (whether that is its own).  Vectors that are null, empty or zero or hold null or not finite
    components link with nothing; a shorter vector counts as filled up with zeros; repeated rows are linked with each other
    and both kept where their id is the smallest; a row without an id is linked as any other, but has no component, names none, and is
    kept; other columns are ignored; an empty table gives no rows.
    """
    epsilon = float(np.sqrt(2 - 2 * cosine))
    numbers = F.col("vector").cast("array<double>")
    all_rows = rows.select(F.col("id").cast("long").alias("id"), numbers.alias("vector")).withColumn("good", usable(F.col("vector")))
    low = F.when(F.col("good"), F.xxhash64("vector"))
    high = F.when(F.col("good"), F.xxhash64(F.lit(1), "vector"))  # 128 bits of the vector in all
    keyed = all_rows.select("id", "good", "vector", low.alias("low"), high.alias("high"))
    alone = F.col("id").alias("component_id")
    good = keyed.where("good")
    classes = materialize(
        good.groupBy("low", "high").agg(
            F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.any_value("vector").alias("vector")
        ),
        "classes",
    )
    dim = classes.agg(F.max(F.size("vector"))).first()[0]
    if dim is None:
        return all_rows.select("id", F.lit(0).cast("long").alias("n_links"), alone, F.lit(True).alias("kept"))
    axes = principal_axes(classes, dim)
    in_order = sequence(classes, axes, epsilon)
    with_vectors = materialize(in_order, "sequence")
    discard(in_order)
    discard(classes)
    packed = materialize(blocks(with_vectors, axes, block), "blocks")
    placed = materialize(with_vectors.drop("vector"), "places")
    discard(with_vectors)
    levels = [packed.drop("sizes", "units")]
    while not levels[-1].where("interval > 0").isEmpty():
        levels.append(materialize(_wider(levels[-1], fan), "intervals"))
    whole, pairs = descend(levels, epsilon, fan)
    found = _block_links(packed, pairs, dim, cosine, block, fan)
    for depth, near in zip(range(len(levels) - 1, -1, -1), whole, strict=True):
        found = found.union(_whole_links(placed, levels[depth], near, block * fan**depth))
    found = materialize(found, "links")
    links = found.groupBy("node").agg((F.sum("links") - 1).alias("n_links"))
    groups = components(found.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = placed.select(F.col("place").alias("node"), "low", "high", "n", "least").join(links, "node").join(groups, "node", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "node")), "components")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    judged = named.where("n_links > 0").join(least, "component").select("low", "high", "n_links", "component_id")
    joined = keyed.select("id", "low", "high").join(
        broadcast_if_small(materialize(judged, "judged")), ["low", "high"], "left"
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    kept = F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True))
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), kept.alias("kept")
    )
