"""Hard negatives: rows of other labels that score almost as high as an anchor's own positives.

Scores are integer inner products of quantised vectors.  A stated set of anchors is met with all rows, block by
block: anchors go in rounds whose size is bounded by bytes, and in a round every task multiplies its tiles of rows
with the round's tiles of anchors by Strassen's recursion on 64-bit integers.  What a task keeps is one heap per
anchor (its best positives), or per anchor and positive (the best negatives of its window); heaps of the same size
merge to a heap of that size, so nothing but heaps is shuffled.  Two passes: the windows depend on the positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.operators.ordering import top_k_per_key
from hinloom.runtime import materialize, new_path, ordered_ids

# Fixed steps per unit of a component.
STEPS = 256

# Bytes of the anchors that go through the driver in one round, and rows of a tile of anchors and of candidates.
ROUND_BYTES = 16 << 20
ANCHOR_TILE = 512
TILE = 4096

# Strassen's recursion ends where a side is no longer than this.
LEAF = 16

_HEAPS = "anchor long, slot int, score long, id long"


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b.T`` of 64-bit integers by Strassen's seven products; sides of odd length get a line of zeros.

    Sums and products are exact modulo 2**64, so the result is exact wherever it fits 64 bits itself.
    """
    (m, k), n = a.shape, len(b)
    if min(m, k, n) <= leaf:
        return a @ b.T
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if n % 2 or k % 2:
        b = np.pad(b, ((0, n % 2), (0, k % 2)))
    h, i, j = len(a) // 2, a.shape[1] // 2, len(b) // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    # The quarters of b transposed.
    b11, b21, b12, b22 = b[:j, :i], b[:j, i:], b[j:, :i], b[j:, i:]
    p1 = product(a11 + a22, b11 + b22, leaf)
    p2 = product(a21 + a22, b11, leaf)
    p3 = product(a11, b12 - b22, leaf)
    p4 = product(a22, b21 - b11, leaf)
    p5 = product(a11 + a12, b22, leaf)
    p6 = product(a21 - a11, b11 + b12, leaf)
    p7 = product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The ``size`` best (score, id) of each slot, as arrays ordered by slot, score from above, id.

    An id with the same score counts once in a slot.
    """

    def __init__(self, size: int):
        self.size = size
        self.slot = self.score = self.id = np.empty(0, np.int64)

    def merge(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        slot, score, id_ = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        new = np.ones(len(slot), bool)
        new[1:] = (np.diff(slot) != 0) | (np.diff(score) != 0) | (np.diff(id_) != 0)
        slot, score, id_ = slot[new], score[new], id_[new]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = place < self.size
        self.slot, self.score, self.id = slot[best], score[best], id_[best]


def _best(scores: np.ndarray, mask: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a matrix that may be among the ``size`` best of their row: ties of the last one are all there."""
    if scores.shape[1] > size:
        masked = np.where(mask, scores, np.iinfo(np.int64).min)
        last = np.partition(masked, -size, axis=1)[:, -size]
        mask = mask & (scores >= last[:, None])
    return np.nonzero(mask)


def _cells(vectors: pa.Array, dim: int) -> np.ndarray:
    """Quantised rows of equal length: a shorter vector is filled up with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(vectors.offsets.to_numpy())
    scaled = np.floor(STEPS * flat)
    # Window bounds multiply scores by 100.
    if len(scaled) and np.abs(scaled).max() > np.sqrt(2.0**62 / 100 / max(dim, 1)):
        raise ValueError("a component is so large that scores would leave 64 bits")
    cells = np.zeros((len(lengths), dim), np.int64)
    cells[np.arange(dim) < lengths[:, None]] = scaled.astype(np.int64)
    return cells


def _tiles(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and cells of up to `TILE` rows; a row repeated inside a tile is there once."""
    for batch in batches:
        for start in range(0, batch.num_rows, TILE):
            tile = batch.slice(start, TILE)
            ids, labels = (tile.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
            cells = _cells(pa.concat_arrays([tile.column("vector")]), dim)
            order = np.lexsort((labels, ids))
            ids, labels, cells = ids[order], labels[order], cells[order]
            new = np.ones(len(ids), bool)
            new[1:] = (np.diff(ids) != 0) | (np.diff(labels) != 0) | (np.diff(cells, axis=0) != 0).any(1)
            yield ids[new], labels[new], cells[new]


def _usable() -> Column:
    numbers = F.col("vector").cast("array<double>")
    finite = ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))


def _heap_rows(heaps: Heaps, anchors: np.ndarray, slots: int) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(anchors[heaps.slot // slots], pa.int64()),
            pa.array(heaps.slot % slots, pa.int32()),
            pa.array(heaps.score, pa.int64()),
            pa.array(heaps.id, pa.int64()),
        ],
        names=["anchor", "slot", "score", "id"],
    )


def _positive_heaps(rows: DataFrame, anchors: tuple, dim: int, size: int) -> DataFrame:
    """Best rows of the anchor's label, per task."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels, a_cells = sent.value
        heaps = Heaps(size)
        for ids, labels, cells in _tiles(batches, dim):
            for label in np.unique(labels):  # rows of other labels need no product here
                mine, theirs = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
                for start in range(0, len(mine), ANCHOR_TILE):
                    some = mine[start : start + ANCHOR_TILE]
                    scores = product(a_cells[some], cells[theirs])
                    at, to = _best(scores, a_ids[some, None] != ids[theirs], size)
                    heaps.merge(some[at], scores[at, to], ids[theirs[to]])
        yield from _heap_rows(heaps, a_ids, 1)

    return rows.mapInArrow(run, _HEAPS)


def _window_heaps(rows: DataFrame, anchors: tuple, limits: np.ndarray, dim: int, size: int, low: int, high: int) -> DataFrame:
    """Best rows of other labels in each window, per task; ``limits`` holds an anchor's positive scores, best first.

    Scores below ``least`` mark places without a positive.
    """
    slots = limits.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast((*anchors, limits))
    none = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels, a_cells, scores_of = sent.value
        heaps = Heaps(size)
        for ids, labels, cells in _tiles(batches, dim):
            for start in range(0, len(a_ids), ANCHOR_TILE):
                some = np.arange(start, min(start + ANCHOR_TILE, len(a_ids)))
                other = a_labels[some, None] != labels
                if not other.any():
                    continue
                scores = product(a_cells[some], cells)
                for slot in range(slots):
                    limit = scores_of[some, slot]
                    there = limit != none
                    limit = np.where(there, limit, 0)[:, None]
                    window = other & there[:, None] & (100 * scores >= low * limit) & (100 * scores <= high * limit)
                    if window.any():
                        at, to = _best(scores, window, size)
                        heaps.merge(some[at] * slots + slot, scores[at, to], ids[to])
        yield from _heap_rows(heaps, a_ids, slots)

    return rows.mapInArrow(run, _HEAPS)


def _merged(heaps: DataFrame, size: int) -> DataFrame:
    """The heaps of all tasks merged; each task has at most ``size`` rows of a slot, and Spark trims before it shuffles."""
    return top_k_per_key(heaps.distinct(), ["anchor", "slot"], [F.desc("score"), F.asc("id")], size)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels in a score window.

    ``rows`` has ``id, label, vector``; components become ``floor(256 * x)`` and a score is the inner product with
    the anchor.  The window of a positive reaches from ``low`` to ``high`` percent of its score, so a positive with
    a score below 0 has none.  Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score; higher scores first, ties by smaller id.

    Rows with a null id, label or vector or a null or not finite component take no part; an empty or shorter vector
    counts as filled up with zeros; an anchor is no positive of its own id; an id with the same score counts once,
    so repeated rows change nothing; of different rows with an anchor's id the one with the smallest label and vector is the anchor;
    other columns are ignored; an empty table gives no rows.  A component so large that scores would leave 64 bits
    is an error (above 3e7 in vectors of 64).
    """
    good = rows.select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", is_anchor.alias("anchor")
    ).where(_usable())
    good = good.withColumn("vector", F.col("vector").cast("array<double>"))
    dim = good.agg(F.max(F.size("vector"))).first()[0] or 0
    anchors = good.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    anchors = materialize(ordered_ids(anchors.select("id", "row.*"), ["id"], "place"), "anchors")
    count = anchors.count()
    step = max(1, round_bytes // (8 * max(dim, 1)))
    candidates = good.select("id", "label", "vector")
    path = new_path(rows.sparkSession, "negatives")
    none = np.iinfo(np.int64).min
    for first in range(0, max(count, 1), step):
        # No more than `step` rows.
        part = anchors.where((F.col("place") >= first) & (F.col("place") < first + step)).orderBy("id").toArrow()
        ids, labels = (part.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        own = (ids, labels, _cells(pa.concat_arrays(part.column("vector").chunks), dim) if len(ids) else np.zeros((0, dim), np.int64))
        best = materialize(_merged(_positive_heaps(candidates, own, dim, positives), positives), "positives")
        known = best.select("anchor", "rank", "score").toArrow()  # `positives` numbers per anchor of the round
        limits = np.full((len(ids), positives), none, np.int64)
        at = np.searchsorted(ids, known.column("anchor").to_numpy())
        limits[at, known.column("rank").to_numpy() - 1] = known.column("score").to_numpy()
        found = _merged(_window_heaps(candidates, own, limits, dim, negatives, low, high), negatives)
        named = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found.join(named, ["anchor", "slot"]).select(
            F.col("anchor").alias("anchor_id"),
            "positive_id",
            "rank",
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)
