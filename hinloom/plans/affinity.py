"""Clustering of an undirected similarity graph by power iteration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.operators import matrix
from hinloom.runtime import discard, materialize, spread


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Cells of the similarity matrix from one row per undirected edge.

    Self loops are dropped; a negative similarity raises.
    """
    checked = edges.where(F.col("src") != F.col("dst")).select(
        "src",
        "dst",
        F.when(F.col("weight") >= 0, F.col("weight"))
        .otherwise(F.raise_error(F.lit("a similarity is negative")).cast("double"))
        .alias("value"),
    )
    both = F.array(
        F.struct(F.col("src").alias("i"), F.col("dst").alias("j")),
        F.struct(F.col("dst").alias("i"), F.col("src").alias("j")),
    )
    return checked.select(F.inline(both), "value")


def row_normalize(a: DataFrame) -> DataFrame:
    degree = a.groupBy("i").agg(F.sum("value").alias("_d"))
    return (
        a.join(degree, "i")
        .where(F.col("_d") > 0)
        .select("i", "j", (F.col("value") / F.col("_d")).alias("value"))
    )


def degree_vector(a: DataFrame) -> DataFrame:
    """Start vector proportional to the degrees, L1 norm 1."""
    degree = a.groupBy("i").agg(F.sum("value").alias("value"))
    return _unit_l1(degree)


def random_vector(a: DataFrame, seed: int = 42) -> DataFrame:
    """Start vector from a hash of the vertex id, L1 norm 1."""
    draw = F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return _unit_l1(a.select("i").distinct().withColumn("value", draw + 2.0 ** -31))


def _unit_l1(v: DataFrame) -> DataFrame:
    # One row.
    total = v.agg(F.sum(F.abs("value")).alias("_t")).first()["_t"]
    return v.withColumn("value", F.col("value") / F.lit(total))


def power_step(normalized: DataFrame, v: DataFrame) -> DataFrame:
    """``W v`` scaled to L1 norm 1."""
    return _unit_l1(matrix.matvec(normalized, v))


# Edges of one block of `power_iterate`.
BLOCK_EDGES = 1_000_000

_BLOCK = "bs int, bd int, src_ids binary, dst_ids binary, s binary, d binary, w binary, src_sums binary, dst_sums binary"
_STATE = "bucket int, ids binary, degree binary, old binary, u binary, n long, norm double"


def _packed(edges: DataFrame, buckets: int) -> DataFrame:
    """One row per pair of buckets of vertices: its edges as places in the lists of their ends, and the ends' sums."""

    def pack(table: pa.Table) -> pa.Table:
        src, dst, w = (table.column(c).to_numpy() for c in ("src", "dst", "weight"))
        if not (w >= 0).all():
            raise ValueError("a similarity is negative")
        src, dst, w = (a[table.column("src").to_numpy() != table.column("dst").to_numpy()] for a in (src, dst, w))
        (src_ids, s), (dst_ids, d) = (np.unique(a, return_inverse=True) for a in (src, dst))
        columns = [src_ids, dst_ids, s.astype(np.int32), d.astype(np.int32), w]
        columns += [np.bincount(at, w, len(ids)) for at, ids in ((s, src_ids), (d, dst_ids))]
        keys = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("bs", "bd")]
        names = ["bs", "bd", "src_ids", "dst_ids", "s", "d", "w", "src_sums", "dst_sums"]
        return pa.table([*keys, *(pa.array([a.tobytes()], pa.binary()) for a in columns)], names=names)

    def bucket(end: str) -> Column:
        return F.pmod(F.xxhash64(F.col(end).cast("long")), F.lit(buckets)).cast("int")

    ends = [F.col(end).cast("long").alias(end) for end in ("src", "dst")]
    rows = edges.select(*ends, F.col("weight").cast("double").alias("weight"), bucket("src").alias("bs"), bucket("dst").alias("bd"))
    return rows.repartition(2 * buckets**2, "bs", "bd").groupBy("bs", "bd").applyInArrow(pack, _BLOCK)


def _arrays(table: pa.Table, row: int, **kinds: type) -> list[np.ndarray]:
    return [np.frombuffer(table.column(c)[row].as_py(), kind) for c, kind in kinds.items()]


def _first_state(blocks: DataFrame) -> DataFrame:
    """A row per bucket: its vertices in order, and their degrees as the vector that is not yet scaled."""

    def join(table: pa.Table) -> pa.Table:
        found = [_arrays(table, r, ids=np.int64, sums=np.float64) for r in range(len(table))]
        ids, at = np.unique(np.concatenate([i for i, _ in found]), return_inverse=True)
        degree = np.bincount(at, np.concatenate([v for _, v in found]), len(ids))
        return _state(table.column("bucket")[0].as_py(), ids, degree, np.zeros(len(ids)), degree)

    def side(key: str, end: str) -> Column:
        return F.struct(F.col(key).alias("bucket"), F.col(f"{end}_ids").alias("ids"), F.col(f"{end}_sums").alias("sums"))

    sides = blocks.select(F.inline(F.array(side("bs", "src"), side("bd", "dst"))))
    return sides.groupBy("bucket").applyInArrow(join, _STATE)


def _state(bucket: int, ids: np.ndarray, degree: np.ndarray, old: np.ndarray, u: np.ndarray) -> pa.Table:
    held = {c: pa.array([a.tobytes()], pa.binary()) for c, a in (("ids", ids), ("degree", degree), ("old", old), ("u", u))}
    ends = {"n": pa.array([len(ids)], pa.int64()), "norm": pa.array([float(np.abs(u).sum())])}
    return pa.table({"bucket": pa.array([bucket], pa.int32()), **held, **ends})


def _multiplied(blocks: DataFrame, state: DataFrame, scale: float, buckets: int) -> DataFrame:
    """The next state: ``D^-1 W v`` for ``v`` the vector of ``state`` over ``scale``."""

    def meet(block: pa.Table, ends: pa.Table) -> pa.Table:
        rows = []
        if len(block):
            held = {ends.column("side")[r].as_py(): _arrays(ends, r, ids=np.int64, u=np.float64) for r in range(len(ends))}
            src_ids, dst_ids, s, d, w = _arrays(block, 0, src_ids=np.int64, dst_ids=np.int64, s=np.int32, d=np.int32, w=np.float64)
            at = [np.searchsorted(held[side][0], ids) for side, ids in ((0, src_ids), (1, dst_ids))]
            x, y = (held[side][1][at[side]] / scale for side in (0, 1))
            sums = [np.bincount(s, w * y[d], len(src_ids)), np.bincount(d, w * x[s], len(dst_ids))]
            rows = [(block.column(k)[0].as_py(), at[side].tobytes(), sums[side].tobytes()) for side, k in enumerate(("bs", "bd"))]
        return pa.table({c: pa.array([r[n] for r in rows], kind) for n, (c, kind) in enumerate(sent)})

    sent = (("bucket", pa.int32()), ("at", pa.binary()), ("sums", pa.binary()))

    def add(state: pa.Table, found: pa.Table) -> pa.Table:
        ids, degree, u = _arrays(state, 0, ids=np.int64, degree=np.float64, u=np.float64)
        total = np.zeros(len(ids))
        for r in range(len(found)):
            at, sums = _arrays(found, r, at=np.int64, sums=np.float64)
            total[at] += sums
        return _state(state.column("bucket")[0].as_py(), ids, degree, u / scale, total / np.maximum(degree, np.finfo(float).eps))

    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    to_src = state.select(F.col("bucket").alias("bs"), every.alias("bd"), F.lit(0).alias("side"), "ids", "u")
    to_dst = state.select(every.alias("bs"), F.col("bucket").alias("bd"), F.lit(1).alias("side"), "ids", "u")
    tasks, key = 2 * buckets**2, ["bs", "bd"]
    there = blocks.drop("src_sums", "dst_sums").repartition(tasks, *key).groupBy(*key)
    ends = to_src.unionByName(to_dst).repartition(tasks, *key).groupBy(*key)
    found = there.cogroup(ends).applyInArrow(meet, "bucket int, at binary, sums binary")
    return state.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(add, _STATE)


def power_iterate(edges: DataFrame, iterations: int) -> DataFrame:
    """``(id, value)`` after at most so many steps ``v <- D^-1 W v`` of L1 norm 1, from a vector like the degrees.

    Steps end as Spark's do, where the change of the change is within its tolerance.  Edges lie in blocks of pairs of
    buckets of vertices, of about `BLOCK_EDGES`; a step sends each bucket of the vector to the blocks with its
    vertices, and a packed row of sums comes back from each.
    """
    buckets = max(1, math.ceil(math.sqrt(edges.count() / BLOCK_EDGES)))
    blocks = materialize(_packed(edges, buckets), "edge-blocks")
    state = materialize(_first_state(blocks), "power-state")
    count, scale = state.agg(F.sum("n"), F.sum("norm")).first()
    tolerance = max(1e-5 / max(count or 0, 1), 1e-8)
    before, change = float("inf"), float("inf")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            both = [_arrays(table, r, old=np.float64, u=np.float64) for r in range(len(table))]
            yield pa.RecordBatch.from_pydict({"delta": [float(np.abs(u / scale - old).sum()) for old, u in both]})

    for _ in range(iterations):
        if not abs(change) > tolerance or not count:
            break
        after = materialize(_multiplied(blocks, state, scale, buckets), "power-state")
        discard(state)
        state, scale = after, after.agg(F.sum("norm")).first()[0]
        delta = state.select("old", "u").mapInArrow(moved, "delta double").agg(F.sum("delta")).first()[0]
        before, change = delta, abs(delta - before)
    discard(blocks)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for r in range(len(table)):
                ids, u = _arrays(table, r, ids=np.int64, u=np.float64)
                for start in range(0, len(ids), 65536):
                    part = slice(start, start + 65536)
                    yield pa.RecordBatch.from_pydict({"id": ids[part], "value": u[part] / scale})

    return state.select("ids", "u").mapInArrow(listed, "id long, value double")


def cluster(edges: DataFrame, k: int, iterations: int = 20, init: str = "random") -> DataFrame:
    """``(id, cluster)`` for edges ``(src, dst, weight)``.

    From ``degree`` the steps of `power_iterate` are followed by Spark's k-means, as in Spark's own power iteration.
    ``random`` draws its start by task and stays with that one.  For it the edges are written once and lie by their
    source, in tasks of a bounded number: in every iteration a vertex is sent to each task that has an edge of it,
    which for a source is then one, however many tasks there are.
    """
    from pyspark.ml.clustering import KMeans, PowerIterationClustering

    written = materialize(edges.select("src", "dst", "weight"), "similarities")
    if init == "degree":
        places = materialize(power_iterate(written, iterations), "places")
        points = places.select("id", array_to_vector(F.array("value")).alias("features"))
        model = KMeans(k=k, seed=0, predictionCol="cluster").fit(points)
        return model.transform(points).select("id", "cluster")
    worker = PowerIterationClustering(
        k=k, maxIter=iterations, initMode=init, srcCol="src", dstCol="dst", weightCol="weight"
    )
    return worker.assignClusters(spread(written, ["src"]))
