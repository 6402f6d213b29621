"""Approximate nearest neighbours by cosine: one hierarchical small-world graph per shard of the rows.

Each shard is built by one task and holds a bounded number of rows; its graph is kept as flat arrays of neighbour
numbers, one block per layer.  Every block of queries meets every shard, in a group of one index row and a bounded
number of queries, and the best of all shards are merged.  Vectors of one direction are one entry with their
smallest ids.

Inside a task the graph is built layer by layer from the top, in batches that double, and a whole batch of queries
walks the graph in step, so the work is in numpy.  The graph only finds candidates; what is returned is scored in
double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinloom.runtime import materialize

# Rows of a shard, queries of a block, and queries that walk in step.
SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
WALKERS = 1024

# Neighbours per node above the base layer and in it; beams while building and searching.
LINKS = 16
BASE_LINKS = 32
BUILD_BEAM = 80
SEARCH_BEAM = 160

_INDEX = "dim int, shard int, ids binary, members binary, vectors binary, layers binary, graph binary"
_FOUND = "query_id long, score double, ids array<long>"


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has a component above or below 0, and only finite ones."""
    numbers = vector.cast("array<double>")
    finite = ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(finite & F.exists(numbers, lambda x: x != 0), F.lit(False))


# --- the graph of one shard --------------------------------------------------------


def walk(
    unit: np.ndarray, layer: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries in step: node numbers (-1: none) and similarities, best first.

    ``layer`` has the neighbours of each node, -1 where there is none; ``start`` one node per query.
    """
    count = len(queries)
    rows = np.arange(count)[:, None]
    seen = np.zeros((count, len(unit) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    nodes = np.full((count, beam), -1, np.int32)
    near = np.full((count, beam), -np.inf, np.float32)
    done = np.ones((count, beam), bool)
    nodes[:, 0], done[:, 0] = start, False
    near[:, 0] = np.einsum("qd,qd->q", unit[start], queries)
    seen[np.arange(count), start] = True
    alive = np.arange(count)
    while len(alive):
        open_near = np.where(done[alive], -np.inf, near[alive])
        pick = open_near.argmax(1)
        more = open_near[np.arange(len(alive)), pick] > -np.inf
        alive, pick = alive[more], pick[more]
        if not len(alive):
            break
        done[alive, pick] = True
        there = layer[nodes[alive, pick]]
        fresh = ~seen[alive[:, None], there]
        seen[alive[:, None], there] = True
        closeness = np.einsum("qmd,qd->qm", unit[there], queries[alive])
        closeness[~fresh] = -np.inf
        all_nodes = np.concatenate([nodes[alive], np.where(fresh, there, -1)], 1)
        all_near = np.concatenate([near[alive], closeness], 1)
        all_done = np.concatenate([done[alive], ~fresh], 1)
        best = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        nodes[alive] = np.take_along_axis(all_nodes, best, 1)
        near[alive] = np.take_along_axis(all_near, best, 1)
        done[alive] = np.take_along_axis(all_done, best, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return nodes[rows, order], near[rows, order]


def choose(unit: np.ndarray, own: np.ndarray, candidates: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """Pick neighbours from candidates sorted best first: one that no chosen one is nearer to than the node.

    Places left over go to the nearest of the rest.
    """
    count, width = candidates.shape
    vectors = unit[candidates]
    between = np.matmul(vectors, vectors.transpose(0, 2, 1))
    valid = (candidates >= 0) & (candidates != own[:, None]) & np.isfinite(near)
    taken = np.zeros((count, width), bool)
    crowd = np.full((count, width), -np.inf, np.float32)  # similarity to the nearest chosen one
    for c in range(width):
        good = valid[:, c] & (crowd[:, c] < near[:, c]) & (taken.sum(1) < links)
        taken[good, c] = True
        crowd[good] = np.maximum(crowd[good], between[good, c])
    # Chosen ones first, then the rest, each by nearness; then what is no candidate at all.
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :links]
    out = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(candidates, order, 1), -1)
    if width < links:
        out = np.pad(out, ((0, 0), (0, links - width)), constant_values=-1)
    return out.astype(np.int32)


def _distinct(candidates: np.ndarray, near: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort candidates best first and mask repeats."""
    by_node = np.argsort(candidates, axis=1, kind="stable")
    sorted_nodes = np.take_along_axis(candidates, by_node, 1)
    sorted_near = np.take_along_axis(near, by_node, 1).copy()
    repeat = np.zeros_like(sorted_nodes, bool)
    repeat[:, 1:] = sorted_nodes[:, 1:] == sorted_nodes[:, :-1]
    sorted_near[repeat | (sorted_nodes < 0)] = -np.inf
    order = np.argsort(-sorted_near, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(sorted_nodes, order, 1), np.take_along_axis(sorted_near, order, 1)


def _link(unit: np.ndarray, layer: np.ndarray, batch: np.ndarray, links: int) -> None:
    """Add the reverse of the edges of ``batch``; a node with too many is chosen for anew."""
    targets = layer[batch].ravel()
    sources = np.repeat(batch, layer.shape[1])
    sources, targets = sources[targets >= 0], targets[targets >= 0]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    nodes, first, counts = np.unique(targets, return_index=True, return_counts=True)
    for begin in range(0, len(nodes), WALKERS):
        own, at, many = nodes[begin : begin + WALKERS], first[begin : begin + WALKERS], counts[begin : begin + WALKERS]
        widest = int(many.max())
        places = at[:, None] + np.arange(widest)
        incoming = np.where(
            np.arange(widest) < many[:, None], sources[np.minimum(places, len(sources) - 1)], -1
        ).astype(np.int32)
        candidates = np.concatenate([layer[own], incoming], 1)
        near = np.einsum("nmd,nd->nm", unit[candidates], unit[own])
        near[candidates < 0] = -np.inf
        candidates, near = _distinct(candidates, near, 2 * links)
        layer[own] = choose(unit, own, candidates, near, links)


def build(unit: np.ndarray, seed: int = 7) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Layers from the base up: the nodes of each (rows of ``unit``) and their neighbours.

    Rows are drawn to layers by their number, so a retried task builds the same graph.
    """
    count = len(unit)
    height = np.minimum(
        (-np.log(1 - np.random.default_rng(seed).random(count)) / np.log(LINKS)).astype(int), 8
    )
    height[0] = height.max()
    order = np.lexsort((np.arange(count), -height))  # higher nodes first, so a layer is a prefix of the order
    sizes = [int((height >= h).sum()) for h in range(height.max() + 1)]
    ranked = unit[order]
    layers: list[np.ndarray] = [np.empty((0, 0), np.int32)] * len(sizes)
    for h in range(len(sizes) - 1, -1, -1):
        links = BASE_LINKS if h == 0 else LINKS
        size = sizes[h]
        layer = np.full((size, links), -1, np.int32)
        begin = 0
        while begin < size:
            if begin == 0:
                end = min(size, sizes[h + 1] if h + 1 < len(sizes) else 256)
            else:
                end = min(size, begin + min(max(begin, 64), WALKERS))
            batch = np.arange(begin, end)
            queries = ranked[begin:end]
            near = queries @ queries.T  # the batch does not see itself in the graph
            np.fill_diagonal(near, -np.inf)
            width = min(links, len(batch))
            best = np.argpartition(-near, width - 1, axis=1)[:, :width]
            candidates = (best + begin).astype(np.int32)
            near = np.take_along_axis(near, best, 1)
            if begin:
                start = descend(ranked, layers[h + 1 :], queries) if h + 1 < len(sizes) else np.zeros(len(batch), int)
                found, found_near = walk(ranked[:begin], layer[:begin], queries, start, min(BUILD_BEAM, begin))
                candidates = np.concatenate([candidates, found], 1)
                near = np.concatenate([near, found_near], 1)
            candidates, near = _distinct(candidates, near, BUILD_BEAM)
            layer[batch] = choose(ranked, batch, candidates, near, links)
            _link(ranked, layer, batch, links)
            begin = end
        layers[h] = layer
    return layers, [order[:size] for size in sizes]


def descend(ranked: np.ndarray, upper: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The node each query reaches through the layers above, from the topmost down."""
    at = np.zeros(len(queries), int)
    for layer in reversed(upper):
        nodes, _ = walk(ranked[: len(layer)], layer, queries, at, min(4, len(layer)))
        at = nodes[:, 0].astype(int)
    return at


def search(ranked: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """Candidate nodes of each query, -1 where there are fewer than ``beam``."""
    found = []
    for begin in range(0, len(queries), WALKERS):
        part = queries[begin : begin + WALKERS]
        start = descend(ranked, layers[1:], part)
        found.append(walk(ranked, layers[0], part, start, min(beam, len(ranked)))[0])
    return np.concatenate(found)


# --- on Spark ----------------------------------------------------------------------


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; scaled first, so that no square overflows or vanishes."""
    a = a / np.abs(a).max(-1, keepdims=True)
    b = b / np.abs(b).max(-1, keepdims=True)
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """``vector, members``: equal vectors with their ``keep`` smallest ids."""
    first = Window.partitionBy("vector").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    return kept.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members"))


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: its ids, vectors and flat neighbour arrays.

    ``vectors`` has ``vector, members, dim``.  Every row is indexed.
    """
    counts = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = F.lit(1)
    for dim, count in counts.items():  # a few lengths at most
        shards = F.when(F.col("dim") == dim, -(-count // shard_rows)).otherwise(shards)
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64(F.element_at("members", 1)), shards).cast("int"))

    def make(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(pc.list_element(table.column("members"), 0)))
        matrix = _matrix(table, "vector")
        layers, nodes = build(_unit(matrix))
        order = nodes[0]
        members = [table.column("members")[int(i)].as_py() for i in order]
        sizes = np.array([layer.shape for layer in layers], np.int32)
        row = {
            "dim": [table.column("dim")[0].as_py()],
            "shard": [table.column("shard")[0].as_py()],
            "ids": [np.concatenate([np.array(m, "<i8") for m in members]).tobytes()],
            "members": [np.array([len(m) for m in members], "<i4").tobytes()],
            "vectors": [matrix[order].astype("<f8").tobytes()],
            "layers": [sizes.astype("<i4").tobytes()],
            "graph": [np.concatenate([layer.ravel() for layer in layers]).astype("<i4").tobytes()],
        }
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.table(row, schema=pa.schema(list(zip(row, kinds, strict=True))))

    return placed.groupBy("dim", "shard").applyInArrow(make, _INDEX)


def _loaded(row: dict) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    sizes = np.frombuffer(row["layers"], "<i4").reshape(-1, 2)
    edges = np.frombuffer(row["graph"], "<i4")
    layers, at = [], 0
    for count, links in sizes:
        layers.append(edges[at : at + count * links].reshape(count, links))
        at += count * links
    matrix = np.frombuffer(row["vectors"], "<f8").reshape(sizes[0][0], -1)
    ends = np.cumsum(np.frombuffer(row["members"], "<i4"))
    return layers, matrix, np.split(np.frombuffer(row["ids"], "<i8"), ends[:-1])


def nearest(
    rows: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The ``k`` rows nearest to each query by cosine, as far as the graphs find them.

    ``rows`` and ``queries`` have ``id, vector``.  Null ids and vectors that are null, zero or hold null or not
    finite components take no part; vectors of another length than the query's are no candidates; a query's own id
    is none either.  Ties go to the smaller id, also among
    any number of vectors of one direction; repeated (id, vector) rows count once; with fewer candidates all are
    returned; empty tables give no rows.  Returns query_id, rank (from 1), id, score.
    """

    def ready(table: DataFrame) -> DataFrame:
        good = F.col("id").isNotNull() & usable(F.col("vector"))
        numbers = F.col("vector").cast("array<double>")
        # Scaled as `cosine` scales them: vectors of one direction become equal, and with them their scores.
        longest = F.nullif(F.array_max(F.transform(numbers, lambda x: F.abs(x))), F.lit(0.0))
        # Repeated first, so that it is found once per row and not once per component.
        scaled = F.zip_with(numbers, F.array_repeat(longest, F.size(numbers)), lambda x, m: x / m)
        return table.select("id", scaled.alias("vector")).where(good).distinct()

    # One more than k, since the query's own row may be among them.
    distinct = classes(ready(rows), k + 1).withColumn("dim", F.size("vector"))
    shards = materialize(index(materialize(distinct, "vectors"), shard_rows), "graphs")
    asked = ready(queries).withColumn("dim", F.size("vector"))
    asked = materialize(asked, "queries")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    # A copy of each query for every shard, of each shard for every block.
    places = shards.groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # a number per some thousand rows
    sent = asked.withColumn("block", block).join(F.broadcast(places), "dim").select(
        "id", "vector", "dim", "block", F.explode("shards").alias("shard")
    )
    met = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(graph: pa.Table, block_: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "score": [], "ids": []}
        if graph.num_rows and block_.num_rows:
            layers, matrix, members = _loaded(graph.to_pylist()[0])
            wanted = _matrix(block_, "vector")
            nodes = search(_unit(matrix), layers, _unit(wanted), max(beam, 2 * k))
            first = np.array([m[0] for m in members])
            for query, own, at in zip(block_.column("id").to_pylist(), wanted, nodes, strict=True):
                at = at[at >= 0]
                scores = cosine(matrix[at], own[None])
                for i in np.lexsort((first[at], -scores))[: k + 1]:
                    found["query_id"].append(query)
                    found["score"].append(float(scores[i]))
                    found["ids"].append(members[at[i]].tolist())
        kinds = [pa.int64(), pa.float64(), pa.list_(pa.int64())]
        return pa.table(found, schema=pa.schema(list(zip(found, kinds, strict=True))))

    keys = ["dim", "shard", "block"]
    candidates = met.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(find, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        candidates.select("query_id", "score", F.explode("ids").alias("id"))
        .where(F.col("id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
