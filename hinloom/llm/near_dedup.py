"""Near-duplicate documents: MinHash signatures posted by coordinate, links confirmed on full shingle sets.

Stages, each over written tables:

1. Every text becomes a set of hashed word shingles, of which one pass keeps a key of the whole set and a MinHash
   signature.  Documents with equal sets are one *node* from here on, so copies cost one entry.
2. A node is posted under its (coordinate, value) pairs.  Linked nodes share at least ``matches`` of them, so two
   linked nodes share one of the ``coordinates - matches + 1`` rarest pairs of each: the more frequent pairs of a
   node are skipped, and with them the long lists.
3. In each list all nodes are compared with one *hub*, the node whose pairs are most frequent, never all with all.
   Pairs with enough equal coordinates are confirmed on the full sets, and components are formed.
4. Lists that still hold more than one component may hide links.  Their nodes are joined exactly, by the rarest
   shingles of each node among these nodes: a place in that order bounds the overlap that is still possible, so
   pairs that cannot reach the threshold are never formed, and pairs inside a component are skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinloom.llm.common import bounded, text_of
from hinloom.runtime import broadcast_if_small, materialize

# Similarity of a link, in percent.
PERCENT = 75
WORDS = 5

COORDINATES = 64

# Links that may be lost in all if every node had one at the very threshold.
LOST_LINKS = 1e-6

# Bytes of text, and rows of the hash matrix, handled at once.
BLOCK = 1 << 22
ROWS = 1 << 13


def matches_for(nodes: int, coordinates: int = COORDINATES, percent: int = PERCENT, lost: float = LOST_LINKS) -> int:
    """Equal coordinates that are asked of a pair, so that of ``nodes`` pairs at the threshold ``lost`` are missed.

    The coordinates of two sets are equal with their similarity, each for itself.
    """
    share, missed = percent / 100, 0.0
    for equal in range(coordinates):
        missed += math.comb(coordinates, equal) * share**equal * (1 - share) ** (coordinates - equal)
        if missed * max(nodes, 1) > lost:
            return max(equal, 1)
    return coordinates


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(count: int) -> np.ndarray:
    return _mixed((np.arange(count, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_WEIGHTS = _weights(1 << 12)


def _blanks(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a weighted sum of each word's bytes."""
    data = np.frombuffer(text, np.uint8)
    found = []
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + BLOCK)
        while end < len(data):  # up to a blank
            gap = np.flatnonzero(_blanks(data[end : end + BLOCK]))
            end = end + int(gap[0]) if len(gap) else min(len(data), end + BLOCK)
            if len(gap):
                break
        block = data[begin:end]
        begin = end
        solid = ~_blanks(block)
        edges = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(starts):
            continue
        lengths = ends - starts
        longest = int(lengths.max())
        weights = _WEIGHTS if longest <= len(_WEIGHTS) else _weights(longest)
        letters = block[solid].astype(np.uint64)
        letters += np.uint64(32) * ((letters >= 65) & (letters <= 90)).astype(np.uint64)
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        sums = np.add.reduceat((letters + np.uint64(1)) * weights[place], first)
        found.append(_mixed(sums + lengths.astype(np.uint64)))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of all words as one where there are fewer; none without words."""
    hashes = word_hashes(text)
    width = min(words, len(hashes))
    if not width:
        return hashes
    count = len(hashes) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = _mixed(out ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)


def _coordinate_hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    return draw.integers(1, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, count, np.uint64)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Smallest value of each coordinate's hash over a set that is not empty.

    Values have 64 bits: shorter ones would be equal by chance in many pairs of a large corpus.
    """
    factor, shift = _coordinate_hashes(coordinates)
    least = np.full(coordinates, 2**64 - 1, np.uint64)
    for begin in range(0, len(shingles), ROWS):
        values = shingles[begin : begin + ROWS, None] * factor + shift
        least = np.minimum(least, values.min(0))
    return least.view(np.int64)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for text in batch.column(column):
        yield text.as_py().encode()


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, sketch`` of each row; node and sketch are null for a text without words.

    ``node`` is a 128-bit hash of the whole set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                sizes, nodes, sketches = [], [], []
                for text in _texts(batch, "text"):
                    shingles = shingle_set(text)
                    sizes.append(len(shingles))
                    some = len(shingles) > 0
                    nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if some else None)
                    sketches.append(signature(shingles) if some else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("text_hash"),
                        pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.binary()),
                        pa.array(sketches, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "node", "sketch"],
                )

    texts = docs.select(
        F.col("doc_id").cast("long"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash")
    )
    return texts.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node binary, sketch array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` for the given nodes (``node, doc_id``), computed anew from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                sets = [shingle_set(text) for text in _texts(batch, "text")]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["node", "shingles"],
                )

    wanted = broadcast_if_small(nodes.select("doc_id").distinct())
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(wanted, "doc_id", "left_semi")
    sets = texts.select("text").mapInArrow(run, "node binary, shingles array<long>")
    # A row with another text under the same id makes another node, and a repeated row the same one.
    return materialize(sets.join(nodes.select("node"), "node", "left_semi"), "shingle-sets").dropDuplicates(["node"])


def postings(nodes: DataFrame, matches: int, coordinates: int = COORDINATES) -> DataFrame:
    """``node, pairs, frequency``: the shared pairs of each node that are not skipped.

    Pairs are ordered by frequency, rarest first.  Pairs of one node only share nothing, but take up places among
    the first ``coordinates - matches + 1``, so a node with few shared pairs has none to post.
    """
    all_pairs = nodes.select("node", F.posexplode("sketch").alias("at", "value"))
    all_pairs = all_pairs.select("node", F.xxhash64("at", "value").alias("pair"))
    shared = all_pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
    own = all_pairs.join(shared, "pair").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("count", "pair"))).alias("shared"),  # as many as coordinates at most
        F.sum(F.log("count")).alias("frequency"),
    )
    posted = F.size("shared") - (matches - 1)
    return own.where(posted > 0).select(
        "node", "frequency", F.slice(F.col("shared.pair"), F.lit(1), posted).alias("pairs")
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of an edge table ``a, b``: the least node that can be reached.

    Labels fall to the least of the neighbours' and then to the label of the label, so the number of rounds grows
    with the logarithm of the diameter.  Each round is a written table.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = materialize(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = materialize(
        both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")),
        "labels",
    )
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("component").alias("theirs"))
        heard = both.join(seen, "other").groupBy("node").agg(F.min("theirs").alias("heard"))
        lower = labels.join(heard, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "heard").alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        new = materialize(
            lower.join(jump, "low").select("node", F.least("low", "further").alias("component"), "was"), "labels"
        )
        changed = not new.where(F.col("component") != F.col("was")).isEmpty()
        labels = new.drop("was")
        if not changed:
            return labels


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    total = F.size("of_a") + F.size("of_b")
    linked = pairs.join(left, "a").join(right, "b").select(
        "a", "b", (common * 100 >= (total - common) * percent).alias("linked")
    )
    return linked.where("linked").select("a", "b")


def _hub_pairs(posted: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """Each node with the hub of each of its lists, where enough coordinates are equal."""
    lists = posted.select("node", "frequency", F.explode("pairs").alias("pair"))
    hubs = lists.groupBy("pair").agg(F.max(F.struct("frequency", "node")).alias("hub"), F.count(F.lit(1)).alias("n"))
    hubs = hubs.where(F.col("n") > 1).select("pair", F.col("hub.node").alias("hub"))
    ordered = lists.join(hubs, "pair").where(F.col("node") != F.col("hub")).select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    )
    sketch_a = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("of_a"))
    sketch_b = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("of_b"))
    equal = F.size(F.filter(F.zip_with("of_a", "of_b", lambda x, y: x == y), lambda same: same))
    met = ordered.distinct().join(sketch_a, "a").join(sketch_b, "b")
    return met.where(equal >= matches).select("a", "b")


def _open_nodes(posted: DataFrame, found: DataFrame) -> DataFrame:
    """``node, component`` of the nodes in lists with more than one component."""
    labelled = posted.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = labelled.select("node", "component", F.explode("pairs").alias("pair"))
    mixed = lists.groupBy("pair").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = mixed.where(F.col("low") != F.col("high")).select("pair")
    return lists.join(mixed, "pair", "left_semi").select("node", "component").distinct()


def _exact_pairs(open_nodes: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs of nodes in different components that can be similar enough, by their rarest shingles.

    With the shingles of each node ordered by their number of nodes, two similar nodes share one at places p and q
    such that ``100 + percent`` times what is left behind the place is at least ``percent`` times both sizes
    together, for either node.  ``reach`` is the largest size the other node may have.  The smaller of the two must
    reach at least its own size, so other places of a node only meet smaller nodes.
    """
    rows = sets.join(open_nodes, "node").select(
        "node", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")
    )
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
    per_node = (
        rows.join(shared, "shingle")
        .groupBy("node", "component", "size")
        .agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("shared"))  # a document's own shingles
    )
    # Places that can be the first common one.
    places = F.col("size") - F.ceil(F.col("size") * percent / 100).cast("int") + 1
    alone = F.col("size") - F.size("shared")
    first = per_node.where(places > alone).select(
        "node", "component", "size", alone.alias("alone"),
        F.posexplode(F.slice(F.col("shared.shingle"), F.lit(1), places - alone)).alias("place", "shingle"),
    )
    left = F.col("size") - F.col("alone") - F.col("place")
    reach = F.floor(left * (100 + percent) / percent).cast("long") - F.col("size")
    posted = materialize(
        first.select("shingle", "component", "node", "size", reach.alias("reach")).where(
            F.col("reach") * 100 >= F.col("size") * percent
        ),
        "rarest-shingles",
    )
    # Components meet before their nodes do, so a large component in a list is one row.
    wide = posted.where(F.col("reach") >= F.col("size"))
    small = wide.groupBy("shingle", F.col("component").alias("small")).agg(
        F.min("size").alias("least"), F.max("reach").alias("most")
    )
    large = posted.groupBy("shingle", F.col("component").alias("large")).agg(
        F.max("size").alias("tallest"), F.max("reach").alias("far"), F.min("size").alias("lowest")
    )
    possible = (
        (F.col("small") != F.col("large"))
        & (F.col("tallest") >= F.col("least"))
        & (F.col("far") >= F.col("least"))
        & (F.col("most") >= F.col("lowest"))
    )
    met = small.join(large, "shingle").where(possible)
    met = met.select("shingle", "small", "large", "tallest", "far", "lowest")
    of_small = wide.select("shingle", F.col("component").alias("small"), F.col("node").alias("a"),
                           F.col("size").alias("size_a"), F.col("reach").alias("reach_a"))
    of_large = posted.select("shingle", F.col("component").alias("large"), F.col("node").alias("b"),
                             F.col("size").alias("size_b"), F.col("reach").alias("reach_b"))
    fits = (
        (F.col("size_b") >= F.col("size_a"))
        & (F.col("reach_a") >= F.col("size_b"))
        & (F.col("reach_b") >= F.col("size_a"))
    )
    # Of a large component only the nodes that suit the other one's sizes come forth.
    suits = (
        (F.col("size_a") <= F.col("tallest"))
        & (F.col("size_a") <= F.col("far"))
        & (F.col("reach_a") >= F.col("lowest"))
    )
    chosen = met.join(of_small, ["shingle", "small"]).where(suits).drop("tallest", "far", "lowest")
    pairs = chosen.join(of_large, ["shingle", "large"]).where(fits)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, matches: int | None = None) -> DataFrame:
    """Component of every document under links of 75 % shared word shingles.

    A pair is compared if it has enough equal coordinates (``matches``, by default from `matches_for`): were there as
    many pairs at exactly 75 % as there are different sets, one in a million runs would lose one of them, at any
    size of the table; pairs above 75 % are lost less often by orders of magnitude.  Every pair that is compared is
    decided on its full sets.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that can be reached), kept (whether it is the
    document's own) and text_hash, a row per row of ``docs``.  A text that is null, empty or blank has no shingles and is linked
    with nothing; texts are taken whole; repeated rows are copies of each other with the same id, so both are
    kept; rows with the same id and different texts are documents of their own; a row without an id is linked with
    nothing, has no component and is kept; other columns are ignored; an empty table gives no rows.
    """
    sketches = materialize(sketched(docs), "sketches")
    members = sketches.where("doc_id is not null and node is not null")
    nodes = materialize(
        members.groupBy("node").agg(F.min(F.struct("doc_id", "sketch")).alias("least")).select(
            "node", "least.doc_id", "least.sketch"
        ),
        "nodes",
    )
    if matches is None:
        matches = matches_for(nodes.count())
    posted = materialize(postings(nodes, matches), "postings")
    pairs = materialize(_hub_pairs(posted, nodes, matches), "hub-pairs")
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = materialize(confirmed(pairs, shingle_sets(docs, nodes.join(met, "node"))), "links")
    found = components(links)
    open_nodes = materialize(_open_nodes(posted, found), "open-nodes")
    sets = shingle_sets(docs, nodes.join(open_nodes.select("node"), "node"))
    exact = materialize(_exact_pairs(open_nodes, sets), "exact-pairs")
    more = materialize(confirmed(exact, sets), "more-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    least = (
        found.join(nodes.select("node", "doc_id"), "node")
        .groupBy("component")
        .agg(F.min("doc_id").alias("component_id"))
    )
    # Nodes without a link are their own components.
    labelled = nodes.select("node", "doc_id").join(
        found.join(least, "component").select("node", "component_id"), "node", "left"
    ).select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    named = sketches.select("doc_id", "text_hash", "n_shingles", "node").join(labelled, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").select(
        "doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash"
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that `near_duplicates` keeps; of repeated rows one stays."""
    judged = materialize(near_duplicates(docs), "near-duplicates")
    # Those to drop are the fewer; a row is known by its id and text.
    dropped = judged.where(~F.col("kept")).select(
        F.col("doc_id").alias("llm_doc"), F.col("text_hash").alias("llm_hash")
    ).distinct()
    same = (F.col("doc_id").cast("long") == F.col("llm_doc")) & (F.xxhash64(text_of()) == F.col("llm_hash"))
    kept = docs.join(broadcast_if_small(materialize(dropped, "dropped")), same, "left_anti")
    repeated = judged.where("kept and doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
