"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

A chunk of a huge text is a row of its own, so one text spreads over many tasks.  Neighbouring chunks overlap.
Both report the token starts they found in the overlap that are *stable*: the character before is no white space
and the one at it is.  No token of a byte-level pre-tokeniser spans such a place, and what stands on either side
of it is encoded alike whatever lies beyond, so the counts left and right of it can be added.  A text whose
neighbours share no stable start (one without white space there) is encoded anew with a wider overlap, until one
chunk holds all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hinloom.llm.common import SAFE_CUT, arrow_map, text_of
from hinloom.llm.vocabularies import ids_of
from hinloom.runtime import materialize

# Stable starts a chunk reports for each of its two overlaps.  Neighbours list the same places in the same
# order, so the first would do; more of them only guard the comparison.
REPORTED = 16

_CHUNKS = "uid long, chunk int, chunks int, start long, text string"
# Chunks of huge texts that a task encodes.
CHUNKS_PER_TASK = 64

_ENDS = (
    "uid long, chunk int, chunks int, tokens long, left_at array<long>, left_tokens array<long>, "
    "right_at array<long>, right_tokens array<long>"
)


def chunked(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """Cut ``uid, text`` into chunks of ``size`` characters, each with ``overlap`` more from the next ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                # A text that the first chunk and its overlap cover is one chunk.
                count = 1 if len(text) <= size + overlap else -(-len(text) // size)
                for k in range(count):
                    start = k * size
                    part = text[start : start + size + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([uid], pa.int64()),
                            pa.array([k], pa.int32()),
                            pa.array([count], pa.int32()),
                            pa.array([start], pa.int64()),
                            pa.array([part], pa.string()),
                        ],
                        names=["uid", "chunk", "chunks", "start", "text"],
                    )

    return texts.select("uid", "text").mapInArrow(cut, _CHUNKS)


def encoded_ends(chunks: DataFrame, tokenizer: str, size: int, overlap: int) -> DataFrame:
    """Encode chunks with offsets and report the stable starts in the overlaps with both neighbours."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for row in batch.to_pylist():
            text, first = row["text"], row["start"]
            starts = ids_of(tokenizer).spans(text)
            ends = []
            for begin in (0, size):
                region = text[max(begin - 1, 0) : begin + overlap + 1]
                cuts = np.array([m.start() for m in SAFE_CUT.finditer(region)], np.int64) + max(begin - 1, 0)
                cuts = cuts[(cuts >= begin) & (cuts < begin + overlap) & np.isin(cuts, starts)][:REPORTED]
                ends.append(((cuts + first).tolist(), np.searchsorted(starts, cuts).tolist()))
            rows.append(
                {
                    "uid": row["uid"],
                    "chunk": row["chunk"],
                    "chunks": row["chunks"],
                    "tokens": len(starts),
                    "left_at": ends[0][0],
                    "left_tokens": ends[0][1],
                    "right_at": ends[1][0],
                    "right_tokens": ends[1][1],
                }
            )
        lists = pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), lists, lists, lists, lists]
        names = ["uid", "chunk", "chunks", "tokens", "left_at", "left_tokens", "right_at", "right_tokens"]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, kinds, strict=True))))

    return arrow_map(chunks, encode, _ENDS)


def spliced(ends: DataFrame) -> DataFrame:
    """``uid, n_tokens`` of each text; null where some neighbours share no stable start."""
    order = Window.partitionBy("uid").orderBy("chunk")
    previous = F.lag("right_at").over(order)
    following = F.lead("left_at").over(order)
    joint_left = F.array_min(F.array_intersect(F.col("left_at"), "previous_at"))
    joint_right = F.array_min(F.array_intersect(F.col("right_at"), "following_at"))
    # Tokens of the chunk before a joint; null where there is none.
    before = "element_at({n}_tokens, nullif(cast(array_position({n}_at, joint_{n}) as int), 0))"
    left = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.expr(before.format(n="left")))
    right = F.when(F.col("chunk") == F.col("chunks") - 1, F.col("tokens")).otherwise(
        F.expr(before.format(n="right"))
    )
    counted = (
        ends.withColumn("previous_at", previous)
        .withColumn("following_at", following)
        .withColumn("joint_left", joint_left)
        .withColumn("joint_right", joint_right)
        .withColumn("own", right - left)
    )
    whole = F.count("own") == F.max("chunks")
    return counted.groupBy("uid").agg(F.when(whole, F.sum("own")).alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 512, size: int = 1 << 15, overlap: int = 256
) -> DataFrame:
    """Tokens of every text, as the library of ``tokenizer`` (a byte-level BPE ``.json``) gives them.

    Returns doc_id, n_bytes, n_tokens, over_limit, one row per row of ``docs``.  A null or empty text has 0
    tokens; texts above ``size`` characters go through chunks; repeated rows are counted each; other columns are
    ignored; no documents give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    long = F.char_length("text") > size

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = ids_of(tokenizer)
        texts_ = batch.column(1)
        tokens = [len(encode(t.as_py())) for t in texts_]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pc.binary_length(texts_).cast(pa.int64()), pa.array(tokens, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    short = arrow_map(texts.where(~long), counts, "doc_id long, n_bytes long, n_tokens long")
    # The ids are fixed by writing them.
    waiting = materialize(texts.where(long).withColumn("uid", F.monotonically_increasing_id()), "huge-texts")
    results = [short]
    while not waiting.isEmpty():
        # A number of partitions that is asked for stays: chunks are small, but much work.
        chunks = waiting.agg(F.sum(F.ceil(F.char_length("text") / size))).first()[0]
        spread = chunked(waiting, size, overlap).repartition(max(1, -(-int(chunks) // CHUNKS_PER_TASK)), "uid", "chunk")
        found = materialize(spliced(encoded_ends(spread, tokenizer, size, overlap)), "spliced")
        joined = waiting.join(found, "uid")
        done = joined.where(F.col("n_tokens").isNotNull())
        results.append(done.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens"))
        if not found.where(F.col("n_tokens").isNull()).isEmpty():
            waiting = materialize(joined.where(F.col("n_tokens").isNull()).drop("n_tokens"), "unaligned")
        else:
            break
        overlap *= 8
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
