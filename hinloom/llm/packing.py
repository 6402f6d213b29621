"""Best-fit packing of tokenised documents into sequences of fixed length.

The plan is made over the histogram of piece lengths, never over pieces: a placement puts a number of equal
lengths into a number of equally full sequences.  The histogram has one row per length up to the sequence
length, so it, the plan and their planning time do not grow with the corpus.  Each piece then takes its slot by
a join on length and on its rank among the pieces of that length.

Ranks are dealt without gathering a length in one task: pieces of a length are spread over hashed buckets, ranked
inside their bucket, and shifted by the sizes of the buckets before it.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinloom.llm.common import arrow_map, text_of
from hinloom.llm.vocabularies import ids_of
from hinloom.runtime import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, first_rank long, end_rank long, first_sequence long, offset long"

# Buckets a length is ranked in: at least so many, and more for tables beyond so many pieces per bucket.
RANK_BUCKETS = 256
PIECES_PER_BUCKET = 1_000_000


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place ``count`` items of each length, longest first, in the fullest sequence that takes them.

    Returns (length, first rank, end rank, first sequence, offset): the items of a length with ranks in the range
    go to consecutive sequences at that offset.  Sequences that are equally full are kept as ranges, so a step
    handles a range at once.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> ranges (first sequence, count)
    free: list[int] = []  # sorted keys of `room`
    opened = 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if not room[left]:
                bisect.insort(free, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while rank < count:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, ready = room[left].pop()
                if not room[left]:
                    free.pop(at)
                taken = min(ready, count - rank)
                put(left, first + taken, ready - taken)
                put(left - length, first, taken)
                plan.append((length, rank, rank + taken, first, capacity - left))
                rank += taken
                continue
            each = capacity // length
            full, rest = divmod(count - rank, each)
            for slot in range(each if full else rest):
                taken = full + (slot < rest)
                plan.append((length, rank, rank + taken, opened, slot * length))
                rank += taken
            put(capacity - each * length, opened, full)
            if rest:
                put(capacity - rest * length, opened + full, 1)
            opened += full + bool(rest)
    return plan


def cut(docs: DataFrame, tokenizer: str, sequence_length: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, append ``end_id`` and cut what is longer than a sequence; one row per piece.

    All pieces of a cut document but the first are full, so only one needs company.
    """

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = ids_of(tokenizer)
        docs_, numbers, starts, lengths, sums = [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(encode(text.as_py()).astype("<u4", copy=False), np.uint32(end_id))
            head = len(ids) % sequence_length or sequence_length
            edges = [0, *range(head, len(ids) + 1, sequence_length)]
            for number, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
                docs_.append(doc)
                numbers.append(number)
                starts.append(start)
                lengths.append(end - start)
                sums.append(zlib.crc32(ids[start:end]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(docs_, pa.int64()),
                pa.array(numbers, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), pieces, PIECES)


def ranked(pieces: DataFrame, by: str, order: list[str], buckets: int) -> DataFrame:
    """Add ``rank``, counted from 0 among the rows with the same ``by``; no task meets a whole hot value."""
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    spread = pieces.withColumn("bucket", bucket)
    inside = Window.partitionBy(by, "bucket").orderBy(*order)
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        spread.groupBy(by, "bucket")
        .agg(F.count(F.lit(1)).alias("size"))
        .select(by, "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    )
    return (
        spread.withColumn("place", F.row_number().over(inside) - 1)
        .join(shifts, [by, "bucket"])
        .withColumn("rank", F.col("shift") + F.col("place"))
        .drop("bucket", "place", "shift")
    )


def assign(pieces: DataFrame, sequence_length: int = 2048) -> DataFrame:
    """Give each piece (``doc_id, piece, length``) its ``sequence_id`` and ``offset``.

    ``pieces`` should be a written table: it is read for the histogram, the bucket sizes and the slots.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit(histogram, sequence_length)
    total = sum(histogram.values())
    buckets = max(RANK_BUCKETS, total // PIECES_PER_BUCKET)
    spark = pieces.sparkSession
    # At most one row per length and place in a sequence, plus two per split of a range: tens of thousands.
    slots = spark.createDataFrame(plan, PLAN).withColumnRenamed("length", "slot_length")
    here: Column = (
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("end_rank"))
    )
    return (
        ranked(pieces, "length", ["doc_id", "piece"], buckets)
        .join(F.broadcast(slots), here)
        .withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, tokenizer: str, sequence_length: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack the texts of ``docs`` (``doc_id, text``) into as few sequences as best-fit decreasing finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty text is the end id
    alone; a text of any length is cut whole; equal lengths fall in any order, which changes no sequence count;
    repeated rows are packed once each; other columns are ignored; no documents give no rows.
    """
    return assign(materialize(cut(docs, tokenizer, sequence_length, end_id), "pieces"), sequence_length)
