"""Frequent itemsets, association rules and sequential patterns."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.runtime import broadcast_if_small, discard, hot_key_join, materialize

# Rows of all sequences with a pattern, up to which one task finishes it.
LOCAL_ROWS = 100_000


def frequent_itemsets(
    baskets: DataFrame, items: str, min_support: float = 0.3, partitions: int | None = None
) -> DataFrame:
    """``(items, freq)``: sorted itemsets in at least ``ceil(min_support * n)`` baskets.

    An item given twice in a basket raises.
    """
    miner = FPGrowth(itemsCol=items, minSupport=min_support)
    if partitions:
        miner = miner.setNumPartitions(partitions)
    return miner.fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), "freq")


def association_rules(itemsets: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """``(antecedent, consequent, freq, confidence)`` with one-item consequents.

    Itemsets are sorted arrays, so the antecedent's own row is an equi join.
    """
    larger = itemsets.where(F.size("items") > 1).select(
        "items", "freq", F.explode("items").alias("consequent")
    )
    split = larger.select(
        F.array_except("items", F.array("consequent")).alias("antecedent"), "consequent", "freq"
    )
    base = itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("_base"))
    return (
        split.join(base, "antecedent")
        .withColumn("confidence", F.col("freq") / F.col("_base"))
        .where(F.col("confidence") >= min_confidence)
        .drop("_base")
    )


def sequential_patterns(
    events: DataFrame,
    sequence: str,
    position: str,
    item: str,
    min_support: float = 0.1,
    max_length: int = 10,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """``(pattern, freq)`` from one row per item of a sequence.

    ``pattern`` is an array of elements (sorted arrays of items); items at the
    same position form one element, and ``freq`` counts sequences.  Patterns
    grow by one item per level, and supports are counted before anything is
    written: a new element needs the first end of the pattern and the last
    place of the item in a sequence, a wider last element needs the positions
    where the pattern can end.  Only the positions of frequent patterns are
    written, and a sequence is never gathered.  Positions carry the number of their pattern and its last item; the
    pattern itself is kept once.

    A pattern whose sequences hold no more than ``local_rows`` rows altogether
    is finished in one task, with all that grows from it.  Rows with a null in
    any of the three columns match nothing; a sequence of nulls alone is not
    counted.
    """
    rows = (
        events.select(F.col(sequence).alias("seq"), F.col(position).alias("pos"), F.col(item).alias("item"))
        .dropna()
        .distinct()
    )
    total = rows.select("seq").distinct().count()
    needed = max(1, math.ceil(min_support * total))

    seqs_of_item = rows.select("item", "seq").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    frequent = materialize(seqs_of_item.where(F.col("freq") >= needed), "items")
    rows = materialize(rows.join(broadcast_if_small(frequent.select("item")), "item", "left_semi"), "sequences")
    # Of an item that repeats in a sequence, counting needs the last place alone.
    lasts = materialize(rows.groupBy("seq", "item").agg(F.max("pos").alias("last"), F.count(F.lit(1)).alias("n")), "lasts")
    sizes = lasts.groupBy("seq").agg(F.sum("n").alias("size"))

    found = frequent.select(F.array(F.array("item")).alias("pattern"), "freq")
    number = F.monotonically_increasing_id()
    known = materialize(frequent.select(number.alias("id"), F.array(F.array("item")).alias("pattern"), "item"), "numbers")
    level = rows.join(broadcast_if_small(known.select("id", "item")), "item").select("id", F.col("item").alias("tail"), "seq", "pos")
    written: DataFrame | None = None
    for length in range(1, max_length):
        ends = level.groupBy("id", "seq").agg(F.min("pos").alias("end"))
        if local_rows:
            weight = ends.join(sizes, "seq").groupBy("id").agg(F.sum("size").alias("rows"))
            weight = materialize(weight.select("id", (F.col("rows") <= local_rows).alias("small")), "weights")
            small = weight.where("small").select("id")
            if not small.isEmpty():
                named = small.join(known.select("id", "pattern"), "id")
                found = found.unionByName(_finished(level, ends, rows, named, needed, max_length - length))
                level = level.join(broadcast_if_small(small), "id", "left_anti")
                ends = ends.join(broadcast_if_small(small), "id", "left_anti")
            if weight.where("not small").isEmpty():
                break
        longer = (
            ends.join(lasts, "seq").where(F.col("last") > F.col("end")).groupBy("id", "item").agg(F.count(F.lit(1)).alias("freq"))
        )
        wider = (
            level.join(rows, ["seq", "pos"]).where(F.col("item") > F.col("tail"))
            .select("id", "item", "seq").distinct()
            .groupBy("id", "item").agg(F.count(F.lit(1)).alias("freq"))
        )
        counted = longer.withColumn("wide", F.lit(False)).unionByName(wider.withColumn("wide", F.lit(True)))
        support = materialize(counted.where(F.col("freq") >= needed), "support")
        if support.isEmpty():
            break
        grown = F.when(F.col("wide"), _widened("pattern", "item")).otherwise(F.concat("pattern", F.array(F.array("item"))))
        numbered = materialize(
            support.join(broadcast_if_small(known.select("id", "pattern")), "id")
            .select(number.alias("new"), "id", "item", "wide", "freq", grown.alias("pattern")),
            "numbers",
        )
        found = found.unionByName(numbered.select("pattern", "freq"))
        if length + 1 == max_length:
            break
        survivors = broadcast_if_small(numbered.select("new", "id", "item", "wide"))
        key = F.struct("seq", "item").alias("key")
        starts = ends.join(survivors.where("not wide"), "id").select("new", "end", key)
        after = hot_key_join(materialize(starts, "starts"), rows.select(key, "pos"), "key").where(F.col("pos") > F.col("end"))
        beside = (
            level.join(survivors.where("wide"), "id").join(rows, ["seq", "pos", "item"]).select("new", "item", "seq", "pos")
        )
        following = after.select("new", "key.item", "key.seq", "pos").unionByName(beside).toDF("id", "tail", "seq", "pos")
        following = materialize(following, "patterns")
        if written is not None:
            discard(written)
        written = level = following
        known = numbered.select(F.col("new").alias("id"), "pattern", "item")
    return found


def _widened(pattern: str, item: str) -> Column:
    """The pattern with one more item in its last element."""
    last = F.array(F.concat(F.element_at(pattern, -1), F.array(item)))
    return F.concat(F.slice(pattern, F.lit(1), F.size(pattern) - 1), last)


def _finished(
    level: DataFrame, ends: DataFrame, rows: DataFrame, small: DataFrame, needed: int, more: int
) -> DataFrame:
    """All frequent patterns with up to ``more`` further items that begin with the patterns ``small(id, pattern)``.

    A group holds the rows of the pattern's sequences from its first end on, and once more, marked, the positions where
    the pattern can end; the caller has bounded both.
    """
    pattern_type = small.schema["pattern"].dataType.simpleString()
    hinted = broadcast_if_small(small.select("id"))
    rest = (
        ends.join(hinted, "id").join(rows, "seq").where(F.col("pos") >= F.col("end"))
        .select("id", "seq", "pos", "item", F.lit(False).alias("ends"))
    )
    marks = level.join(hinted, "id").select("id", "seq", "pos", F.col("tail").alias("item"), F.lit(True).alias("ends"))

    def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        places: dict = {}  # sequence -> item -> sorted positions
        elements: dict = {}  # sequence -> position -> items
        lies: dict = {}  # sequence -> positions where the pattern can end
        last = group["item"].iloc[0]
        for seq, pos, item, is_end in group[["seq", "pos", "item", "ends"]].sort_values("pos").itertuples(index=False):
            if is_end:
                last = item
                lies.setdefault(seq, []).append(pos)
            else:
                places.setdefault(seq, {}).setdefault(item, []).append(pos)
                elements.setdefault(seq, {}).setdefault(pos, []).append(item)
        tails, freqs = [], []
        open_tails = [([[last]], lies, more)]
        while open_tails:
            tail, at, left = open_tails.pop()
            longer: dict = {}
            wider: dict = {}
            for seq, positions in at.items():
                for item, all_places in places[seq].items():
                    later = all_places[bisect_right(all_places, positions[0]) :]
                    if later:
                        longer.setdefault(item, {})[seq] = later
                for pos in positions:
                    for item in elements[seq].get(pos, ()):
                        if item > tail[-1][-1]:
                            wider.setdefault(item, {}).setdefault(seq, []).append(pos)
            for grown, wide in ((longer, False), (wider, True)):
                for item, where in grown.items():
                    if len(where) >= needed:
                        new = [*tail[:-1], [*tail[-1], item]] if wide else [*tail, [item]]
                        tails.append(new)
                        freqs.append(len(where))
                        if left > 1:
                            open_tails.append((new, where, left - 1))
        ids, counts = np.full(len(tails), key[0], dtype=np.int64), np.asarray(freqs, dtype=np.int64)
        return pd.DataFrame({"id": ids, "tail": pd.Series(tails, dtype=object), "freq": counts})

    tails = rest.unionByName(marks).groupBy("id").applyInPandas(finish, f"id long, tail {pattern_type}, freq long")
    # A tail starts with the last item of its pattern, to which items of the same element may have been added.
    element = F.concat(F.element_at("pattern", -1), F.slice(F.element_at("tail", 1), F.lit(2), F.size(F.element_at("tail", 1))))
    whole = F.concat(
        F.slice("pattern", F.lit(1), F.size("pattern") - 1), F.array(element), F.slice("tail", F.lit(2), F.size("tail"))
    )
    return materialize(tails.join(small, "id").select(whole.alias("pattern"), "freq"), "finished")
