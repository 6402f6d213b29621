"""Rounds of the class ranking in which edges stay where they were written.

Both arcs of an edge lie with the item they leave from, and all arcs, ranks and degrees of an item in one bucket.
New weights are a product, ``W' = W (a_i a_j + 2^-t)`` with ``a`` the root of the relative rank, so sums over them
split into sums over ``W`` of what the far ends send.  The weights are not written: a round moves one row of sums
per arc, and none for sides of relations on which nothing can arrive.  As all that is taken from ``W`` is sums, equal
edges add up in these and are not brought together before.  Sums of many arcs are moved for some of the buckets at a
time, and what was moved is deleted before the next ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.runtime import bucket_round, by_bucket, materialize_buckets, materialize_rounds

NODE = ["m", "x"]

# Ends are first counted together in so many cells; only a cell above the bound is counted end by end.
COARSE_CELLS = 1 << 16

# Values an arc moves at once, counted over all arcs, the most turns, and arcs from which on they take any.
VALUES_OF_TURN = 2
TURNS = 6
ARCS_OF_TURNS = 10_000_000


def turns(values: int, number: int) -> int:
    """In how many turns, a divisor of `TURNS`, ``number`` arcs move ``values`` values each."""
    if number < ARCS_OF_TURNS:
        return 1
    return next((n for n in range(1, TURNS) if TURNS % n == 0 and n * VALUES_OF_TURN >= values), TURNS)


def slots(lanes) -> list[int]:
    """Each lane's number among the lanes that leave from the same type."""
    seen: Counter = Counter()
    found = []
    for m in lanes.near_types():
        found.append(seen[m])
        seen[m] += 1
    return found


def _arcs_of(edges: DataFrame, lanes, *more: str) -> DataFrame:
    lane = F.col("lane")
    out = F.struct(lane, F.col("row").alias("x"), F.col("col").alias("y"))
    back = F.struct((lane + 1).alias("lane"), F.col("col").alias("x"), F.col("row").alias("y"))
    return edges.select(lanes.lane().alias("lane"), "row", "col", *more).select(F.inline(F.array(out, back)), *more)


def arcs_if_still(edges: DataFrame, lanes, cell: int) -> int | None:
    """The number of arcs, or nothing if an end has more than ``cell`` edges or a weight is negative."""
    arcs = _arcs_of(edges, lanes, "w").withColumn("_cell", F.pmod(F.xxhash64("x"), F.lit(COARSE_CELLS)))
    counts = arcs.groupBy("lane", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("w").alias("_w"))
    arcs_in_all, largest, least = counts.agg(F.sum("_n"), F.max("_n"), F.min("_w")).first()
    if (least or 0.0) < 0.0:
        return None
    if (largest or 0) > cell:
        full = counts.where(F.col("_n") > cell).select("lane", "_cell")
        ends = arcs.join(full, ["lane", "_cell"], "left_semi").groupBy("lane", "x").agg(F.count(F.lit(1)).alias("_n"))
        if not ends.where(F.col("_n") > cell).isEmpty():
            return None
    return arcs_in_all or 0


def place(edges: DataFrame, lanes, buckets: int, number: int = 0) -> DataFrame:
    """``(m, x, lane, y, w0)``: both arcs of every edge in buckets of the item they leave from.

    Many arcs, of which there are ``number``, take turns, each of which reads the edges.  They are then kept by the
    ``turn`` of their far end.
    """
    arcs = _arcs_of(edges, lanes, "w").select(lanes.end_type().alias("m"), "x", "lane", "y", F.col("w").alias("w0"))
    # An arc is about as much as four sums.
    count = turns(2 * VALUES_OF_TURN, number)
    if number < ARCS_OF_TURNS:
        return materialize_buckets(arcs, NODE, "arcs", buckets=buckets)
    types = lanes.near_types()
    far = [lanes.pick([types[n ^ 1] for n in range(len(types))]).cast(lanes.kind), F.col("y")]

    def part(turn: int) -> DataFrame:
        placed = by_bucket(of_turn(arcs, turn, count, buckets), NODE, buckets)
        return placed.withColumn("turn", bucket_round(far, buckets, TURNS).cast("int"))

    return materialize_rounds(part, count, NODE, "arcs", True, buckets, ["turn"])


def of_turn(df: DataFrame, turn: int, count: int, buckets: int) -> DataFrame:
    """Rows of the buckets whose turn it is."""
    return df if count == 1 else df.where(bucket_round(NODE, buckets, count) == turn)


def nodes(arcs: DataFrame, lanes, initial: DataFrame, classes: int, buckets: int) -> DataFrame:
    """``(m, x, p0 .., known, d)`` of every item and every end: start ranks, and a degree per slot."""
    number = slots(lanes)
    slot = lanes.pick(number)
    sums = arcs.groupBy(*NODE).agg(*[F.sum(F.when(slot == s, F.col("w0"))).alias(f"_d{s}") for s in range(max(number) + 1)])
    degree = F.array(*[F.coalesce(F.col(f"_d{s}"), F.lit(0.0)) for s in range(max(number) + 1)])
    start = by_bucket(initial.withColumn("known", F.lit(True)), NODE, buckets)
    both = start.join(sums.hint("shuffle_hash"), NODE, "full").select(
        *NODE, *_ranks(classes), F.coalesce("known", F.lit(False)).alias("known"), degree.alias("d")
    )
    return materialize_buckets(both, NODE, "nodes", placed=True, buckets=buckets)


def _ranks(classes: int) -> list[str]:
    return [f"p{k}" for k in range(classes)]


def largest_ranks(ranks: DataFrame, classes: int) -> dict:
    """The largest rank per type and class: one row per object type."""
    found = ranks.groupBy("m").agg(*[F.max(p).alias(p) for p in _ranks(classes)])
    return {r["m"]: [r[p] or 0.0 for p in _ranks(classes)] for r in found.collect()}


def _root(k: int, largest: dict) -> Column:
    """The root of the relative rank; 0 where a type has no rank in the class."""
    root = F.lit(0.0)
    for m, tops in largest.items():
        if tops[k] > 0:
            root = F.when(F.col("m") == m, F.sqrt(F.col(f"p{k}") / F.lit(tops[k]))).otherwise(root)
    return root


def _send(
    arcs: DataFrame,
    sender: DataFrame,
    lanes,
    used: Sequence[int],
    sums: dict[str, Column],
    buckets: int,
    turn: int = 0,
    count: int = 1,
) -> DataFrame:
    """``(m, x, slot, ..)`` at the far ends: one row per arc of the ``used`` lanes, not added up before it moves.

    Most ends get few rows from a bucket, and none gets more than an item may have.  Ends get theirs in ``count`` turns.
    """
    number = slots(lanes)
    other = [n ^ 1 for n in range(len(number))]
    types = lanes.near_types()
    if "turn" in arcs.columns:
        arcs = arcs.where(F.col("turn").isin(list(range(turn, TURNS, count))))
    met = arcs.where(F.col("lane").isin(list(used))).join(sender.hint("shuffle_hash"), NODE)
    sent = met.select(
        lanes.pick([types[o] for o in other]).cast(lanes.kind).alias("m"),
        F.col("y").alias("x"),
        lanes.pick([number[o] for o in other]).alias("slot"),
        *[(F.col("w0") * value).alias(name) for name, value in sums.items()],
    )
    return by_bucket(sent, NODE, buckets)


def _lent(slot: Column, k: int, classes: int, shared: bool, name: str = "f") -> Column:
    """The factor ``1 / sqrt(degree)`` of a slot, kept for all classes together or one by one."""
    return F.col(name)[slot if shared else slot * classes + k]


def _factors(degrees: Column) -> Column:
    return F.transform(degrees, lambda d: F.when(d > 0, 1.0 / F.sqrt(d)).otherwise(F.lit(0.0)))


def _met(lanes, largest: dict, classes: int) -> list[int]:
    """Lanes with a class that has ranks at both ends: only there new weights differ from old ones by more than a factor."""
    tops = [largest.get(m, [0.0] * classes) for m in lanes.near_types()]
    return [n for n in range(len(tops)) if any(a > 0 and b > 0 for a, b in zip(tops[n], tops[n ^ 1]))]


def weighted_degrees(
    arcs: DataFrame, known: DataFrame, ranks: DataFrame, lanes, classes: int, t: int, buckets: int, number: int = 0
) -> DataFrame:
    """``(m, x, p0 .., a0 .., f)`` under the weights that round ``t`` made from ``ranks``.

    ``sum_j W (a_i a_j + 2^-t) = a_i sum_j W a_j + 2^-t sum_j W``.
    """
    slots_of, roots = slots(lanes), [f"a{k}" for k in range(classes)]
    largest = largest_ranks(ranks, classes)
    used = _met(lanes, largest, classes)
    rooted = ranks.select(*NODE, *_ranks(classes), *[_root(k, largest).alias(a) for k, a in enumerate(roots)])
    sender = rooted.where(" or ".join(f"{a} > 0" for a in roots)).select(*NODE, *roots)
    count = turns(classes, number)
    reached = sorted({slots_of[n ^ 1] for n in used}) or [0]

    def degree(s: int, k: int) -> Column:
        same = F.col("d")[s] * 2.0**-t
        return same + F.col(roots[k]) * F.coalesce(F.col(f"_s{s}_{k}"), F.lit(0.0)) if s in reached else same

    degrees = F.array(*[degree(s, k) for s in range(max(slots_of) + 1) for k in range(classes)])

    def table(turn: int) -> DataFrame:
        sent = {f"s{k}": F.col(a) for k, a in enumerate(roots)}
        arrived = _send(arcs, sender, lanes, used, sent, buckets, turn, count)
        sums = arrived.groupBy(*NODE).agg(
            *[F.sum(F.when(F.col("slot") == s, F.col(f"s{k}"))).alias(f"_s{s}_{k}") for s in reached for k in range(classes)]
        )
        mine = [of_turn(df, turn, count, buckets) for df in (rooted, known.select(*NODE, "d"))]
        met = mine[0].join(mine[1].hint("shuffle_hash"), NODE).join(sums.hint("shuffle_hash"), NODE, "left")
        return met.select(*NODE, *_ranks(classes), *roots, _factors(degrees).alias("f"))

    return materialize_rounds(table, count, NODE, "ends", True, buckets)


def neighbour_sums(
    arcs: DataFrame,
    ends: DataFrame,
    lanes,
    classes: int,
    buckets: int,
    only: Sequence[int] | None = None,
    t: int | None = None,
    number: int = 0,
) -> list[Callable[[], DataFrame]]:
    """``(m, x, _a0 ..)``: what `rankclass.pass_ranks` adds up, with the weights of ``W``, or of round ``t`` over it.

    ``ends`` holds ranks and factors of every item, with ``t`` also the roots of the relative ranks.  One table per turn;
    `of_turn` gives the items of a turn.
    """
    slots_of, types, shared = slots(lanes), lanes.near_types(), t is None
    largest = largest_ranks(ends, classes)
    used = [n for n, m in enumerate(types) if any(v > 0 for v in largest.get(m, [])) and (only is None or n in only)]
    # What is sent per slot, made once per item.
    wide = 1 if shared else classes

    def lent(s: int, k: int) -> Column:
        factor = F.col("f")[s * wide + (0 if shared else k)]
        return F.when(F.col(f"p{k}") > 0, F.col(f"p{k}") * factor).otherwise(F.lit(0.0))

    roots = [] if shared else [f"a{k}" for k in range(classes)]
    given = F.array(*[lent(s, k) for s in range(max(slots_of) + 1) for k in range(classes)]).alias("g")
    sender = ends.where(" or ".join(f"{p} > 0" for p in _ranks(classes))).select(*NODE, given, *roots)
    slot = lanes.pick(slots_of)
    sums = {f"u{k}": _lent(slot, k, classes, False, "g") for k in range(classes)}
    if not shared:
        met = F.col("lane").isin(_met(lanes, largest, classes))
        sums |= {f"v{k}": F.when(met, sums[f"u{k}"] * F.col(a)) for k, a in enumerate(roots)}
    def taken(k: int) -> Column:
        value = F.col(f"u{k}")
        if not shared:
            value = value * 2.0**-t + F.coalesce(F.col(f"v{k}"), F.lit(0.0)) * F.col(roots[k])
        return value * _lent(F.col("slot"), k, classes, shared)

    count = turns(len(sums), number)

    def table(turn: int) -> DataFrame:
        arrived = _send(arcs, sender, lanes, used, sums, buckets, turn, count)
        mine = of_turn(ends.select(*NODE, "f", *roots), turn, count, buckets)
        here = arrived.join(mine.hint("shuffle_hash"), NODE)
        return here.groupBy(*NODE).agg(*[F.sum(taken(k)).alias(f"_a{k}") for k in range(classes)]).hint("shuffle_hash")

    return [partial(table, turn) for turn in range(count)]


def first_ends(known: DataFrame, classes: int) -> DataFrame:
    """The `nodes` with the factors of their degrees, which all classes share."""
    return known.select(*NODE, *_ranks(classes), _factors(F.col("d")).alias("f"))
