"""Ranking-based classification of network nodes.

Ranks of all classes sit side by side: ``(m, x, p0 .. p{K-1})`` holds the rank
of item ``x`` of type ``m`` in each class, and an edge row holds one weight per
class, or ``w0`` alone as long as all classes share it.  A round is thus one pass
over the edges for all classes and relations.
An edge is stored as two arcs, each in a bucket of the end it leaves from, so
both ends sum over their edges and lend them their ranks without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hinloom.plans import rankstill
from hinloom.runtime import broadcast_if_small, by_bucket, by_default, discard, materialize, materialize_buckets, materialize_rounds, spread

# Fixed values of the method: neighbour weight and prior weight.
LAMBDA = 0.2
ALPHA = 0.1

# Edges of one end that lie together; a larger end is cut into parts.
HOT_ARCS = 1 << 20

# Arcs of one bucket, where edges stay as they are written.
ARCS_OF_TASK = 1_000_000

# Ends of one task that counts them, and the slots that tell where a hot one is.
END_ROWS = 500_000
END_SLOTS = 1 << 16

# Arcs lie in buckets by the end they leave from.
NEAR = ["lane", "x", "part"]
_ARC = [*NEAR, "y", "far_part"]


@dataclass(frozen=True)
class Lanes:
    """Relations with the types of their ends; number ``2 n + side`` is a side of relation ``n``."""

    relations: tuple[tuple, ...]
    kind: T.DataType

    @staticmethod
    def of(relations: DataFrame) -> Lanes:
        # One row per relation of the network's schema.
        found = relations.select("rel", "i", "j").distinct().collect()
        return Lanes(tuple(sorted(tuple(r) for r in found)), relations.schema["i"].dataType)

    def lane(self) -> Column:
        """The lane of side 0 of a row of an edge table."""
        number = F.lit(None).cast("int")
        for n, (rel, i, j) in enumerate(self.relations):
            own = (F.col("rel") == rel) & (F.col("i") == i) & (F.col("j") == j)
            number = F.when(own, 2 * n).otherwise(number)
        return number

    def pick(self, values: list, shift: int = 0) -> Column:
        """The lane's entry of a list with one per lane."""
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("lane") + shift + 1).cast("int"))

    def relation(self) -> Column:
        return self.pick([rel for rel, _, _ in self.relations for _ in range(2)])

    def near_types(self) -> list:
        return [m for _, i, j in self.relations for m in (i, j)]

    def end_type(self, shift: int = 0) -> Column:
        """The type of the items at the lane's near end."""
        return self.pick(self.near_types(), shift).cast(self.kind)

    def numbers(self, names: Sequence[str]) -> list[int]:
        return [2 * n + side for n, (rel, _, _) in enumerate(self.relations) if rel in names for side in (0, 1)]


@dataclass(frozen=True)
class State:
    """Ranks and edge weights after ``round`` rounds.

    ``parted`` is false if no end is known to be cut into parts, ``one_way`` true if only the arcs from row to column
    are there, after which no round can follow.  With ``weighed`` the weights are those that round ``weighed[1]`` makes
    of the arcs' from the ranks ``weighed[0]``.
    """

    classes: int
    types: int
    initial: DataFrame
    ranks: DataFrame
    arcs: DataFrame
    lanes: Lanes
    round: int = 0
    parted: bool = True
    one_way: bool = False
    weighed: tuple[DataFrame, int] | None = None

    @property
    def relations(self) -> DataFrame:
        """``(rel, i, row, j, col, w0 ..)``: every edge once."""
        written = self.arcs.where(F.col("lane") % 2 == 0).select(
            self.lanes.relation().alias("rel"),
            self.lanes.end_type().alias("i"),
            F.col("x").alias("row"),
            self.lanes.end_type(1).alias("j"),
            F.col("y").alias("col"),
            *[_weight(self.arcs, k).alias(w) for k, w in enumerate(_weights(self.classes))],
        )
        if "part" not in self.arcs.columns:
            # Arcs as `run` leaves them: equal edges are not added up yet.
            weights = [F.sum(w).alias(w) for w in _weights(self.classes)]
            written = written.groupBy("rel", "i", "row", "j", "col").agg(*weights)
        if self.weighed is None:
            return written
        ranks, t = self.weighed
        return reweight(written, ranks, self.classes, t)


def _p(k: int) -> str:
    return f"p{k}"


def initial_ranks(items: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """Start ranks ``(m, x, p0 ..)``.

    ``items(m, x)`` are all nodes, ``labels(m, x, k)`` the known classes.  A
    labelled node gets one over the number of labels of its class and type;
    a label row that occurs twice for the same node and class gives 0.
    """
    sizes = labels.groupBy("m", "k").agg(F.count(F.lit(1)).alias("_size"))
    once = labels.groupBy("m", "x", "k").agg(F.count(F.lit(1)).alias("_copies"))
    # (types x classes) rows: the number of classes and types bounds it.
    known = once.where(F.col("_copies") == 1).join(F.broadcast(sizes), ["m", "k"])
    per_item = known.groupBy("m", "x").agg(
        *[
            F.max(F.when(F.col("k") == k, 1.0 / F.col("_size"))).alias(_p(k))
            for k in range(classes)
        ]
    )
    joined = items.select("m", "x").distinct().join(per_item, ["m", "x"], "left")
    return joined.select(
        "m", "x", *[F.coalesce(F.col(_p(k)), F.lit(0.0)).alias(_p(k)) for k in range(classes)]
    )


def ambiguous_labels(labels: DataFrame) -> DataFrame:
    """Nodes whose label row occurs more than once; they start from 0."""
    return (
        labels.groupBy("m", "x", "k")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def relation_table(edges: DataFrame, classes: int) -> DataFrame:
    """``edges(rel, i, row, j, col, w)`` with one weight per class.

    Duplicate edges add up.  They meet in as many tasks as their number asks for, without sums before: those would hold
    nearly all edges of an input file in memory, as few occur twice.
    """
    merged = spread(edges, ["rel", "i", "row", "j", "col"]).groupBy("rel", "i", "row", "j", "col").agg(F.sum("w").alias("w"))
    return merged.select(
        "rel", "i", "row", "j", "col", *[F.col("w").alias(f"w{k}") for k in range(classes)]
    )


def tall_ranks(ranks: DataFrame, classes: int) -> DataFrame:
    """``(k, m, x, p)``."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(_p(k)).alias("p")) for k in range(classes)])
    return ranks.select("m", "x", F.inline(cells)).select("k", "m", "x", "p")


def tall_relations(
    relations: DataFrame, classes: int, kept: Sequence[str] = ("rel", "i", "row", "j", "col")
) -> DataFrame:
    """``(k, rel, i, row, j, col, w)`` in the stored direction; ``kept`` are the columns beside class and weight."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"w{k}").alias("w")) for k in range(classes)])
    return relations.select(*kept, F.inline(cells)).select("k", *kept, "w")


def normalize_relations(relations: DataFrame, classes: int) -> DataFrame:
    """``S = Drow^-1/2 W Dcol^-1/2`` per relation and class, as ``s0 ..``."""
    weights = [f"w{k}" for k in range(classes)]
    rows = relations.groupBy("rel", "row").agg(
        *[F.sum(w).alias(f"_r{k}") for k, w in enumerate(weights)]
    )
    cols = relations.groupBy("rel", "col").agg(
        *[F.sum(w).alias(f"_c{k}") for k, w in enumerate(weights)]
    )
    joined = relations.join(rows, ["rel", "row"]).join(cols, ["rel", "col"])

    kept = [c for c in relations.columns]
    return joined.select(*kept, *[_scaled(k).alias(f"s{k}") for k in range(classes)])


def update_ranks(
    normalized: DataFrame,
    ranks: DataFrame,
    initial: DataFrame,
    classes: int,
    types: int,
    lam: float = LAMBDA,
    alpha: float = ALPHA,
    lambda_weighted: bool = False,
) -> DataFrame:
    """``(sum_j S[i,j] p[j] + alpha p0) / (types * lam + alpha)``.

    ``lambda_weighted`` also multiplies the neighbour sum by ``lam``.  Each
    edge feeds both of its ends.
    """
    ends = _with_end_ranks(normalized, ranks, classes)
    to_row = F.struct(
        F.col("i").alias("m"),
        F.col("row").alias("x"),
        *[_mass(F.col(f"s{k}"), f"_q{k}").alias(f"_a{k}") for k in range(classes)],
    )
    to_col = F.struct(
        F.col("j").alias("m"),
        F.col("col").alias("x"),
        *[_mass(F.col(f"s{k}"), f"_p{k}").alias(f"_a{k}") for k in range(classes)],
    )
    gathered = (
        ends.select(F.inline(F.array(to_row, to_col)))
        .groupBy("m", "x")
        .agg(*[F.sum(f"_a{k}").alias(f"_a{k}") for k in range(classes)])
    )
    return _mixed(gathered, initial, classes, types, lam, alpha, lambda_weighted)


def _mixed(
    gathered: DataFrame,
    initial: DataFrame,
    classes: int,
    types: int,
    lam: float,
    alpha: float,
    lambda_weighted: bool,
) -> DataFrame:
    """New ranks from the neighbour sums ``(m, x, _a0 ..)`` and the start ranks."""
    factor = lam if lambda_weighted else 1.0
    divisor = types * lam + alpha
    return initial.join(gathered, ["m", "x"], "left").select(
        "m",
        "x",
        *[
            (
                (F.coalesce(F.col(f"_a{k}"), F.lit(0.0)) * factor + F.col(_p(k)) * alpha) / divisor
            ).alias(_p(k))
            for k in range(classes)
        ],
    )


def _scaled(k: int) -> Column:
    degrees = F.col(f"_r{k}") * F.col(f"_c{k}")
    return F.when(degrees > 0, F.col(f"w{k}") / F.sqrt(degrees)).otherwise(F.lit(0.0))


def _mass(weight: Column, rank: str) -> Column:
    """Neighbours without a positive rank add nothing."""
    return F.when(F.col(rank) > 0, weight * F.col(rank)).otherwise(F.lit(0.0))


def _with_end_ranks(edges: DataFrame, ranks: DataFrame, classes: int) -> DataFrame:
    """Add the ranks of both ends: ``_p{k}`` at the row, ``_q{k}`` at the column."""
    at_row = ranks.select(
        F.col("m").alias("i"), F.col("x").alias("row"), *[F.col(_p(k)).alias(f"_p{k}") for k in range(classes)]
    )
    at_col = ranks.select(
        F.col("m").alias("j"), F.col("x").alias("col"), *[F.col(_p(k)).alias(f"_q{k}") for k in range(classes)]
    )
    return edges.join(at_row, ["i", "row"]).join(at_col, ["j", "col"])


def relative_ranks(ranks: DataFrame, classes: int) -> DataFrame:
    """Ranks over the largest rank of their type and class; 0 where that is 0."""
    # One row per object type.
    largest = ranks.groupBy("m").agg(*[F.max(_p(k)).alias(f"_max{k}") for k in range(classes)])
    return ranks.join(F.broadcast(largest), "m").select(
        "m",
        "x",
        *[
            F.when(F.col(f"_max{k}") > 0, F.col(_p(k)) / F.col(f"_max{k}")).otherwise(F.lit(0.0)).alias(_p(k))
            for k in range(classes)
        ],
    )


def reweight(relations: DataFrame, ranks: DataFrame, classes: int, t: int) -> DataFrame:
    """``W' = W (sqrt(p_i / max_i * p_j / max_j) + 2^-t)``.

    The ratio is 0 for a class and type whose largest rank is 0.
    """
    relative = relative_ranks(ranks, classes)
    ends = _with_end_ranks(relations, relative, classes)
    floor = 2.0 ** -t
    return ends.select(
        "rel", "i", "row", "j", "col",
        *[
            (F.col(f"w{k}") * (F.sqrt(F.col(f"_p{k}") * F.col(f"_q{k}")) + floor)).alias(f"w{k}")
            for k in range(classes)
        ],
    )


def arc_table(
    relations: DataFrame, lanes: Lanes, classes: int, cell: int = HOT_ARCS, edges: DataFrame | None = None
) -> DataFrame:
    """Both directions of every edge, written in buckets by their near end.

    An arc ``(lane, x, part, y, far_part, w0 ..)`` leads from item ``x`` on a
    side of a relation to item ``y`` on its other side.  An end with more than
    ``cell`` edges is cut into parts by a hash of the other end, so no bucket
    holds a whole hot item.  ``edges`` are what ``relations`` adds up; its rows
    are counted in their place, which bounds theirs.
    """
    return _cut_arcs(relations, lanes, classes, cell, edges)[0]


def _cut_arcs(
    relations: DataFrame, lanes: Lanes, classes: int, cell: int, edges: DataFrame | None
) -> tuple[DataFrame, bool]:
    """The `arc_table`, and whether any end is cut into parts."""
    lane = lanes.lane()
    weights = [w for w in _weights(classes) if w in relations.columns]
    row_end = F.struct(lane.alias("lane"), F.col("row").alias("x"))
    col_end = F.struct((lane + 1).alias("lane"), F.col("col").alias("x"))
    hot = materialize(
        (relations if edges is None else edges)
        .select(F.inline(F.array(row_end, col_end)))
        .groupBy("lane", "x")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > cell)
        .select("lane", "x", F.ceil(F.col("_n") / cell).cast("int").alias("_parts")),
        "hot-ends",
    )
    zero = F.lit(0)
    cut = relations.select(lane.alias("lane"), "row", "col", zero.alias("_row"), zero.alias("_col"), *weights)
    parted = not hot.isEmpty()
    if parted:
        known = broadcast_if_small(hot)
        for side, x, other in ((0, "row", "col"), (1, "col", "row")):
            own = known.where(F.col("lane") % 2 == side).select(
                (F.col("lane") - side).alias("lane"), F.col("x").alias(x), "_parts"
            )
            place = F.pmod(F.xxhash64(other), F.col("_parts")).cast("int")
            cut = cut.join(own, ["lane", x], "left").withColumn(f"_{x}", F.coalesce(place, zero)).drop("_parts")

    def arc(side: int, *ends: str) -> Column:
        return F.struct((F.col("lane") + side).alias("lane"), *[F.col(e).alias(n) for e, n in zip(ends, _ARC[1:])])

    both = F.array(arc(0, "row", "_row", "col", "_col"), arc(1, "col", "_col", "row", "_row"))
    written = materialize_buckets(cut.select(F.inline(both), *weights), NEAR, "arcs")
    discard(hot)
    return written, parted


def _weights(classes: int) -> list[str]:
    return [f"w{k}" for k in range(classes)]


def _weight(arcs: DataFrame, k: int, prefix: str = "w") -> Column:
    """The weight of class ``k``, or the one that all classes share."""
    name = f"{prefix}{k}"
    return F.col(name if name in arcs.columns else f"{prefix}0")


def _at_ends(arcs: DataFrame, ends: DataFrame) -> DataFrame:
    """Join on the near end.  An end is one row, so its side is hashed bucket by bucket and the arcs are not sorted."""
    return arcs.join(ends.hint("shuffle_hash"), NEAR)


def end_table(arcs: DataFrame, lanes: Lanes, ranks: DataFrame, classes: int, parted: bool = True) -> DataFrame:
    """Degrees and ranks at every part of every end: ``(lane, x, part, m, d0 .., p0 ..)``.

    Sums per part come from the buckets as they lie; only these move.  Without ``parted`` a part is a whole end.
    """
    weights = [w for w in _weights(classes) if w in arcs.columns]
    sums = arcs.groupBy(*NEAR).agg(*[F.sum(w).alias(w) for w in weights])
    whole = Window.partitionBy(*NEAR[:-1])
    degrees = [(F.sum(w).over(whole) if parted else F.col(w)).alias(f"d{k}") for k, w in enumerate(weights)]
    return sums.select(*NEAR, lanes.end_type().alias("m"), *degrees).join(ranks, ["m", "x"])


def pass_ranks(
    arcs: DataFrame,
    ends: DataFrame,
    initial: DataFrame,
    classes: int,
    types: int,
    lam: float = LAMBDA,
    alpha: float = ALPHA,
    lambda_weighted: bool = False,
) -> DataFrame:
    """`normalize_relations` and `update_ranks` over arcs and a written `end_table`.

    ``W[i,j] / sqrt(d[i] d[j])`` splits into a factor of each end: an arc
    takes that of its near end where it lies, and the far one is taken once
    per sum that arrives there.  Ends without a positive rank send nothing.
    """

    def factor(k: int) -> Column:
        degree = _weight(ends, k, "d")
        return F.when(degree > 0, 1.0 / F.sqrt(degree)).otherwise(F.lit(0.0))

    ranked = reduce(Column.__or__, [F.col(_p(k)) > 0 for k in range(classes)])
    sent = ends.where(ranked).select(
        *NEAR, *[_mass(factor(k), _p(k)).alias(f"_s{k}") for k in range(classes)]
    )
    taken = ends.select(*NEAR, "m", *[factor(k).alias(f"_f{k}") for k in range(classes)])
    arrived = (
        _at_ends(arcs, sent)
        .groupBy(*_far())
        .agg(*[F.sum(_weight(arcs, k) * F.col(f"_s{k}")).alias(f"_a{k}") for k in range(classes)])
    )
    gathered = (
        _at_ends(arrived, taken)
        .groupBy("m", "x")
        .agg(*[F.sum(F.col(f"_a{k}") * F.col(f"_f{k}")).alias(f"_a{k}") for k in range(classes)])
    )
    return _mixed(gathered, initial, classes, types, lam, alpha, lambda_weighted)


def _far() -> list[Column]:
    """The near key of the same edge's other arc."""
    return [
        F.col("lane").bitwiseXOR(F.lit(1)).alias("lane"),
        F.col("y").alias("x"),
        F.col("far_part").alias("part"),
    ]


def reweight_arcs(
    arcs: DataFrame, ends: DataFrame, ranks: DataFrame, classes: int, t: int, one_way: bool = False
) -> DataFrame:
    """`reweight` over arcs, not yet written.

    An arc takes the rank of its near end where it lies, is turned round and
    moved once to its other end, and lies there as the arc of that end.  With
    ``one_way`` only the arcs from row to column are made, each edge once.
    """
    relative = relative_ranks(ranks, classes)
    at_end = ends.select(*NEAR, "m").join(relative, ["m", "x"])
    near = at_end.select(*NEAR, *[F.col(_p(k)).alias(f"_p{k}") for k in range(classes)])
    far = at_end.select(*NEAR, *[F.col(_p(k)).alias(f"_q{k}") for k in range(classes)])
    if one_way:
        arcs, near, far = (df.where(F.col("lane") % 2 == side) for df, side in ((arcs, 1), (near, 1), (far, 0)))
    turned = _at_ends(arcs, near).select(
        *_far(),
        F.col("x").alias("y"),
        F.col("part").alias("far_part"),
        *[w for w in _weights(classes) if w in arcs.columns],
        *[f"_p{k}" for k in range(classes)],
    )
    floor = 2.0 ** -t
    return _at_ends(by_bucket(turned, NEAR), far).select(
        *_ARC,
        *[
            (_weight(turned, k) * (F.sqrt(F.col(f"_p{k}") * F.col(f"_q{k}")) + floor)).alias(f"w{k}")
            for k in range(classes)
        ],
    )


def start(
    items: DataFrame, labels: DataFrame, edges: DataFrame, classes: int, types: int, cell: int = HOT_ARCS
) -> State:
    """Start ranks and arcs.  ``edges`` is read three times: give a table or a short lineage."""
    first = materialize(initial_ranks(items, labels, classes), "ranks")
    lanes = Lanes.of(edges)
    # At first all classes share one weight.
    arcs, parted = _cut_arcs(relation_table(edges, 1), lanes, 1, cell, edges)
    return State(classes, types, first, first, arcs, lanes, parted=parted)


def step(
    state: State,
    lam: float = LAMBDA,
    alpha: float = ALPHA,
    lambda_weighted: bool = False,
    only_relations: Sequence[str] | None = None,
    reweighted: bool = True,
    one_way: bool = False,
) -> State:
    """One round: ranks from the normalised relations, then new weights.

    Arcs are read from their buckets and moved once, for new weights; all
    else that moves is sums and ranks of items.  Both results are written, so
    the plan of a later round does not grow.  ``only_relations`` limits the
    rank update (not the re-weighting).  Without ``reweighted`` the weights
    stay those the ranks come from, which is all a last round needs; with
    ``one_way`` the new ones are made once per edge, which is all that
    `State.relations` needs, and no round can follow.
    """
    if state.one_way:
        raise ValueError("the arcs lie at their rows alone; no round can follow")
    if "part" not in state.arcs.columns:
        # Arcs as `run` leaves them.
        now = materialize(state.relations, "edges")
        arcs, parted = _cut_arcs(now, state.lanes, state.classes, HOT_ARCS, None)
        discard(now)
        state = replace(state, arcs=arcs, parted=parted, weighed=None)
    t = state.round + 1
    arcs = state.arcs
    table = end_table(arcs, state.lanes, state.ranks, state.classes, state.parted)
    ends = materialize_buckets(table, NEAR, "ends")
    used = arcs if only_relations is None else arcs.where(F.col("lane").isin(state.lanes.numbers(only_relations)))
    ranks = materialize(
        pass_ranks(used, ends, state.initial, state.classes, state.types, lam, alpha, lambda_weighted), "ranks"
    )
    if reweighted:
        new = reweight_arcs(arcs, ends, ranks, state.classes, t, one_way)
        arcs = materialize_buckets(new, NEAR, "arcs", placed=True)
    discard(ends)
    return replace(state, ranks=ranks, arcs=arcs, round=t, one_way=reweighted and one_way)


def run(
    items: DataFrame,
    labels: DataFrame,
    edges: DataFrame,
    classes: int = 4,
    types: int = 4,
    rounds: int = 2,
    first_relation: str | None = None,
    last_weights: bool = False,
    **options: object,
) -> State:
    """The whole loop.

    The weights of the result are those its ranks come from, or with ``last_weights`` new ones made from the ranks.

    ``first_relation`` limits the rank update of round 1 to one relation, for
    comparison with results that were computed that way.

    Up to two rounds read arcs that are written once (`rankstill`), unless an end is hot, a weight negative or an end
    not among the items.
    """
    if 1 <= rounds <= 2 and not last_weights:
        state = _run_still(items, labels, edges, classes, types, rounds, first_relation, **options)
        if state is not None:
            return state
    state = start(items, labels, edges, classes, types)
    for t in range(1, rounds + 1):
        only = [first_relation] if first_relation and t == 1 else None
        before = state
        state = step(state, only_relations=only, reweighted=t < rounds or last_weights, **options)
        if state.arcs is not before.arcs:
            discard(before.arcs)
        if before.ranks is not before.initial:
            discard(before.ranks)
    return state


def _run_still(
    items: DataFrame,
    labels: DataFrame,
    edges: DataFrame,
    classes: int,
    types: int,
    rounds: int,
    first_relation: str | None,
    lam: float = LAMBDA,
    alpha: float = ALPHA,
    lambda_weighted: bool = False,
    only_relations: Sequence[str] | None = None,
) -> State | None:
    """`run` over arcs that stay where they are, or nothing if they must be cut or their ends are not all items."""
    lanes = Lanes.of(edges)
    number = rankstill.arcs_if_still(edges, lanes, HOT_ARCS) if lanes.relations else None
    if number is None:
        return None
    buckets = max(by_default(edges.sparkSession), -(-number // ARCS_OF_TASK))
    arcs = rankstill.place(edges, lanes, buckets, number)
    known = rankstill.nodes(arcs, lanes, initial_ranks(items, labels, classes), classes, buckets)
    if not known.where(~F.col("known")).isEmpty():
        discard(arcs)
        discard(known)
        return None
    initial = known.select("m", "x", *[_p(k) for k in range(classes)])
    ranks, before, written = initial, None, None
    for t in range(1, rounds + 1):
        if t == 1:
            ends = rankstill.first_ends(known, classes)
        else:
            before = ranks
            ends = written = rankstill.weighted_degrees(arcs, known, ranks, lanes, classes, t - 1, buckets, number)
        names = only_relations if only_relations is not None else [first_relation] if first_relation and t == 1 else None
        only = None if names is None else lanes.numbers(names)
        sums = rankstill.neighbour_sums(arcs, ends, lanes, classes, buckets, only, None if t == 1 else t - 1, number)
        given = [rankstill.of_turn(initial, turn, len(sums), buckets) for turn in range(len(sums))]
        ranks = materialize_rounds(
            lambda turn: _mixed(sums[turn](), given[turn], classes, types, lam, alpha, lambda_weighted),  # noqa: B023
            len(sums), rankstill.NODE, "ranks", True, buckets,
        )
    if written is not None:
        discard(written)
    return State(classes, types, initial, ranks, arcs, lanes, rounds, False, weighed=None if before is None else (before, rounds - 1))


def assign_classes(ranks: DataFrame, classes: int) -> DataFrame:
    """The class of highest rank per node, lowest class on a tie.

    Nodes whose ranks are all 0 have no class and are left out.
    """
    best = F.greatest(*[F.col(_p(k)) for k in range(classes)]) if classes > 1 else F.col(_p(0))
    lowest = F.coalesce(*[F.when(F.col(_p(k)) == F.col("p"), F.lit(k)) for k in range(classes)])
    return ranks.select("*", best.alias("p")).where(F.col("p") > 0).select("m", "x", lowest.alias("k"), "p")


def relation_dimensions(relations: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Number of distinct rows, columns and cells per relation.

    The ends of all cells move to as many tasks as their number asks for, not as the session has for a shuffle, and
    are made distinct there; those of a hot slot are cut into parts, each of which may name an end once more.
    ``edges`` are what ``relations`` adds up; they are counted in its place, which bounds its cells.
    """
    kinds = relations.schema
    number, hot = _hot_slots(relations if edges is None else edges)
    slots = [s for s, _ in hot]
    parts = -(-max((n for _, n in hot), default=0) // END_ROWS)

    def listed(own: str, other: str) -> Column:
        none = F.lit(None).cast(kinds[other].dataType)
        part = F.when(_slot(own).isin(slots), F.pmod(F.xxhash64(other), F.lit(parts))) if slots else F.lit(None).cast("long")
        ends = {own: F.col(own), other: none}
        return F.struct(F.lit(own == "row").alias("at_row"), *[ends[c].alias(c) for c in ("row", "col")], part.alias("part"))

    end = ["rel", "at_row", "row", "col", "part"]
    both = relations.select("rel", F.inline(F.array(listed("row", "col"), listed("col", "row"))))
    found = spread(both, end, END_ROWS, 2 * number).groupBy(*end).agg(F.count(F.lit(1)).alias("_cells"))
    # Ends that are whole add up where they lie; only those in parts keep their names.
    cut = [F.when(F.col("part").isNotNull(), F.col(c)).alias(f"_{c}") for c in ("row", "col")]
    named = found.groupBy("rel", "at_row", F.col("part").isNotNull().alias("_cut"), *cut).agg(
        F.count("row").alias("row"),
        F.count("col").alias("col"),
        F.sum("_cells").alias("_cells"),
    )
    return named.groupBy("rel").agg(
        *[
            F.sum(F.when(F.col("_cut"), F.least(F.col(c), F.lit(1))).otherwise(F.col(c))).alias(f"num_{c}s")
            for c in ("row", "col")
        ],
        F.sum(F.when(F.col("at_row"), F.col("_cells"))).alias("num_cells"),
    )


def _slot(end: str) -> Column:
    return F.pmod(F.xxhash64("rel", F.lit(end == "row"), end), F.lit(END_SLOTS)).cast("int")


def _hot_slots(edges: DataFrame) -> tuple[int, list[tuple[int, int]]]:
    """The number of edges, and the slots of ends that hold many more than others, with their edges.

    A slot with a hot end is among them.  There are at most as many as there are tasks of ends.
    """
    number = edges.count()
    usual = 2 * (2 * number // END_SLOTS)
    slots = F.array(_slot("row"), _slot("col"))
    sizes = edges.select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    return number, [(r["slot"], r["n"]) for r in sizes.where(F.col("n") > END_ROWS + usual).collect()]
