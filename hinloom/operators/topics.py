"""Topic models as tables: one row per term and per document, each with its expected count in every topic.

Smoothed by Dirichlet priors and fitted by expectation maximisation of the posterior.  Neither vocabulary nor documents
come to the driver, and terms keep their own names: the driver sees one number per topic.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.operators.ordering import top_k_per_key
from hinloom.runtime import BROADCAST_ROWS, broadcast_if_small, by_bucket, discard, materialize, materialize_buckets
from hinloom.sources.generators import keyed_uniform


@dataclass(frozen=True)
class TopicTable:
    """``terms(term, n)`` and ``docs(doc, n)`` with an array of expected counts by topic; ``totals`` sums those of the terms."""

    terms: DataFrame
    docs: DataFrame
    totals: tuple[float, ...]
    vocabulary: int
    doc_prior: float
    term_prior: float

    @property
    def k(self) -> int:
        return len(self.totals)

    def term_shares(self, counts: str = "n") -> list[Column]:
        """Smoothed probability of a term in each topic."""
        e = self.term_prior - 1
        return [(F.col(counts)[c] + e) / (self.totals[c] + self.vocabulary * e) for c in range(self.k)]

    def doc_shares(self, counts: str = "n") -> list[Column]:
        """Smoothed share of each topic in a document."""
        a = self.doc_prior - 1
        size = sum((F.col(counts)[c] for c in range(self.k)), F.lit(0.0)) + self.k * a
        return [(F.col(counts)[c] + a) / size for c in range(self.k)]


def term_counts(docs: DataFrame, doc: str, words: str, placed: bool = False) -> DataFrame:
    """Cells ``(doc, term, count)`` of an array of words; a null array has none, null words and documents are left out.

    Whole arrays move to the bucket of their document, or are ``placed`` there already; their cells stay there.
    """
    texts = docs.select(F.col(doc).alias("doc"), F.col(words).alias("_words"))
    texts = texts if placed else by_bucket(texts, ["doc"])
    terms = texts.select("doc", F.explode("_words").alias("term")).dropna()
    return terms.groupBy("doc", "term").agg(F.count(F.lit(1)).cast("double").alias("count"))


@dataclass(frozen=True)
class PlacedCells:
    """Written cells: ``all`` in buckets of their document, and those of ``rare`` terms also in buckets of their term.

    The names of the other terms, ``often``, fit a broadcast; ``rare`` is None where there are no more.
    """

    often: DataFrame
    all: DataFrame
    rare: DataFrame | None

    def discard(self) -> None:
        for part in (self.often, self.all, self.rare):
            if part is not None:
                discard(part)


# Cells of a term from here on are not told apart in finding the terms most cells have.
_MOST_CELLS = 1 << 14


def place_cells(cells: DataFrame, k: int, placed: bool = False) -> PlacedCells:
    """Cells as `em_round` needs them, for models of ``k`` topics; ``placed`` says they come from `term_counts` as they are.

    Few terms have most cells.  As many of the most frequent as fit a broadcast meet their cells where those lie, by
    document, in every round, and only the cells of the others move.
    """
    rows = materialize_buckets(cells.select("doc", "term", "count"), ["doc"], "cells", placed)
    sizes = materialize(rows.groupBy("term").agg(F.count(F.lit(1)).alias("_cells")), "term-cells")
    held = sizes.groupBy(F.least("_cells", F.lit(_MOST_CELLS)).alias("_cells")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, room = _MOST_CELLS + 1, BROADCAST_ROWS * 8 // k
    for size, n in sorted(held, reverse=True):
        room -= n
        if room < 0:
            break
        least = size
    often = materialize(sizes.where(F.col("_cells") >= least).select("term") if least <= _MOST_CELLS else sizes.limit(0).select("term"), "often")
    discard(sizes)
    if room >= 0:
        return PlacedCells(often, rows, None)
    rare = rows.join(F.broadcast(often), "term", "left_anti").select("doc", "term", "count")
    return PlacedCells(often, rows, materialize_buckets(rare, ["term"], "rare"))


def _expected(weighted: DataFrame, k: int, doc_prior: float, term_prior: float) -> TopicTable:
    """Split each cell's count by its weights ``w_0`` .. and add up by document and by term in one pass.

    Both sums are combined map side; what moves is one row per document and per term of a task.
    """
    size = sum((F.col(f"w_{c}") for c in range(k)), F.lit(0.0))
    parts = weighted.withColumn("_share", F.col("count") / size)
    sums = [F.sum(F.col(f"w_{c}") * F.col("_share")).alias(f"n_{c}") for c in range(k)]
    both = parts.groupingSets([["doc"], ["term"]], "doc", "term").agg(F.grouping("doc").alias("of_term"), *sums)
    written = materialize(
        both.select("doc", "term", "of_term", F.array(*[F.col(f"n_{c}") for c in range(k)]).alias("n")), "topics"
    )
    terms = written.where("of_term = 1").select("term", "n")
    docs = written.where("of_term = 0").select("doc", "n")
    found = terms.agg(F.count(F.lit(1)), *[F.sum(F.col("n")[c]) for c in range(k)]).first()
    return TopicTable(terms, docs, tuple(v or 0.0 for v in found[1:]), found[0], doc_prior, term_prior)


def first_topics(
    cells: DataFrame,
    k: int = 10,
    doc_prior: float | None = None,
    term_prior: float | None = None,
    seed: int = 42,
    weights: Sequence[Column] | None = None,
) -> TopicTable:
    """Expected counts under starting weights of every cell: a positive column per topic, by default draws by document and term.

    Priors are above 1, by default ``50 / k + 1`` for documents and 1.1 for terms.
    """
    doc_prior = 50.0 / k + 1 if doc_prior is None else doc_prior
    term_prior = 1.1 if term_prior is None else term_prior
    if doc_prior <= 1 or term_prior <= 1:
        raise ValueError("priors are above 1")
    if k < 2:
        raise ValueError("at least two topics")
    if weights is None:
        weights = [keyed_uniform(F.struct("doc", "term"), seed + c) + 1e-3 for c in range(k)]
    started = cells.select("doc", "term", "count", *[w.alias(f"w_{c}") for c, w in enumerate(weights)])
    return _expected(started, k, doc_prior, term_prior)


def _matched(cells: DataFrame | PlacedCells, table: TopicTable, docs: DataFrame) -> DataFrame:
    """Cells with the counts of their term (``_t``) and of their document (``_d``).

    Placed cells of the frequent terms stay where they lie: those terms are broadcast, and their cells are in buckets by
    document.  Where the term table fits a broadcast other cells move once, by document; else by term, too.
    """
    own = docs.select("doc", F.col("n").alias("_d"))
    all_terms = table.terms.select("term", F.col("n").alias("_t"))
    if isinstance(cells, PlacedCells):
        often = F.broadcast(all_terms.join(F.broadcast(cells.often), "term", "left_semi"))
        met = cells.all.join(own, "doc").join(often, "term")
        if cells.rare is None:
            return met
        return met.unionByName(cells.rare.join(all_terms, "term").join(own, "doc"))
    terms = broadcast_if_small(all_terms, BROADCAST_ROWS * 8 // table.k)
    return cells.join(terms, "term").join(own, "doc")


def em_round(cells: DataFrame | PlacedCells, table: TopicTable) -> TopicTable:
    """Expected counts after one more step over ``cells(doc, term, count)``; write or place the cells before."""
    shares = zip(table.term_shares("_t"), table.doc_shares("_d"), strict=True)
    weighted = _matched(cells, table, table.docs).select(
        "doc", "term", "count", *[(t * d).alias(f"w_{c}") for c, (t, d) in enumerate(shares)]
    )
    return _expected(weighted, table.k, table.doc_prior, table.term_prior)


def fit_topics(
    cells: DataFrame | PlacedCells,
    k: int = 10,
    iterations: int = 20,
    doc_prior: float | None = None,
    term_prior: float | None = None,
    seed: int = 42,
    weights: Sequence[Column] | None = None,
) -> TopicTable:
    """``iterations`` steps from the starting weights; the tables a step replaces are deleted."""
    placed = cells if isinstance(cells, PlacedCells) else place_cells(cells, k)
    table = first_topics(placed.all, k, doc_prior, term_prior, seed, weights)
    for _ in range(iterations):
        after = em_round(placed, table)
        discard(table.terms)
        table = after
    if placed is not cells:
        placed.discard()
    return table


def table_terms(table: TopicTable, n: int) -> DataFrame:
    """``(topic, rank, term, weight)``: the terms with the largest share of a topic's expected count; ties by term."""
    shares = [
        F.struct(F.lit(c).alias("topic"), (F.col("n")[c] / total).alias("weight")) for c, total in enumerate(table.totals)
    ]
    long = table.terms.select("term", F.inline(F.array(*shares))).where("weight > 0")
    return top_k_per_key(long, ["topic"], [F.desc("weight"), F.col("term")], n)


def table_mix(table: TopicTable, docs: DataFrame | None = None) -> DataFrame:
    """``(doc, topic, weight)``: each topic's share of a document's expected counts, for `top_documents` and `top_topics`."""
    rows = table.docs if docs is None else docs
    size = sum((F.col("n")[c] for c in range(table.k)), F.lit(0.0))
    return rows.select("doc", F.posexplode(F.transform("n", lambda v: v / size)).alias("topic", "weight"))


def fold_in(cells: DataFrame, table: TopicTable, rounds: int = 20) -> DataFrame:
    """``docs(doc, n)`` of other documents on fixed topics, from an equal share of each.

    Terms the table does not know are left out; a document without a known term has no row.
    """
    k = table.k
    terms = broadcast_if_small(table.terms.select("term", F.array(*table.term_shares()).alias("_t")), BROADCAST_ROWS * 8 // k)
    known = materialize_buckets(cells.join(terms, "term").select("doc", "count", "_t"), ["doc"], "known")
    docs = known.groupBy("doc").agg(F.sum("count").alias("s")).select("doc", F.array_repeat(F.col("s") / k, k).alias("n"))
    for turn in range(rounds):
        mixed = known.join(docs.select("doc", F.array(*table.doc_shares()).alias("_d")), "doc")
        weighted = mixed.select("doc", "count", *[(F.col("_t")[c] * F.col("_d")[c]).alias(f"w_{c}") for c in range(k)])
        shared = weighted.withColumn("_share", F.col("count") / sum((F.col(f"w_{c}") for c in range(k)), F.lit(0.0)))
        sums = shared.groupBy("doc").agg(F.array(*[F.sum(F.col(f"w_{c}") * F.col("_share")) for c in range(k)]).alias("n"))
        before, docs = docs, materialize(sums, "folded")
        if turn:
            discard(before)
    return docs


def table_quality(cells: DataFrame | PlacedCells, table: TopicTable) -> DataFrame:
    """One row: ``log_likelihood`` of the cells, ``log_prior`` of the smoothed shares, and ``perplexity`` per word."""
    chance = sum((t * d for t, d in zip(table.term_shares("_t"), table.doc_shares("_d"), strict=True)), F.lit(0.0))
    likelihood = _matched(cells, table, table.docs).agg(
        F.sum(F.col("count") * F.log(chance)).alias("fit"), F.sum("count").alias("words"), F.lit(0.0).alias("prior")
    )

    def prior(rows: DataFrame, shares: list[Column], strength: float) -> DataFrame:
        logs = sum((F.log(s) for s in shares), F.lit(0.0))
        return rows.agg(F.lit(0.0).alias("fit"), F.lit(0.0).alias("words"), F.sum(logs * (strength - 1)).alias("prior"))

    parts = likelihood.unionByName(prior(table.terms, table.term_shares(), table.term_prior)).unionByName(
        prior(table.docs, table.doc_shares(), table.doc_prior)
    )
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns]).select(
        F.col("fit").alias("log_likelihood"), F.col("prior").alias("log_prior"), F.exp(-F.col("fit") / F.col("words")).alias("perplexity")
    )
