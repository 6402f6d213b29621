import numpy as np
import pytest
from pyspark.sql import functions as F

from hinloom.operators import clustering, topics

TEXTS = {1: "a b a c", 2: "c d d", 3: "a", 4: "e f e f f", 5: "e f a", 6: ""}
K, A, E = 2, 1.5, 1.2


def cells_of(spark, texts):
    rows = [(d, None if t is None else t.split()) for d, t in texts.items()]
    return topics.term_counts(spark.createDataFrame(rows, "d long, w array<string>"), "d", "w")


def start():
    # Any positive function of the two keys.
    first = F.length(F.concat("term", F.col("doc").cast("string"))) + F.ascii("term") % 5 + F.col("doc") % 3
    return [first.cast("double"), (F.ascii("term") % 3 + 1).cast("double")]


def weight(c, doc, term):
    if c == 0:
        return float(len(term + str(doc)) + ord(term[0]) % 5 + doc % 3)
    return float(ord(term[0]) % 3 + 1)


def by_hand(texts, rounds):
    cells = {}
    for d, t in texts.items():
        for x in t.split():
            cells[d, x] = cells.get((d, x), 0) + 1
    shares = {key: np.array([weight(c, *key) for c in range(K)]) for key in cells}
    for turn in range(rounds + 1):
        terms, docs = {}, {}
        for (d, x), n in cells.items():
            part = n * shares[d, x] / shares[d, x].sum()
            terms[x] = terms.get(x, 0) + part
            docs[d] = docs.get(d, 0) + part
        totals = sum(terms.values())
        phi = {x: (v + E - 1) / (totals + len(terms) * (E - 1)) for x, v in terms.items()}
        theta = {d: (v + A - 1) / (v + A - 1).sum() for d, v in docs.items()}
        shares = {(d, x): phi[x] * theta[d] for d, x in cells}
    fit = sum(n * np.log(phi[x] @ theta[d]) for (d, x), n in cells.items())
    prior = (E - 1) * sum(np.log(v).sum() for v in phi.values()) + (A - 1) * sum(np.log(v).sum() for v in theta.values())
    return terms, docs, phi, fit, prior


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_rounds_equal_a_loop(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(topics, "BROADCAST_ROWS", broadcast_rows)
    cells = cells_of(spark, TEXTS).persist()
    for rounds in (0, 3):
        table = topics.fit_topics(cells, K, rounds, A, E, weights=start())
        terms, docs, _, fit, prior = by_hand(TEXTS, rounds)
        got_terms = {r["term"]: r["n"] for r in table.terms.collect()}
        got_docs = {r["doc"]: r["n"] for r in table.docs.collect()}
        assert set(got_terms) == set(terms) and set(got_docs) == set(docs)
        for key, value in terms.items():
            assert got_terms[key] == pytest.approx(value.tolist())
        for key, value in docs.items():
            assert got_docs[key] == pytest.approx(value.tolist())
        assert table.vocabulary == len(terms) and sum(table.totals) == pytest.approx(16)
        quality = topics.table_quality(cells, table).first()
        assert quality["log_likelihood"] == pytest.approx(fit) and quality["log_prior"] == pytest.approx(prior)
        assert quality["perplexity"] == pytest.approx(np.exp(-fit / 16))


def test_posterior_rises_and_topics_part(spark):
    texts = {d: ("red blue green " * (d % 4 + 1) if d % 2 else "salt sugar flour " * (d % 3 + 1)) for d in range(24)}
    cells = cells_of(spark, texts).persist()
    scores = []
    for rounds in (0, 4, 12):
        table = topics.fit_topics(cells, 2, rounds, 1.1, 1.1)
        quality = topics.table_quality(cells, table).first()
        scores.append(quality["log_likelihood"] + quality["log_prior"])
    assert scores == sorted(scores)
    main = clustering.top_topics(topics.table_mix(table), "doc", 1)
    assert main.select((F.col("doc") % 2).alias("half"), "topic").distinct().count() == 2
    named = {(r["topic"], r["term"]) for r in topics.table_terms(table, 3).collect()}
    assert {frozenset(t for k, t in named if k == topic) for topic in (0, 1)} == {
        frozenset(["red", "blue", "green"]), frozenset(["salt", "sugar", "flour"])
    }


def test_the_same_start_twice(spark):
    cells = cells_of(spark, TEXTS)
    runs = [sorted(map(str, topics.fit_topics(cells.repartition(p), 3, 1).terms.select("term", F.transform("n", lambda v: F.round(v, 9))).collect())) for p in (1, 5)]
    assert runs[0] == runs[1]


def test_fold_in_equals_a_loop(spark):
    cells = cells_of(spark, TEXTS)
    table = topics.fit_topics(cells, K, 2, A, E, weights=start())
    phi = by_hand(TEXTS, 2)[2]
    new = {7: "a a e unknown", 8: "unknown", 9: "f d"}
    got = {r["doc"]: r["n"] for r in topics.fold_in(cells_of(spark, new), table, 3).collect()}
    assert set(got) == {7, 9}
    for d in got:
        words = [x for x in new[d].split() if x in phi]
        n = np.full(K, len(words) / K)
        for _ in range(3):
            shares = [phi[x] * (n + A - 1) for x in words]
            n = sum(s / s.sum() for s in shares)
        assert got[d] == pytest.approx(n.tolist())


def test_nulls_and_empty_tables(spark):
    cells = cells_of(spark, {1: None, 2: "", 3: "x x"})
    assert [tuple(r) for r in cells.collect()] == [(3, "x", 2.0)]
    words = spark.createDataFrame([(None, ["x", None]), (4, ["x"])], "d long, w array<string>")
    assert {tuple(r) for r in topics.term_counts(words, "d", "w").collect()} == {(4, "x", 1.0)}
    none = topics.fit_topics(cells.limit(0), 2, 1)
    assert none.vocabulary == 0 and topics.table_terms(none, 3).isEmpty() and topics.table_mix(none).isEmpty()
    with pytest.raises(ValueError, match="above 1"):
        topics.first_topics(cells, 2, 1.0)


def test_cells_of_frequent_terms_stay_in_place(spark, monkeypatch):
    texts = {d: " ".join([f"w{n}" for n in range(12) if (d * n) % (n + 1) < 2] + [f"own{d}"]) for d in range(30)}
    cells = cells_of(spark, texts)
    named = lambda table: {(r["term"], c): v for r in table.terms.collect() for c, v in enumerate(r["n"])}
    whole = topics.fit_topics(cells, 2, 2, 1.5, 1.1)
    assert topics.place_cells(cells, 2).rare is None
    monkeypatch.setattr(topics, "BROADCAST_ROWS", 2)
    placed = topics.place_cells(cells, 2)
    assert 0 < placed.often.count() <= 8 and 0 < placed.rare.count() < placed.all.count() == cells.count()
    table = topics.fit_topics(placed, 2, 2, 1.5, 1.1)
    assert named(table) == pytest.approx(named(whole))
    assert topics.table_quality(placed, table).first()[:2] == pytest.approx(topics.table_quality(cells, whole).first()[:2])
    plan = topics._matched(topics.PlacedCells(placed.often, placed.all, None), table, table.docs)._jdf.queryExecution().executedPlan().toString()
    # One exchange, that of the documents.
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 1
