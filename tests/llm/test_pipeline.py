"""The stages of the pipeline on their own inputs, against brute force."""

from collections import defaultdict

import pytest
from test_near_dedup import plain_components
from test_urls_lines import plain_lines, plain_weights

import corpus_pipeline as pipeline
from hinloom.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    return out


def test_stages_keep_the_columns_of_documents(outputs):
    for table in outputs[1:-1]:
        assert table.dtypes == outputs[0].dtypes


def test_toxic_documents_go(spark, outputs):
    docs, left = outputs[:2]
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if lexicon.score(r.text or "") < toxicity.THRESHOLD}
    assert {r.doc_id for r in left.collect()} == want


def test_lines_are_cut(outputs):
    rows = [(r.doc_id, r.source, r.text) for r in outputs[1].collect()]
    want = {i: t for i, _, t, _, _ in plain_lines(rows, weights=plain_weights(rows))}
    got = outputs[2].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_one_of_each_group_stays(outputs):
    rows = [(r.doc_id, r.text) for r in outputs[2].collect()]
    want = {doc for doc, _, _, kept in plain_components(rows) if kept}
    assert sorted(r.doc_id for r in outputs[3].collect()) == sorted(want)


def test_everything_left_is_packed(spark, outputs):
    packed = defaultdict(int)
    for r in pipeline.run(spark, SF).collect():
        packed[r.doc_id] += r.length
    assert set(packed) == {r.doc_id for r in outputs[3].collect()}


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (None, "a text of several words here", "en", "s", 4), (2, "", "en", "s", 0)]
    rows += [(3, "one text twice " * 3, "en", "s", 1)] * 2 + [(4, "one text twice " * 3, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, shard int")
    for table, left in ((docs, {None, 1, 2, 3}), (docs.limit(0), set())):
        for _, stage in pipeline.STAGES[:-1]:
            table = stage(spark, table, SF)
            assert table.columns == docs.columns
        assert sorted(map(str, (r.doc_id for r in table.collect()))) == sorted(map(str, left))
        assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, table, SF).collect()} == left


@pytest.mark.parametrize("own", [True, False])
def test_one_of_a_hot_group_of_copies_stays_with_its_text(spark, own):
    """A third of the rows are copies of one text over all sources; a menu on other pages still goes."""
    body = [f"shared line {k} of the copied text number {k * 7} with some words" for k in range(20)]
    rows = [(i, "\n".join([*body, f"own line {i}"] if own else body), f"s{i % 4}") for i in range(60)]
    rows += [
        (i, "\n".join(["The menu"] * (i % 3 == 0) + [f"word{i}a word{i}b line {k} of page {i}" for k in range(6)]), f"s{i % 4}")
        for i in range(60, 180)
    ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t), 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, shard int")
    stages = dict(pipeline.STAGES)
    cut = stages["line dedup"](spark, docs, SF)
    left = {r.doc_id: r.text for r in stages["MinHash near-dedup"](spark, cut, SF).collect()}
    assert sorted(left) == [0, *range(60, 180)] and left[0] == rows[0][1]
    assert not any("The menu" in t for t in left.values())


@pytest.mark.parametrize("name", ["InPandas", "Python", "Arrow"])
def test_the_line_stage_is_native(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cut = dict(pipeline.STAGES)["line dedup"](spark, docs, SF)
    assert name not in cut._jdf.queryExecution().optimizedPlan().toString()
