"""Topic tables over whole texts, with every step in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.catalog.base import Catalog, rounded, table
from hinloom.operators import clustering, topics
from hinloom.runtime import by_bucket, materialize

catalog = Catalog()

TOPICS, ROUNDS, DOC_PRIOR, TERM_PRIOR = 3, 2, 2.0, 1.1


def start_weight(topic: int) -> Column:
    """1 to 16 by a digit of the MD5 sum of document and term, which any engine gives alike."""
    digit = F.substring(F.md5(F.concat(F.col("doc").cast("string"), F.lit("/"), F.col("term"))), topic + 1, 1)
    return (F.conv(digit, 16, 10).cast("double") + 1.0)


def document_cells(spark: SparkSession, sf: str) -> topics.PlacedCells:
    texts = by_bucket(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
    words = texts.select("doc_id", F.split("text", " ").alias("words"))
    return topics.place_cells(topics.term_counts(words, "doc_id", "words", placed=True), TOPICS, placed=True)


def fitted(cells: topics.PlacedCells) -> topics.TopicTable:
    starts = [start_weight(c) for c in range(TOPICS)]
    return topics.fit_topics(cells, TOPICS, ROUNDS, DOC_PRIOR, TERM_PRIOR, weights=starts)


def _each(form: str, rows: str = ", ") -> str:
    return rows.join(form.replace("#", str(c)) for c in range(TOPICS))


_A, _E = f"{DOC_PRIOR - 1}", f"{TERM_PRIOR} - 1"


def _matched(of: int, doc: str) -> str:
    """Weights of every cell under the tables of a step, with document counts ``doc``."""
    form = (
        f"(t{of}.a# + ({_E})) / (z{of}.a# + z{of}.v * ({_E})) * ({doc}.a# + {_A}) / ({_each(doc + '.a#', ' + ')} + {TOPICS} * {_A}) as w#"
    )
    return _each(form)


def _steps() -> str:
    start = _each("instr('0123456789abcdef', substr(md5(d || '/' || t), # + 1, 1))::double as w#")
    ctes = [
        "w as (select doc_id as d, unnest(string_split(text, ' ')) as t from documents)",
        "c as (select d, t, count(*)::double as n from w group by 1, 2)",
        f"r0 as (select d, t, n, {start} from c)",
    ]
    for k in range(ROUNDS + 1):
        if k:
            ctes.append(
                f"r{k} as (select c.d, c.t, c.n, {_matched(k - 1, f'd{k - 1}')} from c join t{k - 1} using (t) join d{k - 1} using (d), z{k - 1})"
            )
        split = _each(f"n * w# / ({_each('w#', ' + ')}) as s#")
        sums, totals = _each("sum(s#) as a#"), _each("sum(a#) as a#")
        ctes += [
            f"x{k} as (select d, t, {split} from r{k})",
            f"t{k} as (select t, {sums} from x{k} group by 1)",
            f"d{k} as (select d, {sums} from x{k} group by 1)",
            f"z{k} as (select {totals}, count(*) as v from t{k})",
        ]
    return "with " + ", ".join(ctes)


_STEPS, _LAST = _steps(), ROUNDS

_LONG = " union all ".join(f"select {c} as topic, t as term, t{_LAST}.a{c} / z{_LAST}.a{c} as weight from t{_LAST}, z{_LAST}" for c in range(TOPICS))


@catalog.query(
    "topic_table_terms",
    f"""{_STEPS}, l as ({_LONG}), k as (select *, row_number() over (partition by topic order by weight desc, term) as rank from l)
    select topic, rank::integer as rank, term, round(weight, 6) as weight from k where rank <= 10""",
)
def topic_table_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The ten leading terms of each topic, as words."""
    found = topics.table_terms(fitted(document_cells(spark, sf)), 10)
    return found.select("topic", "rank", "term", rounded("weight").alias("weight"))


_MIX = " union all ".join(f"select d as doc_id, {c} as topic, round(a{c} / ({_each('a#', ' + ')}), 6) as weight from d{_LAST}" for c in range(TOPICS))


@catalog.query("topic_table_mix", f"{_STEPS} {_MIX}")
def topic_table_mix(spark: SparkSession, sf: str) -> DataFrame:
    mix = topics.table_mix(fitted(document_cells(spark, sf)))
    return mix.select(F.col("doc").alias("doc_id"), "topic", rounded("weight").alias("weight"))


_CHANCE = _each("w#", " + ")
_T_SHARE = _each(f"ln((t{_LAST}.a# + ({_E})) / (z{_LAST}.a# + z{_LAST}.v * ({_E})))", " + ")
_D_SHARE = _each(f"ln((a# + {_A}) / ({_each('a#', ' + ')} + {TOPICS} * {_A}))", " + ")


@catalog.query(
    "topic_table_quality",
    f"""{_STEPS}, m as (select c.n, {_matched(_LAST, f"d{_LAST}")} from c join t{_LAST} using (t) join d{_LAST} using (d), z{_LAST}),
    f as (select sum(n * ln({_CHANCE})) as fit, sum(n) as words from m)
    select round(fit, 2) as log_likelihood, round(exp(-fit / words), 6) as perplexity,
      round((select sum({_T_SHARE}) * ({_E}) from t{_LAST}, z{_LAST}) + (select sum({_D_SHARE}) * {_A} from d{_LAST}), 2) as log_prior from f""",
)
def topic_table_quality(spark: SparkSession, sf: str) -> DataFrame:
    cells = document_cells(spark, sf)
    found = topics.table_quality(cells, fitted(cells))
    return found.select(
        rounded("log_likelihood", 2).alias("log_likelihood"), rounded("perplexity").alias("perplexity"), rounded("log_prior", 2).alias("log_prior")
    )


def _fold_sql() -> str:
    ctes = [
        "u as (select conv_id, turn, unnest(string_split(text, ' ')) as t from conversations)",
        "q as (select conv_id || '/' || turn as d, t, count(*)::double as n from u group by 1, 2)",
        f"g as (select q.d, q.n, t, {_each(f'(t{_LAST}.a# + ({_E})) / (z{_LAST}.a# + z{_LAST}.v * ({_E})) as p#')} from q join t{_LAST} using (t), z{_LAST})",
        f"h0 as (select d, {_each(f'sum(n) / {TOPICS} as a#')} from g group by 1)",
    ]
    for k in range(1, ROUNDS + 1):
        ctes.append(f"y{k} as (select g.d, n, {_each('p# * (h' + str(k - 1) + f'.a# + {_A}) as w#')} from g join h{k - 1} using (d))")
        ctes.append(f"h{k} as (select d, {_each('sum(n * w# / (' + _each('w#', ' + ') + ')) as a#')} from y{k} group by 1)")
    rows = " union all ".join(f"select d as turn_id, {c} as topic, round(a{c} / ({_each('a#', ' + ')}), 6) as weight from h{_LAST}" for c in range(TOPICS))
    return f"{_STEPS}, {', '.join(ctes)} {rows}"


@catalog.query("topic_fold_in", _fold_sql())
def topic_fold_in(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of the documents' words in every turn of a conversation."""
    model = fitted(document_cells(spark, sf))
    turn = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    words = table(spark, sf, "conversations").select(turn.alias("turn_id"), F.split("text", " ").alias("words"))
    folded = topics.fold_in(topics.term_counts(words, "turn_id", "words"), model, ROUNDS)
    mix = topics.table_mix(model, folded)
    return mix.select(F.col("doc").alias("turn_id"), "topic", rounded("weight").alias("weight"))


@catalog.query(
    "topic_table_reports",
    f"""{_STEPS}, m as ({_MIX}),
    a as (select *, row_number() over (partition by topic order by weight desc, doc_id) as r, row_number() over (partition by doc_id order by weight desc, topic) as s from m)
    select 'documents' as report, topic, doc_id as item, weight from a where r <= 5
    union all select 'main topic of', topic, count(*), round(avg(weight), 5) from a where s = 1 group by 1, 2""",
)
def topic_table_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Leading documents of each topic, and how many documents have it as their main one."""
    mix = topics.table_mix(fitted(document_cells(spark, sf)))
    mix = materialize(mix.select(F.col("doc").alias("doc_id"), "topic", rounded("weight").alias("weight")), "mix")
    leading = clustering.top_documents(mix, "doc_id", 5).select(F.lit("documents").alias("report"), "topic", F.col("doc_id").alias("item"), "weight")
    main = clustering.top_topics(mix, "doc_id", 1).groupBy("topic").agg(F.count(F.lit(1)).alias("item"), rounded(F.avg("weight"), 5).alias("weight"))
    return leading.unionByName(main.select(F.lit("main topic of").alias("report"), "topic", "item", "weight"))
