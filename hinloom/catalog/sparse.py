"""Sparse rows from the scan to the model, and wide dense rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.catalog.base import Catalog, rounded, table
from hinloom.operators import dense, isotonic, sparse
from hinloom.operators import statistics as stats
from hinloom.runtime import materialize, new_path
from hinloom.sources import libsvm

catalog = Catalog()


def hex_slot(term: Column) -> Column:
    """The first five hexadecimal digits of the MD5 sum: 2^20 slots that any engine gives alike."""
    return F.conv(F.substring(F.md5(term), 1, 5), 16, 10).cast("long")


_DIGITS = " + ".join(f"(instr('0123456789abcdef', substr(md5(term), {k}, 1)) - 1) * {16 ** (5 - k)}" for k in range(1, 6))

_CELLS = f"""with w as (select doc_id as r, unnest(string_split(text, ' ')) as term from documents),
c as (select r, cast({_DIGITS} as bigint) as slot, count(*)::double as v from w group by 1, 2),
l as (select doc_id as r, quality as y from labels join documents using (doc_id)) """


def labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Hashed terms of the whole texts of labelled documents, and their quality labels."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("row"), F.col("quality").alias("label"))
    docs = table(spark, sf, "documents").join(labels.select(F.col("row").alias("doc_id")), "doc_id", "left_semi")
    words = docs.select("doc_id", F.split("text", " ").alias("words"))
    cells = materialize(sparse.hashed_terms(words, "doc_id", "words", hex_slot), "cells")
    return cells, labels.join(docs.select(F.col("doc_id").alias("row")), "row", "left_semi")


@catalog.query("sparse_hashed_terms", _CELLS + "select slot, count(*) as n, sum(v) as total from c group by 1")
def sparse_hashed_terms(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    cells = sparse.hashed_terms(words, "doc_id", "words", hex_slot)
    return cells.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@catalog.query(
    "sparse_libsvm",
    _CELLS + "select y::double as label, slot, count(*) as n, sum(v) as total from c join l using (r) group by 1, 2",
)
def sparse_libsvm(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed texts written as libSVM lines and scanned again."""
    cells, labels = labelled(spark, sf)
    path = new_path(spark, "libsvm")
    libsvm.write_cells(labels, cells, path)
    rows, scanned = libsvm.read_cells(spark, path)
    return scanned.join(rows, "row").groupBy("label", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


_BAYES = (
    _CELLS
    + """, n as (select y, count(*) as n from l group by 1),
s as (select y, slot, sum(v) as s from c join l using (r) group by 1, 2),
t as (select y, sum(s) as t from s group by 1),
k as (select n.y, ln(n + 1) - ln((select sum(n) + count(*) from n)) as prior, ln(coalesce(t, 0) + 1048576) as below from n left join t using (y)),
p as (select l.r, k.y, any_value(k.prior) + coalesce(sum(c.v * (ln(coalesce(s.s, 0) + 1) - k.below)), 0) as score
    from l cross join k left join c on c.r = l.r left join s on s.y = k.y and s.slot = c.slot group by 1, 2) """
)


@catalog.query(
    "sparse_naive_bayes",
    _BAYES
    + """select a.r as row, case when b.score > a.score then 1 else 0 end as prediction, round(a.score, 4) as score_0,
    round(b.score, 4) as score_1 from p a join p b on a.r = b.r and a.y = 0 and b.y = 1""",
)
def sparse_naive_bayes(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of the labelled documents by naive Bayes over 2^20 slots."""
    cells, labels = labelled(spark, sf)
    model = sparse.train_bayes(cells, labels, sparse.SLOTS)
    found = sparse.predict_bayes(cells, labels, model)
    scores = [rounded(F.col("scores")[k], 4).alias(f"score_{k}") for k in range(2)]
    return found.select("row", F.col("prediction").cast("int").alias("prediction"), *scores)


@catalog.query(
    "sparse_bernoulli_bayes",
    _CELLS
    + """, n as (select y, count(*) as n from l group by 1),
s as (select l.y, slot, count(*) as s from c join l using (r) group by 1, 2),
k as (select y as ky, n, ln(n + 1) - ln((select sum(n) + count(*) from n)) as prior, ln(n + 2) as below,
    ln(1 - exp(-ln(n + 2))) as none from n),
a as (select ky as ay, any_value(prior) + sum(ln(1 - exp(ln(s + 1) - below))) + (1048576 - count(*)) * any_value(none) as base
    from k join s on s.y = ky group by 1)
select l.r as row, ky::int as label, round(any_value(a.base) + coalesce(sum(case when c.r is null then 0
    else ln(coalesce(s.s, 0) + 1) - k.below - ln(1 - exp(ln(coalesce(s.s, 0) + 1) - k.below)) end), 0), 4) as score
from l cross join k join a on ay = ky left join c on c.r = l.r left join s on s.y = ky and s.slot = c.slot group by 1, 2""",
)
def sparse_bernoulli_bayes(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of both classes when only the presence of a slot counts, and its absence."""
    cells, labels = labelled(spark, sf)
    present = cells.withColumn("value", F.lit(1.0))
    model = sparse.train_bayes(present, labels, sparse.SLOTS, "bernoulli")
    names, scored = sparse.bayes_scores(present, labels, model)
    each = F.posexplode("scores").alias("k", "score")
    found = scored.select("row", each)
    return found.select(
        "row", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).cast("int").alias("label"), rounded("score", 4).alias("score")
    )


_WEIGHTS = "((slot % 7) - 3) / 100.0::double"


@catalog.query(
    "sparse_logistic_gradient",
    _CELLS
    + f""", m as (select l.r, y, coalesce(sum(v * {_WEIGHTS}), 0) as m from l left join c using (r) group by 1, 2),
g as (select slot, sum(v * (1 / (1 + exp(-m)) - y)) as g from c join m using (r) group by 1),
t as (select avg(case when y > 0 then ln(1 + exp(-m)) else ln(1 + exp(m)) end) as mean_loss, count(*) as n from m)
select slot, round(g / n, 6) as gradient, round(mean_loss, 6) as mean_loss from g cross join t where round(g / n, 6) <> 0""",
)
def sparse_logistic_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """Mean log-loss gradient by slot, at weights that depend on the slot."""
    cells, labels = labelled(spark, sf)
    weights = cells.select("slot").distinct().withColumn("weight", (F.col("slot") % 7 - 3) / 100.0)
    by_slot, loss, n = sparse.gradient(cells, labels, weights, "logistic")
    mean = rounded(F.col("gradient") / n)
    return by_slot.select("slot", mean.alias("gradient"), F.lit(round(loss / n, 6)).alias("mean_loss")).where("gradient != 0")


# --- wide dense rows -----------------------------------------------------------------

WIDE = 5000


@catalog.query(
    "wide_gramian",
    f"""with x as (select vec_id, c, embedding[(c * 13) % 64 + 1]::double * ((c % 7) - 2.5) as v from embeddings, range({WIDE}) t(c)),
    s as (select vec_id, sum(v) as s from x group by 1)
    select c as i, round(sum(v * s), 3) as row_sum, round(sum(v * v), 6) as diagonal from x join s using (vec_id) group by 1""",
)
def wide_gramian(spark: SparkSession, sf: str) -> DataFrame:
    """Row sums and diagonal of the products of 5,000 columns."""
    column = F.transform(
        F.sequence(F.lit(0), F.lit(WIDE - 1)),
        lambda c: F.element_at("embedding", (c * 13 % 64 + 1).cast("int")).cast("double") * (c % 7 - 2.5),
    )
    cells = dense.gramian(table(spark, sf, "embeddings").select(column.alias("x")), "x")
    diagonal = F.max(F.when(F.col("i") == F.col("j"), F.col("value")))
    return cells.groupBy("i").agg(rounded(F.sum("value"), 3).alias("row_sum"), rounded(diagonal).alias("diagonal"))


# --- pooling and tests -----------------------------------------------------------------


@catalog.query(
    "isotonic_blocks",
    """with d as (select l_extendedprice as x, sum(l_quantity) as s, count(*)::double as w, row_number() over (order by l_extendedprice) as k
      from (select round(l_extendedprice / 2000) * 2000 as l_extendedprice, case when l_extendedprice < 60000 then l_quantity else 60 - l_quantity / 2 end
        as l_quantity from lineitem) group by 1),
    c as (select x, k, sum(s) over (order by k) as cs, sum(w) over (order by k) as cw from d),
    m as (select a.k as a, b.k as b, (b.cs - coalesce(p.cs, 0)) / (b.cw - coalesce(p.cw, 0)) as m from c a join c b on a.k <= b.k left join c p on p.k = a.k - 1),
    n as (select d.k, a, min(m) as m from d join m on a <= d.k and b >= d.k group by 1, 2),
    f as (select k, round(max(m), 6) as value from n group by 1)
    select min(x) as low, max(x) as high, value, sum(w) as weight from f join d using (k) group by value""",
)
def isotonic_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity by price step, which rises and then falls: every pooled block, against the largest least mean."""
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(
        (F.round(price / 2000) * 2000).alias("x"), F.when(price < 60000, quantity).otherwise(60 - quantity / 2).alias("y")
    )
    return isotonic.isotonic_blocks(rows, "x", "y").withColumn("value", rounded("value"))


@catalog.query(
    "chi_square_contingency",
    """with o as (select l_returnflag as r, l_linestatus as c, count(*)::double as n from lineitem group by 1, 2),
    r as (select r, sum(n) as rn from o group by 1), c as (select c, sum(n) as cn from o group by 1), t as (select sum(n) as t from o)
    select round(sum(pow(coalesce(n, 0) - rn * cn / t, 2) / (rn * cn / t)), 4) as statistic, (count(distinct r.r) - 1) * (count(distinct c.c) - 1) as df
    from r cross join c cross join t left join o on o.r = r.r and o.c = c.c""",
)
def chi_square_contingency(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    found = stats.chi_square_contingency(counts, "l_returnflag", "l_linestatus", "n")
    return found.select(rounded("statistic", 4).alias("statistic"), "df")
