"""Pattern mining, supervised and unsupervised learning, streaming models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.catalog.base import Catalog, rounded, table
from hinloom.catalog.vectors import embeddings, tokens
from hinloom.functions import vectors as v
from hinloom.operators import bayes, clustering, linear, mining, recommend, trees
from hinloom.operators import evaluation as ev
from hinloom.operators import features as text_features
from hinloom.runtime import collect_garbage, materialize, new_path
from hinloom.sources import generators as gen
from hinloom.sources import models
from hinloom.streaming.kmeans import StreamingKMeans
from hinloom.streaming.linear import StreamingLogisticRegression, StreamingRegression

catalog = Catalog()

# --- pattern mining --------------------------------------------------------------


def brand_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct brands per order; there are few brands, which bounds a basket."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("items"))


SUPPORT = 0.004

_BASKETS = """with b as (select distinct l_orderkey as o, p_brand as x from lineitem join part on p_partkey = l_partkey),
need as (select ceil(0.004 * count(distinct o)) as n from b),
s as (
  select x as items, count(*) as freq, 1 as size from b group by 1
  union all select a.x || ',' || b2.x, count(*), 2 from b a join b b2 on a.o = b2.o and a.x < b2.x group by 1
  union all select a.x || ',' || b2.x || ',' || c.x, count(*), 3 from b a join b b2 on a.o = b2.o and a.x < b2.x
    join b c on c.o = a.o and b2.x < c.x group by 1
  union all select a.x || ',' || b2.x || ',' || c.x || ',' || d.x, count(*), 4 from b a join b b2 on a.o = b2.o and a.x < b2.x
    join b c on c.o = a.o and b2.x < c.x join b d on d.o = a.o and c.x < d.x group by 1),
f as (select items, freq, size from s where freq >= (select n from need)) """


@catalog.query("frequent_itemsets", _BASKETS + "select items, freq from f")
def frequent_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    found = mining.frequent_itemsets(brand_baskets(spark, sf), "items", SUPPORT)
    return found.select(F.array_join("items", ",").alias("items"), "freq")


@catalog.query(
    "association_rules",
    _BASKETS
    + """, r as (select string_split(items, ',') as l, unnest(string_split(items, ',')) as consequent, freq from f where size > 1),
    q as (select array_to_string(list_filter(l, lambda e: e <> consequent), ',') as antecedent, consequent, freq from r)
    select antecedent, consequent, q.freq, round(q.freq / f.freq, 6) as confidence from q join f on f.items = q.antecedent
    where q.freq / f.freq >= 0.15""",
)
def association_rules(spark: SparkSession, sf: str) -> DataFrame:
    itemsets = materialize(mining.frequent_itemsets(brand_baskets(spark, sf), "items", SUPPORT), "itemsets")
    rules = mining.association_rules(itemsets, 0.15)
    return rules.select(
        F.array_join("antecedent", ",").alias("antecedent"), "consequent", "freq", rounded("confidence").alias("confidence")
    )


@catalog.query(
    "sequential_patterns",
    """with e as (select distinct o_custkey as s, o_orderdate as t, substr(o_orderpriority, 1, 1) || o_orderstatus as x from orders),
    need as (select ceil(0.1 * count(distinct s)) as n from e),
    p as (
      select '<' || x || '>' as pattern, count(distinct s) as freq from e group by 1
      union all select '<' || a.x || '><' || b.x || '>', count(distinct a.s) from e a join e b on a.s = b.s and a.t < b.t group by 1
      union all select '<' || a.x || ',' || b.x || '>', count(distinct a.s) from e a join e b on a.s = b.s and a.t = b.t and a.x < b.x group by 1)
    select pattern, freq from p where freq >= (select n from need)""",
)
def sequential_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Priority and status of a customer's orders over time.

    Its SQL stops at two items, which is all there is on the test tables at this support.
    """
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderdate", F.concat(F.substring("o_orderpriority", 1, 1), "o_orderstatus").alias("x")
    )
    return pattern_text(mining.sequential_patterns(orders, "o_custkey", "o_orderdate", "x", 0.1))


def _pattern_sql(length: int) -> str:
    """Every pattern of up to ``length`` items with the positions where it can end, one item more per level."""
    levels = ["l1 as (select '<' || x as pattern, x as last, s, t from e)"]
    for k in range(2, length + 1):
        levels.append(
            f"l{k} as (select distinct pattern || '><' || x as pattern, x as last, l.s, e.t from l{k - 1} l join e on l.s = e.s and e.t > l.t"
            f" union all select distinct pattern || ',' || x, x, l.s, e.t from l{k - 1} l join e on l.s = e.s and e.t = l.t and x > last)"
        )
    every = " union all ".join(f"select pattern, count(distinct s) as freq from l{k} group by 1" for k in range(1, length + 1))
    return f"""with e as (select distinct o_custkey as s, year(o_orderdate) * 4 + quarter(o_orderdate) as t, o_orderstatus as x from orders),
    need as (select ceil(0.02 * count(distinct s)) as n from e), {", ".join(levels)}, p as ({every})
    select pattern || '>' as pattern, freq from p where freq >= (select n from need)"""


@catalog.query("sequential_patterns_long", _pattern_sql(4))
def sequential_patterns_long(spark: SparkSession, sf: str) -> DataFrame:
    """States of a customer's orders over quarters of years, up to four items."""
    quarter = F.year("o_orderdate") * 4 + F.quarter("o_orderdate")
    orders = table(spark, sf, "orders").select("o_custkey", quarter.alias("t"), F.col("o_orderstatus").alias("x"))
    return pattern_text(mining.sequential_patterns(orders, "o_custkey", "t", "x", 0.02, 4))


def pattern_text(found: DataFrame) -> DataFrame:
    text = F.concat_ws("", F.transform("pattern", lambda e: F.concat(F.lit("<"), F.array_join(e, ","), F.lit(">"))))
    return found.select(text.alias("pattern"), "freq")


# --- linear models -----------------------------------------------------------------

WEIGHTS = [0.1, -0.2, 0.3, 0.4]


def flag_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Four scaled line measures; label 1 for returned lines."""
    return table(spark, sf, "lineitem").select(
        F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("features"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
    )


def noisy_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same measures; label 1 is likelier the larger the quantity."""
    noise = gen.keyed_uniform(F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return table(spark, sf, "lineitem").select(
        F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("features"),
        F.when(F.col("l_quantity") / 50 + noise > 1.0, 1.0).otherwise(0.0).alias("label"),
    )


_FLAGS = """with r as (select [l_quantity / 50, l_extendedprice / 100000, l_discount * 10, l_tax * 10] as x,
  case when l_returnflag = 'R' then 1.0::double else 0.0::double end as y from lineitem),
m as (select *, 0.1 * x[1] - 0.2 * x[2] + 0.3 * x[3] + 0.4 * x[4] as m from r),
g as (select 'squared' as loss, x, m - y as s, (m - y) * (m - y) / 2 as l from m
  union all select 'logistic', x, 1 / (1 + exp(-m)) - y, case when y > 0 then ln(1 + exp(-m)) else ln(1 + exp(m)) end from m
  union all select 'hinge', x, case when (2 * y - 1) * m < 1 then -(2 * y - 1) else 0 end, greatest(0, 1 - (2 * y - 1) * m) from m),
a as (select loss, avg(l) as mean_loss, avg(s * x[1]) as g1, avg(s * x[2]) as g2, avg(s * x[3]) as g3, avg(s * x[4]) as g4 from g group by 1),
u as (select loss, mean_loss, unnest([0, 1, 2, 3]) as i, unnest([0.1, -0.2, 0.3, 0.4])::double as w, unnest([g1, g2, g3, g4]) as g from a) """


@catalog.query(
    "sgd_step",
    _FLAGS
    + """select loss, i, round(mean_loss, 6) as mean_loss, round(w - 0.5 / sqrt(2) * g, 6) as simple,
      round(w * (1 - 0.5 / sqrt(2) * 0.1) - 0.5 / sqrt(2) * g, 6) as l2,
      round(sign(w - 0.5 / sqrt(2) * g) * greatest(0, abs(w - 0.5 / sqrt(2) * g) - 0.5 / sqrt(2) * 0.1), 6) + 0 as l1 from u""",
)
def sgd_step(spark: SparkSession, sf: str) -> DataFrame:
    """The second step of each loss with each penalty."""
    rows = materialize(flag_rows(spark, sf), "rows")
    out = []
    for loss in ("squared", "logistic", "hinge"):
        # One pass per loss; the penalties differ on the driver only.
        total, g, n = linear.gradient(rows, "features", "label", WEIGHTS, linear.LOSSES[loss])
        start = np.array(WEIGHTS)
        moved = [linear.updated_weights(start, g / n, 0.5, 2, 0.1, p) for p in ("none", "l2", "l1")]
        for i in range(len(WEIGHTS)):
            out.append((loss, i, total / n, *[float(m[i]) for m in moved]))
    made = spark.createDataFrame(out, "loss string, i int, mean_loss double, simple double, l2 double, l1 double")
    return made.select("loss", "i", *[rounded(c).alias(c) for c in ("mean_loss", "simple", "l2", "l1")])


@catalog.query(
    "least_squares",
    """select round(regr_slope(l_extendedprice / 1000, l_quantity), 6) as slope,
       round(regr_intercept(l_extendedprice / 1000, l_quantity), 6) as intercept from lineitem""",
)
def least_squares(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.array("l_quantity").alias("features"), (F.col("l_extendedprice") / 1000).alias("label")
    )
    model = linear.least_squares(rows, "features", "label")
    made = spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
    return made.select(rounded("slope").alias("slope"), rounded("intercept").alias("intercept"))


@catalog.query("logistic_gradient", "select unnest(range(4))::int as i, 0.0::double as gradient")
def logistic_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """The mean log-loss gradient at the fitted coefficients, to four digits."""
    rows = noisy_rows(spark, sf)
    model = linear.logistic(rows, "features", "label")
    with_bias = rows.withColumn("features", v.append_bias(F.col("features")))
    weights = [float(c) for c in model.coefficients] + [float(model.intercept)]
    _, g, n = linear.gradient(with_bias, "features", "label", weights, linear.LOSSES["logistic"])
    made = spark.createDataFrame([(i, float(abs(g[i] / n))) for i in range(4)], "i int, gradient double")
    return made.withColumn("gradient", rounded("gradient", 4))


@catalog.query("ridge_and_lasso")
def ridge_and_lasso(spark: SparkSession, sf: str) -> DataFrame:
    rows = noisy_rows(spark, sf)
    out = []
    for name, model in (("ridge", linear.ridge(rows, "features", "label")), ("lasso", linear.lasso(rows, "features", "label"))):
        out += [(name, i, float(c)) for i, c in enumerate(model.coefficients)]
    return spark.createDataFrame(out, "model string, i int, coefficient double")


@catalog.query(
    "ridge_and_lasso_closed_form",
    """with r as (select l_quantity / 50 as x, l_extendedprice / 100000 as y from lineitem),
    m as (select covar_pop(x, y) as c, var_pop(x) as v, avg(x) as mx, avg(y) as my from r),
    w as (select 'ridge' as model, c / (v + 0.01) as slope, mx, my from m
      union all select 'lasso', sign(c) * greatest(0, abs(c) - 0.01) / v, mx, my from m)
    select model, round(slope, 5) as slope, round(my - slope * mx, 5) as intercept from w""",
)
def ridge_and_lasso_closed_form(spark: SparkSession, sf: str) -> DataFrame:
    """One feature: the penalised slope has a closed form."""
    rows = table(spark, sf, "lineitem").select(
        F.array(F.col("l_quantity") / 50).alias("features"), (F.col("l_extendedprice") / 100000).alias("label")
    )
    out = []
    for name, fit in (("ridge", linear.ridge), ("lasso", linear.lasso)):
        model = fit(rows, "features", "label", 0.01)
        out.append((name, float(model.coefficients[0]), float(model.intercept)))
    made = spark.createDataFrame(out, "model string, slope double, intercept double")
    return made.select("model", *[rounded(c, 5).alias(c) for c in ("slope", "intercept")])


@catalog.query("linear_svm")
def linear_svm(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions counted per class."""
    rows = noisy_rows(spark, sf)
    model = linear.svm(rows, "features", "label", iterations=20)
    scored = linear.predict_class(
        rows, "features", [float(c) for c in model.coefficients], float(model.intercept), 0.0, "margin"
    )
    return ev.confusion(scored, "label", "prediction")


@catalog.query(
    "isotonic_regression", "select round(avg(l_extendedprice), 4) as mean, 0::bigint as falling from lineitem"
)
def isotonic_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Line price by quantity: the fit keeps the mean and never falls."""
    lines = table(spark, sf, "lineitem")
    model = linear.isotonic(lines, "l_quantity", "l_extendedprice")
    steps = [float(p) for p in model.predictions]
    falling = sum(b < a for a, b in zip(steps, steps[1:]))
    fitted = model.transform(lines.select(F.col("l_quantity").alias("features")))
    return fitted.agg(rounded(F.avg("prediction"), 4).alias("mean"), F.lit(falling).cast("long").alias("falling"))


# --- naive Bayes -------------------------------------------------------------------


def count_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.array("l_quantity", F.col("l_linenumber").cast("double"), F.round(F.col("l_discount") * 100)).alias("features"),
        F.col("l_returnflag").alias("label"),
    )


_NB = """with r as (select l_returnflag as label, [l_quantity, l_linenumber, round(l_discount * 100)] as x from lineitem),
c as (select label, count(*) as n, sum(x[1]) as s0, sum(x[2]) as s1, sum(x[3]) as s2 from r group by 1),
t as (select label, ln(n + 1) - ln((select sum(n) + count(*) from c)) as log_prior, unnest([0, 1, 2]) as pos,
      unnest([s0, s1, s2]) as s, s0 + s1 + s2 as total from c),
m as (select label, log_prior, pos, ln(s + 1) - ln(total + 3) as log_prob from t) """


@catalog.query(
    "naive_bayes_model",
    _NB + "select label, pos, round(log_prior, 6) as log_prior, round(log_prob, 6) as log_prob from m",
)
def naive_bayes_model(spark: SparkSession, sf: str) -> DataFrame:
    model = bayes.train(count_rows(spark, sf), "features", "label")
    return model.likelihoods.join(model.priors, "label").select(
        "label", "pos", rounded("log_prior").alias("log_prior"), rounded("log_prob").alias("log_prob")
    )


@catalog.query(
    "naive_bayes_bernoulli",
    """with r as (select l_returnflag as label, (l_quantity > 25)::int as a, (l_linestatus = 'O')::int as b from lineitem),
    c as (select label, count(*) as n, sum(a) as a, sum(b) as b from r group by 1)
    select label, unnest([0, 1]) as pos, round(unnest([ln(a + 1) - ln(n + 2), ln(b + 1) - ln(n + 2)]), 6) as log_prob from c""",
)
def naive_bayes_bernoulli(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.array((F.col("l_quantity") > 25).cast("double"), (F.col("l_linestatus") == "O").cast("double")).alias("features"),
        F.col("l_returnflag").alias("label"),
    )
    model = bayes.train(rows, "features", "label", "bernoulli")
    return model.likelihoods.select("label", "pos", rounded("log_prob").alias("log_prob"))


@catalog.query(
    "naive_bayes_predict",
    _NB
    + """, w as (select label, max(log_prior) as p, list(log_prob order by pos) as th from m group by 1),
    d as (select row_number() over () as id, label, x from r),
    z as (select d.id, d.label, w.label as guess, row_number() over (partition by d.id order by
      round(w.p + d.x[1] * w.th[1] + d.x[2] * w.th[2] + d.x[3] * w.th[3], 9) desc, w.label) as k from d cross join w)
    select label, guess as prediction, count(*) as n from z where k = 1 group by 1, 2""",
)
def naive_bayes_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a model that was saved and loaded."""
    rows = count_rows(spark, sf)
    path = new_path(spark, "naive-bayes")
    models.save_naive_bayes(bayes.train(rows, "features", "label"), path)
    model = models.load_naive_bayes(spark, path)
    return ev.confusion(bayes.predict(rows, model, "features"), "label", "prediction")


# --- trees ---------------------------------------------------------------------------

SPLIT_FEATURES = ["l_quantity", "l_linenumber", "l_discount"]

_GAINS = """with d as (select (l_returnflag = 'R')::int as y, l_linestatus as node,
    unnest(['l_quantity', 'l_linenumber', 'l_discount']) as feature, unnest([l_quantity, l_linenumber, l_discount])::double as x from lineitem),
b as (select node, feature, x, count(*)::double as n, sum(y)::double as p from d group by all),
r as (select node, feature, x, sum(n) over w as nl, sum(p) over w as pl, sum(n) over t as nt, sum(p) over t as pt from b
  window w as (partition by node, feature order by x), t as (partition by node, feature)),
g as (select node, feature, x as threshold, nl, nt - nl as nr,
   (1 - pow(pt / nt, 2) - pow((nt - pt) / nt, 2)) - (1 - pow(pl / nl, 2) - pow((nl - pl) / nl, 2)) * nl / nt
   - (1 - pow((pt - pl) / (nt - nl), 2) - pow((nt - nl - pt + pl) / (nt - nl), 2)) * (nt - nl) / nt as gain
   from r where nt > nl) """


def gains(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        *SPLIT_FEATURES, F.col("l_linestatus").alias("node"), (F.col("l_returnflag") == "R").cast("int").alias("label")
    )
    splits = trees.thresholds(rows, SPLIT_FEATURES, max_bins=64)
    return trees.split_gains(rows, splits, "label", "gini", node="node")


@catalog.query(
    "split_gains",
    _GAINS + "select node, feature, threshold, nl::bigint as n_left, nr::bigint as n_right, round(gain, 9) as gain from g",
)
def split_gains(spark: SparkSession, sf: str) -> DataFrame:
    return gains(spark, sf).withColumn("gain", rounded("gain", 9))


@catalog.query(
    "best_split",
    _GAINS + "select node, feature, threshold, nl::bigint as n_left, nr::bigint as n_right, round(gain, 9) as gain from g order by g.gain desc, feature, threshold limit 1",
)
def best_split(spark: SparkSession, sf: str) -> DataFrame:
    return trees.best_split(gains(spark, sf)).withColumn("gain", rounded("gain", 9))


@catalog.query(
    "variance_split",
    """with b as (select l_linenumber::double as x, count(*)::double as n, sum(l_quantity) as s, sum(l_quantity * l_quantity) as q from lineitem group by 1),
    r as (select x, sum(n) over w as nl, sum(s) over w as sl, sum(q) over w as ql, sum(n) over () as nt, sum(s) over () as st, sum(q) over () as qt
      from b window w as (order by x))
    select 'l_linenumber' as feature, x as threshold, round((qt - st * st / nt) / nt - (ql - sl * sl / nl) / nt
      - ((qt - ql) - pow(st - sl, 2) / (nt - nl)) / nt, 6) as gain from r where nt > nl""",
)
def variance_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    splits = trees.thresholds(rows, ["l_linenumber"])
    found = trees.split_gains(rows, splits, "l_quantity", "variance")
    return found.select("feature", "threshold", rounded("gain").alias("gain"))


@catalog.query(
    "bagging_weights",
    """select unnest([0, 1])::int as tree, count(*) as n, true as mean_is_one, true as variance_is_one from orders""",
)
def bagging_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Every order gets a weight from each tree; weights have mean and variance near 1."""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.inline(F.array(*[F.struct(F.lit(t).alias("tree"), trees.bagging_weight(key, t).alias("weight")) for t in range(2)]))
    )
    near = lambda c: F.abs(c - 1.0) < 0.15
    return rows.groupBy("tree").agg(
        F.count(F.lit(1)).alias("n"),
        near(F.avg("weight")).alias("mean_is_one"),
        near(F.var_samp("weight")).alias("variance_is_one"),
    )


def _stump_sql(label: str) -> str:
    """The split of least squared error over three measures of lines, and its two means."""
    measures = {"a": "l_quantity", "b": "l_discount * 100", "c": "l_linenumber"}
    cells = " union all ".join(
        f"select '{f}' as f, ({x})::double as x, count(*)::double as n, sum(y) as s from l group by 1, 2" for f, x in measures.items()
    )
    return f"""with l as (select *, {label} as y from lineitem), b as ({cells}),
    r as (select f, x, sum(n) over w as nl, sum(s) over w as sl, sum(n) over (partition by f) as nt, sum(s) over (partition by f) as st
      from b window w as (partition by f order by x)),
    m as (select * from r where nt > nl order by sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) desc limit 1) """


@catalog.query(
    "tree_stumps",
    _stump_sql("l_extendedprice / 1000")
    + """, p as (select sl / nl as prediction, nl as n from m union all select (st - sl) / (nt - nl), nt - nl from m)
    select unnest(['tree', 'boosted']) as model, round(prediction, 6) as prediction, n::bigint as n from p""",
)
def tree_stumps(spark: SparkSession, sf: str) -> DataFrame:
    """One level of the models that see every row once, with a bin per value: the best split and its means.

    A forest draws its rows even for one tree, so its means are others; `class_stumps` has it.
    """
    given = table(spark, sf, "lineitem").select(
        F.array("l_quantity", F.col("l_discount") * 100, F.col("l_linenumber").cast("double")).alias("features"),
        (F.col("l_extendedprice") / 1000).alias("label"),
    )
    with trees.shared_rows(given, "features", "label") as rows:
        fitted = {
            "tree": trees.tree_regressor(rows, "features", "label", depth=1, bins=64),
            "boosted": trees.boosted_regressor(rows, "features", "label", iterations=1, depth=1, bins=64),
        }
        scored = [trees.predict(model, rows, "features").select(F.lit(name).alias("model"), rounded("prediction").alias("prediction")) for name, model in fitted.items()]
        return materialize(reduce(DataFrame.unionByName, scored).groupBy("model", "prediction").agg(F.count(F.lit(1)).alias("n")), "stumps")


@catalog.query(
    "class_stumps",
    _stump_sql("case when l_quantity > 25 and l_linenumber < 6 then 1.0::double else 0.0::double end")
    + """, side as (select y, case when case f when 'a' then l_quantity when 'b' then l_discount * 100 else l_linenumber end <= x
        then sl / nl else (st - sl) / (nt - nl) end > 0.5 as over from l, m)
    select unnest(['tree', 'forest', 'boosted']) as model, y as label, case when over then 1.0::double else 0.0::double end as prediction,
      count(*) as n from side group by 2, 3""",
)
def class_stumps(spark: SparkSession, sf: str) -> DataFrame:
    """One level of every classifier, with a bin per value: for two classes all share the best split.

    It beats the next ones by so much that the rows a forest draws do not change it.
    """
    given = table(spark, sf, "lineitem").select(
        F.array("l_quantity", F.col("l_discount") * 100, F.col("l_linenumber").cast("double")).alias("features"),
        F.when((F.col("l_quantity") > 25) & (F.col("l_linenumber") < 6), 1.0).otherwise(0.0).alias("label"),
    )
    with trees.shared_rows(given, "features", "label") as rows:
        fitted = {
            "tree": trees.tree_classifier(rows, "features", "label", depth=1, bins=64),
            "forest": trees.forest_classifier(rows, "features", "label", trees=1, depth=1, bins=64),
            "boosted": trees.boosted_classifier(rows, "features", "label", iterations=1, depth=1, bins=64),
        }
        scored = [trees.predict(model, rows, "features").select(F.lit(name).alias("model"), "label", "prediction") for name, model in fitted.items()]
        return materialize(reduce(DataFrame.unionByName, scored).groupBy("model", "label", "prediction").agg(F.count(F.lit(1)).alias("n")), "stumps")


@catalog.query("tree_models")
def tree_models(spark: SparkSession, sf: str) -> DataFrame:
    """Squared error of every tree model of the line price."""
    given = table(spark, sf, "lineitem").select(
        F.array("l_quantity", F.col("l_discount") * 100, F.col("l_linenumber").cast("double")).alias("features"),
        (F.col("l_extendedprice") / 1000).alias("label"),
    )
    with trees.shared_rows(given, "features", "label") as rows:
        fitted = {
            "tree": trees.tree_regressor(rows, "features", "label", depth=4),
            "forest": trees.forest_regressor(rows, "features", "label", trees=5, depth=4),
            "boosted": trees.boosted_regressor(rows, "features", "label", iterations=5, depth=3),
        }
        out = None
        for name, model in fitted.items():
            scored = trees.predict(model, rows, "features")
            error = ev.regression_summary(scored, "label", "prediction").select(F.lit(name).alias("model"), "mse", "r2")
            out = error if out is None else out.unionByName(error)
        return materialize(out, "errors")


@catalog.query("tree_classifiers")
def tree_classifiers(spark: SparkSession, sf: str) -> DataFrame:
    given = noisy_rows(spark, sf)
    with trees.shared_rows(given, "features", "label") as rows:
        fitted = {
            "tree": trees.tree_classifier(rows, "features", "label", depth=4, impurity="entropy"),
            "forest": trees.forest_classifier(rows, "features", "label", trees=5, depth=4),
            "boosted": trees.boosted_classifier(rows, "features", "label", iterations=3),
        }
        out = None
        for name, model in fitted.items():
            counts = ev.confusion(trees.predict(model, rows, "features"), "label", "prediction")
            counts = counts.select(F.lit(name).alias("model"), "label", "prediction", "n")
            out = counts if out is None else out.unionByName(counts)
        return materialize(out, "confusion")


# --- recommendation -----------------------------------------------------------------


@catalog.query("als_model")
def als_model(spark: SparkSession, sf: str) -> DataFrame:
    """Error of the fitted model on the ratings it saw."""
    ratings = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_suppkey").cast("int").alias("item"))
        .agg(F.avg("l_quantity").cast("float").alias("rating"))
    )
    ratings = materialize(ratings, "ratings")
    model = recommend.factorize(ratings, rank=5, iterations=3, reg=0.1)
    users, items = (materialize(f, "factors") for f in recommend.factors_of(model))
    del model
    collect_garbage(spark)
    scored = recommend.predict_pairs(ratings, users, items).join(ratings, ["user", "item"])
    return ev.regression_summary(scored, "rating", "score")


def factor_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = embeddings(spark, sf)
    users = rows.select(F.col("vec_id").alias("id"), F.col("x").alias("factors"))
    return users, rows.select(F.col("vec_id").alias("id"), F.reverse("x").alias("factors"))


@catalog.query(
    "recommend_pairs",
    """select l_orderkey % (select count(*) from embeddings) as user, l_partkey % (select count(*) from embeddings) as item,
       round(list_inner_product(u.embedding::double[], list_reverse(i.embedding::double[])), 6) as score
       from lineitem join embeddings u on u.vec_id = l_orderkey % (select count(*) from embeddings)
       join embeddings i on i.vec_id = l_partkey % (select count(*) from embeddings)""",
)
def recommend_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as the pairs, mapped onto the factor ids."""
    users, items = factor_tables(spark, sf)
    n = users.count()
    pairs = table(spark, sf, "lineitem").select((F.col("l_orderkey") % n).alias("user"), (F.col("l_partkey") % n).alias("item"))
    return recommend.predict_pairs(pairs, users, items).withColumn("score", rounded("score"))


@catalog.query(
    "recommend_all",
    """with s as (select u.vec_id as user, i.vec_id as item,
         list_inner_product(u.embedding::double[], list_reverse(i.embedding::double[])) as score from embeddings u cross join embeddings i)
       select user, item, round(score, 6) as score, r::int as rank from (
         select *, row_number() over (partition by user order by score desc, item) as r from s) where r <= 5""",
)
def recommend_all(spark: SparkSession, sf: str) -> DataFrame:
    users, items = factor_tables(spark, sf)
    return recommend.recommend_all(users, items, 5, block=256).withColumn("score", rounded("score"))


@catalog.query(
    "recommend_for_one",
    """select i.vec_id as id, round(list_inner_product(u.embedding::double[], list_reverse(i.embedding::double[])), 6) as score
       from embeddings u cross join embeddings i where u.vec_id = 7 order by score desc, id limit 10""",
)
def recommend_for_one(spark: SparkSession, sf: str) -> DataFrame:
    users, items = factor_tables(spark, sf)
    best = recommend.recommend_for(recommend.factor_row(users, 7), items, 10)
    return best.withColumn("score", rounded("score"))


# --- clustering -----------------------------------------------------------------------


def label_centres(spark: SparkSession, sf: str) -> list[list[float]]:
    """The first vector of every label."""
    first = embeddings(spark, sf).groupBy("label").agg(F.min_by("x", "vec_id").alias("x")).orderBy("label")
    return [list(r["x"]) for r in first.collect()]


_CENTRES = """with x as (select vec_id, label, embedding::double[] as x from embeddings),
c as (select label as cluster, arg_min(x, vec_id) as c from x group by 1),
d as (select vec_id, cluster, x, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from x cross join c),
a as (select vec_id, x, arg_min(cluster, d) as cluster, min(d) as d from d group by vec_id, x),
e as (select cluster, unnest(x) as v, generate_subscripts(x, 1) - 1 as pos from a),
s as (select cluster, pos, sum(v) as s, count(*) as n from e group by 1, 2) """


@catalog.query("kmeans_assign", _CENTRES + "select vec_id, cluster, round(d, 6) as sq_distance from a")
def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf).select("vec_id", "x")
    found = clustering.assign(rows, "x", label_centres(spark, sf))
    return found.select("vec_id", "cluster", rounded("sq_distance").alias("sq_distance"))


@catalog.query("kmeans_step", _CENTRES + "select cluster, pos::int as pos, n, round(s / n, 6) as value from s")
def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    moved = clustering.lloyd_step(embeddings(spark, sf), "x", label_centres(spark, sf))
    return moved.select("cluster", "n", F.posexplode("centre").alias("pos", "value")).withColumn("value", rounded("value"))


@catalog.query("kmeans_cost", _CENTRES + "select round(sum(d), 6) as cost, count(*) as n from a")
def kmeans_cost(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.within_cost(embeddings(spark, sf), "x", label_centres(spark, sf)).withColumn("cost", rounded("cost"))


@catalog.query("kmeans_model", "select count(*) as n, 10::bigint as clusters, true as improved from embeddings")
def kmeans_model(spark: SparkSession, sf: str) -> DataFrame:
    """The better of two runs: all rows placed, and cheaper than the start by labels."""
    rows = materialize(embeddings(spark, sf).select("vec_id", "x"), "rows")
    centres = clustering.centres_of(clustering.k_means(rows, "x", k=10, runs=2))
    start = clustering.within_cost(rows, "x", label_centres(spark, sf)).first()["cost"]
    return clustering.cluster_sums(rows, "x", centres).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"), (F.sum("cost") < start).alias("improved")
    )


_LLOYD = """with x as (select vec_id, label, embedding::double[] as x from embeddings),
c0 as (select 0 as run, label as cluster, arg_min(x, vec_id) as c from x group by 2 union all
  select 1, vec_id, x from x where vec_id < 4),
d1 as (select vec_id, run, cluster, x, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from x cross join c0),
a1 as (select vec_id, run, x, arg_min(cluster, d) as cluster from d1 group by 1, 2, 3),
e1 as (select run, cluster, unnest(x) as v, generate_subscripts(x, 1) as pos from a1),
m1 as (select run, cluster, pos, avg(v) as v from e1 group by 1, 2, 3),
c1 as (select run, cluster, list(v order by pos) as c from m1 group by 1, 2),
d2 as (select vec_id, run, cluster, x, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from x cross join c1),
a2 as (select vec_id, run, x, arg_min(cluster, d) as cluster, min(d) as d from d2 group by 1, 2, 3),
e2 as (select run, cluster, unnest(x) as v, generate_subscripts(x, 1) - 1 as pos from a2),
k as (select run, sum(d) as cost from a2 group by 1) """


@catalog.query(
    "kmeans_runs",
    _LLOYD + "select run, cluster::int as cluster, pos::int as pos, round(avg(v), 6) as value, round(any_value(cost), 6) as cost from e2 join k using (run) group by 1, 2, 3",
)
def kmeans_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of two runs from given centres, in two passes: the first vectors of the labels, and four vectors."""
    rows = materialize(embeddings(spark, sf).select("vec_id", "x"), "rows")
    some = [list(r["x"]) for r in rows.where("vec_id < 4").orderBy("vec_id").collect()]
    centres, costs, _ = clustering.lloyd_runs(rows, "x", [label_centres(spark, sf), some], 2, tolerance=0.0)
    out = [
        (run, cluster, pos, float(value), costs[run])
        for run, table_ in enumerate(centres)
        for cluster, centre in enumerate(table_)
        for pos, value in enumerate(centre)
    ]
    made = spark.createDataFrame(out, "run int, cluster int, pos int, value double, cost double")
    return made.withColumn("value", rounded("value")).withColumn("cost", rounded("cost"))


@catalog.query(
    "mixture_step",
    """with x as (select l_quantity / 50 as a, l_discount * 10 as b from lineitem),
    p as (select a, b, 0.4 * exp(-0.5 * (pow(a - 0.3, 2) / 0.05 + pow(b - 0.4, 2) / 0.1)) / (2 * pi() * sqrt(0.05 * 0.1)) as p0,
      0.6 * exp(-0.5 * (pow(a - 0.7, 2) / 0.08 + pow(b - 0.6, 2) / 0.06)) / (2 * pi() * sqrt(0.08 * 0.06)) as p1 from x),
    r as (select 0 as c, a, b, p0 / (p0 + p1) as r, ln(p0 + p1) as l from p union all select 1, a, b, p1 / (p0 + p1), ln(p0 + p1) from p),
    m as (select c, sum(r) / (select count(*) from x) as weight, sum(r) as s, sum(r * a) / sum(r) as ma, sum(r * b) / sum(r) as mb, sum(l) as l from r group by 1)
    select r.c::int as component, round(any_value(weight), 6) as weight, round(any_value(ma), 6) as mean_0, round(any_value(mb), 6) as mean_1,
      round(sum(r * (a - ma) * (a - ma)) / any_value(s), 6) as cov_00, round(sum(r * (a - ma) * (b - mb)) / any_value(s), 6) as cov_01,
      round(sum(r * (b - mb) * (b - mb)) / any_value(s), 6) as cov_11, round(any_value(m.l), 2) as log_likelihood from r join m on m.c = r.c group by 1""",
)
def mixture_step(spark: SparkSession, sf: str) -> DataFrame:
    """One EM step of two components from given parameters."""
    rows = table(spark, sf, "lineitem").select(F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("x"))
    start = ([0.4, 0.6], [[0.3, 0.4], [0.7, 0.6]], [[[0.05, 0.0], [0.0, 0.1]], [[0.08, 0.0], [0.0, 0.06]]])
    w, m, s, likelihood = clustering.mixture_step(rows, "x", *start)
    out = [(c, *map(float, (w[c], *m[c], s[c][0][0], s[c][0][1], s[c][1][1], likelihood))) for c in range(2)]
    names = ["weight", "mean_0", "mean_1", "cov_00", "cov_01", "cov_11"]
    made = spark.createDataFrame(out, ", ".join(["component int", *(f"{n} double" for n in [*names, "log_likelihood"])]))
    return made.select("component", *[rounded(n).alias(n) for n in names], rounded("log_likelihood", 2).alias("log_likelihood"))


MEAN = [0.01 * (i % 5) for i in range(64)]
VARIANCE = [0.5 + 0.01 * i for i in range(64)]


@catalog.query(
    "gaussian_density",
    f"""select vec_id, round(-0.5 * list_sum(list_transform(list_zip(embedding::double[], {MEAN}::double[], {VARIANCE}::double[]),
        lambda p: (p[1] - p[2]) * (p[1] - p[2]) / p[3] + ln(2 * pi() * p[3]))), 6) as logpdf from embeddings""",
)
def gaussian_density(spark: SparkSession, sf: str) -> DataFrame:
    density = v.diagonal_gaussian_logpdf(F.col("x"), MEAN, VARIANCE)
    return embeddings(spark, sf).select("vec_id", rounded(density).alias("logpdf"))


@catalog.query(
    "gaussian_density_full",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(-ln(2 * pi()) - 0.5 * ln(0.75::double)
         - 0.5 * (1.0 * u * u - 2 * 0.5 * u * w + 1.0 * w * w) / 0.75::double, 6) as logpdf from (
       select *, l_quantity / 50 - 0.5 as u, l_discount * 10 - 0.5 as w from lineitem)""",
)
def gaussian_density_full(spark: SparkSession, sf: str) -> DataFrame:
    """Correlated components, against the two-dimensional closed form."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = table(spark, sf, "lineitem").select(*keys, F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("x"))
    found = clustering.gaussian_logpdf(rows, "x", [0.5, 0.5], [[1.0, 0.5], [0.5, 1.0]])
    return found.select(*keys, rounded("logpdf").alias("logpdf"))


@catalog.query("gaussian_mixture", "select count(*) as n, count(*)::double as certainty from lineitem")
def gaussian_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Every row has a cluster, and its probabilities add up to 1."""
    rows = table(spark, sf, "lineitem").select(F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("x"))
    model = clustering.gaussian_mixture(rows, "x", 2, iterations=5)
    scored = clustering.predict_mixture(rows, model, "x")
    placed = F.when(F.col("cluster").between(0, 1), 1)
    return scored.agg(F.count(placed).alias("n"), rounded(F.sum(v.total(F.col("probabilities"))), 3).alias("certainty"))


# Slots of the term counts.  A topic model keeps topics x slots on the driver, so terms share slots by their hash;
# none is left out, however many there are.
TERM_SLOTS = 1 << 16


def counted_terms(docs: DataFrame) -> DataFrame:
    return text_features.hashing_tf(docs, "words", TERM_SLOTS, "counts").select("doc_id", "counts")


@catalog.query("topic_reports")
def topic_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Topic reports over the whole texts: top terms, documents and quality."""
    docs = tokens(spark, sf)
    counted = materialize(counted_terms(docs), "counts")
    model = clustering.topics(counted, "counts", k=4, iterations=3, optimizer="online")
    mix = materialize(clustering.topic_mix(model, counted, "doc_id"), "mix")
    terms = clustering.top_terms(model, 3).select(
        F.lit("terms").alias("report"), F.col("topic").cast("long").alias("topic"), F.col("term").cast("long").alias("item"), "weight"
    )
    best = clustering.top_documents(mix, "doc_id", 3).select(
        F.lit("documents").alias("report"), F.col("topic").cast("long").alias("topic"), F.col("doc_id").alias("item"), "weight"
    )
    main = clustering.top_topics(mix, "doc_id", 1).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("main topic of").alias("report"), F.col("topic").cast("long").alias("topic"), F.col("n").alias("item"), F.lit(1.0).alias("weight")
    )
    quality = clustering.topic_quality(model, counted).select(
        F.lit("quality").alias("report"), F.lit(None).cast("long").alias("topic"), F.lit(None).cast("long").alias("item"),
        F.col("log_perplexity").alias("weight"),
    )
    return terms.unionByName(best).unionByName(main).unionByName(quality)


@catalog.query(
    "topic_mix", "select doc_id, 1.0::double as total, 4::bigint as topics from documents"
)
def topic_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The topic shares of every text add up to 1."""
    docs = tokens(spark, sf)
    counted = materialize(counted_terms(docs), "counts")
    model = clustering.topics(counted, "counts", k=4, iterations=2, optimizer="online")
    mix = clustering.topic_mix(model, counted, "doc_id")
    return mix.groupBy("doc_id").agg(rounded(F.sum("weight")).alias("total"), F.count(F.lit(1)).alias("topics"))


# --- random draws from keys -----------------------------------------------------------


# Mean and variance of each distribution.
MOMENTS = {
    "uniform": (0.5, 1 / 12),
    "normal": (0.0, 1.0),
    "exponential": (2.0, 4.0),
    "log_normal": (1.133148453, 0.364695854),
    "poisson": (3.0, 3.0),
}


@catalog.query(
    "keyed_random_columns",
    f"select unnest({list(MOMENTS)}) as name, count(*) as n, true as mean_near, true as variance_near from lineitem",
)
def keyed_random_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Draws made for every order line have the moments of their distribution."""
    key = F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    u, z = gen.keyed_uniform(key), gen.keyed_normal(key, 7)
    columns = {
        "uniform": u,
        "normal": z,
        "exponential": -F.log(u) * 2.0,
        "log_normal": F.exp(z * 0.5),
        "poisson": trees.poisson_from_uniform(u, 3.0).cast("double"),
    }
    draws = table(spark, sf, "lineitem").select(
        F.inline(F.array(*[F.struct(F.lit(name).alias("name"), c.alias("v")) for name, c in columns.items()]))
    )
    pick = lambda i: F.coalesce(*[F.when(F.col("name") == name, F.lit(float(m[i]))) for name, m in MOMENTS.items()])
    found = draws.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("_m"), F.var_samp("v").alias("_v"))
    return found.select(
        "name",
        "n",
        (F.abs(F.col("_m") - pick(0)) < 0.15).alias("mean_near"),
        (F.abs(F.col("_v") - pick(1)) < pick(1) * 0.2).alias("variance_near"),
    )


# Mean and variance of the rejection draws.
REJECTION_MOMENTS = {"gamma_half": (1.0, 2.0), "gamma_seven": (21.0, 63.0), "poisson_800": (800.0, 800.0), "poisson_150": (150.0, 150.0)}


@catalog.query(
    "keyed_rejection_draws",
    f"select unnest({list(REJECTION_MOMENTS)}) as name, count(*) as n, true as mean_near, true as variance_near from orders",
)
def keyed_rejection_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Gamma draws below and above shape 1, and Poisson draws of large means, have their moments."""
    key = F.col("o_orderkey")
    columns = {
        "gamma_half": gen.keyed_gamma(key, 0.5, 2.0),
        "gamma_seven": gen.keyed_gamma(key, 7.0, 3.0),
        "poisson_800": gen.keyed_poisson(key, 800.0),
        "poisson_150": gen.keyed_poisson(key, 150.0, 5),
    }
    draws = table(spark, sf, "orders").select(
        F.inline(F.array(*[F.struct(F.lit(name).alias("name"), c.alias("v")) for name, c in columns.items()]))
    )
    pick = lambda i: F.coalesce(*[F.when(F.col("name") == n, F.lit(m[i])) for n, m in REJECTION_MOMENTS.items()])
    found = draws.groupBy("name").agg(F.count("v").alias("n"), F.avg("v").alias("_m"), F.var_samp("v").alias("_v"))
    # Six standard errors of the mean.
    return found.select(
        "name",
        "n",
        (F.abs(F.col("_m") - pick(0)) < 6 * F.sqrt(pick(1) / F.col("n"))).alias("mean_near"),
        (F.abs(F.col("_v") - pick(1)) < pick(1) * 0.3).alias("variance_near"),
    )


# --- streaming ---------------------------------------------------------------------------


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One table, a file or a folder of them, as a stream."""
    path = f"{sf}/{name}.parquet"
    schema = table(spark, sf, name).schema
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    if found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(found).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    # A stream reads folders only.
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def trained_kmeans(spark: SparkSession, sf: str) -> StreamingKMeans:
    model = StreamingKMeans(spark, new_path(spark, "kmeans-state"), decay=0.5)
    centres = label_centres(spark, sf)
    model.start(centres, [10.0] * len(centres))
    stream = stream_of(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"))
    model.train_on(stream, new_path(spark, "kmeans-checkpoint")).awaitTermination()
    return model


_STREAMED = _CENTRES + """, o as (select cluster, unnest(c) as v, generate_subscripts(c, 1) - 1 as pos from c),
n as (select o.cluster, o.pos, (o.v * 5 + coalesce(s.s, 0)) / (5 + coalesce(s.n, 0)) as v, 5.0::double + coalesce(s.n, 0) as w
      from o left join s on s.cluster = o.cluster and s.pos = o.pos) """


@catalog.query(
    "streaming_kmeans_batch",
    _STREAMED + "select cluster, pos::int as pos, round(v, 6) as value, w as weight from n",
)
def streaming_kmeans_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Centres after the stream, with start weight 10 and decay one half."""
    newest = trained_kmeans(spark, sf).state.latest()
    return newest.select("cluster", "weight", F.posexplode("centre").alias("pos", "value")).withColumn("value", rounded("value"))


@catalog.query(
    "streaming_kmeans_predict",
    _STREAMED
    + """, k as (select cluster, list(v order by pos) as c from n group by 1)
    select vec_id, arg_min(k.cluster, list_sum(list_transform(list_zip(x, k.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as cluster
    from x cross join k group by 1""",
)
def streaming_kmeans_predict(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed stream scored with the newest model."""
    model = trained_kmeans(spark, sf)
    stream = stream_of(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    sink = new_path(spark, "assigned")
    model.predict_on(stream, sink, new_path(spark, "predict-checkpoint")).awaitTermination()
    return spark.read.parquet(sink).select("vec_id", "cluster")


def line_stream(spark: SparkSession, sf: str) -> DataFrame:
    return stream_of(spark, sf, "lineitem").select(
        "l_orderkey",
        F.array(F.lit(1.0), F.col("l_quantity") / 50).alias("features"),
        (F.col("l_extendedprice") / 100000).alias("label"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("class"),
    )


@catalog.query(
    "streaming_linear",
    """with r as (select l_quantity / 50 as x, l_extendedprice / 100000 as y from lineitem),
    w1 as (select 0.0::double - 0.5 * avg(0 - y) as a, 0.0::double - 0.5 * avg((0 - y) * x) as b from r),
    w2 as (select max(a) - 0.5 / sqrt(2) * avg(a + b * x - y) as a, max(b) - 0.5 / sqrt(2) * avg((a + b * x - y) * x) as b from r cross join w1)
    select 0 as i, round(a, 6) as weight from w2 union all select 1, round(b, 6) from w2""",
)
def streaming_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Two steps over the one batch of the stream."""
    model = StreamingRegression(spark, new_path(spark, "linear-state"), step=0.5, iterations=2)
    model.start([0.0, 0.0])
    model.train_on(line_stream(spark, sf), new_path(spark, "linear-checkpoint")).awaitTermination()
    newest = model.state.latest().select(F.posexplode("weights").alias("i", "weight"))
    return newest.withColumn("weight", rounded("weight"))


@catalog.query(
    "streaming_logistic",
    """with r as (select l_quantity / 50 as x, (l_quantity > 25)::int as y from lineitem),
    w1 as (select 0.0::double - 0.5 * avg(0.5::double - y) as a, 0.0::double - 0.5 * avg((0.5::double - y) * x) as b from r),
    w2 as (select max(a) - 0.5 / sqrt(2) * avg(1 / (1 + exp(-a - b * x)) - y) as a,
      max(b) - 0.5 / sqrt(2) * avg((1 / (1 + exp(-a - b * x)) - y) * x) as b from r cross join w1)
    select 0 as i, round(a, 6) as weight from w2 union all select 1, round(b, 6) from w2""",
)
def streaming_logistic(spark: SparkSession, sf: str) -> DataFrame:
    model = StreamingLogisticRegression(spark, new_path(spark, "logistic-state"), step=0.5, iterations=2)
    model.start([0.0, 0.0])
    model.train_on(line_stream(spark, sf), new_path(spark, "logistic-checkpoint"), label="class").awaitTermination()
    newest = model.state.latest().select(F.posexplode("weights").alias("i", "weight"))
    return newest.withColumn("weight", rounded("weight"))


@catalog.query(
    "streaming_predict",
    "select l_orderkey, round(0.25 + 0.5 * (l_quantity / 50), 6) as prediction from lineitem",
)
def streaming_predict(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed stream scored by a stateless column and written out."""
    model = StreamingRegression(spark, new_path(spark, "linear-state"))
    model.start([0.25, 0.5])
    scored = model.predict(line_stream(spark, sf)).select("l_orderkey", rounded("prediction").alias("prediction"))
    sink = new_path(spark, "scored")
    scored.writeStream.format("parquet").option("path", sink).option(
        "checkpointLocation", new_path(spark, "scored-checkpoint")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(scored.schema).parquet(sink)


def in_two_runs(spark: SparkSession, sf: str, train) -> None:
    """Train on the order lines up to number 3, then on the others, each with a checkpoint folder of its own."""
    lines = table(spark, sf, "lineitem")
    for chosen in (F.col("l_linenumber") <= 3, F.col("l_linenumber") > 3):
        part = new_path(spark, "line-part")
        lines.where(chosen).write.parquet(part)
        train(spark.readStream.schema(lines.schema).parquet(part), new_path(spark, "run-checkpoint")).awaitTermination()


_TWO_RUNS = """with r as (select l_quantity / 50 as x, l_extendedprice / 100000 as y, (l_quantity > 25)::int as c, l_linenumber <= 3 as f from lineitem), """


@catalog.query(
    "streaming_linear_two_runs",
    _TWO_RUNS
    + """w1 as (select 0.5 * avg(y) as a, 0.5 * avg(y * x) as b from r where f),
    w2 as (select max(a) - 0.5 * avg(a + b * x - y) as a, max(b) - 0.5 * avg((a + b * x - y) * x) as b from r cross join w1 where not f)
    select 0 as i, round(a, 6) as weight from w2 union all select 1, round(b, 6) from w2""",
)
def streaming_linear_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Weights carried from one query to the next, whose batch numbers start anew."""
    model = StreamingRegression(spark, new_path(spark, "linear-state"), step=0.5, iterations=1)
    model.start([0.0, 0.0])
    features = F.array(F.lit(1.0), F.col("l_quantity") / 50).alias("features")
    label = (F.col("l_extendedprice") / 100000).alias("label")
    in_two_runs(spark, sf, lambda stream, checkpoint: model.train_on(stream.select(features, label), checkpoint))
    return model.state.latest().select(F.posexplode("weights").alias("i", "weight")).withColumn("weight", rounded("weight"))


@catalog.query(
    "streaming_logistic_two_runs",
    _TWO_RUNS
    + """w1 as (select -0.5 * avg(0.5::double - c) as a, -0.5 * avg((0.5::double - c) * x) as b from r where f),
    w2 as (select max(a) - 0.5 * avg(1 / (1 + exp(-a - b * x)) - c) as a, max(b) - 0.5 * avg((1 / (1 + exp(-a - b * x)) - c) * x) as b
      from r cross join w1 where not f)
    select 0 as i, round(a, 6) as weight from w2 union all select 1, round(b, 6) from w2""",
)
def streaming_logistic_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    model = StreamingLogisticRegression(spark, new_path(spark, "logistic-state"), step=0.5, iterations=1)
    model.start([0.0, 0.0])
    features = F.array(F.lit(1.0), F.col("l_quantity") / 50).alias("features")
    label = F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("label")
    in_two_runs(spark, sf, lambda stream, checkpoint: model.train_on(stream.select(features, label), checkpoint))
    return model.state.latest().select(F.posexplode("weights").alias("i", "weight")).withColumn("weight", rounded("weight"))


@catalog.query(
    "streaming_kmeans_two_runs",
    """with r as (select l_quantity / 50 as x, l_linenumber <= 3 as f from lineitem),
    a as (select case when x <= 0.5 then 0 else 1 end as k, count(*) as n, sum(x) as s from r where f group by 1),
    m as (select k, (k * 10 * 0.5 + s) / (10 * 0.5 + n) as c, 10 * 0.5 + n as w from a),
    d as (select x, arg_min(k, abs(x - c)) as k from (select x, row_number() over () as id from r where not f) cross join m group by x, id),
    b as (select k, count(*) as n, sum(x) as s from d group by 1)
    select m.k::int as cluster, round((c * w * 0.5 + coalesce(s, 0)) / (w * 0.5 + coalesce(n, 0)), 6) as value,
      round((w * 0.5 + coalesce(n, 0))::double, 6) as weight from m left join b on m.k = b.k""",
)
def streaming_kmeans_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two centres, started at 0 and 1 with weight 10, over two runs with decay one half."""
    model = StreamingKMeans(spark, new_path(spark, "kmeans-state"), decay=0.5)
    model.start([[0.0], [1.0]], [10.0, 10.0])
    features = F.array(F.col("l_quantity") / 50).alias("features")
    in_two_runs(spark, sf, lambda stream, checkpoint: model.train_on(stream.select(features), checkpoint))
    return model.state.latest().select("cluster", rounded(F.col("centre")[0]).alias("value"), rounded("weight").alias("weight"))
