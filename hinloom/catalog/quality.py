"""Order-based operators, statistics tests and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.catalog.base import Catalog, rounded, table
from hinloom.operators import dictionary as dic
from hinloom.operators import evaluation as ev
from hinloom.operators import ordering as order
from hinloom.operators import statistics as stats
from hinloom.runtime import materialize

catalog = Catalog()

# --- order ---------------------------------------------------------------------


@catalog.query(
    "sliding_by_key",
    """select user_id, p as position, v0 as value_0, v1 as value_1, v2 as value_2 from (
      select user_id, row_number() over (order by user_id, ts, event_id) - 1 as p, value as v0,
        lead(value, 1) over (partition by user_id order by ts, event_id) as v1,
        lead(value, 2) over (partition by user_id order by ts, event_id) as v2 from events) where v2 is not null""",
)
def sliding_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Three consecutive events of a user, in chunks far smaller than a hot user."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return order.sliding(events, ["ts", "event_id"], 3, ["value"], key="user_id", chunk=512)


@catalog.query(
    "sliding_global",
    """select p as position, a as value_0, b as value_1 from (
      select row_number() over (order by ts, event_id) - 1 as p, value as a, lead(value) over (order by ts, event_id) as b
      from events) where b is not null""",
)
def sliding_global(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("ts", "event_id", "value")
    return order.sliding(events, ["ts", "event_id"], 2, ["value"])


_COUNTS = """with s as (select l_extendedprice as score, count(*) filter (where l_returnflag = 'R') as pos,
  count(*) filter (where l_returnflag <> 'R') as neg from lineitem group by 1),
c as (select score, pos, neg, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
  row_number() over (order by score desc) - 1 as rn from s) """


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Line price as the score, returned lines as the positives."""
    label = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("score"), label.alias("label"))


@catalog.query(
    "cumulative_counts",
    _COUNTS + "select score, pos, neg, tp::bigint as pos_cum, fp::bigint as neg_cum from c",
)
def cumulative_counts(spark: SparkSession, sf: str) -> DataFrame:
    return order.cumulative_counts(scored(spark, sf), "score", "label")


@catalog.query(
    "average_rank",
    """select l_quantity as value, count(*) as n, sum(count(*)) over (order by l_quantity)::double - (count(*) - 1) / 2.0::double as rank
       from lineitem group by 1""",
)
def average_rank(spark: SparkSession, sf: str) -> DataFrame:
    return order.average_ranks(table(spark, sf, "lineitem"), "l_quantity")


@catalog.query(
    "score_downsampling",
    _COUNTS
    + """select max(score) as score, sum(pos)::bigint as pos, sum(neg)::bigint as neg from c
         group by rn // ((select count(*) from s) // 100)""",
)
def score_downsampling(spark: SparkSession, sf: str) -> DataFrame:
    return order.downsample_scores(scored(spark, sf), "score", "label", 100)


@catalog.query("global_sort", "select o_orderkey, o_totalprice from orders")
def global_sort(spark: SparkSession, sf: str) -> DataFrame:
    return order.global_sort(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey")


@catalog.query(
    "topk_per_key",
    """select o_custkey, o_orderkey, o_totalprice, r::int as rank from (
      select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3""",
)
def topk_per_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return order.top_k_per_key(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@catalog.query(
    "topk_per_hot_key",
    """select l_linestatus, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, r::int as rank from (
      select *, row_number() over (partition by l_linestatus order by l_extendedprice desc, l_orderkey, l_partkey, l_suppkey, l_linenumber) as r
      from lineitem) where r <= 1500""",
)
def topk_per_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """Two keys hold all rows, and the limit is above Spark's own trimming."""
    rows = table(spark, sf, "lineitem").select(
        "l_linestatus", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"
    )
    by = [F.desc("l_extendedprice"), *[F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber")]]
    return order.top_k_per_key(rows, ["l_linestatus"], by, 1500)


@catalog.query(
    "topk_global", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25"
)
def topk_global(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return order.top_k(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


# --- validation and splits ---------------------------------------------------------


@catalog.query(
    "label_validators",
    """select 'quality' as label, count(*) filter (where quality not in (0, 1)) = 0 as valid from labels
       union all select 'priority', false from labels group by 2
       union all select 'linenumber', count(*) filter (where l_linenumber < 0 or l_linenumber >= 8) = 0 from lineitem""",
)
def label_validators(spark: SparkSession, sf: str) -> DataFrame:
    priority = table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))

    def verdict(df: DataFrame, label: str, classes: int) -> DataFrame:
        bad = dic.invalid_labels(df, label, classes).agg(F.count(F.lit(1)).alias("n"))
        return bad.select(F.lit(label.removeprefix("l_")).alias("label"), (F.col("n") == 0).alias("valid"))

    return (
        verdict(table(spark, sf, "labels"), "quality", 2)
        .unionByName(verdict(priority, "priority", 5))
        .unionByName(verdict(table(spark, sf, "lineitem"), "l_linenumber", 8))
    )


@catalog.query(
    "k_fold_cover",
    """select 'validated' as what, count(*) as n from orders
       union all select 'validated keys', count(distinct o_orderkey) from orders
       union all select 'keys trained four times', count(distinct o_orderkey) from orders""",
)
def k_fold_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds: every key validates once and trains four times."""
    folds = dic.k_folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)
    validation, training = folds[0][1], folds[0][0]
    for train, valid in folds[1:]:
        validation, training = validation.unionByName(valid), training.unionByName(train)
    uses = training.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("uses"))

    def count(df: DataFrame, what: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")

    return (
        count(validation, "validated")
        .unionByName(count(validation.distinct(), "validated keys"))
        .unionByName(count(uses.where(F.col("uses") == 4), "keys trained four times"))
    )


# --- statistics --------------------------------------------------------------------


@catalog.query("pearson_pair", "select round(corr(l_quantity, l_extendedprice), 9) as correlation from lineitem")
def pearson_pair(spark: SparkSession, sf: str) -> DataFrame:
    pair = stats.pearson_pair(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return pair.withColumn("correlation", rounded("correlation", 9))


@catalog.query(
    "spearman",
    """with d as (select row_number() over () as id, l_quantity as a, l_extendedprice as b, l_discount as c from lineitem),
    t as (select id, 0 as i, a as v from d union all select id, 1, b from d union all select id, 2, c from d),
    r as (select id, i, rank() over (partition by i order by v) + (count(*) over (partition by i, v) - 1) / 2.0::double as r from t)
    select x.i::bigint as i, y.i::bigint as j, case when x.i = y.i then 1.0::double else round(corr(x.r, y.r), 9) end as value
    from r x join r y on x.id = y.id group by 1, 2, x.i, y.i""",
)
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    cells = stats.spearman(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return cells.withColumn("value", rounded("value", 9))


@catalog.query(
    "chi_square",
    """with f as (
      select 0 as feature, l_linestatus as v, l_returnflag as y from lineitem
      union all select 1, l_linenumber::varchar, l_returnflag from lineitem
      union all select 2, l_discount::varchar, l_returnflag from lineitem),
    o as (select feature, v, y, count(*) as o from f group by all),
    r as (select feature, v, count(*)::double as r from f group by all),
    c as (select feature, y, count(*)::double as c from f group by all),
    n as (select count(*)::double as n from lineitem)
    select r.feature, round(sum(pow(coalesce(o, 0) - r * c / n, 2) / (r * c / n)), 4) as statistic,
      (count(distinct r.v) - 1) * (count(distinct c.y) - 1) as df
    from r join c on c.feature = r.feature cross join n
    left join o on o.feature = r.feature and o.v = r.v and o.y = c.y group by 1""",
)
def chi_square(spark: SparkSession, sf: str) -> DataFrame:
    tests = stats.chi_square_independence(
        table(spark, sf, "lineitem"), ["l_linestatus", "l_linenumber", "l_discount"], "l_returnflag"
    )
    return tests.select("feature", rounded("statistic", 4).alias("statistic"), "df")


# With an even number of degrees of freedom the tail is a finite sum.
@catalog.query(
    "chi_square_p_values",
    """select feature, df, round(sum(exp(-s / 2) * pow(s / 2, k) / gamma(k + 1)), 6) as p_value from (
    with f as (
      select 0 as feature, l_linestatus as v, l_returnflag as y from lineitem
      union all select 1, l_linenumber::varchar, l_returnflag from lineitem
      union all select 2, l_discount::varchar, l_returnflag from lineitem),
    o as (select feature, v, y, count(*) as o from f group by all),
    r as (select feature, v, count(*)::double as r from f group by all),
    c as (select feature, y, count(*)::double as c from f group by all),
    n as (select count(*)::double as n from lineitem)
    select r.feature, sum(pow(coalesce(o, 0) - r * c / n, 2) / (r * c / n)) as s,
      (count(distinct r.v) - 1) * (count(distinct c.y) - 1) as df
    from r join c on c.feature = r.feature cross join n
    left join o on o.feature = r.feature and o.v = r.v and o.y = c.y group by 1)
    join range(0, 1000) t(k) on k < df / 2 group by 1, 2""",
)
def chi_square_p_values(spark: SparkSession, sf: str) -> DataFrame:
    tests = stats.chi_square_independence(
        table(spark, sf, "lineitem"), ["l_linestatus", "l_linenumber", "l_discount"], "l_returnflag"
    )
    described = stats.describe_test(tests, "pearson", "the outcomes are statistically independent")
    return described.select("feature", "df", rounded("p_value").alias("p_value"))


@catalog.query(
    "chi_square_fit",
    """with o as (select o_orderpriority, count(*)::double as o from orders group by 1), t as (select sum(o) as t, count(*) as n from o)
    select round(sum(pow(o - t / n, 2) / (t / n)), 6) as statistic, count(*) - 1 as df from o cross join t""",
)
def chi_square_fit(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return stats.chi_square_fit(counts, "n").select(rounded("statistic").alias("statistic"), "df")


KDE_POINTS = [0.0, 5.0, 10.0, 25.0, 50.0, 100.0]


@catalog.query(
    "kernel_density",
    f"""select point, round(avg(exp(-0.5 * pow((value - point) / 3, 2))) / (3 * sqrt(2 * pi())), 9) as density
        from events cross join (select unnest({KDE_POINTS})::double as point) group by 1""",
)
def kernel_density(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.kernel_density(table(spark, sf, "events"), "value", KDE_POINTS, 3.0, at_once=4)
    return found.withColumn("density", rounded("density", 9))


@catalog.query(
    "ks_statistic",
    """with d as (select o_totalprice as v, row_number() over (order by o_totalprice) as i, count(*) over () as n from orders),
    b as (select min(v) as lo, max(v) as hi from d)
    select max(n) as n, round(max(greatest(i / n - (v - lo) / (hi - lo), (v - lo) / (hi - lo) - (i - 1) / n)), 9) as statistic
    from d cross join b""",
)
def ks_statistic(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals against a uniform distribution over their range."""
    orders = table(spark, sf, "orders")
    ends = orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).first()
    uniform = lambda v: (v - ends["lo"]) / (ends["hi"] - ends["lo"])
    found = stats.ks_statistic(orders, "o_totalprice", uniform)
    return found.withColumn("statistic", rounded("statistic", 9))


@catalog.query("ks_normal_test")
def ks_normal_test(spark: SparkSession, sf: str) -> DataFrame:
    return stats.ks_normal_test(table(spark, sf, "customer"), "c_acctbal", 4500.0, 3000.0)


# --- evaluation ----------------------------------------------------------------------

_RATES = _COUNTS + """, t as (select sum(pos) as p, sum(neg) as n from s),
r as (select score as threshold, tp::bigint as tp, fp::bigint as fp, tp / (tp + fp) as precision, tp / p as recall, fp / n as fpr
      from c cross join t) """


def curve(spark: SparkSession, sf: str) -> DataFrame:
    return ev.binary_curve(scored(spark, sf), "score", "label")


@catalog.query(
    "binary_curve",
    _RATES + "select threshold, tp, fp, round(precision, 6) as precision, round(recall, 6) as recall, round(fpr, 6) as fpr from r",
)
def binary_curve(spark: SparkSession, sf: str) -> DataFrame:
    points = curve(spark, sf)
    for c in ("precision", "recall", "fpr"):
        points = points.withColumn(c, rounded(c))
    return points


@catalog.query(
    "roc_points",
    _RATES
    + """select round(fpr, 6) as x, round(recall, 6) as y from r
         union all select 0.0::double, 0.0::double union all select 1.0::double, 1.0::double""",
)
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return ev.roc(curve(spark, sf)).select(rounded("x").alias("x"), rounded("y").alias("y"))


@catalog.query(
    "precision_recall_points",
    _RATES + "select round(recall, 6) as x, round(precision, 6) as y from r union all select 0.0::double, 1.0::double",
)
def precision_recall_points(spark: SparkSession, sf: str) -> DataFrame:
    return ev.precision_recall(curve(spark, sf)).select(rounded("x").alias("x"), rounded("y").alias("y"))


@catalog.query(
    "f_measure",
    _RATES
    + """select threshold, round(case when precision + recall = 0 then 0 else 1.25::double * precision * recall
         / (0.25::double * precision + recall) end, 6) as f from r""",
)
def f_measure(spark: SparkSession, sf: str) -> DataFrame:
    return ev.f_measure(curve(spark, sf), 0.5).withColumn("f", rounded("f"))


@catalog.query(
    "auc",
    _RATES
    + """, roc as (select fpr as x, recall as y, 1 as o, -threshold as q from r union all select 0, 0, 0, 0 union all select 1, 1, 2, 0),
    pr as (select recall as x, precision as y, 1 as o, -threshold as q from r union all select 0, 1, 0, 0)
    select 'roc' as curve, round(sum(a), 9) as area from (
      select (x - lag(x) over (order by o, q)) * (y + lag(y) over (order by o, q)) / 2 as a from roc)
    union all select 'pr', round(sum(a), 9) from (
      select (x - lag(x) over (order by o, q)) * (y + lag(y) over (order by o, q)) / 2 as a from pr)""",
)
def auc(spark: SparkSession, sf: str) -> DataFrame:
    areas = ev.areas(scored(spark, sf), "score", "label")
    named = F.inline(F.array(*[F.struct(F.lit(c).alias("curve"), rounded(c, 9).alias("area")) for c in ("roc", "pr")]))
    return areas.select(named)


@catalog.query(
    "curve_areas",
    _RATES
    + """, roc as (select fpr as x, recall as y, 1 as o, -threshold as q from r union all select 0, 0, 0, 0 union all select 1, 1, 2, 0),
    a as (select (x - lag(x) over (order by o, q)) * (y + lag(y) over (order by o, q)) / 2 as a from roc)
    select round(sum(a), 9) as area from a""",
)
def curve_areas(spark: SparkSession, sf: str) -> DataFrame:
    """The area under the points of a curve, whatever they come from."""
    return ev.area(ev.roc(materialize(curve(spark, sf), "curve"))).select(rounded("area", 9).alias("area"))


@catalog.query(
    "binary_curve_binned",
    _COUNTS
    + """, g as (select max(score) as threshold, sum(pos) as pos, sum(neg) as neg from c group by rn // ((select count(*) from s) // 50)),
    t as (select sum(pos) as p, sum(neg) as n from s)
    select threshold, round(sum(pos) over (order by threshold desc) / p, 6) as recall,
      round(sum(neg) over (order by threshold desc) / n, 6) as fpr from g cross join t""",
)
def binary_curve_binned(spark: SparkSession, sf: str) -> DataFrame:
    points = ev.binary_curve(scored(spark, sf), "score", "label", bins=50)
    return points.select("threshold", rounded("recall").alias("recall"), rounded("fpr").alias("fpr"))


_CLASSES = """with p as (select substr(o_orderpriority, 1, 1)::int as label, floor(o_totalprice / 100000)::int as prediction from orders),
m as (select label, prediction, count(*) as n from p group by 1, 2) """


def class_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Order priority as the class, price band as its prediction."""
    return table(spark, sf, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("label"),
        F.floor(F.col("o_totalprice") / 100000).cast("int").alias("prediction"),
    )


@catalog.query("confusion_matrix", _CLASSES + "select label, prediction, n from m")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion(class_predictions(spark, sf), "label", "prediction")


_PER_LABEL = _CLASSES + """, t as (select count(*) as n from p),
l as (select label, count(*) as support, count(*) filter (where label = prediction) as tp from p group by 1),
q as (select prediction, count(*) as c from p group by 1),
z as (select l.label, support, tp, coalesce(c, 0) - tp as fp from l left join q on q.prediction = l.label),
e as (select label, support, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, tp / support as recall,
      fp / (n - support) as fpr from z cross join t),
f as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f from e) """


@catalog.query(
    "multiclass_per_label",
    _PER_LABEL
    + """select label, support, round(recall, 6) as tpr, round(fpr, 6) as fpr, round(precision, 6) as precision,
         round(recall, 6) as recall, round(f, 6) as f from f""",
)
def multiclass_per_label(spark: SparkSession, sf: str) -> DataFrame:
    rates = ev.per_label(ev.confusion(class_predictions(spark, sf), "label", "prediction"))
    for c in ("tpr", "fpr", "precision", "recall", "f"):
        rates = rates.withColumn(c, rounded(c))
    return rates


@catalog.query(
    "multiclass_summary",
    _PER_LABEL
    + """select round(sum(recall * support) / sum(support), 6) as accuracy, round(sum(recall * support) / sum(support), 6) as weighted_tpr,
      round(sum(fpr * support) / sum(support), 6) as weighted_fpr, round(sum(precision * support) / sum(support), 6) as weighted_precision,
      round(sum(recall * support) / sum(support), 6) as weighted_recall, round(sum(f * support) / sum(support), 6) as weighted_f from f""",
)
def multiclass_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = ev.multiclass_summary(ev.confusion(class_predictions(spark, sf), "label", "prediction"))
    return summary.select(*[rounded(c).alias(c) for c in summary.columns])


_SETS = """with a as (select l_orderkey as k, l_linenumber as v, bool_or(l_quantity > 25) as p, bool_or(l_discount > 0.05) as t
  from lineitem group by 1, 2),
d as (select k, count(*) filter (where p and t)::double as b, count(*) filter (where p and not t)::double as op,
  count(*) filter (where t and not p)::double as ot from a group by 1) """


def label_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: line numbers of large lines as predicted, of discounted lines as true.

    A set holds at most the seven line numbers.
    """
    picked = lambda c: F.collect_set(F.when(c, F.col("l_linenumber")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        picked(F.col("l_quantity") > 25).alias("predicted"), picked(F.col("l_discount") > 0.05).alias("truth")
    )


@catalog.query(
    "multilabel_summary",
    _SETS
    + """, s as (select coalesce(b / nullif(b + op, 0), 0) as pr, coalesce(b / nullif(b + ot, 0), 0) as rc,
       coalesce(2 * b / nullif(2 * b + op + ot, 0), 0) as f1, coalesce(b / nullif(b + op + ot, 0), 0) as ac, * from d)
    select round(avg(case when op + ot = 0 then 1.0::double else 0 end), 6) as subset_accuracy, round(avg(ac), 6) as accuracy,
      round(avg(op + ot) / (select count(distinct v) from a where t), 6) as hamming_loss, round(avg(pr), 6) as precision,
      round(avg(rc), 6) as recall, round(avg(f1), 6) as f1, round(sum(b) / sum(b + op), 6) as micro_precision,
      round(sum(b) / sum(b + ot), 6) as micro_recall, round(2 * sum(b) / sum(2 * b + op + ot), 6) as micro_f1 from s""",
)
def multilabel_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = ev.multilabel_summary(label_sets(spark, sf), "predicted", "truth")
    return summary.select(*[rounded(c).alias(c) for c in summary.columns])


@catalog.query(
    "multilabel_per_label",
    _SETS
    + """select v as label, round(coalesce(count(*) filter (where p and t) / nullif(count(*) filter (where p), 0), 0), 6) as precision,
      round(coalesce(count(*) filter (where p and t) / nullif(count(*) filter (where t), 0), 0), 6) as recall,
      round(2 * count(*) filter (where p and t) / (count(*) filter (where p) + count(*) filter (where t)), 6) as f1
      from a where p or t group by 1""",
)
def multilabel_per_label(spark: SparkSession, sf: str) -> DataFrame:
    rates = ev.multilabel_per_label(label_sets(spark, sf), "predicted", "truth")
    return rates.select("label", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")])


_RANKING = """with b as (select o_custkey as c, p_brand as b, sum(l_quantity) as q, bool_or(l_returnflag = 'R') as rel from lineitem
  join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey group by 1, 2),
r as (select *, row_number() over (partition by c order by q desc, b) as n from b),
h as (select *, case when rel and n <= 8 then 1.0::double else 0 end as h from r),
g as (select *, sum(h) over (partition by c order by n) as hits, count(*) filter (where rel) over (partition by c) as size from h),
m as (select c, max(size) as size, sum(case when n <= 5 then h else 0 end) / 5 as prec,
  sum(case when n <= 8 then h * hits / n else 0 end) as ap, sum(case when n <= 5 then h / ln(n + 1) else 0 end) as dcg from g group by 1),
e as (select c, case when size = 0 then 0.0::double else prec end as precision_at,
  case when size = 0 then 0.0::double else ap / size end as average_precision,
  case when size = 0 then 0.0::double else dcg / (select sum(1 / ln(i + 1)) from range(1, 6) t(i) where i <= size) end as ndcg_at from m) """


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: the eight brands bought most, and the brands with returns.

    There are few brands, which bounds both arrays.
    """
    lines = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    brands = materialize(
        lines.groupBy("o_custkey", "p_brand").agg(
            F.sum("l_quantity").alias("q"), F.max(F.col("l_returnflag") == "R").alias("rel")
        ),
        "brands",
    )
    top = order.top_k_per_key(brands, ["o_custkey"], [F.desc("q"), F.col("p_brand")], 8)
    predicted = top.groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("rank", "p_brand")))["p_brand"].alias("predicted")
    )
    relevant = brands.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("rel"), F.col("p_brand"))).alias("relevant"))
    return predicted.join(relevant, "o_custkey")


@catalog.query(
    "ranking_rows",
    _RANKING
    + """select c as o_custkey, round(precision_at, 6) as precision_at, round(average_precision, 6) as average_precision,
         round(ndcg_at, 6) as ndcg_at from e""",
)
def ranking_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.ranking_rows(rankings(spark, sf), "predicted", "relevant", 5)
    return rows.select("o_custkey", *[rounded(c).alias(c) for c in ("precision_at", "average_precision", "ndcg_at")])


@catalog.query(
    "ranking_summary",
    _RANKING
    + """select round(avg(precision_at), 6) as precision_at, round(avg(average_precision), 6) as mean_average_precision,
         round(avg(ndcg_at), 6) as ndcg_at from e""",
)
def ranking_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = ev.ranking_summary(rankings(spark, sf), "predicted", "relevant", 5)
    return summary.select(*[rounded(c).alias(c) for c in summary.columns])


@catalog.query(
    "regression_metrics",
    """with d as (select l_extendedprice / 1000 as y, l_quantity * 1.5::double as p from lineitem), m as (select avg(y) as m from d)
    select round(avg(pow(p - m, 2)), 6) as explained_variance, round(avg(abs(y - p)), 6) as mae, round(avg(pow(y - p, 2)), 6) as mse,
      round(sqrt(avg(pow(y - p, 2))), 6) as rmse, round(1 - sum(pow(y - p, 2)) / sum(pow(y - m, 2)), 6) as r2 from d cross join m""",
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("label"), (F.col("l_quantity") * 1.5).alias("prediction")
    )
    summary = ev.regression_summary(rows, "label", "prediction")
    return summary.select(*[rounded(c).alias(c) for c in summary.columns])
