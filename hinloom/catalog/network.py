"""Network queries: meta-path similarity, network build, ranks and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.catalog.base import Catalog, rounded, table
from hinloom.operators import dictionary as dic
from hinloom.operators import matrix
from hinloom.plans import affinity, hin, pathsim, rankclass
from hinloom.runtime import materialize

catalog = Catalog()

_PATHSIM = """
with w as (select distinct l_suppkey as i, l_partkey as k from lineitem),
d as (select i, count(*)::double as d from w group by i),
m as (select a.i, b.i as j, count(*)::double as m from w a join w b on a.k = b.k group by 1, 2),
s as (select m.i, m.j, 2 * m / (da.d + db.d) as s from m
      join d da on da.i = m.i join d db on db.i = m.j)
"""


def supplier_parts(spark: SparkSession, sf: str) -> DataFrame:
    return pathsim.incidence(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@catalog.query("pathsim_supplier_part", _PATHSIM + "select i, j, round(s, 6) as value from s")
def pathsim_supplier_part(spark: SparkSession, sf: str) -> DataFrame:
    return pathsim.pathsim(supplier_parts(spark, sf)).withColumn("value", rounded("value"))


@catalog.query(
    "pathsim_topk",
    _PATHSIM
    + """
select i, j, round(s, 6) as value, r::int as rank from (
  select *, row_number() over (partition by i order by s desc, j) as r from s where i <> j)
where r <= 5""",
)
def pathsim_topk(spark: SparkSession, sf: str) -> DataFrame:
    return pathsim.pathsim_top_k(supplier_parts(spark, sf), 5).withColumn("value", rounded("value"))


@catalog.query(
    "pathsim_customer_segment",
    """with w as (select c_custkey as i, c_nationkey as k, c_mktsegment as s from customer),
    m as (select a.i, b.i as j, ((a.k = b.k)::int + (a.s = b.s)::int) / 2.0::double as s from w a join w b
          on (a.k = b.k or a.s = b.s) and a.i <> b.i)
    select i, j, s as value, r::int as rank from (select *, row_number() over (partition by i order by s desc, j) as r from m)
    where r <= 4""",
)
def pathsim_customer_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Customers over nation and segment: each middle node is hot, and many customers are equal."""
    customers = table(spark, sf, "customer")
    nation = customers.select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("mid"))
    edges = nation.unionByName(customers.select("c_custkey", F.col("c_mktsegment").alias("mid")))
    return pathsim.pathsim_top_k(pathsim.incidence(edges, "c_custkey", "mid"), 4)


@catalog.query(
    "commuting_matrix",
    """
with w as (select distinct l_suppkey as i, l_partkey as k from lineitem)
select a.i, b.i as j, count(*)::double as value from w a join w b on a.k = b.k group by 1, 2""",
)
def commuting(spark: SparkSession, sf: str) -> DataFrame:
    return pathsim.commuting_matrix(supplier_parts(spark, sf))


@catalog.query(
    "pathsim_normalize",
    """
with w as (select l_suppkey as i, l_partkey as k, count(*)::double as v from lineitem group by 1, 2),
m as (select a.i, b.i as j, sum(a.v * b.v) as m from w a join w b on a.k = b.k group by 1, 2)
select m.i, m.j, round(2 * m.m / (di.m + dj.m), 6) as value from m
join m di on di.i = m.i and di.j = m.i join m dj on dj.i = m.j and dj.j = m.j""",
)
def pathsim_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicate edges add up, and the given matrix is normalised by its own diagonal."""
    w = pathsim.incidence(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "sum")
    m = materialize(pathsim.commuting_matrix(w), "commuting")
    return pathsim.normalize_commuting(m).withColumn("value", rounded("value"))


@catalog.query(
    "pathsim_nation_path",
    """
with w as (
  select i, k, sum(v) as v from (
    select c.c_nationkey as i, o.o_orderkey as ok, count(*)::double as v from customer c
    join orders o on o.o_custkey = c.c_custkey group by 1, 2) a
  join (select distinct l_orderkey as ok, l_partkey as k from lineitem) b using (ok) group by 1, 2),
d as (select i, sum(v * v) as d from w group by i),
m as (select a.i, b.i as j, sum(a.v * b.v) as m from w a join w b on a.k = b.k group by 1, 2)
select m.i, m.j, round(2 * m / (da.d + db.d), 6) as value from m
join d da on da.i = m.i join d db on db.i = m.j""",
)
def pathsim_nation_path(spark: SparkSession, sf: str) -> DataFrame:
    """nation - customer - order - part and back."""
    w = pathsim.path_incidence(
        [
            (table(spark, sf, "customer"), "c_nationkey", "c_custkey"),
            (table(spark, sf, "orders"), "o_custkey", "o_orderkey"),
            (table(spark, sf, "lineitem"), "l_orderkey", "l_partkey"),
        ]
    )
    return pathsim.pathsim(w).withColumn("value", rounded("value"))


@catalog.query(
    "metapath_incidence",
    """
with r as (select l_suppkey as key, row_number() over (order by l_suppkey) - 1 as i
           from (select distinct l_suppkey from lineitem)),
c as (select l_partkey as key, row_number() over (order by l_partkey) - 1 as j
      from (select distinct l_partkey from lineitem))
select distinct r.i, c.j, 1.0::double as value from lineitem
join r on r.key = l_suppkey join c on c.key = l_partkey""",
)
def metapath_incidence(spark: SparkSession, sf: str) -> DataFrame:
    """Keys replaced by their positions on both sides."""
    edges = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    rows = dic.dictionary(edges, "l_suppkey", "r")
    cols = dic.dictionary(edges, "l_partkey", "c")
    coded = dic.encode(edges, "l_suppkey", rows, "l_suppkey", "r", "row")
    coded = dic.encode(coded.drop("l_suppkey"), "l_partkey", cols, "l_partkey", "c", "col")
    return pathsim.incidence(coded, "row", "col")


@catalog.query(
    "dictionary_encode",
    """select p_name, row_number() over (order by p_name) - 1 as idx
       from (select distinct p_name from part)""",
)
def dictionary_encode(spark: SparkSession, sf: str) -> DataFrame:
    return dic.dictionary(table(spark, sf, "part"), "p_name")


@catalog.query(
    "external_dictionary",
    """select n.n_regionkey as idx, count(*) as n from customer c
       join nation n on n.n_nationkey = c.c_nationkey group by 1""",
)
def external_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Positions from a given table instead of a derived one."""
    coded = dic.encode(
        table(spark, sf, "customer"), "c_nationkey", table(spark, sf, "nation"), "n_nationkey", "n_regionkey", "idx"
    )
    return coded.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))


@catalog.query(
    "lookup_misses",
    "select c_custkey from customer where c_mktsegment = 'FURNITURE'",
)
def lookup_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Customers the label table does not know."""
    customers = table(spark, sf, "customer").select("c_custkey")
    known = customer_labels(spark, sf).withColumnRenamed("c_custkey", "key")
    return dic.misses(customers, "c_custkey", known, "key")


# Class of a customer's market segment; FURNITURE stays without a label.
SEGMENT_CLASS = {"AUTOMOBILE": 0, "BUILDING": 1, "HOUSEHOLD": 2, "MACHINERY": 3}


def customer_labels(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    cls = F.coalesce(*[F.when(segment == s, F.lit(k)) for s, k in SEGMENT_CLASS.items()])
    return table(spark, sf, "customer").select("c_custkey", cls.alias("class")).where(F.col("class").isNotNull())


def network(spark: SparkSession, sf: str) -> hin.Network:
    customers, suppliers = table(spark, sf, "customer"), table(spark, sf, "supplier")
    orders, parts = table(spark, sf, "orders"), table(spark, sf, "part")
    lineitem = table(spark, sf, "lineitem")
    return hin.build(
        {
            "A": hin.Entity(customers, "c_custkey", "c_name", customer_labels(spark, sf), "c_custkey", "class"),
            "C": hin.Entity(suppliers, "s_suppkey", "s_name"),
            "P": hin.Entity(orders, "o_orderkey", "o_orderpriority"),
            "T": hin.Entity(parts, "p_partkey", "p_name"),
        },
        [
            hin.Relation(orders, "A", "o_custkey", "P", "o_orderkey", "write"),
            hin.Relation(lineitem, "C", "l_suppkey", "P", "l_orderkey", "publish"),
            hin.Relation(lineitem, "P", "l_orderkey", "T", "l_partkey", "contain"),
        ],
    )


_SEGMENT_CASE = "case c_mktsegment " + " ".join(
    f"when '{s}' then {k}" for s, k in SEGMENT_CLASS.items()
) + " end"

_VERTICES = f"""
with v as (
  select 'A' as type, c_custkey::varchar as id, c_name as name,
         coalesce('L' || ({_SEGMENT_CASE})::varchar, 'L00') as label from customer
  union all select 'C', s_suppkey::varchar, s_name, 'L00' from supplier
  union all select 'P', o_orderkey::varchar, o_orderpriority, 'L00' from orders
  union all select 'T', p_partkey::varchar, p_name, 'L00' from part),
vertices as (select row_number() over (order by type, id) - 1 as vid, * from v)
"""


@catalog.query("hin_vertices", _VERTICES + "select vid, type, id, label, name from vertices")
def hin_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return network(spark, sf).vertices


@catalog.query(
    "hin_edges",
    _VERTICES
    + """
select a.vid as src, p.vid as dst, 'write' as rel from orders
  join vertices a on a.type = 'A' and a.id = o_custkey::varchar
  join vertices p on p.type = 'P' and p.id = o_orderkey::varchar
union all
select c.vid, p.vid, 'publish' from lineitem
  join vertices c on c.type = 'C' and c.id = l_suppkey::varchar
  join vertices p on p.type = 'P' and p.id = l_orderkey::varchar
union all
select p.vid, t.vid, 'contain' from lineitem
  join vertices p on p.type = 'P' and p.id = l_orderkey::varchar
  join vertices t on t.type = 'T' and t.id = l_partkey::varchar""",
)
def hin_edges(spark: SparkSession, sf: str) -> DataFrame:
    return network(spark, sf).edges


@catalog.query(
    "hin_build_counts",
    """
select 'vertex' as kind, 'A' as name, count(*) as n from customer
union all select 'vertex', 'C', count(*) from supplier
union all select 'vertex', 'P', count(*) from orders
union all select 'vertex', 'T', count(*) from part
union all select 'edge', 'write', count(*) from orders join customer on c_custkey = o_custkey
union all select 'edge', 'publish', count(*) from lineitem
  join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey
union all select 'edge', 'contain', count(*) from lineitem
  join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey""",
)
def hin_build_counts(spark: SparkSession, sf: str) -> DataFrame:
    return network(spark, sf).counts()


@catalog.query(
    "hin_repeated_rows",
    """
select 'vertex' as kind, 'A' as name, count(*) as n from customer
union all select 'vertex', 'P', count(*) from orders
union all select 'edge', 'write', count(*) from orders join customer on c_custkey = o_custkey
union all select 'label', 'L' || least(k, 2)::varchar, count(*) from (select c_custkey % 4 as k from customer) group by 2""",
)
def hin_repeated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Entity rows and labels that are given twice make one vertex each; the smallest label counts."""
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    labels = customers.select("c_custkey", (F.col("c_custkey") % 4).alias("class"))
    labels = labels.unionByName(labels.withColumn("class", F.lit(2).cast(labels.schema["class"].dataType)))
    found = hin.build(
        {
            "A": hin.Entity(customers.union(customers), "c_custkey", "c_name", labels, "c_custkey", "class"),
            "P": hin.Entity(orders, "o_orderkey", "o_orderpriority"),
        },
        [hin.Relation(orders, "A", "o_custkey", "P", "o_orderkey", "write")],
    )
    classes = found.vertices.where("type = 'A'").groupBy(F.lit("label").alias("kind"), F.col("label").alias("name"))
    return found.counts().unionByName(classes.agg(F.count(F.lit(1)).alias("n")))


@catalog.query(
    "label_default",
    f"""select 'A' || c_custkey::varchar as id,
        coalesce('L' || ({_SEGMENT_CASE})::varchar, 'L00') as label from customer""",
)
def label_default(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey")
    known = customer_labels(spark, sf).withColumnRenamed("c_custkey", "key")
    return dic.labelled(customers, "c_custkey", known, "key", "class").select(
        F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("id"), "label"
    )


# --- ranks and classes -----------------------------------------------------

# One per region; customers are labelled by segment, of which four have a class.
CLASSES = 5


def rank_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers, suppliers, orders and parts as types 0 to 3."""
    items = reduce(
        DataFrame.unionByName,
        [
            table(spark, sf, t).select(F.lit(m).alias("m"), F.col(key).alias("x"))
            for m, (t, key) in enumerate(
                [("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"), ("part", "p_partkey")]
            )
        ],
    )
    regions = table(spark, sf, "nation")
    supplier_labels = (
        table(spark, sf, "supplier")
        .join(regions, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.lit(1).alias("m"), F.col("s_suppkey").alias("x"), F.col("n_regionkey").alias("k"))
    )
    labels = (
        customer_labels(spark, sf)
        .select(F.lit(0).alias("m"), F.col("c_custkey").alias("x"), F.col("class").alias("k"))
        .unionByName(supplier_labels)
    )
    lineitem, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")

    def edge(df: DataFrame, rel: str, row: str, j: int, col: str) -> DataFrame:
        return df.select(
            F.lit(rel).alias("rel"),
            F.lit(2).alias("i"),
            F.col(row).alias("row"),
            F.lit(j).alias("j"),
            F.col(col).alias("col"),
            F.lit(1.0).alias("w"),
        )

    edges = (
        edge(orders, "customer", "o_orderkey", 0, "o_custkey")
        .unionByName(edge(lineitem, "supplier", "l_orderkey", 1, "l_suppkey"))
        .unionByName(edge(lineitem, "part", "l_orderkey", 3, "l_partkey"))
    )
    return items, labels, edges


_RANK_START = f"""
with items as (
  select 0 as m, c_custkey as x from customer union all select 1, s_suppkey from supplier
  union all select 2, o_orderkey from orders union all select 3, p_partkey from part),
labels as (
  select 0 as m, c_custkey as x, ({_SEGMENT_CASE}) as k from customer where ({_SEGMENT_CASE}) is not null
  union all
  select 1, s_suppkey, n_regionkey from supplier join nation on n_nationkey = s_nationkey),
sized as (select m, x, k, 1.0::double / count(*) over (partition by m, k) as p from labels),
p0 as (select c.k::int as k, i.m, i.x, coalesce(s.p, 0.0::double) as p from items i
       cross join range(5) c(k) left join sized s on s.m = i.m and s.x = i.x and s.k = c.k),
e as (
  select 'customer' as rel, 2 as i, o_orderkey as r, 0 as j, o_custkey as c from orders
  union all select 'supplier', 2, l_orderkey, 1, l_suppkey from lineitem
  union all select 'part', 2, l_orderkey, 3, l_partkey from lineitem),
w0 as (select c4.k::int as k, rel, i, r, j, c, count(*)::double as w from e cross join range(5) c4(k) group by all)
"""


def _round_sql(t: int, relation: str = "") -> str:
    """Round ``t`` in the tall form, both directions written out."""
    b = t - 1
    return f""",
s{t} as (select *, w / sqrt(sum(w) over (partition by k, rel, r) * sum(w) over (partition by k, rel, c)) as s
         from w{b} {relation}),
g{t} as (select k, m, x, sum(v) as a from (
    select s.k, s.i as m, s.r as x, s.s * p.p as v from s{t} s
      join p{b} p on p.k = s.k and p.m = s.j and p.x = s.c where p.p > 0
    union all
    select s.k, s.j, s.c, s.s * p.p from s{t} s
      join p{b} p on p.k = s.k and p.m = s.i and p.x = s.r where p.p > 0) group by all),
p{t} as (select z.k, z.m, z.x, (coalesce(g.a, 0) + 0.1::double * z.p) / (4 * 0.2::double + 0.1::double) as p
         from p0 z left join g{t} g on g.k = z.k and g.m = z.m and g.x = z.x),
x{t} as (select k, m, x, case when max(p) over (partition by k, m) > 0
         then p / max(p) over (partition by k, m) else 0 end as q from p{t}),
w{t} as (select w.k, w.rel, w.i, w.r, w.j, w.c, w.w * (sqrt(a.q * b.q) + pow(2.0::double, -{t})) as w from w{b} w
         join x{t} a on a.k = w.k and a.m = w.i and a.x = w.r
         join x{t} b on b.k = w.k and b.m = w.j and b.x = w.c)
"""


def _started(spark: SparkSession, sf: str) -> rankclass.State:
    return rankclass.start(*rank_inputs(spark, sf), classes=CLASSES, types=4)


def _ranks(state: rankclass.State) -> DataFrame:
    return rankclass.tall_ranks(state.ranks, CLASSES).withColumn("p", rounded("p", 9))


@catalog.query("rankclass_init", _RANK_START + "select k, m, x, round(p, 9) as p from p0")
def rankclass_init(spark: SparkSession, sf: str) -> DataFrame:
    items, labels, _ = rank_inputs(spark, sf)
    ranks = rankclass.initial_ranks(items, labels, CLASSES)
    return rankclass.tall_ranks(ranks, CLASSES).withColumn("p", rounded("p", 9))


@catalog.query("rankclass_round1", _RANK_START + _round_sql(1) + "select k, m, x, round(p, 9) as p from p1")
def rankclass_round1(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(rankclass.run(*rank_inputs(spark, sf), classes=CLASSES, rounds=1))


@catalog.query(
    "rankclass_round2",
    _RANK_START + _round_sql(1) + _round_sql(2) + "select k, m, x, round(p, 9) as p from p2",
)
def rankclass_round2(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(rankclass.run(*rank_inputs(spark, sf), classes=CLASSES))


@catalog.query(
    "rankclass_first_relation",
    _RANK_START
    + _round_sql(1, "where rel = 'customer'")
    + _round_sql(2)
    + "select k, m, x, round(p, 9) as p from p2",
)
def rankclass_first_relation(spark: SparkSession, sf: str) -> DataFrame:
    """Round 1 updates ranks from one relation only."""
    return _ranks(rankclass.run(*rank_inputs(spark, sf), classes=CLASSES, first_relation="customer"))


@catalog.query(
    "rankclass_reweight",
    _RANK_START + _round_sql(1) + 'select k, rel, r as "row", count(*) as cells, round(sum(w), 9) as w from w1 group by k, rel, r',
)
def rankclass_reweight(spark: SparkSession, sf: str) -> DataFrame:
    """New weights of all cells, added up per row of each relation."""
    state = rankclass.step(_started(spark, sf), one_way=True)
    weights = [F.sum(f"w{k}").alias(f"w{k}") for k in range(CLASSES)]
    sums = state.relations.groupBy("rel", "row").agg(F.count(F.lit(1)).alias("cells"), *weights)
    return rankclass.tall_relations(sums, CLASSES, ["rel", "row", "cells"]).withColumn("w", rounded("w", 9))


@catalog.query(
    "rankclass_classes",
    _RANK_START
    + _round_sql(1)
    + _round_sql(2)
    + """select m, x, k, round(p, 12) as p from (
  select *, row_number() over (partition by m, x order by round(p, 12) desc, k) as n from p2 where p > 0) where n = 1""",
)
def rankclass_classes(spark: SparkSession, sf: str) -> DataFrame:
    state = rankclass.run(*rank_inputs(spark, sf), classes=CLASSES)
    near_ties_equal = state.ranks.select("m", "x", *[rounded(f"p{k}", 12).alias(f"p{k}") for k in range(CLASSES)])
    return rankclass.assign_classes(near_ties_equal, CLASSES)


@catalog.query(
    "rankclass_dimensions",
    """
select 'customer' as rel, count(distinct o_orderkey) as num_rows, count(distinct o_custkey) as num_cols,
       count(*) as num_cells from orders
union all
select 'supplier', count(distinct l_orderkey), count(distinct l_suppkey), count(distinct (l_orderkey, l_suppkey)) from lineitem
union all
select 'part', count(distinct l_orderkey), count(distinct l_partkey), count(distinct (l_orderkey, l_partkey)) from lineitem""",
)
def rankclass_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    edges = rank_inputs(spark, sf)[2]
    return rankclass.relation_dimensions(rankclass.relation_table(edges, CLASSES), edges)


@catalog.query(
    "relation_normalize",
    """
with w as (select l_suppkey as i, l_partkey as j, sum(l_quantity) as w from lineitem group by 1, 2)
select i, j, round(w / sqrt(sum(w) over (partition by i) * sum(w) over (partition by j)), 9) as value from w""",
)
def relation_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """``Drow^-1/2 W Dcol^-1/2`` as two diagonal scalings."""
    w = materialize(
        matrix.canonical(matrix.cells(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")),
        "weights",
    )
    inverse_root = lambda sums: sums.withColumn("value", 1.0 / F.sqrt("value"))
    left = inverse_root(matrix.row_sums(w))
    right = inverse_root(matrix.col_sums(w).withColumnRenamed("j", "i"))
    return matrix.diagonal_scale(w, left, right).withColumn("value", rounded("value", 9))


# --- power iteration clustering --------------------------------------------

_AFFINITY = """
with e as (select o_custkey as src, l_suppkey as dst, count(*)::double as w
           from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
a as (select src as i, 1000000000 + dst as j, w from e union all select 1000000000 + dst, src, w from e),
n as (select i, j, w / sum(w) over (partition by i) as v, w from a),
v0 as (select i, sum(w) / (select sum(w) from a) as v from a group by i)
"""


def customer_supplier_affinity(spark: SparkSession, sf: str) -> DataFrame:
    """Bipartite similarity graph; suppliers get ids above all customers."""
    orders, lineitem = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return (
        orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


@catalog.query("affinity_normalize", _AFFINITY + "select i, j, round(v, 9) as value from n")
def affinity_normalize(spark: SparkSession, sf: str) -> DataFrame:
    a = affinity.symmetric_edges(customer_supplier_affinity(spark, sf))
    return affinity.row_normalize(a).withColumn("value", rounded("value", 9))


@catalog.query(
    "affinity_power_step",
    _AFFINITY
    + """, u as (select n.i, sum(n.v * v0.v) as u from n join v0 on v0.i = n.j group by 1)
select i, round(u / (select sum(abs(u)) from u), 9) as value from u""",
)
def affinity_power_step(spark: SparkSession, sf: str) -> DataFrame:
    a = materialize(affinity.symmetric_edges(customer_supplier_affinity(spark, sf)), "affinity")
    step = affinity.power_step(affinity.row_normalize(a), affinity.degree_vector(a))
    return step.withColumn("value", rounded("value", 9))


@catalog.query(
    "affinity_clusters",
    """select count(distinct src) + count(distinct dst) as vertices, count(distinct src) + count(distinct dst) as placed
       from (select o_custkey as src, l_suppkey as dst from orders join lineitem on l_orderkey = o_orderkey)""",
)
def affinity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every vertex gets one of the three clusters."""
    found = affinity.cluster(customer_supplier_affinity(spark, sf), 3, 5, "degree")
    return found.agg(
        F.countDistinct("id").alias("vertices"), F.count(F.when(F.col("cluster").between(0, 2), 1)).alias("placed")
    )
