"""Vector algebra, feature transforms and text queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.catalog.base import Catalog, rounded, table
from hinloom.functions import vectors as v
from hinloom.operators import features as feat
from hinloom.operators import statistics as stats
from hinloom.runtime import double_array, materialize, new_path
from hinloom.sources import text

catalog = Catalog()


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", double_array("embedding").alias("x"), "label")


_X = "with x as (select vec_id, embedding::double[] as x, label from embeddings) "
_ONES = "[1.0 for r in range(64)]"


@catalog.query(
    "vector_norms",
    _X
    + """select vec_id, round(list_sum([abs(e) for e in x]), 6) as l1, round(sqrt(list_sum([e * e for e in x])), 6) as l2,
      round(pow(list_sum([pow(abs(e), 3) for e in x]), 1.0::double / 3), 6) as l3, round(list_max([abs(e) for e in x]), 6) as linf from x""",
)
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    return embeddings(spark, sf).select(
        "vec_id",
        rounded(v.norm(x, 1)).alias("l1"),
        rounded(v.norm(x, 2)).alias("l2"),
        rounded(v.norm(x, 3)).alias("l3"),
        rounded(v.norm(x, math.inf)).alias("linf"),
    )


@catalog.query(
    "vector_algebra",
    _X
    + """select vec_id, round(list_inner_product(x, list_reverse(x)), 6) as dot,
      round(list_sum(list_transform(list_zip(x, list_reverse(x)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) as sqdist,
      round(list_sum([e * 2.5 for e in x]), 6) as scaled,
      round(list_sum(list_transform(list_zip(x, list_reverse(x)), lambda p: 0.5 * p[1] + p[2])), 6) as axpy,
      round(list_cosine_similarity(x, list_reverse(x)), 6) as cosine from x""",
)
def vector_algebra(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.reverse("x")
    return embeddings(spark, sf).select(
        "vec_id",
        rounded(v.dot(x, y)).alias("dot"),
        rounded(v.squared_distance(x, y)).alias("sqdist"),
        rounded(v.total(v.scale(2.5, x))).alias("scaled"),
        rounded(v.total(v.axpy(0.5, x, y))).alias("axpy"),
        rounded(v.cosine(x, y)).alias("cosine"),
    )


@catalog.query(
    "vector_argmax_nnz",
    _X
    + """select vec_id, (list_position(x, list_max(x)) - 1)::int as argmax,
      len([e for e in x if e > 0.1])::int as nnz, len(x)::int as actives from x""",
)
def vector_argmax_nnz(spark: SparkSession, sf: str) -> DataFrame:
    clipped = F.transform("x", lambda e: F.when(e > 0.1, e).otherwise(0.0))
    return embeddings(spark, sf).select(
        "vec_id",
        v.argmax(F.col("x")).alias("argmax"),
        v.nnz(clipped).alias("nnz"),
        v.num_actives(F.col("x")).alias("actives"),
    )


@catalog.query(
    "vector_sparse_and_back",
    _X
    + """select vec_id, len([e for e in x if e > 0.1])::int as stored,
      round(coalesce(list_sum([e for e in x if e > 0.1]), 0), 6) as total, len(x)::int as size,
      (len([e for e in x if e > 0.1]) + 1) * 1.5 < len(x) as smaller,
      round(x[8] + 10 * x[1] + 100 * x[64], 6) as picked from x""",
)
def vector_sparse_and_back(spark: SparkSession, sf: str) -> DataFrame:
    clipped = F.transform("x", lambda e: F.when(e > 0.1, e).otherwise(0.0))
    picked = v.take(F.col("x"), [7, 0, 63])
    rows = embeddings(spark, sf).select("vec_id", "x", clipped.alias("c")).select(
        "vec_id", "x", "c", v.to_sparse(F.col("c")).alias("s")
    )
    dense = v.to_dense(F.col("s"), 64)
    return rows.select(
        "vec_id",
        F.size("s").alias("stored"),
        rounded(v.total(dense)).alias("total"),
        F.size(dense).alias("size"),
        v.is_smaller_sparse(F.col("c")).alias("smaller"),
        rounded(picked[0] + 10 * picked[1] + 100 * picked[2]).alias("picked"),
    )


@catalog.query(
    "vector_append_bias",
    _X + "select vec_id, (len(x) + 1)::int as size, 1.0::double as last, round(list_sum(x) + 1, 6) as total from x",
)
def vector_append_bias(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf).select("vec_id", v.append_bias(F.col("x")).alias("b"))
    return rows.select(
        "vec_id", F.size("b").alias("size"), F.element_at("b", -1).alias("last"), rounded(v.total(F.col("b"))).alias("total")
    )


@catalog.query(
    "vector_hadamard",
    _X
    + """select vec_id, round(list_sum(list_transform(x, lambda e, i: e * (i % 7))), 6) as total from x""",
)
def vector_hadamard(spark: SparkSession, sf: str) -> DataFrame:
    weights = [float((i + 1) % 7) for i in range(64)]
    return embeddings(spark, sf).select("vec_id", rounded(v.total(v.hadamard(F.col("x"), weights))).alias("total"))


@catalog.query(
    "embedding_normalize",
    _X
    + """select vec_id, (p - 1)::int as pos, round(e / n, 6) as value from (
      select vec_id, unnest(x) as e, generate_subscripts(x, 1) as p, sqrt(list_sum([e * e for e in x])) as n from x)""",
)
def embedding_normalize(spark: SparkSession, sf: str) -> DataFrame:
    unit = v.normalize(F.col("x"), 2)
    rows = embeddings(spark, sf).select("vec_id", F.posexplode(unit).alias("pos", "value"))
    return rows.withColumn("value", rounded("value"))


@catalog.query(
    "math_functions",
    """select l_orderkey, l_linenumber, count(*) as n, round(sum(sqrt(l_quantity)), 6) as root, round(sum(ln(l_quantity)), 6) as logs,
       round(sum(exp(-l_discount)), 6) as exps, round(sum(abs(l_discount - l_tax)), 6) as gap,
       round(sum(pow(1 + l_tax, 3)), 6) as cubes, round(sum(ln(1 + exp(l_quantity / 10))), 6) as softplus,
       sum(l_partkey // 7)::bigint as quotient, sum(l_partkey % 7)::bigint as remainder from lineitem group by 1, 2""",
)
def math_functions(spark: SparkSession, sf: str) -> DataFrame:
    q, d, t, p = (F.col(f"l_{c}") for c in ("quantity", "discount", "tax", "partkey"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.sum(F.sqrt(q))).alias("root"),
        rounded(F.sum(F.log(q))).alias("logs"),
        rounded(F.sum(F.exp(-d))).alias("exps"),
        rounded(F.sum(F.abs(d - t))).alias("gap"),
        rounded(F.sum(F.pow(1 + t, F.lit(3.0)))).alias("cubes"),
        rounded(F.sum(v.log1p_exp(q / 10))).alias("softplus"),
        F.sum(F.floor(p / 7)).alias("quotient"),
        F.sum(p % 7).alias("remainder"),
    )


@catalog.query(
    "string_functions",
    """select p_partkey, split_part(p_name, ' ', 1) as first_word, substr(p_brand, 7) as brand_number,
       starts_with(p_name, 'red') as is_red, 'P' || p_partkey::varchar as tagged, trim(' ' || p_type || ' ') as trimmed,
       regexp_extract(p_brand, '#([0-9]+)', 1) as digits from part""",
)
def string_functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        F.split("p_name", " ")[0].alias("first_word"),
        F.expr("substring(p_brand, 7)").alias("brand_number"),
        F.col("p_name").startswith("red").alias("is_red"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("tagged"),
        F.trim(F.concat(F.lit(" "), F.col("p_type"), F.lit(" "))).alias("trimmed"),
        F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("digits"),
    )


@catalog.query(
    "nearest_embeddings",
    _X
    + """, q as (select x from x where vec_id = 0)
    select vec_id, round(c, 6) as similarity from (
      select x.vec_id, list_cosine_similarity(x.x, q.x) as c from x cross join q where x.vec_id <> 0)
    order by c desc, vec_id limit 10""",
)
def nearest_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    found = feat.nearest(embeddings(spark, sf), "vec_id", "x", 0, 10)
    return found.withColumn("similarity", rounded("similarity"))


# --- feature transforms -------------------------------------------------------


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the whole texts, split at spaces."""
    return table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))


_WORDS = "with w as (select doc_id, unnest(string_split(text, ' ')) as term from documents) "
_TF = _WORDS + ", tf as (select doc_id, term, count(*) as tf from w group by 1, 2) "


@catalog.query("word_count", _WORDS + "select term as word, count(*) as count from w group by 1")
def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return feat.word_count(table(spark, sf, "documents"), "text")


@catalog.query(
    "count_per_class",
    "select quality as class, count(*) as n, 1.0::double / count(*) as weight from labels group by 1",
)
def count_per_class(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "labels").groupBy(F.col("quality").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", 1.0 / F.col("n"))


@catalog.query(
    "distinct_values",
    """select count(distinct user_id) as users, count(distinct event_type) as types,
       count(distinct (user_id, event_type)) as pairs from events""",
)
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("event_type").alias("types"),
        F.countDistinct("user_id", "event_type").alias("pairs"),
    )


@catalog.query(
    "approximate_distinct",
    "select count(distinct l_orderkey) as orders, count(distinct l_partkey) as parts, true as close from lineitem",
)
def approximate_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The exact counts, and whether both estimates are within a fifth of them."""
    counts = table(spark, sf, "lineitem").agg(
        F.countDistinct("l_orderkey").alias("orders"),
        F.countDistinct("l_partkey").alias("parts"),
        F.approx_count_distinct("l_orderkey", 0.05).alias("_o"),
        F.approx_count_distinct("l_partkey", 0.05).alias("_p"),
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < F.col(b) * 0.2
    return counts.select("orders", "parts", (near("_o", "orders") & near("_p", "parts")).alias("close"))


@catalog.query("term_frequency", _TF + "select doc_id, term, tf from tf")
def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return feat.term_counts(tokens(spark, sf), "doc_id", "words")


@catalog.query(
    "idf",
    _TF
    + """select term, count(*) as df, case when count(*) < 2 then 0.0::double else
      round(ln(((select count(*) from documents) + 1)::double / (count(*) + 1)), 6) end as idf from tf group by 1""",
)
def idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = tokens(spark, sf)
    weights = feat.idf(feat.term_counts(docs, "doc_id", "words"), docs.count(), min_doc_freq=2)
    return weights.withColumn("idf", rounded("idf"))


@catalog.query(
    "tf_idf",
    _TF
    + """, i as (select term, ln(((select count(*) from documents) + 1)::double / (count(*) + 1)) as idf from tf group by 1)
      select doc_id, term, round(tf * idf, 6) as weight from tf join i using (term)""",
)
def tf_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = tokens(spark, sf)
    return feat.tf_idf(feat.term_counts(docs, "doc_id", "words"), docs.count()).withColumn("weight", rounded("weight"))


@catalog.query(
    "doc_vocab",
    _WORDS + "select term, count(*) as n from w group by 1 having count(*) >= 5",
)
def doc_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return feat.vocabulary(tokens(spark, sf), "words", 5)


@catalog.query("hashing_tf", _WORDS + "select doc_id, count(*)::double as total from w group by 1")
def hashing_tf(spark: SparkSession, sf: str) -> DataFrame:
    """Every word lands in a slot: the slots of a text add up to its words."""
    hashed = feat.hashing_tf(tokens(spark, sf), "words", 1 << 12)
    return hashed.select("doc_id", v.total(feat.vector_to_array(F.col("tf"))).alias("total"))


_CELLS = _X + ", c as (select vec_id, unnest(x) as e, generate_subscripts(x, 1) - 1 as p from x) "


@catalog.query(
    "standard_scaler",
    _CELLS
    + """, s as (select p, avg(e) as m, stddev_samp(e) as d from c group by 1)
      select vec_id, p::int as pos, round(case when d > 0 then (e - m) / d else 0 end, 6) as value from c join s using (p)""",
)
def standard_scaler(spark: SparkSession, sf: str) -> DataFrame:
    scaled = feat.standard_scale(embeddings(spark, sf), "x", "scaled", with_mean=True)
    rows = scaled.select("vec_id", F.posexplode("scaled").alias("pos", "value"))
    return rows.withColumn("value", rounded("value"))


@catalog.query(
    "column_summary",
    _CELLS
    + """select p::int as pos, count(*) as count, round(avg(e), 6) as mean, round(var_samp(e), 6) as variance,
      count(*) filter (where e <> 0) as nnz, max(e) as max, min(e) as min, round(sum(abs(e)), 6) as l1,
      round(sqrt(sum(e * e)), 6) as l2 from c group by 1""",
)
def column_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = stats.column_summary(embeddings(spark, sf), "x")
    for c in ("mean", "variance", "l1", "l2"):
        summary = summary.withColumn(c, rounded(c))
    return summary


@catalog.query(
    "sparse_column_summary",
    """with o as (select l_orderkey as i, l_linenumber::bigint as j, sum(l_quantity) as v from lineitem group by 1, 2),
    g as (select ids.i, c.j, coalesce(o.v, 0) as v from (select distinct i from o) ids cross join (select distinct j from o) c
          left join o on o.i = ids.i and o.j = c.j)
    select j, count(*) as count, round(avg(v), 6) as mean, round(var_samp(v), 6) as variance,
      count(*) filter (where v <> 0) as nnz, max(v) as max, min(v) as min, sum(abs(v)) as l1, round(sqrt(sum(v * v)), 6) as l2
    from g group by 1""",
)
def sparse_column_summary(spark: SparkSession, sf: str) -> DataFrame:
    from hinloom.catalog.algebra import order_lines

    cells = order_lines(spark, sf)
    rows = cells.select("i").distinct().count()
    summary = stats.sparse_column_summary(cells, rows)
    for c in ("mean", "variance", "l2"):
        summary = summary.withColumn(c, rounded(c))
    return summary


LINE_FEATURES = ["l_linestatus", "l_linenumber", "l_discount", "l_tax"]


@catalog.query(
    "chi_square_selector",
    """with f as (
      select 0 as feature, l_linestatus as v, l_returnflag as y from lineitem
      union all select 1, l_linenumber::varchar, l_returnflag from lineitem
      union all select 2, l_discount::varchar, l_returnflag from lineitem
      union all select 3, l_tax::varchar, l_returnflag from lineitem),
    o as (select feature, v, y, count(*) as o from f group by all),
    r as (select feature, v, count(*) as r from f group by all),
    c as (select feature, y, count(*) as c from f group by all),
    s as (select r.feature, sum(pow(coalesce(o, 0) - r * c / 1.0 / (select count(*) from lineitem), 2)
            / (r * c / 1.0 / (select count(*) from lineitem))) as s
          from r join c on c.feature = r.feature left join o on o.feature = r.feature and o.v = r.v and o.y = c.y group by 1)
    select feature from s order by s desc, feature limit 2""",
)
def chi_square_selector(spark: SparkSession, sf: str) -> DataFrame:
    return feat.select_by_chi_square(table(spark, sf, "lineitem"), LINE_FEATURES, "l_returnflag", 2)


@catalog.query("word2vec_synonyms")
def word2vec_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of the commonest word; the word itself is excluded by key."""
    docs = tokens(spark, sf)
    word = feat.vocabulary(docs, "words", 5).orderBy(F.desc("n"), "term").first()["term"]
    return feat.synonyms(feat.word2vec(docs, "words", dimension=16, min_count=5, partitions=8), word, 5)


# --- text scans ---------------------------------------------------------------


def _written(df: DataFrame, label: str) -> str:
    """One text column written out, for a scan to read back."""
    path = new_path(df.sparkSession, label)
    df.write.text(path)
    return path


@catalog.query("scan_entities", "select p_partkey::varchar as id, p_name as name from part")
def scan_entities(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name"))
    return text.read_entities(spark, _written(lines, "entities"))


@catalog.query(
    "scan_labels",
    "select doc_id::varchar as id, quality as class, lang as name from labels join documents using (doc_id)",
)
def scan_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    lines = rows.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("quality").cast("string"), "lang", F.lit("")))
    return text.read_labels(spark, _written(lines, "labels"))


@catalog.query(
    "scan_edges", 'select o_orderkey::varchar as "left", o_custkey::varchar as "right", 1.0::double as weight from orders'
)
def scan_edges(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "orders").select(
        F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    )
    return text.read_edges(spark, _written(lines, "edges"))


@catalog.query("scan_vectors", "select round(list_sum(embedding::double[]), 6) as total, len(embedding)::int as size from embeddings")
def scan_vectors(spark: SparkSession, sf: str) -> DataFrame:
    lines = embeddings(spark, sf).select(F.concat_ws(" ", F.col("x").cast("array<string>")))
    rows = text.read_vectors(spark, _written(lines, "vectors"))
    return rows.select(rounded(v.total(F.col("features"))).alias("total"), F.size("features").alias("size"))


@catalog.query(
    "scan_ratings",
    """select l_orderkey::int as user, l_partkey::int as item, l_quantity::float as rating, epoch(l_shipdate)::bigint as ts from lineitem""",
)
def scan_ratings(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.concat_ws(
            "::",
            F.col("l_orderkey").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_quantity").cast("string"),
            F.unix_timestamp("l_shipdate").cast("string"),
        )
    )
    return text.read_ratings(spark, _written(lines, "ratings"))


@catalog.query(
    "scan_matrix_entries",
    "select l_suppkey as i, l_partkey as j, sum(l_quantity) as value from lineitem group by 1, 2",
)
def scan_matrix_entries(spark: SparkSession, sf: str) -> DataFrame:
    from hinloom.catalog.algebra import quantities

    lines = quantities(spark, sf).select(F.format_string("MatrixEntry(%d,%d,%s)", "i", "j", F.col("value").cast("string")))
    return text.read_matrix_entries(spark, _written(lines, "entries"))


@catalog.query(
    "scan_indexed_rows",
    "select l_orderkey as i, l_linenumber::bigint as j, sum(l_quantity) as value from lineitem group by 1, 2",
)
def scan_indexed_rows(spark: SparkSession, sf: str) -> DataFrame:
    from hinloom.catalog.algebra import order_lines
    from hinloom.operators.matrix import to_row_segments

    joined = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    lines = to_row_segments(order_lines(spark, sf)).select(
        F.format_string("IndexedRow(%d,(8,[%s],[%s]))", "i", joined("cols"), joined("vals"))
    )
    return text.read_indexed_rows(spark, _written(lines, "rows"))


@catalog.query(
    "scan_embeddings",
    """select label::bigint as index, round(list_sum(embedding::double[]), 6) as total from embeddings where label <> 3""",
)
def scan_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Token lines looked up in a dictionary; label 3 carries another prefix."""
    token = F.concat(F.when(F.col("label") == 3, "a_").otherwise("p_"), F.col("vec_id").cast("string"))
    rows = embeddings(spark, sf).select(token.alias("token"), "label", "x")
    lines = rows.select(F.concat_ws(" ", "token", F.concat_ws(" ", F.col("x").cast("array<string>"))))
    found = text.read_embeddings(spark, _written(lines, "tokens"), rows, "token", "label")
    return found.select("index", rounded(v.total(F.col("vector"))).alias("total"))


@catalog.query(
    "scan_vector_literals",
    """select round(list_sum([e for e in embedding::double[] if e > 0.1]), 6) as total, len(embedding)::int as size from embeddings
       union all select round(list_sum(embedding::double[]), 6), len(embedding)::int from embeddings""",
)
def scan_vector_literals(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a dense and as a sparse literal."""
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda e: e.cast("string")))
    rows = embeddings(spark, sf)
    stored = v.to_sparse(F.transform("x", lambda e: F.when(e > 0.1, e).otherwise(0.0)))
    sparse = rows.select(stored.alias("s")).select(
        F.format_string("(64,[%s],[%s])", joined(F.col("s.index")), joined(F.col("s.value"))).alias("line")
    )
    dense = rows.select(F.format_string("[%s]", joined(F.col("x"))).alias("line"))
    found = text.read_vector_literals(spark, _written(dense.unionByName(sparse), "literals"))
    return found.select(rounded(v.total(F.col("features"))).alias("total"), F.size("features").alias("size"))


@catalog.query(
    "scan_labeled_points",
    """select l_discount as label, l_quantity as f0, l_tax as f1 from lineitem""",
)
def scan_labeled_points(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled CSV written and read back."""
    rows = table(spark, sf, "lineitem").select(F.col("l_discount").alias("label"), F.array("l_quantity", "l_tax").alias("features"))
    path = new_path(spark, "labeled")
    text.write_labeled_csv(rows, path)
    back = text.read_labeled_csv(spark, path)
    return back.select("label", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@catalog.query("scan_libsvm", "select l_tax as label, l_quantity as f0, l_discount as f1, 2::int as size from lineitem")
def scan_libsvm(spark: SparkSession, sf: str) -> DataFrame:
    from hinloom.sources import libsvm

    rows = table(spark, sf, "lineitem").select(F.col("l_tax").alias("label"), F.array("l_quantity", "l_discount").alias("features"))
    path = new_path(spark, "libsvm")
    libsvm.write(rows, path)
    back = libsvm.read(spark, path, 2)
    return back.select("label", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"), F.size("features").alias("size"))


@catalog.query(
    "scan_matrix_parquet", "select l_suppkey as i, l_partkey as j, sum(l_quantity) as value from lineitem group by 1, 2"
)
def scan_matrix_parquet(spark: SparkSession, sf: str) -> DataFrame:
    from hinloom.catalog.algebra import quantities

    path = new_path(spark, "matrix")
    text.write_matrix(quantities(spark, sf), path)
    return text.read_matrix(spark, path)


@catalog.query("scan_table_or_jdbc", "select c_custkey, c_name from customer")
def scan_table_or_jdbc(spark: SparkSession, sf: str) -> DataFrame:
    """The relational scan with a parquet file standing in for the database."""
    from hinloom.sources import jdbc

    return jdbc.read_table(spark, f"{sf}/customer.parquet", ["c_custkey", "c_name"])
