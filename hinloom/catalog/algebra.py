"""Coordinate-matrix queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.catalog.base import Catalog, rounded, table
from hinloom.operators import dense, matrix
from hinloom.runtime import double_array, materialize, new_path
from hinloom.sources import text

catalog = Catalog()


def quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier x part, summed quantity."""
    return matrix.canonical(matrix.cells(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_quantity"))


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order x line number, summed quantity."""
    cells = matrix.cells(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")
    return matrix.canonical(cells.withColumn("j", F.col("j").cast("long")))


def flagged(spark: SparkSession, sf: str, returned: bool) -> DataFrame:
    """Supplier x line number of the returned lines, or of all others."""
    rows = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") == returned)
    return matrix.canonical(matrix.cells(rows, "l_suppkey", "l_linenumber", "l_quantity"))


_Q = "with q as (select l_suppkey as i, l_partkey as j, sum(l_quantity) as v from lineitem group by 1, 2) "
_O = "with o as (select l_orderkey as i, l_linenumber::bigint as j, sum(l_quantity) as v from lineitem group by 1, 2) "
_AR = """with a as (select l_suppkey as i, l_linenumber as j, sum(l_quantity) as v from lineitem where l_returnflag <> 'R' group by 1, 2),
r as (select l_suppkey as i, l_linenumber as j, sum(l_quantity) as v from lineitem where l_returnflag = 'R' group by 1, 2) """


@catalog.query("coo_canonical", _Q + "select i, j, v as value from q where v <> 0")
def coo_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return quantities(spark, sf)


@catalog.query("coo_transpose", _Q + "select j as i, i as j, v as value from q where v <> 0")
def coo_transpose(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.transpose(quantities(spark, sf))


@catalog.query(
    "coo_multiply",
    _Q + "select i, p_size as j, sum(v) as value from q join part on p_partkey = j group by 1, 2",
)
def coo_multiply(spark: SparkSession, sf: str) -> DataFrame:
    sizes = matrix.cells(table(spark, sf, "part"), "p_partkey", "p_size")
    return matrix.multiply(quantities(spark, sf), sizes)


@catalog.query(
    "coo_multiply_hot_keys",
    """select l_returnflag as i, o_orderstatus as j, sum(l_quantity) as value
       from lineitem join orders on o_orderkey = l_orderkey group by 1, 2""",
)
def coo_multiply_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The flag and status columns make every key of the middle side hot.

    ``(flag x order) (order x status)`` with parts of at most two rows.
    """
    left = matrix.cells(table(spark, sf, "lineitem"), "l_returnflag", "l_orderkey", "l_quantity")
    right = matrix.cells(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus")
    return matrix.multiply(left, right, cell=2)


@catalog.query(
    "coo_add",
    _AR + "select i, j, sum(v) as value from (select * from a union all select * from r) group by 1, 2",
)
def coo_add(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.add(flagged(spark, sf, False), flagged(spark, sf, True))


@catalog.query(
    "coo_divide",
    _AR + "select a.i, a.j, round(a.v / r.v, 9) as value from a left join r on r.i = a.i and r.j = a.j",
)
def coo_divide(spark: SparkSession, sf: str) -> DataFrame:
    ratio = matrix.divide(flagged(spark, sf, False), flagged(spark, sf, True))
    return ratio.withColumn("value", rounded("value", 9))


@catalog.query(
    "coo_diagonal_scale",
    _Q
    + """select i, j, (s_nationkey + 1) * v * p_size as value from q
         join supplier on s_suppkey = i join part on p_partkey = j""",
)
def coo_diagonal_scale(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") + 1).alias("value"))
    right = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").alias("value"))
    return matrix.diagonal_scale(quantities(spark, sf), left, right)


@catalog.query(
    "coo_sums",
    _Q
    + """select 'row' as side, i as id, sum(v) as total, sum(v * v) as squares from q group by 2
         union all select 'col', j, sum(v), sum(v * v) from q group by 2""",
)
def coo_sums(spark: SparkSession, sf: str) -> DataFrame:
    q = quantities(spark, sf)
    t = matrix.transpose(q)

    def side(m: DataFrame, name: str) -> DataFrame:
        sums = matrix.row_sums(m).withColumnRenamed("value", "total")
        squares = matrix.row_square_sums(m).withColumnRenamed("value", "squares")
        return sums.join(squares, "i").select(F.lit(name).alias("side"), F.col("i").alias("id"), "total", "squares")

    return side(q, "row").unionByName(side(t, "col"))


@catalog.query("coo_diagonal", _Q + "select i, v as value from q where i = j")
def coo_diagonal(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.diagonal(quantities(spark, sf))


@catalog.query(
    "coo_dimensions",
    _Q + "select max(i) + 1 as num_rows, max(j) + 1 as num_cols, count(*) as num_cells from q",
)
def coo_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.dimensions(quantities(spark, sf))


@catalog.query(
    "coo_duplicate_cells",
    "select l_suppkey as i, l_partkey as j, count(*) as copies from lineitem group by 1, 2 having count(*) > 1",
)
def coo_duplicate_cells(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.duplicate_cells(matrix.cells(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey"))


@catalog.query(
    "coo_blocks",
    _Q
    + """select i // 32 as block_row, j // 64 as block_col, (i % 32)::int as row, (j % 64)::int as col, v as value
         from q where v <> 0""",
)
def coo_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.to_blocks(quantities(spark, sf), 32, 64)


@catalog.query("coo_blocks_and_back", _Q + "select i, j, v as value from q where v <> 0")
def coo_blocks_and_back(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.from_blocks(matrix.to_blocks(quantities(spark, sf), 32, 64), 32, 64)


@catalog.query(
    "row_segments",
    _Q
    + """select i, j // 256 as segment, count(*)::int as entries, string_agg(j::varchar, ',' order by j) as cols,
         sum(v) as total from q group by 1, 2""",
)
def row_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = matrix.to_row_segments(quantities(spark, sf), 256)
    return rows.select(
        "i",
        "segment",
        F.size("cols").alias("entries"),
        F.concat_ws(",", F.col("cols").cast("array<string>")).alias("cols"),
        F.aggregate("vals", F.lit(0.0), lambda a, v: a + v).alias("total"),
    )


@catalog.query("row_segments_and_back", _Q + "select i, j, v as value from q where v <> 0")
def row_segments_and_back(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.from_row_segments(matrix.to_row_segments(quantities(spark, sf), 256))


@catalog.query(
    "vectors_to_cells",
    """select i, (p - 1) as j, v as value from (
         select vec_id as i, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as p from embeddings)
       where v <> 0""",
)
def vectors_to_cells(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.from_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")


@catalog.query(
    "coo_gramian",
    _O + "select a.j as i, b.j, sum(a.v * b.v) as value from o a join o b on a.i = b.i group by 1, 2",
)
def coo_gramian(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.gramian(order_lines(spark, sf))


@catalog.query(
    "column_similarity",
    _O
    + """, n as (select j, sqrt(sum(v * v)) as n from o group by 1)
    select a.j as i, b.j, round(sum(a.v * b.v) / (max(na.n) * max(nb.n)), 9) as value
    from o a join o b on a.i = b.i and a.j < b.j join n na on na.j = a.j join n nb on nb.j = b.j group by 1, 2""",
)
def column_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.column_similarity(order_lines(spark, sf)).withColumn("value", rounded("value", 9))


@catalog.query(
    "column_similarity_sampled",
    _O + "select a.j as i, b.j, true as close from o a join o b on a.i = b.i and a.j < b.j group by 1, 2",
)
def column_similarity_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each estimate for the 0/1 pattern of order lines is near the exact value."""
    pattern = order_lines(spark, sf).withColumn("value", F.lit(1.0))
    exact = matrix.column_similarity(pattern)
    near = matrix.sampled_column_similarity(pattern, 0.02, 8).withColumnRenamed("value", "estimate")
    gap = F.abs(F.col("value") - F.coalesce("estimate", F.lit(0.0)))
    return exact.join(near, ["i", "j"], "left").select("i", "j", (gap < 0.25).alias("close"))


def part_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("value"))


@catalog.query("coo_matvec", _Q + "select i, sum(v * p_size) as value from q join part on p_partkey = j group by 1")
def coo_matvec(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.matvec(quantities(spark, sf), part_sizes(spark, sf))


@catalog.query(
    "coo_gramian_matvec",
    _Q
    + """, y as (select i, sum(v * p_size) as y from q join part on p_partkey = j group by 1)
    select q.j as i, sum(q.v * y.y) as value from q join y on y.i = q.i group by 1""",
)
def coo_gramian_matvec(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.gramian_matvec(materialize(quantities(spark, sf), "q"), part_sizes(spark, sf))


@catalog.query(
    "matrix_preview",
    _Q
    + "select i, "
    + ", ".join(f"coalesce(sum(v) filter (where j = {c}), 0.0::double) as c{c}" for c in range(8))
    + " from q where i < 8 and j < 8 group by 1",
)
def matrix_preview(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.preview(quantities(spark, sf), 8, 8)


@catalog.query(
    "matrix_times_transpose",
    """with a as (select s_nationkey as i, l_linenumber as j, sum(l_quantity) as v from lineitem
       join supplier on s_suppkey = l_suppkey group by 1, 2)
       select a.i::bigint as i, b.i::bigint as j, sum(a.v * b.v) as value from a join a b on a.j = b.j group by 1, 2""",
)
def matrix_times_transpose(spark: SparkSession, sf: str) -> DataFrame:
    """A coordinate CSV with 1-based ids, scanned and multiplied by its transpose."""
    lines = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy((F.col("s_nationkey") + 1).alias("i"), (F.col("l_linenumber") + 1).alias("j"))
        .agg(F.sum("l_quantity").alias("value"))
    )
    path = new_path(spark, "coo-csv")
    lines.write.csv(path)
    a = text.read_coo(spark, path)
    return matrix.multiply(a, matrix.transpose(a))


# --- dense rows --------------------------------------------------------------


def line_measures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.array("l_quantity", F.col("l_extendedprice") / 1000.0, F.col("l_discount") * 100.0, F.col("l_tax") * 100.0).alias("features")
    )


_MEASURES = """with m as (select unnest([l_quantity, l_extendedprice / 1000.0, l_discount * 100.0, l_tax * 100.0]) as v,
  unnest([0, 1, 2, 3])::bigint as c, l_orderkey as o, l_linenumber as l, l_partkey as p, l_suppkey as s, rowid as r from
  (select *, row_number() over () as rowid from lineitem)) """


@catalog.query(
    "dense_gramian",
    _MEASURES + "select a.c as i, b.c as j, round(sum(a.v * b.v), 3) as value from m a join m b on a.r = b.r group by 1, 2",
)
def dense_gramian(spark: SparkSession, sf: str) -> DataFrame:
    return dense.gramian(line_measures(spark, sf), "features").withColumn("value", rounded("value", 3))


@catalog.query(
    "covariance_matrix",
    _MEASURES + "select a.c as i, b.c as j, round(covar_samp(a.v, b.v), 6) as value from m a join m b on a.r = b.r group by 1, 2",
)
def covariance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return dense.covariance(line_measures(spark, sf), "features").withColumn("value", rounded("value"))


@catalog.query(
    "pearson_matrix",
    _MEASURES
    + """select a.c as i, b.c as j, case when a.c = b.c then 1.0::double else round(corr(a.v, b.v), 9) end as value
         from m a join m b on a.r = b.r group by 1, 2""",
)
def pearson_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return dense.pearson(line_measures(spark, sf), "features").withColumn("value", rounded("value", 9))


@catalog.query(
    "moments_far_from_zero",
    # A shift changes none of the three; shifted values would cost the SQL itself its digits.
    """with r as (select l_quantity::double as x, l_extendedprice::double as y from lineitem)
    select round(var_samp(x), 3) as var_x, round(covar_samp(x, y), 3) as cov_xy, round(corr(x, y), 6) as corr_xy from r""",
)
def moments_far_from_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Small variances of large values, as timestamps and ids have them."""
    rows = table(spark, sf, "lineitem").select(F.array(F.col("l_quantity") + 1e9, F.col("l_extendedprice") + 1e9).alias("x"))
    pick = lambda i, j, name, digits: rounded(F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("value"))), digits).alias(name)
    covariance = dense.covariance(rows, "x").agg(pick(0, 0, "var_x", 3), pick(0, 1, "cov_xy", 3))
    correlation = dense.pearson(rows, "x").agg(pick(0, 1, "corr_xy", 6))
    return covariance.withColumn("one", F.lit(1)).join(correlation.withColumn("one", F.lit(1)), "one").drop("one")


# A fixed 64 x 3 matrix.
LOCAL_MATRIX = [[float((r + 1) * (c + 1) % 5) for c in range(3)] for r in range(64)]


@catalog.query(
    "row_matrix_times_local",
    "select vec_id, "
    + ", ".join(
        f"round(list_inner_product(embedding::double[], {[row[c] for row in LOCAL_MATRIX]}::double[]), 6) as y{c}"
        for c in range(3)
    )
    + " from embeddings",
)
def row_matrix_times_local(spark: SparkSession, sf: str) -> DataFrame:
    rows = dense.multiply_local(table(spark, sf, "embeddings"), "embedding", LOCAL_MATRIX)
    return rows.select("vec_id", *[rounded(F.col("product")[c]).alias(f"y{c}") for c in range(3)])


@catalog.query(
    "svd_embeddings",
    "select i, j, case when i = j then 1.0::double else 0.0::double end as value from range(4) a(i), range(4) b(j)",
)
def svd_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """``U^T U`` of the first four left singular vectors: the identity."""
    df = table(spark, sf, "embeddings").select("vec_id", double_array("embedding").alias("features"))
    s, v = dense.svd(df, "features", 4)
    u = dense.left_singular(df, "features", s, v)
    return dense.gramian(u, "u").withColumn("value", F.abs(rounded("value")))


@catalog.query(
    "svd_energy",
    "select round(sum(e * e), 6) as energy from (select unnest(embedding)::double as e from embeddings)",
)
def svd_energy(spark: SparkSession, sf: str) -> DataFrame:
    """All squared singular values together are the squared entries."""
    s, _ = dense.svd(table(spark, sf, "embeddings"), "embedding", 64)
    made = spark.createDataFrame([(float((s * s).sum()),)], "energy double")
    return made.select(rounded("energy").alias("energy"))


@catalog.query(
    "pca_embeddings",
    """select round(sum(v), 6) as variance from (select var_samp(e) as v from (
         select unnest(embedding)::double as e, generate_subscripts(embedding, 1) as p from embeddings) group by p)""",
)
def pca_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Projecting on all components keeps the total variance."""
    df = table(spark, sf, "embeddings").select(double_array("embedding").alias("features"))
    components = dense.principal_components(df, "features", 64)
    cells = dense.covariance(dense.project(df, "features", components), "projected")
    return cells.where("i = j").agg(rounded(F.sum("value")).alias("variance"))


@catalog.query(
    "qr_line_measures",
    "select i, j, case when i = j then 1.0::double else 0.0::double end as value from range(4) a(i), range(4) b(j)",
)
def qr_line_measures(spark: SparkSession, sf: str) -> DataFrame:
    """``Q^T Q`` of the orthogonal factor: the identity."""
    df = line_measures(spark, sf)
    q = dense.qr_q(df, "features", dense.qr_r(df, "features"))
    return dense.gramian(q, "q").withColumn("value", F.abs(rounded("value")))
