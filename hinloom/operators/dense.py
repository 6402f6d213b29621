"""Dense rows: per-partition partial sums, packed.

A partition reduces its rows to their products (features with a constant 1
appended, so column sums and the row count come along), cut into square
blocks of columns.  Only those blocks are shuffled, one binary each, never
the rows, and they are added level by level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinloom.functions import vectors
from hinloom.operators.packed import added
from hinloom.runtime import double_array, materialize

# Widest matrix that comes to the driver for its eigenvectors; wider ones are only multiplied with vectors.
MAX_WIDTH = 4096

# Columns of a block of products, and bytes of blocks a task sums at once: wider rows take more passes.
EDGE = 512
PASS_BYTES = 256 << 20

# Values of rows handled at once.
CHUNK_VALUES = 1 << 22

# Widest row of a Gramian: it has width squared cells.
MOST_COLUMNS = 65_535


def rows_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A ``list<double>`` column of equal-length vectors as a 2-d array."""
    lists = batch.column(batch.schema.get_field_index(column))
    if len(lists) == 0:
        return np.empty((0, 0))
    if lists.null_count:
        raise ValueError("a feature vector is null")
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // len(lists)
    if width * len(lists) != len(flat) or pc.min_max(pc.list_value_length(lists))["max"].as_py() != width:
        raise ValueError("feature vectors differ in length")
    return flat.reshape(len(lists), width)


def vector_width(df: DataFrame, features: str) -> int:
    first = df.select(F.size(features).alias("n")).first()
    if first is None:
        raise ValueError("no rows")
    if first["n"] > MOST_COLUMNS:
        raise ValueError(f"a matrix of products takes at most {MOST_COLUMNS} columns")
    return first["n"]


def product_blocks(df: DataFrame, features: str, shift: np.ndarray | None = None, edge: int = EDGE) -> DataFrame:
    """Blocks ``(a, b, sums)`` with ``a <= b`` of ``[X 1]^T [X 1]``, of rows less ``shift`` if it is given.

    A block is the product of two groups of ``edge`` columns.  A task sums as many blocks as `PASS_BYTES` hold, so a
    table of d columns is read ``d^2 / 2 * 8 / PASS_BYTES`` times: once up to about 8,000 columns.  Tasks are as many
    as keep what they send below what they read.
    """
    width = vector_width(df, features) + 1
    groups = [slice(start, min(start + edge, width)) for start in range(0, width, edge)]
    pairs = [(a, b) for a in range(len(groups)) for b in range(a, len(groups))]
    at_once = max(1, PASS_BYTES // (8 * edge * edge))
    rows = df.select(double_array(features).alias("features"))
    if len(groups) > 1:
        rows = rows.coalesce(max(1, df.count() // width))

    def sums_of(some: list[tuple[int, int]]):
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                step = max(1, CHUNK_VALUES // width)
                for start in range(0, batch.num_rows, step):
                    x = rows_of(batch.slice(start, step), "features")
                    x = np.hstack([x if shift is None else x - shift, np.ones((len(x), 1))])
                    for a, b in some:
                        product = x[:, groups[a]].T @ x[:, groups[b]]
                        sums[a, b] = sums[a, b] + product if (a, b) in sums else product
            if sums:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a for a, _ in sums], pa.int32()),
                        pa.array([b for _, b in sums], pa.int32()),
                        pa.array([part] * len(sums), pa.int64()),
                        pa.array([s.tobytes() for s in sums.values()], pa.binary()),
                    ],
                    names=["a", "b", "part", "sums"],
                )

        return partial

    parts = None
    for start in range(0, len(pairs), at_once):
        found = rows.mapInArrow(sums_of(pairs[start : start + at_once]), "a int, b int, part long, sums binary")
        parts = found if parts is None else parts.union(found)
    return added(parts, ["a", "b"])


def _products(df: DataFrame, features: str, shift: np.ndarray | None = None, edge: int = EDGE) -> DataFrame:
    """Upper-triangle cells ``(i, j, value)`` of ``[X 1]^T [X 1]``, of rows less ``shift`` if it is given."""
    width = vector_width(df, features) + 1

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                top, left = row["a"] * edge, row["b"] * edge
                across = min(edge, width - left)
                block = np.frombuffer(row["sums"]).reshape(-1, across)
                i, j = np.triu_indices(len(block), 0, across) if top == left else np.indices(block.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i + top, pa.int64()), pa.array(j + left, pa.int64()), pa.array(block[i, j])],
                    names=["i", "j", "value"],
                )

    return product_blocks(df, features, shift, edge).mapInArrow(unpack, "i long, j long, value double")


# Rows whose mean is taken off all rows before products of large numbers are formed.
FIRST_ROWS = 100


def near_rows(df: DataFrame, features: str) -> np.ndarray:
    """A vector near the rows: the mean of a few of them.  It keeps digits; no result depends on which they are."""
    some = [r[0] for r in df.select(double_array(features)).limit(FIRST_ROWS).collect()]
    if not some or any(x is None or None in x or len(x) != len(some[0]) for x in some):
        raise ValueError("a feature vector is null or of another length" if some else "no rows")
    return np.nan_to_num(np.mean(some, 0))


def column_means(df: DataFrame, features: str) -> np.ndarray:
    """Mean of each column: one pass, a partial sum per partition."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch, "features")
                sums = x.sum(0) if sums is None else sums + x.sum(0)
                count += len(x)
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int64()), pa.array(sums), pa.array([count] * len(sums), pa.int64())],
                names=["i", "sum", "n"],
            )

    parts = df.select(double_array(features).alias("features")).mapInArrow(partial, "i long, sum double, n long")
    rows = parts.groupBy("i").agg((F.sum("sum") / F.sum("n")).alias("mean")).toPandas()  # as many as columns
    return rows.sort_values("i")["mean"].to_numpy()


def gramian(df: DataFrame, features: str, edge: int = EDGE) -> DataFrame:
    """``X^T X`` as symmetric cells."""
    from hinloom.operators.matrix import mirror

    width = vector_width(df, features)
    return mirror(_products(df, features, edge=edge).where((F.col("i") < width) & (F.col("j") < width)))


def covariance(df: DataFrame, features: str, edge: int = EDGE) -> DataFrame:
    """Sample covariance cells; fewer than two rows is an error."""
    return _moments(df, features, edge).select("i", "j", F.col("_cov").alias("value"))


def pearson(df: DataFrame, features: str, edge: int = EDGE) -> DataFrame:
    """Correlation cells: 1 on the diagonal, NaN where a variance is at most 1e-12."""
    m = _moments(df, features, edge)
    flat = (F.col("_vi") <= 1e-12) | (F.col("_vj") <= 1e-12)
    value = (
        F.when(F.col("i") == F.col("j"), F.lit(1.0))
        .when(flat, F.lit(float("nan")))
        .otherwise(F.col("_cov") / F.sqrt(F.col("_vi") * F.col("_vj")))
    )
    return m.select("i", "j", value.alias("value"))


def _moments(df: DataFrame, features: str, edge: int) -> DataFrame:
    from hinloom.operators.matrix import mirror

    width = vector_width(df, features)
    # (width + 1)^2 / 2 cells, written because the joins read them three times.  They are taken about a vector near the
    # rows: the difference of large squares would leave nothing of a small variance.
    cells = materialize(_products(df, features, near_rows(df, features), edge), "products")
    rows = cells.where((F.col("i") == width) & (F.col("j") == width)).first()["value"]
    if rows <= 1:
        raise ValueError("covariance needs at least two rows")
    sums = cells.where((F.col("j") == width) & (F.col("i") < width))
    squares = cells.where((F.col("i") == F.col("j")) & (F.col("i") < width))
    stats = sums.select("i", (F.col("value") / rows).alias("_mu")).join(
        squares.select("i", F.col("value").alias("_sq")), "i"
    )
    stats = stats.withColumn(
        "_v", F.col("_sq") / (rows - 1) - F.col("_mu") * F.col("_mu") * (rows / (rows - 1))
    )
    left = stats.select("i", F.col("_mu").alias("_mi"), F.col("_v").alias("_vi"))
    right = stats.select(F.col("i").alias("j"), F.col("_mu").alias("_mj"), F.col("_v").alias("_vj"))
    upper = (
        cells.where((F.col("i") < width) & (F.col("j") < width))
        .join(left, "i")
        .join(right, "j")
        .withColumn(
            "_cov",
            F.col("value") / (rows - 1) - F.col("_mi") * F.col("_mj") * (rows / (rows - 1)),
        )
    )
    return mirror(upper.select("i", "j", "_cov", "_vi", "_vj"))


def multiply_local(df: DataFrame, features: str, matrix: Sequence[Sequence[float]], name: str = "product") -> DataFrame:
    """Each row vector times a constant matrix, as an array column.

    A small matrix becomes column expressions; a larger one goes to the tasks
    once and meets the rows in Arrow batches.
    """
    grid = np.asarray(matrix, dtype=float)
    if grid.size <= vectors.UNROLLED:
        products = [vectors.dot_constant(double_array(features), c.tolist()) for c in grid.T]
        return df.withColumn(name, F.array(*products))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            product = rows_of(batch, "_x") @ grid
            offsets = np.arange(0, product.size + 1, product.shape[1], dtype="int32")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(product.ravel()))
            table = pa.Table.from_batches([batch]).drop_columns(["_x"])
            yield from table.append_column(name, lists).to_batches()

    kept = [f for f in df.schema if f.name != name]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    rows = df.select(*[f.name for f in kept], double_array(features).alias("_x"))
    return rows.mapInArrow(multiply, f"{fields}, `{name}` array<double>")


def _local(cells: DataFrame, width: int) -> np.ndarray:
    """Width-checked cells as a driver matrix (at most `MAX_WIDTH` squared)."""
    pdf = cells.toPandas()
    out = np.zeros((width, width))
    out[pdf["i"], pdf["j"]] = pdf["value"]
    return out


def svd(
    df: DataFrame, features: str, k: int, r_cond: float = 1e-9
) -> tuple[np.ndarray, np.ndarray]:
    """``(s, V)`` of the ``k`` largest singular values above ``r_cond * s[0]``.

    The Gramian is one distributed pass; its eigenvectors are width squared.  Beyond `MAX_WIDTH` columns only
    vectors of that length come to the driver, by Lanczos steps of one pass each.
    """
    width = df.select(F.size(features)).first()[0]
    if width > MAX_WIDTH:
        values, basis = lanczos(lambda v: gramian_times(df, features, v), width, k)
        s = np.sqrt(np.clip(values, 0, None))
        kept = s > r_cond * s[0]
        return s[kept], basis[:, kept]
    values, basis = np.linalg.eigh(_local(gramian(df, features), width))
    order = np.argsort(values)[::-1][:k]
    s = np.sqrt(np.clip(values[order], 0, None))
    kept = s > r_cond * s[0]
    return s[kept], basis[:, order][:, kept]


def gramian_times(df: DataFrame, features: str, vector: np.ndarray, shift: np.ndarray | None = None) -> np.ndarray:
    """``X^T (X v)`` in one pass, of rows less ``shift`` if it is given; a partition sends one vector."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch, "features")
                if shift is not None:
                    x = x - shift
                part = x.T @ (x @ vector)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["i", "value"])

    parts = df.select(double_array(features).alias("features")).mapInArrow(partial, "i long, value double")
    found = parts.groupBy("i").agg(F.sum("value").alias("value")).toPandas()  # as many as columns
    out = np.zeros(len(vector))
    out[found["i"]] = found["value"]
    return out


def lanczos(times, size: int, k: int, tolerance: float = 1e-10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors of a symmetric matrix known by its products with vectors.

    All basis vectors are kept orthogonal; it ends when the residuals of the ``k`` pairs are small or the space is
    exhausted.
    """
    rng = np.random.default_rng(seed)
    basis = [rng.standard_normal(size)]
    basis[0] /= np.linalg.norm(basis[0])
    diagonal: list[float] = []
    beside: list[float] = []
    while True:
        w = times(basis[-1])
        diagonal.append(float(w @ basis[-1]))
        for _ in range(2):  # twice is enough against rounding
            for q in basis:
                w = w - (w @ q) * q
        rest = float(np.linalg.norm(w))
        m = len(diagonal)
        values, vectors_ = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
        top = np.argsort(values)[::-1][:k]
        scale = max(abs(values).max(), 1e-300)
        settled = m >= k and (rest * np.abs(vectors_[-1, top]) <= tolerance * scale).all()
        if settled or m == size or rest <= 1e-14 * scale:
            return values[top], np.stack(basis, 1) @ vectors_[:, top]
        beside.append(rest)
        basis.append(w / rest)


def left_singular(df: DataFrame, features: str, s: np.ndarray, v: np.ndarray, name: str = "u") -> DataFrame:
    """Rows of ``U = X V S^-1``."""
    return multiply_local(df, features, (v / s).tolist(), name)


def principal_components(df: DataFrame, features: str, k: int) -> np.ndarray:
    """Columns are the top ``k`` eigenvectors of the covariance.

    Beyond `MAX_WIDTH` columns they come by Lanczos steps on the centred rows, and only vectors of that length come to
    the driver.
    """
    width = vector_width(df, features)
    if width > MAX_WIDTH:
        means = column_means(df, features)
        return lanczos(lambda v: gramian_times(df, features, v, means), width, k)[1]
    values, basis = np.linalg.eigh(_local(covariance(df, features), width))
    return basis[:, np.argsort(values)[::-1][:k]]


def project(df: DataFrame, features: str, components: np.ndarray, name: str = "projected") -> DataFrame:
    """Project rows as they are (not centred)."""
    return multiply_local(df, features, components.tolist(), name)


# Triangular blocks a task of a level factors together.
MERGED_BLOCKS = 8


def qr_r(df: DataFrame, features: str) -> np.ndarray:
    """``R`` of a tall-skinny QR, diagonal not negative.

    Partitions factor their rows, groups of partitions factor the stacked
    ``R`` blocks, packed as one binary each, level by level until one is left.
    """
    width = vector_width(df, features)

    def sent(r: np.ndarray, part: int) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "r"])

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, width))
        for batch in batches:
            step = max(width, CHUNK_VALUES // width)
            for start in range(0, batch.num_rows, step):
                r = np.linalg.qr(np.vstack([r, rows_of(batch.slice(start, step), "features")]), mode="r")
        if len(r):
            yield sent(r, TaskContext.get().partitionId())

    def stack(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(r.as_py()).reshape(-1, width) for r in table.column("r")]
        return pa.Table.from_batches([sent(np.linalg.qr(np.vstack(blocks), mode="r"), table.column("part")[0].as_py())])

    blocks = materialize(df.select(double_array(features).alias("features")).mapInArrow(factor, "part long, r binary"), "blocks")
    count = blocks.count()
    while count > 1:
        count = -(-count // MERGED_BLOCKS)
        dealt = blocks.select(F.pmod(F.xxhash64("part"), F.lit(count)).alias("part"), "r")
        blocks = materialize(dealt.groupBy("part").applyInArrow(stack, "part long, r binary"), "blocks")
    r = np.frombuffer(blocks.first()["r"]).reshape(-1, width)
    signs = np.where(np.diag(r) < 0, -1.0, 1.0)
    return r * signs[:, None]


def qr_q(df: DataFrame, features: str, r: np.ndarray, name: str = "q") -> DataFrame:
    """Rows of ``Q = X R^-1``."""
    return multiply_local(df, features, np.linalg.inv(r).tolist(), name)
