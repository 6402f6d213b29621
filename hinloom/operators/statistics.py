"""Column statistics, correlations and hypothesis tests."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.operators import dense
from hinloom.operators.ordering import average_ranks
from hinloom.runtime import double_array, materialize, running_sums

MAX_CATEGORIES = 10_000
_METRICS = ["mean", "variance", "numNonZeros", "max", "min", "normL1", "normL2"]


def column_summary(df: DataFrame, features: str) -> DataFrame:
    """One row per vector position, in one pass over the rows."""
    vector = array_to_vector(double_array(features))
    stats = df.select(vector.alias("v")).agg(
        Summarizer.metrics("count", *_METRICS).summary(F.col("v")).alias("s")
    )
    zipped = F.arrays_zip(*[vector_to_array(F.col(f"s.{m}")).alias(m) for m in _METRICS])
    return stats.select(F.col("s.count").alias("n"), F.posexplode(zipped).alias("pos", "c")).select(
        "pos",
        F.col("n").alias("count"),
        F.col("c.mean").alias("mean"),
        F.col("c.variance").alias("variance"),
        F.col("c.numNonZeros").cast("long").alias("nnz"),
        F.col("c.max").alias("max"),
        F.col("c.min").alias("min"),
        F.col("c.normL1").alias("l1"),
        F.col("c.normL2").alias("l2"),
    )


def sparse_column_summary(cells: DataFrame, num_rows: int) -> DataFrame:
    """The same from coordinate cells; missing cells count as zeros."""
    stats = cells.groupBy("j").agg(
        F.sum("value").alias("_s"),
        F.avg("value").alias("_mean"),
        F.var_pop("value").alias("_var"),
        F.sum(F.col("value") * F.col("value")).alias("_q"),
        F.count(F.when(F.col("value") != 0, 1)).alias("nnz"),
        F.count(F.lit(1)).alias("_stored"),
        F.max("value").alias("_max"),
        F.min("value").alias("_min"),
        F.sum(F.abs("value")).alias("l1"),
    )
    full = F.col("_stored") >= num_rows
    mean = F.col("_s") / num_rows
    return stats.select(
        "j",
        F.lit(num_rows).cast("long").alias("count"),
        mean.alias("mean"),
        (
            # Spread of the stored values, and of their mean against the zeros: no difference of large squares.
            (F.col("_var") + F.col("_mean") * F.col("_mean") * (num_rows - F.col("_stored")) / num_rows)
            * F.col("_stored")
            / (num_rows - 1)
            if num_rows > 1
            else F.lit(0.0)
        ).alias("variance"),
        "nnz",
        F.when(full, F.col("_max")).otherwise(F.greatest("_max", F.lit(0.0))).alias("max"),
        F.when(full, F.col("_min")).otherwise(F.least("_min", F.lit(0.0))).alias("min"),
        "l1",
        F.sqrt("_q").alias("l2"),
    )


def pearson_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("correlation"))


def with_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<c>_rank`` (average rank over all rows) for each column."""
    out = df
    for c in columns:
        ranks = average_ranks(df.select(c), c).select(
            F.col("value").alias("_v"), F.col("rank").alias(f"{c}_rank")
        )
        out = out.join(ranks, F.col(c) == F.col("_v")).drop("_v")
    return out


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation cells of the column ranks.

    All columns are ranked by one sort: their values are counted together, column by column, and a running count over
    (column, value) less that of the columns before is the rank.  The rows meet their ranks in one join.
    """
    cells = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("at", "value")
    # The row numbers are fixed by writing them.
    rows = materialize(df.select(F.monotonically_increasing_id().alias("row"), *columns), "rows").select("row", cells)
    counts = rows.groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_sums(counts, ["at", "value"], ["n"])
    before = placed.groupBy(F.col("at") + 1).agg(F.max("n_cum").alias("before")).withColumnRenamed("(at + 1)", "at")
    rank = F.col("n_cum") - F.coalesce("before", F.lit(0)) - (F.col("n") - 1) / 2.0
    ranks = placed.join(F.broadcast(before), "at", "left").select("at", "value", rank.alias("rank"))  # a row per column
    ranked = rows.join(ranks, ["at", "value"]).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("at", "rank")))["rank"].alias("features")  # one per column
    )
    return dense.pearson(materialize(ranked.select("features"), "ranks"), "features")


def contingency(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``(feature, value, label, n)`` counts of all features in one pass."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("feature"), F.col(c).cast("string").alias("value"))
            for i, c in enumerate(features)
        ]
    )
    return (
        df.select(F.inline(cells), F.col(label).cast("string").alias("label"))
        .groupBy("feature", "value", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def chi_square_independence(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson independence test of each feature against the label.

    ``(feature, statistic, df, p_value)``.  The sum over all cells equals
    ``sum(observed^2 / expected) - n``, so empty cells need no rows.  More
    than 10,000 values of a feature or label raise.
    """
    observed = contingency(df, features, label)
    by_value = observed.groupBy("feature", "value").agg(F.sum("n").alias("_row"))
    by_label = observed.groupBy("feature", "label").agg(F.sum("n").alias("_col"))
    totals = by_label.groupBy("feature").agg(
        F.sum("_col").alias("_n"), F.count(F.lit(1)).alias("_labels")
    )
    sizes = by_value.groupBy("feature").agg(F.count(F.lit(1)).alias("_values"))
    scored = (
        observed.join(by_value, ["feature", "value"])
        .join(by_label, ["feature", "label"])
        .groupBy("feature")
        .agg(F.sum(F.col("n") * F.col("n") / (F.col("_row") * F.col("_col"))).alias("_s"))
    )
    sized = totals.join(sizes, "feature")
    too_many = (F.col("_values") > MAX_CATEGORIES) | (F.col("_labels") > MAX_CATEGORIES)
    statistic = F.when(too_many, F.raise_error(F.lit("more than 10,000 categories")).cast("double")).otherwise(
        (F.col("_s") - 1.0) * F.col("_n")
    )
    result = scored.join(sized, "feature").select(
        "feature",
        statistic.alias("statistic"),
        ((F.col("_values") - 1) * (F.col("_labels") - 1)).alias("df"),
    )
    return with_chi_square_p(result)


def chi_square_contingency(table: DataFrame, row: str, column: str, count: str) -> DataFrame:
    """Pearson independence test of a given table of counts, one row per cell; cells that are missing are 0.

    Counts must not be negative; rows and columns of the table without any count are an error, since their expected
    counts are 0.  Returns one row ``statistic, df, p_value``.
    """
    n = F.col(count).cast("double")
    checked = F.when(n >= 0, n).otherwise(F.raise_error(F.lit("a count is null or negative")).cast("double"))
    cells = table.groupBy(F.col(row).alias("_r"), F.col(column).alias("_c")).agg(F.sum(checked).alias("_n"))
    cells = materialize(cells, "contingency")
    by_row = cells.groupBy("_r").agg(F.sum("_n").alias("_row"))
    by_column = cells.groupBy("_c").agg(F.sum("_n").alias("_col"))
    empty = F.raise_error(F.lit("a row or column of the table has no counts")).cast("double")
    share = F.when((F.col("_row") > 0) & (F.col("_col") > 0), F.col("_n") * F.col("_n") / (F.col("_row") * F.col("_col"))).otherwise(empty)
    scored = cells.join(by_row, "_r").join(by_column, "_c").agg(F.sum(share).alias("_s"), F.sum("_n").alias("_t"))
    sizes = by_row.agg(F.count(F.lit(1)).alias("_rows")).crossJoin(by_column.agg(F.count(F.lit(1)).alias("_columns")))
    tests = scored.crossJoin(sizes).select(
        ((F.col("_s") - 1.0) * F.col("_t")).alias("statistic"), ((F.col("_rows") - 1) * (F.col("_columns") - 1)).alias("df")
    )
    return with_chi_square_p(tests)


def chi_square_fit(observed: DataFrame, count: str, expected: str | None = None) -> DataFrame:
    """Goodness of fit of a count table; uniform unless expectations are given.

    Expectations are rescaled when their sum is off by 1e-7 or more.
    """
    weight = F.lit(1.0) if expected is None else F.col(expected).cast("double")
    sums = observed.agg(
        F.sum(F.col(count).cast("double")).alias("o"), F.sum(weight).alias("e"), F.count(F.lit(1)).alias("n")
    ).first()
    factor = 1.0 if abs(sums["o"] - sums["e"]) < 1e-7 else sums["o"] / sums["e"]
    scaled = weight * factor
    gap = F.col(count).cast("double") - scaled
    return with_chi_square_p(
        observed.agg(
            F.sum(gap * gap / scaled).alias("statistic"), F.lit(sums["n"] - 1).cast("long").alias("df")
        )
    )


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * front
    b = x + 1 - a
    c = 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return h * front
    raise ArithmeticError(f"the incomplete gamma function does not converge at {a}, {x}")


def with_chi_square_p(tests: DataFrame) -> DataFrame:
    """Add the p-value to ``statistic, df`` rows (one row per test)."""

    def p_values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            p = [
                1.0 if df == 0 else _upper_gamma(df / 2.0, s / 2.0)
                for s, df in zip(pdf["statistic"], pdf["df"])
            ]
            yield pdf.assign(p_value=pd.Series(p, index=pdf.index, dtype="float64"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tests.schema)
    return tests.mapInPandas(p_values, f"{fields}, p_value double")


def kernel_density(
    df: DataFrame, value: str, points: Sequence[float], bandwidth: float = 1.0, at_once: int = 256
) -> DataFrame:
    """Gaussian density estimates at the given points.

    Each point is one average over the sample, so a pass serves ``at_once``
    points and no pairs of point and sample are formed.
    """
    if bandwidth <= 0:
        raise ValueError("the bandwidth must be positive")
    constant = 1.0 / (bandwidth * math.sqrt(2 * math.pi))
    passes = []
    for start in range(0, len(points), at_once):
        chunk = list(points[start : start + at_once])
        averages = []
        for i, p in enumerate(chunk):
            z = (F.col(value) - float(p)) / bandwidth
            averages.append(F.avg(F.exp(z * z * -0.5)).alias(f"d{i}"))
        row = df.agg(*averages)
        cells = F.array(
            *[
                F.struct(F.lit(float(p)).alias("point"), (F.col(f"d{i}") * constant).alias("density"))
                for i, p in enumerate(chunk)
            ]
        )
        passes.append(row.select(F.inline(cells)))
    return reduce(DataFrame.unionByName, passes)


def ks_statistic(df: DataFrame, value: str, cdf: Callable[[Column], Column]) -> DataFrame:
    """Largest distance between the sample and a distribution function.

    One row ``(n, statistic)``.  Ranks come from running sums over the
    distinct values, so no task sorts the whole sample.
    """
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = running_sums(counts, ["value"], ["n"])
    n = df.count()
    above = F.col("n_cum") / n - cdf(F.col("value"))
    below = cdf(F.col("value")) - (F.col("n_cum") - F.col("n")) / n
    return placed.agg(F.sum("n").alias("n"), F.max(F.greatest(above, below)).alias("statistic"))


def ks_p_value(statistic: float, n: int) -> float:
    """Limit distribution with the small-sample correction of Stephens."""
    root = math.sqrt(n)
    x = (root + 0.12 + 0.11 / root) * statistic
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def ks_normal_test(df: DataFrame, value: str, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """One row ``(p_value, statistic)`` against a normal distribution."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    result = KolmogorovSmirnovTest.test(df.select(F.col(value).cast("double").alias("v")), "v", "norm", mean, std)
    return result.select(F.col("pValue").alias("p_value"), "statistic")


def describe_test(tests: DataFrame, method: str, null_hypothesis: str) -> DataFrame:
    """Result rows with the method and null hypothesis in words."""
    return tests.withColumn("method", F.lit(method)).withColumn("null_hypothesis", F.lit(null_hypothesis))
