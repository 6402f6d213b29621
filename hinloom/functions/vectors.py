"""Vector algebra on ``array<double>`` columns, JVM side."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = 0.0


def array_of(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(_ZERO), lambda acc, v: acc + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


# Up to this length a product with a constant is written out term by term, which
# compiles into one expression; longer ones loop over the array.
UNROLLED = 256


def dot_constant(x: Column, weights: Sequence[float]) -> Column:
    """``x . w`` for a constant ``w``; a vector of another length raises, however long ``w`` is."""
    size = len(weights)
    wrong = F.raise_error(F.lit(f"product with a constant needs vectors of size {size}")).cast("double")
    if size > UNROLLED:
        out = dot(x, array_of(weights))
    else:
        out = F.lit(_ZERO)
        for i, w in enumerate(weights):
            out = out + F.get(x, F.lit(i)) * float(w)
    return F.when(F.size(x) != size, wrong).otherwise(out)


def scale(a: float | Column, x: Column) -> Column:
    return F.transform(x, lambda v: v * a)


def axpy(a: float | Column, x: Column, y: Column) -> Column:
    """``a * x + y``."""
    return F.zip_with(x, y, lambda u, v: u * a + v)


def norm(x: Column, p: float) -> Column:
    """p-norm, ``p >= 1``; ``math.inf`` gives the largest magnitude."""
    if p < 1:
        raise ValueError("p must be at least 1")
    if p == 1:
        return total(F.transform(x, F.abs))
    if p == 2:
        return F.sqrt(total(F.transform(x, lambda v: v * v)))
    if math.isinf(p):
        return F.aggregate(x, F.lit(_ZERO), lambda acc, v: F.greatest(acc, F.abs(v)))
    return F.pow(total(F.transform(x, lambda v: F.pow(F.abs(v), F.lit(p)))), F.lit(1.0 / p))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def cosine(x: Column, y: Column) -> Column:
    """0 when either vector is zero."""
    lengths = norm(x, 2) * norm(y, 2)
    return F.when(lengths == 0, F.lit(_ZERO)).otherwise(dot(x, y) / lengths)


def argmax(x: Column) -> Column:
    """First 0-based index of the maximum; -1 for an empty vector."""
    return F.when(F.size(x) == 0, F.lit(-1)).otherwise(
        (F.array_position(x, F.array_max(x)) - 1).cast("int")
    )


def nnz(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: v != 0))


def num_actives(x: Column) -> Column:
    """Stored values of a dense vector, zeros included."""
    return F.size(x)


def append_bias(x: Column) -> Column:
    return F.concat(x, F.array(F.lit(1.0)))


def normalize(x: Column, p: float = 2.0) -> Column:
    """``x / norm_p(x)``; a zero vector stays as it is."""
    length = norm(x, p)
    return F.when(length == 0, x).otherwise(F.transform(x, lambda v: v / length))


def hadamard(x: Column, weights: Sequence[float]) -> Column:
    """Elementwise product with a constant; other sizes raise."""
    size = len(weights)
    checked = F.when(F.size(x) == size, x).otherwise(
        F.raise_error(F.lit(f"elementwise product needs vectors of size {size}"))
    )
    return F.zip_with(checked, array_of(weights), lambda a, b: a * b)


def to_sparse(x: Column) -> Column:
    """``array<struct<index, value>>`` of the non-zeros, ascending by index."""
    cells = F.transform(
        x, lambda v, i: F.struct(i.cast("int").alias("index"), v.alias("value"))
    )
    return F.filter(cells, lambda c: c["value"] != 0)


def to_dense(cells: Column, size: int | Column) -> Column:
    """Inverse of `to_sparse` for a vector of ``size`` entries."""
    lookup = F.map_from_entries(
        F.transform(cells, lambda c: F.struct(c["index"].cast("long"), c["value"]))
    )
    last = (size if isinstance(size, Column) else F.lit(size)).cast("long") - 1
    return F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda i: F.coalesce(F.try_element_at(lookup, i), F.lit(_ZERO)),
    )


def is_smaller_sparse(x: Column) -> Column:
    """Whether sparse storage takes less room than dense: ``1.5 (nnz + 1) < size``."""
    return (nnz(x) + 1) * 1.5 < F.size(x)


def take(x: Column, indices: Sequence[int]) -> Column:
    """The entries at the given 0-based indices, in that order."""
    return F.array(*[F.element_at(x, i + 1) for i in indices])


def log1p_exp(x: Column) -> Column:
    """``ln(1 + e^x)`` without overflow."""
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def diagonal_gaussian_logpdf(x: Column, mean: Sequence[float], variance: Sequence[float]) -> Column:
    """Log density of a normal with independent components.

    A component of zero variance is left out, as a pseudo-inverse does.
    """
    kept = [i for i, v in enumerate(variance) if v > 0]
    constant = -0.5 * sum(math.log(2 * math.pi * variance[i]) for i in kept)
    terms = [
        (F.element_at(x, i + 1) - mean[i]) * (F.element_at(x, i + 1) - mean[i]) / variance[i]
        for i in kept
    ]
    quadratic = F.lit(_ZERO)
    for term in terms:
        quadratic = quadratic + term
    return F.lit(constant) - quadratic * 0.5
