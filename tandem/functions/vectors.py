"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Root of the Jensen-Shannon divergence (natural log) of two distributions."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)

    both = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), total(both) / 2))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / total(powers))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def mean_pool(rows: Column, dims: int) -> Column:
    """Mean over an array of vectors."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.get(r, d).cast("double")) / F.size(rows))


def max_pool(rows: Column, dims: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.array_max(F.transform(rows, lambda r: F.get(r, d))))
