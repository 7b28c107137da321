"""Vector arithmetic on array columns, summed in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; null if either is null."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column, epsilon: float = 1e-9) -> Column:
    """v / (|v| + epsilon): a zero vector stays zero."""
    # a lambda evaluates what it closes over for every element: the norm is bound once
    return F.transform(F.array(norm(v) + F.lit(epsilon)), lambda size: F.transform(doubles(v), lambda x: x / size))[0]


def quantise(v: Column, scale: int = 127) -> Column:
    """Integers round(scale * x), half away from zero."""
    return F.transform(doubles(v), lambda x: F.round(x * F.lit(float(scale))).cast("int"))


def dequantise(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale)


def int_dot(a: Column, b: Column) -> Column:
    """Exact whatever the order of summation."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def usable(v: Column, dim: int) -> Column:
    """dim numbers, none null or NaN, and a norm above 0."""
    return v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
