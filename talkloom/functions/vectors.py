"""Vector arithmetic as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda total, x: total + x * x))


def squared_l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(v: Column) -> Column:
    """The vector at unit length; a zero vector has no direction and gives null."""
    # zip_with against the repeated norm: a lambda that called norm() would redo it per element.
    length = F.array_repeat(F.nullif(norm(v), F.lit(0.0)), F.size(v))
    return F.when(norm(v) > 0, F.zip_with(doubles(v), length, lambda x, n: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
