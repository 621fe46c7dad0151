"""Vector arithmetic on array columns, all of it inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return fold_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def sq_l2(a: Column, b: Column) -> Column:
    def term(x, y):
        diff = x.cast("double") - y.cast("double")
        return diff * diff

    return fold_sum(F.zip_with(a, b, term))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def scale(a: Column, k: Column | float) -> Column:
    k = F.lit(k) if isinstance(k, (int, float)) else k
    return F.transform(a, lambda x: x * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vector_sum(col: str, width: int, weight: Column | None = None) -> Column:
    """Element-wise sum of an array column as an aggregate.

    ``width`` plain sums, so Spark combines them map-side and no group of
    vectors is ever gathered in one place.
    """
    terms = []
    for i in range(width):
        x = F.get(F.col(col), F.lit(i)).cast("double")
        terms.append(F.sum(x if weight is None else x * weight))
    return F.array(*terms)
