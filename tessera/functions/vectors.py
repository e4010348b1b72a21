"""Distances and norms of vectors, added up in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term) -> Column:
    parts = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    same = F.size(a) == F.size(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(same, total).otherwise(F.raise_error(F.lit("different vector dimensions")).cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """NaN if either vector is zero."""
    norms = vector_norm(a) * vector_norm(b)
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - inner_product(a, b) / F.nullif(norms, F.lit(0.0)))


def vector_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vector_dims(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def l2_normalize(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    n = vector_norm(a)
    return F.when(n == 0, a.cast("array<float>")).otherwise(F.transform(a, lambda x: (x.cast("double") / F.nullif(n, F.lit(0.0))).cast("float")))


DISTANCES = {"<->": l2_distance, "<#>": negative_inner_product, "<=>": cosine_distance, "<+>": l1_distance}
