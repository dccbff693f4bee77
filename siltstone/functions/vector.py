"""Vector arithmetic on array columns, in double precision and without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; a zero vector is at distance 1 from any."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(F.lit(1.0))


def score(distance: Column) -> Column:
    """Similarity score of a cosine distance, not below zero."""
    return F.greatest(F.lit(0.0), 1 - distance)


def l2_normalize(a: Column) -> Column:
    """Unit length; the norm is taken as 1e-9 at least."""
    size = F.greatest(norm(a), F.lit(1e-9))
    return F.transform(a, lambda x: x.cast("double") / size)
