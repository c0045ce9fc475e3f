"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once.

    Inside a lambda an outer expression is computed again for each element, and
    one that is named twice is computed twice; a bound variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cosine(a: Column, b: Column, zero: float = 0.0) -> Column:
    """Cosine similarity; ``zero`` where a vector has no length."""
    return let(F.sqrt(dot(a, a) * dot(b, b)), lambda n: F.when(n == 0, F.lit(zero)).otherwise(dot(a, b) / n))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return let(doubles(a), lambda v: let(F.sqrt(dot(v, v)), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def weighted_centroid(old: Column, new: Column, old_weight: Column, new_weight: Column) -> Column:
    """Weighted mean of two vectors, brought to unit length."""
    weights = F.struct(old_weight.alias("a"), new_weight.alias("b"))
    return normalised(let(weights, lambda w: F.zip_with(doubles(old), doubles(new), lambda x, y: x * w["a"] + y * w["b"])))


def drift(centroid: Column, query: Column, alpha: float = 0.05) -> Column:
    """The centroid moved towards a query by ``alpha``."""
    return weighted_centroid(centroid, query, F.lit(1 - alpha), F.lit(alpha))
