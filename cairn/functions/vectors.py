"""Column functions over vectors, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter of two vectors."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """Unit length; null for a zero or empty vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def rounded(x: Column, places: int) -> Column:
    """Rounded, with the sign of what becomes zero, as SQL's round keeps it."""
    r = F.round(x, places)
    return F.when(r == 0, x * F.lit(0.0)).otherwise(r)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two vectors, null if either has no direction."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1.0 - dot(a, b) / size)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0 for unequal lengths, empty and zero vectors."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size), F.lit(0.0))
