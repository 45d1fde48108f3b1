"""Vector functions over ``array<float>`` columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lit_or

_TINY = 1.1920929e-07  # a shorter vector has no direction


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length of the two."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    a, b = lit_or(a), lit_or(b)
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    raw = dot(a, b) / (norm(a) * norm(b))
    out = F.when((norm(a) < _TINY) | (norm(b) < _TINY), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    return out


def distance_score(a: Column | str, b: Column | str) -> Column:
    """``1 / (1 + d)`` of the squared Euclidean distance."""
    squares = F.zip_with(lit_or(a), lit_or(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return 1 / (1 + F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def normalised(v: Column | str) -> Column:
    v = lit_or(v)
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def padded(v: Column | str, dim: int) -> Column:
    """Cut or filled with zeros to ``dim``; a missing vector is all zeros."""
    zeros = F.array_repeat(F.lit(0).cast("float"), dim)
    return F.slice(F.concat(F.coalesce(lit_or(v), zeros), zeros), 1, dim)
