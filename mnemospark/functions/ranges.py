"""Range buckets of a sortable column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = 64


def range_bucket(df: DataFrame, col: str, parts: int) -> Column:
    """Number of the range (0 to ``parts - 1``) that a row's ``col`` falls in; the ranges hold
    about as many rows each (``percentile_approx``). Nulls and an empty table: range 0.
    The bounds are searched in two levels of literals, so a row compares with few of them."""
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(col, shares, 10 * max(parts, 1000)).alias("b")).first() if shares else None
    bounds = sorted(set(row["b"] or [])) if row and row["b"] else []
    if not bounds:
        return F.lit(0)
    at_or_below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(col)))
    heads = F.array(*[F.lit(x) for x in bounds[::_STEP]])
    groups = F.array(*[F.array(*[F.lit(x) for x in bounds[i : i + _STEP]]) for i in range(0, len(bounds), _STEP)])
    coarse = at_or_below(heads)
    fine = at_or_below(F.get(groups, coarse - 1))
    return F.when(F.col(col).isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * _STEP + fine).cast("int")
