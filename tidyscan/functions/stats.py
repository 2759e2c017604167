"""Guarded moments and correlations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def both(x: Column, y: Column) -> Column:
    return x.isNotNull() & y.isNotNull()


def pearson_expr(x: Column, y: Column, min_rows: int = 2) -> Column:
    """Pearson r over pairwise-complete rows; null when a side is constant."""
    ok = both(x, y)
    a, b = F.when(ok, x), F.when(ok, y)
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
    return F.when(F.count_if(ok) >= min_rows, r)


def skewness_sql(x: str) -> str:
    """Bias-corrected skewness; null below three values, 0 for a constant column."""
    n = f"CAST(count({x}) AS DOUBLE)"
    raw = f"CASE WHEN var_pop({x}) > 0 THEN skewness({x}) ELSE 0D END"
    return f"CASE WHEN count({x}) >= 3 THEN ({raw}) * sqrt({n} * ({n} - 1)) / nullif({n} - 2, 0D) END"
