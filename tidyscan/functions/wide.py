"""Per-column metrics computed for all columns in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .schema import sql_name, sql_text


def per_column(df: DataFrame, cols: list[str], metrics: dict[str, str]) -> DataFrame:
    """(column, metric…): one row per column out of a single one-row aggregate.

    A metric is the SQL text of an aggregate in which ``{c}`` stands for the column.
    """
    aggs = [f"{text.format(c=sql_name(c))} AS {m}_{i}" for i, c in enumerate(cols) for m, text in metrics.items()]
    return to_rows(
        df.selectExpr(*aggs),
        [{"column": sql_text(c), **{m: f"{m}_{i}" for m in metrics}} for i, c in enumerate(cols)],
    )


def to_rows(one_row: DataFrame, rows: list[dict[str, str]]) -> DataFrame:
    """Turn a one-row table into several rows, each given as output name -> SQL text."""
    made = ", ".join("struct(" + ", ".join(f"{e} AS {sql_name(k)}" for k, e in r.items()) + ")" for r in rows)
    return one_row.selectExpr(f"inline(array({made}))")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)
