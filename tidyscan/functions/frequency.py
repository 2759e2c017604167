"""Counts of distinct values for many columns at once, in long form.

One shuffle on (column, value) serves all columns of a type family; hot values collapse in the
map-side partial aggregate.  Values stay typed, so distinct doubles never meet as equal text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import schema as S
from .wide import to_rows


def _family(dt: T.DataType) -> str:
    if S.is_integer(dt):
        return "bigint"
    if S.is_float(dt):
        return "double"
    if isinstance(dt, (T.DateType, T.TimestampNTZType)):
        return "timestamp_ntz"
    if S.is_string(dt):
        return "string"
    return dt.simpleString()


def families(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in cols:
        out.setdefault(_family(S.dtype_of(df, c)), []).append(c)
    return out


def _plain(df: DataFrame, cols: list[str], family: str) -> DataFrame:
    """The columns as v0, v1, … in the type of their family."""
    if S.is_nested(S.dtype_of(df, cols[0])):
        return df.select(*[S.groupable(S.q(c), S.dtype_of(df, c)).alias(f"v{i}") for i, c in enumerate(cols)])
    if family == "double":
        return df.selectExpr(*[f"{S.double_sql(df, c)} AS v{i}" for i, c in enumerate(cols)])
    return df.selectExpr(*[f"CAST({S.sql_name(c)} AS {family}) AS v{i}" for i, c in enumerate(cols)])


def level_counts(df: DataFrame, cols: list[str], family: str) -> DataFrame:
    """(column_no, value, n) for the columns of one type family; null is a level."""
    plain = _plain(df, cols, family)
    pairs = ", ".join(f"struct({i} AS column_no, v{i} AS value)" for i in range(len(cols)))
    return plain.selectExpr(f"inline(array({pairs}))").groupBy("column_no", "value").agg(F.expr("count(1) AS n"))


def name_of(cols: list[str]) -> Column:
    return F.element_at(F.lit(list(cols)), F.col("column_no") + 1)


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, unique, has_null): distinct non-null values of each column."""
    cols = list(df.columns if cols is None else cols)
    S.require(df, cols)
    if approx:
        clean = S.nan_to_null(df)
        plain = clean.select(*[S.group_column(clean, c).alias(f"v{i}") for i, c in enumerate(cols)])
        parts = [f"approx_count_distinct(v{i}) AS u{i}" for i in range(len(cols))]
        parts += [f"coalesce(bool_or(v{i} IS NULL), false) AS h{i}" for i in range(len(cols))]
        rows = [{"column": S.sql_text(c), "unique": f"u{i}", "has_null": f"h{i}"} for i, c in enumerate(cols)]
        return to_rows(plain.selectExpr(*parts), rows)
    parts = []
    for family, members in families(df, cols).items():
        found = (
            level_counts(df, members, family)
            .groupBy("column_no")
            .agg(F.expr("count(value) AS `unique`"), F.expr("bool_or(value IS NULL) AS has_null"))
        )
        # an empty table has no levels: the name list keeps such columns with 0
        parts.append(
            all_columns(df, members)
            .join(F.broadcast(found), "column_no", "left")
            .selectExpr("column", "coalesce(`unique`, 0L) AS `unique`", "coalesce(has_null, false) AS has_null")
        )
    return reduce(DataFrame.unionByName, parts)


def all_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column name; the list is as long as the schema is wide."""
    spark = df.sparkSession
    return spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "column_no int, column string")


def modes(df: DataFrame, cols: list[str], family: str) -> DataFrame:
    """(column, top, top_count): most frequent non-null value, ties to the smallest."""
    counts = level_counts(df, cols, family).filter("value IS NOT NULL")
    best = counts.groupBy("column_no").agg(F.expr("min(struct(-n AS k, value AS v)) AS b"))
    return best.select(name_of(cols).alias("column"), F.expr("b.v AS top"), F.expr("-b.k AS top_count"))


def mode_values(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent value of each column, as Python values (one per column)."""
    out: dict[str, object] = {c: None for c in cols}
    for family, members in families(df, cols).items():
        for r in modes(df, members, family).collect():
            out[r["column"]] = r["top"]
    return out
