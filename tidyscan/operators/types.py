"""Which type a column should have, and conversion with a policy for cells that do not fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import dates, frequency, schema as S
from ..functions.wide import to_rows

# Spellings of truth, and the shares that decide a recommendation.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]
BOOLEAN_SHARE = 0.95
DATETIME_SHARE = 0.85
NUMERIC_SHARE = 0.90
WHOLE_SHARE = 0.98
WHOLE_TOLERANCE = 1e-9
TARGETS = ("string", "datetime", "float", "integer", "boolean")


def _words(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def current_type(dt: T.DataType) -> str:
    if S.is_datetime(dt):
        return "datetime"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if S.is_integer(dt):
        return "integer"
    return "float" if S.is_number(dt) else "string"


def type_rates(df: DataFrame) -> DataFrame:
    """(column, non_null, boolean_rate, numeric_rate, whole_rate, datetime_rate) of the text columns, in one pass."""
    cols = [f.name for f in df.schema if S.is_string(f.dataType)]
    names = "column string, non_null bigint, boolean_rate double, numeric_rate double, whole_rate double, datetime_rate double"
    if not cols:
        return df.sparkSession.createDataFrame([], names)
    aggs, rows = [], []
    for i, name in enumerate(cols):
        c = S.sql_name(name)
        x = S.number_sql(c)
        aggs += [
            f"count({c}) AS n{i}",
            f"count_if(lower(trim({c})) IN ({_words(TRUE_WORDS + FALSE_WORDS)})) AS b{i}",
            f"count({x}) AS x{i}",
            f"count_if(abs(({x}) - rint({x})) < {WHOLE_TOLERANCE}) AS w{i}",
            f"count({dates.timestamp_sql(c)}) AS d{i}",
        ]
        rows.append(
            {
                "column": S.sql_text(name), "non_null": f"n{i}",
                "boolean_rate": f"b{i} / greatest(n{i}, 1L)", "numeric_rate": f"x{i} / greatest(n{i}, 1L)",
                "whole_rate": f"w{i} / greatest(x{i}, 1L)", "datetime_rate": f"d{i} / greatest(n{i}, 1L)",
            }
        )
    return to_rows(df.selectExpr(*aggs), rows)


def recommend_types(df: DataFrame) -> DataFrame:
    """(column, current, recommended, reason, needs_change); columns to change come first."""
    text = [f.name for f in df.schema if S.is_string(f.dataType)]
    rates = {r["column"]: r for r in type_rates(df).collect()}
    levels = {r["column"]: r["unique"] for r in frequency.distinct_counts(df, text).collect()} if text else {}
    rows = []
    for f in df.schema:
        now = current_type(f.dataType)
        if now != "string" or f.name not in rates:
            rows.append((f.name, now, now, "already_typed" if now != "string" else "nested_or_other", False))
            continue
        r = rates[f.name]
        few = min(50, max(3, int(0.2 * max(1, r["non_null"]))))
        if r["boolean_rate"] >= BOOLEAN_SHARE:
            best, why = "boolean", "yes_no_words"
        elif r["datetime_rate"] >= DATETIME_SHARE:
            best, why = "datetime", "dates"
        elif r["numeric_rate"] >= NUMERIC_SHARE:
            best, why = ("integer", "whole_numbers") if r["whole_rate"] > WHOLE_SHARE else ("float", "numbers")
        else:
            best, why = "string", "low_variety" if levels[f.name] <= few else "free_text"
        rows.append((f.name, now, best, why, best != now))
    made = df.sparkSession.createDataFrame(
        rows, "column string, current string, recommended string, reason string, needs_change boolean"
    )
    return made.orderBy(F.col("needs_change").desc(), "column")


def search_recommendations(recommendations: DataFrame, text: str) -> DataFrame:
    """Rows that contain the text in any of their words."""
    found = [F.lower(c).contains(text.strip().lower()) for c in ("column", "current", "recommended", "reason")]
    return recommendations.filter(reduce(lambda a, b: a | b, found))


# ---- conversion --------------------------------------------------------------------------


def _spec(plan: dict[str, str | dict]) -> dict[str, dict]:
    out = {c: {"to": s} if isinstance(s, str) else dict(s) for c, s in plan.items()}
    for c, s in out.items():
        if s["to"] not in TARGETS:
            raise ValueError(f"column {c!r}: target is one of {TARGETS}")
        if s.setdefault("policy", "null") not in ("null", "drop", "fill"):
            raise ValueError(f"column {c!r}: policy is one of null, drop, fill")
    return out


def _truth_sql(text: str) -> str:
    word = f"lower(trim({text}))"
    return f"CASE WHEN {word} IN ({_words(TRUE_WORDS)}) THEN true WHEN {word} IN ({_words(FALSE_WORDS)}) THEN false END"


def _converted(df: DataFrame, name: str, spec: dict) -> str:
    to, c = spec["to"], S.sql_name(name)
    if to == "string":
        return f"CAST({c} AS STRING)"
    if to == "datetime":
        return dates.datetime_sql(df, name, spec.get("format"), spec.get("day_first", False), spec.get("utc", False))
    if to == "float":
        return S.double_sql(df, name)
    if to == "integer":
        return f"try_cast(bround({S.double_sql(df, name)}) AS BIGINT)"
    return _truth_sql(f"CAST({c} AS STRING)")


def _filler(spec: dict) -> str:
    value = "" if spec.get("value") is None else str(spec["value"])
    text, to = S.sql_text(value), spec["to"]
    if to == "datetime":
        made = f"CAST({dates.timestamp_sql(text, spec.get('format'), spec.get('day_first', False))} AS TIMESTAMP_NTZ)"
        return f"CAST({made} AS TIMESTAMP)" if spec.get("utc") else made
    if to == "float":
        return S.number_sql(text)
    if to == "integer":
        return f"try_cast(bround({S.number_sql(text)}) AS BIGINT)"
    return _truth_sql(text) if to == "boolean" else text


def convert_types(df: DataFrame, plan: dict[str, str | dict]) -> DataFrame:
    """Convert columns; a cell that does not fit becomes null, a constant, or drops its row.

    A plan entry is a target or ``{"to", "policy", "value", "format", "day_first", "utc"}``.  Rows
    to drop are collected over all columns and dropped once.
    """
    specs = _spec(plan)
    S.require(df, list(specs))
    df = S.nan_to_null(df)
    made, doubtful = {}, []
    for c, spec in specs.items():
        value = _converted(df, c, spec)
        if spec["policy"] == "fill":
            value = f"CASE WHEN {S.sql_name(c)} IS NULL THEN NULL ELSE coalesce({value}, {_filler(spec)}) END"
        elif spec["policy"] == "drop":
            doubtful.append(f"({S.sql_name(c)} IS NULL OR ({value}) IS NOT NULL)")
        made[c] = value
    kept = df.filter(" AND ".join(doubtful)) if doubtful else df
    return kept.withColumns({c: F.expr(v) for c, v in made.items()})


def conversion_report(df: DataFrame, plan: dict[str, str | dict]) -> DataFrame:
    """(column, target, invalid): cells that the conversion cannot read."""
    specs = _spec(plan)
    df = S.nan_to_null(df)
    aggs = [
        f"count_if({S.sql_name(c)} IS NOT NULL AND ({_converted(df, c, s)}) IS NULL) AS n{i}"
        for i, (c, s) in enumerate(specs.items())
    ]
    rows = [
        {"column": S.sql_text(c), "target": S.sql_text(s["to"]), "invalid": f"n{i}"}
        for i, (c, s) in enumerate(specs.items())
    ]
    return to_rows(df.selectExpr(*aggs), rows)


def conversion_preview(df: DataFrame, col: str, spec: str | dict, order_by: list[str], n: int = 20) -> DataFrame:
    """(original, converted) of the first n rows that the conversion keeps."""
    before = df.withColumn("__original", S.q(col))
    rows = convert_types(before, {col: spec}).orderBy(*[S.q(c).asc_nulls_last() for c in order_by]).limit(n)
    return rows.select(F.col("__original").alias("original"), S.q(col).alias("converted"))
