"""Outlier bounds by four rules, tables of what they catch, and treatments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import schema as S
from ..functions.quantiles import quantiles
from ..functions.wide import to_rows

_INF = float("inf")
Bounds = dict[str, tuple[float, float]]

# Fixed value: makes the median absolute deviation comparable to a standard deviation.
MAD_SCALE = 1.4826


def _default_columns(df: DataFrame, cols: list[str] | None) -> list[str]:
    cols = list(cols or S.numeric_columns(df))
    S.require(df, cols)
    return cols


def compute_bounds(
    df: DataFrame,
    cols: list[str] | None = None,
    method: str = "iqr",
    k: float | None = None,
    p_low: float = 1.0,
    p_high: float = 99.0,
) -> Bounds:
    """Lower and upper bound of each column; an empty or flat column is unbounded."""
    cols = _default_columns(df, cols)
    x = {c: S.double_sql(df, c) for c in cols}
    free = (-_INF, _INF)
    if method == "iqr":
        k = 1.5 if k is None else k
        found, _ = quantiles(df, x, [0.25, 0.75])
        return {
            c: free if a is None else (a - k * (b - a), b + k * (b - a)) for c, (a, b) in found.items()
        }
    if method == "zscore":
        k = 3.0 if k is None else k
        aggs = [f"avg({x[c]}) AS m{i}" for i, c in enumerate(cols)]
        aggs += [f"stddev_pop({x[c]}) AS s{i}" for i, c in enumerate(cols)]
        row = df.selectExpr(*aggs).first()
        out = {}
        for i, c in enumerate(cols):
            mean, sd = row[f"m{i}"], row[f"s{i}"]
            out[c] = (mean - k * sd, mean + k * sd) if sd else free
        return out
    if method == "mad":
        k = 3.5 if k is None else k
        centre = {c: v[0] for c, v in quantiles(df, x, [0.5])[0].items()}
        known = {c: f"abs({x[c]} - {S.sql_double(m)})" for c, m in centre.items() if m is not None}
        spread = quantiles(df, known, [0.5])[0] if known else {}
        out = {}
        for c in cols:
            mad = spread.get(c, [None])[0]
            out[c] = (centre[c] - k * MAD_SCALE * mad, centre[c] + k * MAD_SCALE * mad) if mad else free
        return out
    if method == "percentile":
        lo, hi = min(max(p_low, 0.0), 100.0), min(max(p_high, 0.0), 100.0)
        if hi <= lo:
            return {c: free for c in cols}
        found, _ = quantiles(df, x, [lo / 100, hi / 100])
        return {c: free if a is None else (a, b) for c, (a, b) in found.items()}
    raise ValueError("method is one of iqr, zscore, mad, percentile")


def _outside(x: str, bounds: tuple[float, float]) -> str:
    return f"({x} < {S.sql_double(bounds[0])} OR {x} > {S.sql_double(bounds[1])})"


def outlier_bounds(df: DataFrame, cols: list[str] | None = None, method: str = "iqr", **options) -> DataFrame:
    """(column, lower, upper)."""
    found = compute_bounds(df, cols, method, **options)
    rows = [(c, a, b) for c, (a, b) in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, lower double, upper double")


def outlier_table(df: DataFrame, cols: list[str] | None = None, method: str = "iqr", **options) -> DataFrame:
    """(column, lower, upper, outliers): one pass counts all columns against their bounds."""
    found = compute_bounds(df, cols, method, **options)
    counts = [f"count_if({_outside(S.double_sql(df, c), b)}) AS n{i}" for i, (c, b) in enumerate(found.items())]
    rows = [
        {"column": S.sql_text(c), "lower": S.sql_double(a), "upper": S.sql_double(b), "outliers": f"n{i}"}
        for i, (c, (a, b)) in enumerate(found.items())
    ]
    return to_rows(df.selectExpr(*counts), rows)


def treat_outliers(
    df: DataFrame,
    cols: list[str] | None = None,
    method: str = "iqr",
    action: str = "clip",
    keep_nulls: bool = False,
    bounds: Bounds | None = None,
    **options,
) -> DataFrame:
    """Clip to the bounds, blank out, or drop rows; treated columns become double.

    ``drop`` also removes rows with a missing value in a chosen column unless ``keep_nulls``.
    """
    found = bounds or compute_bounds(df, cols, method, **options)
    x = {c: S.double_sql(df, c) for c in found}
    lo = {c: S.sql_double(a) for c, (a, _) in found.items()}
    hi = {c: S.sql_double(b) for c, (_, b) in found.items()}
    if action == "drop":
        inside = [f"({x[c]} >= {lo[c]} AND {x[c]} <= {hi[c]})" for c in found]
        if keep_nulls:
            inside = [f"({t} OR {x[c]} IS NULL)" for c, t in zip(found, inside)]
        return df.filter(" AND ".join(inside)) if inside else df
    if action == "clip":
        # greatest and least skip missing values, which must stay missing
        made = {c: f"CASE WHEN {x[c]} IS NOT NULL THEN greatest(least({x[c]}, {hi[c]}), {lo[c]}) END" for c in found}
    elif action == "null":
        made = {c: f"CASE WHEN NOT {_outside(x[c], found[c])} THEN {x[c]} END" for c in found}
    else:
        raise ValueError("action is one of clip, null, drop")
    return df.withColumns({c: F.expr(e) for c, e in made.items()})


def box_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, q1, median, q3, whisker_low, whisker_high, outliers) of a box plot."""
    cols = _default_columns(df, cols)
    x = {c: S.double_sql(df, c) for c in cols}
    found, _ = quantiles(df, x, [0.25, 0.5, 0.75])
    aggs, rows = [], []
    for i, c in enumerate(cols):
        a, m, b = found[c]
        out = _outside(x[c], (a - 1.5 * (b - a), b + 1.5 * (b - a)) if a is not None else (-_INF, _INF))
        inside = f"CASE WHEN NOT {out} THEN {x[c]} END"
        aggs += [f"min({inside}) AS l{i}", f"max({inside}) AS h{i}", f"count_if({out}) AS n{i}"]
        rows.append(
            {
                "column": S.sql_text(c), "q1": S.sql_double(a), "median": S.sql_double(m), "q3": S.sql_double(b),
                "whisker_low": f"l{i}", "whisker_high": f"h{i}", "outliers": f"n{i}",
            }
        )
    return to_rows(df.selectExpr(*aggs), rows)


def iqr_outlier_shares(df: DataFrame, cols: list[str]) -> dict[str, tuple[int, float]]:
    """Non-missing values and the share outside the IQR fences; 0 when the quartiles coincide."""
    if not cols:
        return {}
    x = {c: S.double_sql(df, c) for c in cols}
    found, info = quantiles(df, x, [0.25, 0.75])
    aggs = ["count(1) AS rows"]
    for i, c in enumerate(cols):
        a, b = found[c]
        if a is None or a == b:
            aggs.append(f"0L AS n{i}")
        else:
            aggs.append(f"count_if({_outside(x[c], (a - 1.5 * (b - a), b + 1.5 * (b - a)))}) AS n{i}")
    row = df.selectExpr(*aggs).first()
    return {c: (info["n"][c], row[f"n{i}"] / info["n"][c] if info["n"][c] else 0.0) for i, c in enumerate(cols)}
