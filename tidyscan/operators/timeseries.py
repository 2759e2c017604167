"""Diagnostics, calendar features and rolling features of time-ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dates, schema as S
from ..plans import ordered

# The choices of the feature builders.
CALENDAR = ["year", "quarter", "month", "week", "dayofweek", "day", "is_month_end", "is_month_start"]
CALENDAR_DEFAULT = ["year", "quarter", "month", "dayofweek"]
WINDOWS = [3, 7, 14, 30, 60, 90]
FUNCTIONS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
DAY_NAMES = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
MONTH_NAMES = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def series(df: DataFrame, time: str, value: str) -> DataFrame:
    """Rows that have a time, with time and value in typed form next to the other columns."""
    made = df.withColumns({"__t": dates.to_datetime(df, time).cast("timestamp_ntz"), "__v": S.as_double(df, value)})
    return made.filter(F.col("__t").isNotNull())


def series_kpis(df: DataFrame, time: str, value: str) -> DataFrame:
    """(start, end, rows, cov): span and coefficient of variation."""
    return series(df, time, value).selectExpr(
        "min(__t) AS start", "max(__t) AS end", "count(1) AS rows",
        "stddev_samp(__v) / nullif(avg(__v), 0D) AS cov",
    )


def _positions(df: DataFrame, time: str, value: str, tie_break: list[str], rows_per_block: int | None) -> DataFrame:
    """Typed rows with their zero-based position in time."""
    b = ordered.blocks(series(df, time, value), ["__t", *tie_break], rows_per_block=rows_per_block)
    return ordered.finish(ordered.position(b, "__i")).withColumn("__i", F.col("__i") - 1)


def trend_slope(
    df: DataFrame, time: str, value: str, tie_break: list[str], rows_per_block: int | None = None
) -> DataFrame:
    """(slope, intercept) of the value on the row position; missing values keep their position."""
    rows = _positions(df, time, value, tie_break, rows_per_block)
    return rows.selectExpr(
        "CASE WHEN count(__v) > 1 THEN regr_slope(__v, __i) END AS slope",
        "CASE WHEN count(__v) > 1 THEN regr_intercept(__v, __i) END AS intercept",
    )


def trend_line(
    df: DataFrame, time: str, value: str, tie_break: list[str], rows_per_block: int | None = None
) -> DataFrame:
    """The input rows that have a time, with column ``trend``."""
    fit = trend_slope(df, time, value, tie_break, rows_per_block).first()
    rows = _positions(df, time, value, tie_break, rows_per_block)
    trend = F.lit(fit["slope"]).cast("double") * F.col("__i") + F.lit(fit["intercept"]).cast("double")
    return rows.withColumn("trend", trend).drop("__t", "__v", "__i")


def rolling_mean_auto(
    df: DataFrame, time: str, value: str, tie_break: list[str], rows_per_block: int | None = None
) -> DataFrame:
    """The rows with column ``rolling_mean`` over a window of about five percent of the series."""
    rows = series(df, time, value)
    width = max(5, min(30, int(rows.count() * 0.05)))
    least = max(3, width // 3)
    b = ordered.blocks(rows, ["__t", *tie_break], rows_per_block=rows_per_block)

    def make(frame):
        w = frame(width)
        return [F.when(F.count("__v").over(w) >= least, F.avg("__v").over(w)).alias("rolling_mean")]

    return ordered.rolling(b, width, make).drop("__t", "__v")


def seasonality(df: DataFrame, time: str) -> DataFrame:
    """(part, number, count, share of the largest): rows per month and per weekday (Monday = 0)."""
    t = dates.datetime_sql(df, time)
    parts = df.filter(f"{t} IS NOT NULL").selectExpr(
        f"inline(array(struct('month' AS part, month({t}) AS number), struct('weekday' AS part, weekday({t}) AS number)))"
    )
    counts = parts.groupBy("part", "number").agg(F.expr("count(1) AS count"))  # at most 19 rows
    top = counts.groupBy("part").agg(F.max("count").alias("top"))
    return counts.join(top, "part").select("part", "number", "count", (F.col("count") / F.col("top")).alias("share"))


# ---- frequency ---------------------------------------------------------------------------

_UNITS = [("h", 3_600_000_000), ("min", 60_000_000), ("s", 1_000_000), ("ms", 1_000), ("us", 1)]
_DAY = 86_400_000_000


def _times(n: int, unit: str) -> str:
    return unit if n == 1 else f"{n}{unit}"


def infer_frequency(df: DataFrame, time: str) -> DataFrame:
    """(frequency): label of a regular spacing of at least three distinct times, else null.

    Regularity needs no ordering: distinct values that all sit on a lattice with as many slots as
    values fill it completely.  Two aggregations decide.
    """
    t = dates.datetime_sql(df, time)
    rows = df.selectExpr(f"CAST({t} AS TIMESTAMP_NTZ) AS t").filter("t IS NOT NULL")
    rows = rows.selectExpr(
        "t", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', t) AS u",
        "year(t) AS y", "month(t) AS m", "year(t) * 12 + month(t) AS ym", "weekday(t) AS wd",
        "day(t) = 1 AS first", "CAST(t AS DATE) = last_day(t) AS last",
    )
    r = rows.selectExpr(
        "count(1) AS n", "min(u) AS lo", "max(u) AS hi", "min(ym) AS ym0", "max(ym) AS ym1", "min(y) AS y0",
        "max(y) AS y1", "min(m) AS m0", "max(m) AS m1", "min(wd) AS wd0", "max(wd) AS wd1",
        "bool_and(first) AS first", "bool_and(last) AS last", "min(mod(u, 86400000000)) AS tod0",
        "max(mod(u, 86400000000)) AS tod1",
    ).first()
    return df.sparkSession.createDataFrame([(_frequency(rows, r),)], "frequency string")


def _frequency(rows: DataFrame, r) -> str | None:
    n = r["n"]
    if n < 3 or r["lo"] == r["hi"] or rows.select("u").distinct().count() < n:
        return None
    same_time = r["tod0"] == r["tod1"]

    def lattice(column: str, lo: int, hi: int) -> int | None:
        """Step at which the n values of a column are evenly spaced."""
        step, rest = divmod(hi - lo, n - 1)
        if rest or step == 0:
            return None
        return None if rows.filter(f"({column} - {lo}) % {step} <> 0").take(1) else step

    edge = "S" if r["first"] else "E" if r["last"] else None
    if same_time and edge:
        months = lattice("ym", r["ym0"], r["ym1"])
        if months:
            if r["m0"] == r["m1"]:
                return f"{_times(months // 12, 'Y' + edge)}-{MONTH_NAMES[r['m0'] - 1]}"
            if months % 3 == 0:
                anchor = {0: 12, 2: 11, 1: 10}[((r["ym0"] - 1) % 12 + 1) % 3]
                return f"{_times(months // 3, 'Q' + edge)}-{MONTH_NAMES[anchor - 1]}"
            return _times(months, "M" + edge)
    step = lattice("u", r["lo"], r["hi"])
    if step and step % _DAY == 0:
        days = step // _DAY
        if days % 7 == 0:
            return f"{_times(days // 7, 'W')}-{DAY_NAMES[r['wd0']]}"
        return _times(days, "D")
    if step:
        return next(_times(step // size, unit) for unit, size in _UNITS if step % size == 0)
    if same_time and r["wd1"] <= 4 and _weekdays(r["lo"] // _DAY, r["hi"] // _DAY) == n:
        return "B"
    return None


def _weekdays(first_day: int, last_day: int) -> int:
    """Mondays to Fridays between two days since the epoch, a Thursday, both included."""
    upto = lambda d: 5 * ((d + 3) // 7) + min((d + 3) % 7 + 1, 5)
    return upto(last_day) - upto(first_day - 1)


# ---- features ----------------------------------------------------------------------------


def parse_datetime(
    df: DataFrame, col: str, out: str | None = None, day_first: bool = False, utc: bool = False,
    fmt: str | None = None, replace: bool = False,
) -> DataFrame:
    """Text to time in place or as ``<col>_dt``."""
    return df.withColumn(col if replace else out or f"{col}_dt", dates.to_datetime(df, col, fmt, day_first, utc))


def _calendar(t: str, feature: str) -> Column:
    text = {
        "year": f"year({t})", "quarter": f"quarter({t})", "month": f"month({t})", "week": f"weekofyear({t})",
        "dayofweek": f"weekday({t})", "day": f"day({t})",
        "is_month_end": f"CAST(CAST({t} AS DATE) = last_day({t}) AS INT)", "is_month_start": f"CAST(day({t}) = 1 AS INT)",
    }
    return F.expr(text[feature])


def calendar_features(df: DataFrame, col: str, pick: list[str] | None = None) -> DataFrame:
    """Adds ``<col>_<feature>``; weeks are ISO weeks and Monday is day 0."""
    pick = list(pick or CALENDAR_DEFAULT)
    unknown = [p for p in pick if p not in CALENDAR]
    if unknown:
        raise ValueError(f"unknown features {unknown}: choose from {CALENDAR}")
    t = dates.datetime_sql(df, col)
    return df.withColumns({f"{col}_{p}": _calendar(t, p) for p in pick})


def rolling_features(
    df: DataFrame,
    order_by: list[str],
    cols: list[str],
    windows: list[int] | None = None,
    funcs: list[str] | None = None,
    group_by: list[str] | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Adds ``<col>_roll<w>_<f>`` over the last w rows in order, per group if one is given.

    A window needs max(2, w // 3) non-missing values.  ``order_by`` ends with a unique column.
    """
    windows, funcs = list(windows or WINDOWS[:3]), list(funcs or ["mean", "std"])
    if any(w < 1 for w in windows) or any(f not in FUNCTIONS for f in funcs):
        raise ValueError(f"windows are positive and functions are among {list(FUNCTIONS)}")
    S.require(df, [*order_by, *cols, *(group_by or [])])
    work = df.withColumns({f"__x{i}": S.as_double(df, c) for i, c in enumerate(cols)})
    b = ordered.blocks(work, order_by, group_by, rows_per_block)

    def make(frame):
        out = []
        for w in windows:
            rows = frame(w)
            for i, c in enumerate(cols):
                enough = F.count(f"__x{i}").over(rows) >= max(2, w // 3)
                out += [F.when(enough, FUNCTIONS[f](f"__x{i}").over(rows)).alias(f"{c}_roll{w}_{f}") for f in funcs]
        return out

    return ordered.rolling(b, max(windows), make).drop(*[f"__x{i}" for i in range(len(cols))])
