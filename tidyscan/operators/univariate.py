"""Distributions of single columns: counts, summaries, histograms, time buckets, findings."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dates, frequency, schema as S
from ..functions.quantiles import quantiles
from ..functions.stats import skewness_sql
from ..functions.wide import percent
from ..plans import ordered
from ..plans.settle import settle
from .outliers import iqr_outlier_shares

# Table sizes and the limits of the findings.
TOP_NUMERIC = 100
TOP_CATEGORICAL = 50
SKEW_LIMIT = 1.0
OUTLIER_PCT = 5.0
VARIATION_LIMIT = 1.0
ZERO_PCT = 20.0
MANY_LEVELS = 30
MISSING_LEVEL = "__NA__"

#: Most bins of a dense histogram.
DENSE_BINS = 100_000


def univariate_kind(dt: T.DataType) -> str:
    if S.is_numeric(dt):
        return "numeric"
    return "datetime" if S.is_datetime(dt) else "categorical"


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """(value, count, percent of all rows), most frequent first; a missing value is a level."""
    S.require(df, [col])
    dt = S.dtype_of(df, col)
    value = S.stable_json(S.q(col), dt) if S.is_nested(dt) else S.q(col)
    total = max(1, df.count())
    counts = S.nan_to_null(df).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    ranked = counts.orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
    ranked = ranked.limit(top) if top else ranked
    return ranked.withColumn("percent", percent(F.col("count"), F.lit(total)))


def top_values(df: DataFrame, col: str) -> DataFrame:
    """Value counts at the table size of the column's kind."""
    kind = univariate_kind(S.dtype_of(df, col))
    if kind == "numeric":
        return value_counts(df.filter(S.as_double(df, col).isNotNull()), col, TOP_NUMERIC)
    return value_counts(df, col, TOP_CATEGORICAL)


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) with the sample deviation."""
    cols = list(cols or S.numeric_columns(df))
    S.require(df, cols)
    x = {c: S.double_sql(df, c) for c in cols}
    aggs = [
        f"{fn}({x[c]}) AS {name}{i}"
        for i, c in enumerate(cols)
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    ]
    found, info = quantiles(df, x, [0.25, 0.5, 0.75], aggs)
    rows = [
        (c, info["n"][c], info[f"mean{i}"], info[f"std{i}"], info[f"min{i}"], *found[c], info[f"max{i}"])
        for i, c in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double",
    )


def clip_tails(df: DataFrame, col: str, pct: float) -> DataFrame:
    """Winsorize ``pct`` percent on each side."""
    x = S.as_double(df, col)
    lo, hi = quantiles(df, {col: S.double_sql(df, col)}, [pct / 100, 1 - pct / 100])[0][col]
    if lo is None:
        return df
    return df.withColumn(col, F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo))))


# ---- histogram ---------------------------------------------------------------------------


def bin_width(rule: str, n: int, span: float, iqr: float, skew: float) -> float:
    """Width by the named rule, from public statistics formulas."""
    if rule == "sqrt":
        return span / math.sqrt(n)
    if rule == "sturges":
        return span / (math.log2(n) + 1)
    if rule == "rice":
        return span / (2 * n ** (1 / 3))
    if rule == "fd":
        return 2 * iqr / n ** (1 / 3)
    if rule == "doane":
        if n <= 2 or span == 0:
            return 0.0
        sigma = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
        return span / (1 + math.log2(n) + math.log2(1 + abs(skew) / sigma))
    if rule == "auto":
        wide = max(bin_width("fd", n, span, iqr, skew), bin_width("sqrt", n, span, iqr, skew) / 2)
        return min(wide, bin_width("sturges", n, span, iqr, skew))
    raise ValueError("bins is one of auto, sqrt, sturges, rice, fd, doane")


def bin_count(rule: str, n: int, lo: float, hi: float, iqr: float, skew: float, whole: bool) -> int:
    span = hi - lo
    if span == 0:
        return 1
    width = bin_width(rule, n, span, iqr, skew)
    if whole and width < 1:
        width = 1.0
    return max(1, math.ceil(span / width)) if width else 1


@dataclass(frozen=True)
class _Bins:
    """Even bins between two values, and the rows (b, n) of the occupied ones."""

    lo: float
    hi: float
    count: int
    occupied: DataFrame

    def edge(self, i: Column) -> Column:
        step = (self.hi - self.lo) / self.count
        return F.when(i == self.count, F.lit(self.hi)).otherwise(i * F.lit(step) + F.lit(self.lo))


def _binned(df: DataFrame, col: str, bins: str, log: bool) -> _Bins | None:
    """The occupied bins by one of the rules; none without values."""
    v = S.double_sql(df, col)
    if log:
        v = f"CASE WHEN {v} > 0 THEN log10({v}) END"
    x = F.expr(v)
    aggs = [
        f"min({v}) AS lo", f"max({v}) AS hi", f"CASE WHEN var_pop({v}) > 0 THEN skewness({v}) ELSE 0D END AS skew"
    ]
    if bins in ("auto", "fd"):
        found, info = quantiles(df, {"x": v}, [0.25, 0.75], aggs)
        n, iqr = info["n"]["x"], (found["x"][1] or 0.0) - (found["x"][0] or 0.0)
    else:
        info = df.selectExpr(f"count({v}) AS n", *aggs).first().asDict()
        n, iqr = info["n"], 0.0
    if not n:
        return None
    lo, hi = info["lo"], info["hi"]
    whole = S.is_integer(S.dtype_of(df, col)) and not log
    count = bin_count(bins, n, lo, hi, iqr, info["skew"], whole)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    made = _Bins(lo, hi, count, df)
    guess = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * count), F.lit(count - 1).cast("bigint"))
    # the division may land next to an edge: the edges themselves decide
    bin_no = (
        F.when(x < made.edge(F.col("g")), F.col("g") - 1)
        .when((F.col("g") < count - 1) & (x >= made.edge(F.col("g") + 1)), F.col("g") + 1)
        .otherwise(F.col("g"))
    )
    counts = df.filter(x.isNotNull()).select("*", guess.alias("g")).select(bin_no.alias("b")).groupBy("b")
    return _Bins(lo, hi, count, counts.agg(F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, col: str, bins: str = "auto", log: bool = False) -> DataFrame:
    """(bin_no, bin, count): midpoint and rows of every bin, empty ones too; the last bin is closed on the right.

    More than ``DENSE_BINS`` bins, as a far outlier makes them, are left to ``sparse_histogram``."""
    made = _binned(df, col, bins, log)
    if made is None:
        return df.sparkSession.createDataFrame([], "bin_no bigint, bin double, count bigint")
    if made.count > DENSE_BINS:
        raise ValueError(f"{made.count} bins, most of them empty: use sparse_histogram")
    frame = df.sparkSession.range(made.count).withColumnRenamed("id", "bin_no")
    mid = (made.edge(F.col("bin_no")) + made.edge(F.col("bin_no") + 1)) / 2.0
    return frame.join(made.occupied, F.col("bin_no") == F.col("b"), "left").select(
        "bin_no", mid.alias("bin"), F.coalesce("n", F.lit(0)).cast("bigint").alias("count")
    )


def sparse_histogram(df: DataFrame, col: str, bins: str = "auto", log: bool = False) -> DataFrame:
    """(bin_no, bins, low, high, count): a row for each occupied bin, and one with count 0 for each run of empty ones.

    Its rows grow with the occupied bins, not with the span of the values."""
    made = _binned(df, col, bins, log)
    if made is None:
        return df.sparkSession.createDataFrame([], "bin_no bigint, bins bigint, low double, high double, count bigint")
    # the first and last bin are occupied, so every run of empty ones lies between two that follow each other
    placed = ordered.position(ordered.blocks(settle(made.occupied.select(F.col("b").cast("bigint").alias("b"), "n")), ["b"]), "place")
    placed = settle(ordered.finish(placed))
    following = placed.select((F.col("place") - 1).alias("place"), F.col("b").alias("next"))
    gaps = placed.join(following, "place").filter("next > b + 1")
    gaps = gaps.select((F.col("b") + 1).alias("bin_no"), (F.col("next") - F.col("b") - 1).alias("bins"), F.lit(0).cast("bigint").alias("count"))
    rows = placed.select(F.col("b").alias("bin_no"), F.lit(1).cast("bigint").alias("bins"), F.col("n").alias("count")).unionByName(gaps)
    return rows.select(
        "bin_no", "bins", made.edge(F.col("bin_no")).alias("low"), made.edge(F.col("bin_no") + F.col("bins")).alias("high"), "count"
    )


# ---- findings ----------------------------------------------------------------------------


def iqr_outlier_share(df: DataFrame, cols: list[str]) -> DataFrame:
    rows = [(c, share) for c, (_, share) in iqr_outlier_shares(df, cols).items()]
    return df.sparkSession.createDataFrame(rows, "column string, share double")


def insights(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, rule, value, label): findings about the distribution of each column."""
    cols = list(cols or df.columns)
    S.require(df, cols)
    df = S.nan_to_null(df)
    kinds = {c: univariate_kind(S.dtype_of(df, c)) for c in cols}
    numeric = [c for c in cols if kinds[c] == "numeric"]
    times = [c for c in cols if kinds[c] == "datetime"]
    levels = [c for c in cols if kinds[c] == "categorical"]
    at = {c: i for i, c in enumerate(cols)}
    aggs = ["count(1) AS rows"] + [f"count({S.sql_name(c)}) AS n{at[c]}" for c in cols]
    for c in numeric:
        x, i = S.double_sql(df, c), at[c]
        aggs += [
            f"{skewness_sql(x)} AS skew{i}", f"avg({x}) AS mean{i}", f"stddev_samp({x}) AS std{i}",
            f"count_if({x} = 0) AS zero{i}",
        ]
    for c in times:
        t = f"CAST({S.sql_name(c)} AS TIMESTAMP_NTZ)"
        aggs.append(f"timestampdiff(DAY, min({t}), max({t})) AS span{at[c]}")
    facts = df.selectExpr(*aggs).first().asDict()
    shares = iqr_outlier_shares(df, numeric)
    rows: list[tuple] = []
    for c in cols:
        i, n = at[c], facts[f"n{at[c]}"]
        if facts["rows"] and n < facts["rows"]:
            rows.append((c, "missing_pct", 100.0 * (facts["rows"] - n) / facts["rows"], None))
        if c in numeric and n:
            skew, mean, std = facts[f"skew{i}"], facts[f"mean{i}"], facts[f"std{i}"]
            if skew is not None and skew > SKEW_LIMIT:
                rows.append((c, "right_skewed", skew, None))
            elif skew is not None and skew < -SKEW_LIMIT:
                rows.append((c, "left_skewed", skew, None))
            if shares[c][1] * 100 >= OUTLIER_PCT:
                rows.append((c, "outlier_pct", shares[c][1] * 100, None))
            if mean and std and abs(std / mean) >= VARIATION_LIMIT:
                rows.append((c, "high_variation", abs(std / mean), None))
            if 100.0 * facts[f"zero{i}"] / n >= ZERO_PCT:
                rows.append((c, "zero_pct", 100.0 * facts[f"zero{i}"] / n, None))
        if c in times and n:
            rows.append((c, "span_days", float(facts[f"span{i}"]), None))
    rows += _level_findings(df, levels, facts["rows"]) if levels and facts["rows"] else []
    rows += _weekday_findings(df, times) if times else []
    return df.sparkSession.createDataFrame(rows, "column string, rule string, value double, label string")


def _level_findings(df: DataFrame, cols: list[str], rows: int) -> list[tuple]:
    text = df.select(
        *[
            F.coalesce(
                S.stable_json(S.q(c), S.dtype_of(df, c)) if S.is_nested(S.dtype_of(df, c)) else S.q(c).cast("string"),
                F.lit(MISSING_LEVEL),
            ).alias(c)
            for c in cols
        ]
    )
    found = frequency.level_counts(text, cols, "string").groupBy("column_no").agg(
        F.expr("min(struct(-n AS k, value AS v)) AS best"), F.expr("count(1) AS levels")
    )
    out = []
    for r in found.orderBy("column_no").collect():
        c = cols[r["column_no"]]
        out.append((c, "top_level_pct", 100.0 * -r["best"]["k"] / rows, r["best"]["v"]))
        if r["levels"] > MANY_LEVELS:
            out.append((c, "many_levels", float(r["levels"]), None))
    return out


def _weekday_findings(df: DataFrame, cols: list[str]) -> list[tuple]:
    pairs = F.array(*[F.struct(F.lit(i).alias("column_no"), S.q(c).cast("timestamp_ntz").alias("t")) for i, c in enumerate(cols)])
    days = df.select(F.inline(pairs)).filter(F.col("t").isNotNull())
    counts = days.groupBy("column_no", F.date_format("t", "EEEE").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column_no").agg(
        F.min(F.struct((-F.col("n")).alias("k"), F.col("day").alias("d"))).alias("b"), F.sum("n").alias("total")
    )
    return [
        (cols[r["column_no"]], "busiest_day_pct", 100.0 * -r["b"]["k"] / r["total"], r["b"]["d"])
        for r in best.orderBy("column_no").collect()
    ]


# ---- time buckets ------------------------------------------------------------------------

# Longest span in days per automatic bucket.
AUTO_BUCKETS = [(31, "Day"), (180, "Week"), (730, "Month")]


def auto_bucket(span_days: int) -> str:
    return next((name for limit, name in AUTO_BUCKETS if max(1, span_days) <= limit), "Quarter")


def _bucket_label(start: Column, freq: str) -> Column:
    day = lambda t: F.date_format(t, "yyyy-MM-dd")
    return {
        "Day": day(start),
        "Week": F.concat(day(start), F.lit("/"), day(start + F.expr("INTERVAL 6 DAYS"))),
        "Month": F.date_format(start, "yyyy-MM"),
        "Quarter": F.concat(F.date_format(start, "yyyy"), F.lit("Q"), F.quarter(start).cast("string")),
        "Year": F.date_format(start, "yyyy"),
    }[freq]


def time_counts(df: DataFrame, col: str, freq: str = "Month") -> DataFrame:
    """(bucket, period, count): rows per occupied calendar bucket, in order; weeks start on Monday."""
    t = dates.to_datetime(df, col).cast("timestamp_ntz")
    if freq == "Auto":
        span = df.agg(F.timestamp_diff("DAY", F.min(t), F.max(t))).first()[0]
        freq = auto_bucket(span or 1)
    start = F.date_trunc(freq.lower(), t).cast("timestamp_ntz")
    counts = df.filter(t.isNotNull()).groupBy(start.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bucket", _bucket_label(F.col("bucket"), freq).alias("period"), "count").orderBy("bucket")
