"""Outlier and univariate queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyscan.operators import outliers as O, univariate as U

from .common import EVENTS_GAPS, ORDERS_GAPS, cte, gaps, load, rounded, union

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def events(s, d):
    return gaps(s, d, "events", EVENTS_GAPS)


def orders(s, d):
    return gaps(s, d, "orders", ORDERS_GAPS)


def table(method, **options):
    def run(s, d):
        got = O.outlier_table(events(s, d), ["value", "user_id"], method, **options)
        return rounded(got, 6, "lower", "upper")

    return run


def treated(action, **options):
    def run(s, d):
        df = events(s, d).select("event_id", "user_id", "value")
        return rounded(O.treat_outliers(df, ["value", "user_id"], "iqr", action, **options), 6, "value", "user_id")

    return run


def hist(col, name, rule, log=False):
    def run(s, d):
        return rounded(U.histogram(load(s, d, name), col, rule, log), 9, "bin")

    return run


def far_hist(s, d):
    """One value far off: hundreds of millions of bins, nearly all of them empty."""
    df = load(s, d, "events").selectExpr("CASE WHEN event_id = 7 THEN 1e9 ELSE value END AS value")
    return rounded(U.sparse_histogram(df, "value", "fd"), 6, "low", "high")


QUERIES = {
    "o01_iqr_bounds": lambda s, d: rounded(O.outlier_bounds(load(s, d, "lineitem"), NUMBERS), 6, "lower", "upper"),
    "o01_iqr_table": table("iqr"),
    "o02_zscore_table": table("zscore"),
    "o03_mad_table": table("mad"),
    "o04_percentile_table": table("percentile", p_low=2.5, p_high=95.0),
    "o05_outlier_table_documents": lambda s, d: rounded(
        O.outlier_table(load(s, d, "documents"), ["n_chars", "doc_id"], "iqr"), 6, "lower", "upper"
    ),
    "o06_clip": treated("clip"),
    "o07_null": treated("null"),
    "o08_drop": lambda s, d: O.treat_outliers(events(s, d), ["value", "user_id"], "iqr", "drop"),
    "o08_drop_keep_nulls": lambda s, d: O.treat_outliers(events(s, d), ["value"], "iqr", "drop", keep_nulls=True),
    "o09_box_stats": lambda s, d: rounded(O.box_stats(events(s, d), ["value", "user_id"]), 6, "q1", "median", "q3"),
    "u01_value_counts": lambda s, d: U.value_counts(events(s, d), "event_type"),
    "u01_value_counts_top": lambda s, d: U.value_counts(load(s, d, "lineitem"), "l_partkey", 100),
    "u01_top_values": lambda s, d: U.top_values(load(s, d, "orders"), "o_custkey"),
    "u02_describe": lambda s, d: rounded(U.describe(load(s, d, "lineitem"), NUMBERS), 7, "mean", "std", "p25", "p50", "p75"),
    "u02_describe_nulls": lambda s, d: rounded(U.describe(events(s, d), ["value"]), 7, "mean", "std", "p25", "p50", "p75"),
    "u03_clip_tails": lambda s, d: rounded(
        U.clip_tails(events(s, d).select("event_id", "value"), "value", 1.0), 6, "value"
    ),
    "u04_histogram_sqrt": hist("l_extendedprice", "lineitem", "sqrt"),
    "u04_histogram_sturges": hist("value", "events", "sturges"),
    "u04_histogram_rice_log": hist("value", "events", "rice", True),
    "u04_histogram_fd": hist("value", "events", "fd"),
    "u04_histogram_doane": hist("value", "events", "doane"),
    "u04_histogram_auto": hist("l_quantity", "lineitem", "auto"),
    "u04_histogram_whole": hist("l_linenumber", "lineitem", "auto"),
    "u04_histogram_sparse": far_hist,
    "u06_iqr_outlier_share": lambda s, d: rounded(
        U.iqr_outlier_share(load(s, d, "documents").join(load(s, d, "labels"), "doc_id"), ["n_chars", "toxic"]), 9, "share"
    ),
    "u07_insights_numeric": lambda s, d: rounded(U.insights(events(s, d), ["value", "user_id"]), 6, "value"),
    "u08_insights_levels": lambda s, d: rounded(
        U.insights(events(s, d).join(load(s, d, "events").select("event_id", "props"), "event_id"), ["event_type", "props"]), 6, "value"
    ),
    "u09_insights_times": lambda s, d: rounded(U.insights(load(s, d, "orders"), ["o_orderdate"]), 6, "value"),
    **{
        f"u10_time_counts_{f.lower()}": (lambda f: lambda s, d: U.time_counts(orders(s, d), "o_orderdate", f))(f)
        for f in ("Day", "Week", "Month", "Quarter", "Year", "Auto")
    },
}

_E = cte("events", EVENTS_GAPS)
_COLS = ["value", "user_id"]
_BOUNDS = {
    "iqr": "SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, "
    "quantile_cont({c}, 0.75) AS q3 FROM g)",
    "zscore": "SELECT avg({c}) - 3 * stddev_pop({c}) AS lo, avg({c}) + 3 * stddev_pop({c}) AS hi FROM g",
    "mad": "SELECT m - 3.5 * 1.4826 * s AS lo, m + 3.5 * 1.4826 * s AS hi FROM (SELECT any_value(m) AS m, "
    "median(abs({c} - m)) AS s FROM g, (SELECT median({c}) AS m FROM g))",
    "percentile": "SELECT quantile_cont({c}, 0.025) AS lo, quantile_cont({c}, 0.95) AS hi FROM g",
}


def _bounds(method: str, c: str) -> str:
    return "(" + _BOUNDS[method].format(c=c) + ")"


def _table_sql(method: str, cols=_COLS) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", round(any_value(lo), 6) AS \"lower\", round(any_value(hi), 6) AS \"upper\", "
            f"count(*) FILTER ({c} < lo OR {c} > hi) AS outliers FROM g, {_bounds(method, c)}"
            for c in cols
        ]
    )


_PAIR = f"(SELECT lo AS vlo, hi AS vhi FROM {_bounds('iqr', 'value')}), (SELECT lo AS ulo, hi AS uhi FROM {_bounds('iqr', 'user_id')})"


def _hist_sql(name: str, col: str, width: str, log: bool = False, whole: bool = False) -> str:
    x = f"log10(CASE WHEN {col} > 0 THEN {col} END)" if log else f"CAST({col} AS DOUBLE)"
    width = f"greatest({width}, 1.0)" if whole else width
    return f"""
WITH v AS (SELECT {x} AS x FROM {name}), s AS (
  SELECT count(x) AS n, min(x) AS lo, max(x) AS hi, max(x) - min(x) AS span,
    quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, avg(x) AS mu, stddev_pop(x) AS sd FROM v),
m AS (SELECT avg(power((x - mu) / sd, 3)) AS g1 FROM v, s),
b AS (SELECT lo, hi, CAST(ceil(span / ({width})) AS BIGINT) AS k FROM s, m),
e AS (SELECT lo, hi, k, (hi - lo) / k AS step FROM b),
g AS (SELECT x, lo, hi, k, step, least(CAST(floor((x - lo) / (hi - lo) * k) AS BIGINT), k - 1) AS i FROM v, e WHERE x IS NOT NULL),
c AS (SELECT CASE WHEN x < i * step + lo THEN i - 1
  WHEN i < k - 1 AND x >= (i + 1) * step + lo THEN i + 1 ELSE i END AS bin_no, count(*) AS n FROM g GROUP BY 1)
SELECT r.i AS bin_no, round(((r.i * step + lo) + CASE WHEN r.i + 1 = k THEN hi ELSE (r.i + 1) * step + lo END) / 2, 9) AS bin,
  coalesce(c.n, 0) AS "count"
FROM e, range((SELECT k FROM e)) AS r(i) LEFT JOIN c ON c.bin_no = r.i"""


_SQRT, _STURGES, _RICE = "span / sqrt(n)", "span / (log2(n) + 1)", "span / (2 * power(n, 1.0 / 3))"
_FD = "2 * iqr / power(n, 1.0 / 3)"
_DOANE = "span / (1 + log2(n) + log2(1 + abs(g1) / sqrt(6.0 * (n - 2) / ((n + 1.0) * (n + 3.0)))))"
_AUTO = f"least(greatest({_FD}, {_SQRT} / 2), {_STURGES})"

_COUNTS = "SELECT {c} AS value, count(*) AS \"count\", round(count(*) * 100.0 / (SELECT count(*) FROM g), 2) AS percent FROM g GROUP BY {c}"
_ONE = "WITH g AS (SELECT * FROM {t}) "


def _describe_sql(cols) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std, "
            f"CAST(min({c}) AS DOUBLE) AS \"min\", round(quantile_cont({c}, 0.25), 7) AS p25, round(quantile_cont({c}, 0.5), 7) AS p50, "
            f"round(quantile_cont({c}, 0.75), 7) AS p75, CAST(max({c}) AS DOUBLE) AS \"max\" FROM g"
            for c in cols
        ]
    )


def _numeric_insights(c: str) -> str:
    share = (
        f"(SELECT 100.0 * count(*) FILTER ({c} < lo OR {c} > hi) / count({c}) FROM g, {_bounds('iqr', c)})"
    )
    return f"""
SELECT '{c}' AS "column", 'missing_pct' AS rule, round(100.0 * (count(*) - count({c})) / count(*), 6) AS value,
  CAST(NULL AS VARCHAR) AS label FROM g HAVING count(*) > count({c})
UNION ALL SELECT '{c}', 'right_skewed', round(skewness({c}), 6), NULL FROM g HAVING skewness({c}) > 1
UNION ALL SELECT '{c}', 'left_skewed', round(skewness({c}), 6), NULL FROM g HAVING skewness({c}) < -1
UNION ALL SELECT '{c}', 'outlier_pct', round({share}, 6), NULL WHERE {share} >= 5
UNION ALL SELECT '{c}', 'high_variation', round(abs(stddev_samp({c}) / avg({c})), 6), NULL FROM g
  HAVING abs(stddev_samp({c}) / avg({c})) >= 1
UNION ALL SELECT '{c}', 'zero_pct', round(100.0 * count(*) FILTER ({c} = 0) / count({c}), 6), NULL FROM g
  HAVING 100.0 * count(*) FILTER ({c} = 0) / count({c}) >= 20"""


def _level_insights(c: str) -> str:
    return f"""
SELECT '{c}' AS "column", 'missing_pct' AS rule, round(100.0 * (count(*) - count({c})) / count(*), 6) AS value,
  CAST(NULL AS VARCHAR) AS label FROM g HAVING count(*) > count({c})
UNION ALL SELECT * FROM (SELECT '{c}', 'top_level_pct', round(100.0 * count(*) / (SELECT count(*) FROM g), 6),
  coalesce({c}, '__NA__') AS label FROM g GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
UNION ALL SELECT '{c}', 'many_levels', count(DISTINCT coalesce({c}, '__NA__')), NULL FROM g
  HAVING count(DISTINCT coalesce({c}, '__NA__')) > 30"""


_LABELS = {
    "Day": "strftime(bucket, '%Y-%m-%d')",
    "Week": "strftime(bucket, '%Y-%m-%d') || '/' || strftime(bucket + INTERVAL 6 DAYS, '%Y-%m-%d')",
    "Month": "strftime(bucket, '%Y-%m')",
    "Quarter": "strftime(bucket, '%Y') || 'Q' || quarter(bucket)",
    "Year": "strftime(bucket, '%Y')",
}


def _time_sql(freq: str) -> str:
    return cte("orders", ORDERS_GAPS) + (
        f"SELECT bucket, {_LABELS[freq]} AS period, n AS \"count\" FROM (SELECT CAST(date_trunc('{freq}', o_orderdate) AS TIMESTAMP) "
        "AS bucket, count(*) AS n FROM g WHERE o_orderdate IS NOT NULL GROUP BY 1)"
    )


ORACLES = {
    "o01_iqr_bounds": _ONE.format(t="lineitem")
    + union(
        [
            f"SELECT '{c}' AS \"column\", round(lo, 6) AS \"lower\", round(hi, 6) AS \"upper\" FROM {_bounds('iqr', c)}"
            for c in NUMBERS
        ]
    ),
    "o01_iqr_table": _E + _table_sql("iqr"),
    "o02_zscore_table": _E + _table_sql("zscore"),
    "o03_mad_table": _E + _table_sql("mad"),
    "o04_percentile_table": _E + _table_sql("percentile"),
    "o05_outlier_table_documents": _ONE.format(t="documents") + _table_sql("iqr", ["n_chars", "doc_id"]),
    "o06_clip": _E
    + "SELECT event_id, round(CASE WHEN user_id IS NOT NULL THEN greatest(least(CAST(user_id AS DOUBLE), uhi), ulo) END, 6) AS user_id, "
    f"round(CASE WHEN value IS NOT NULL THEN greatest(least(value, vhi), vlo) END, 6) AS value FROM g, {_PAIR}",
    "o07_null": _E
    + "SELECT event_id, CASE WHEN user_id BETWEEN ulo AND uhi THEN round(CAST(user_id AS DOUBLE), 6) END AS user_id, "
    f"CASE WHEN value BETWEEN vlo AND vhi THEN round(value, 6) END AS value FROM g, {_PAIR}",
    "o08_drop": _E + f"SELECT g.* FROM g, {_PAIR} WHERE value BETWEEN vlo AND vhi AND user_id BETWEEN ulo AND uhi",
    "o08_drop_keep_nulls": _E
    + f"SELECT g.* FROM g, {_bounds('iqr', 'value')} WHERE value BETWEEN lo AND hi OR value IS NULL",
    "o09_box_stats": _E
    + union(
        [
            f"SELECT '{c}' AS \"column\", (SELECT round(quantile_cont({c}, 0.25), 6) FROM g) AS q1, "
            f"(SELECT round(quantile_cont({c}, 0.5), 6) FROM g) AS median, (SELECT round(quantile_cont({c}, 0.75), 6) FROM g) AS q3, "
            f"CAST(min({c}) FILTER ({c} BETWEEN lo AND hi) AS DOUBLE) AS whisker_low, "
            f"CAST(max({c}) FILTER ({c} BETWEEN lo AND hi) AS DOUBLE) AS whisker_high, "
            f"count(*) FILTER ({c} < lo OR {c} > hi) AS outliers FROM g, {_bounds('iqr', c)}"
            for c in _COLS
        ]
    ),
    "u01_value_counts": _E + _COUNTS.format(c="event_type"),
    "u01_value_counts_top": _ONE.format(t="lineitem") + _COUNTS.format(c="l_partkey") + ' ORDER BY "count" DESC, value LIMIT 100',
    "u01_top_values": _ONE.format(t="orders") + _COUNTS.format(c="o_custkey") + ' ORDER BY "count" DESC, value LIMIT 100',
    "u02_describe": _ONE.format(t="lineitem") + _describe_sql(NUMBERS),
    "u02_describe_nulls": _E + _describe_sql(["value"]),
    "u03_clip_tails": _E
    + "SELECT event_id, round(CASE WHEN value IS NOT NULL THEN greatest(least(value, hi), lo) END, 6) AS value FROM g, "
    "(SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM g)",
    "u04_histogram_sqrt": _hist_sql("lineitem", "l_extendedprice", _SQRT),
    "u04_histogram_sturges": _hist_sql("events", "value", _STURGES),
    "u04_histogram_rice_log": _hist_sql("events", "value", _RICE, log=True),
    "u04_histogram_fd": _hist_sql("events", "value", _FD),
    "u04_histogram_doane": _hist_sql("events", "value", _DOANE),
    "u04_histogram_auto": _hist_sql("lineitem", "l_quantity", _AUTO),
    "u04_histogram_whole": _hist_sql("lineitem", "l_linenumber", _AUTO, whole=True),
    "u04_histogram_sparse": """WITH e AS (SELECT CASE WHEN event_id = 7 THEN 1e9 ELSE value END::DOUBLE AS x FROM events),
  f AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM e),
  c AS (SELECT lo, hi, greatest(1, ceil((hi - lo) / (2 * iqr / cbrt(n))))::BIGINT AS bins FROM f),
  b AS (SELECT least(floor((x - lo) / (hi - lo) * bins), bins - 1)::BIGINT AS bin_no, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi,
          any_value(bins) AS total FROM e, c GROUP BY 1),
  g AS (SELECT *, lead(bin_no) OVER (ORDER BY bin_no) AS next FROM b),
  r AS (SELECT bin_no, 1::BIGINT AS bins, n AS count, lo, hi, total FROM g
        UNION ALL SELECT bin_no + 1, next - bin_no - 1, 0, lo, hi, total FROM g WHERE next > bin_no + 1)
SELECT bin_no, bins, round(lo + bin_no * ((hi - lo) / total), 6) AS low,
  round(CASE WHEN bin_no + bins = total THEN hi ELSE lo + (bin_no + bins) * ((hi - lo) / total) END, 6) AS high, count FROM r""",
    "u06_iqr_outlier_share": "WITH g AS (SELECT * FROM documents JOIN labels USING (doc_id)) "
    + union(
        [
            f"SELECT '{c}' AS \"column\", (SELECT CASE WHEN lo = hi THEN 0.0 ELSE round(count(*) FILTER ({c} < lo OR {c} > hi) "
            f"/ CAST(count({c}) AS DOUBLE), 9) END FROM g, {_bounds('iqr', c)} GROUP BY lo, hi) AS share"
            for c in ("n_chars", "toxic")
        ]
    ),
    "u07_insights_numeric": _E + union([_numeric_insights(c) for c in _COLS]),
    "u08_insights_levels": "WITH g AS (SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS event_type, props FROM events) "
    + union([_level_insights(c) for c in ("event_type", "props")]),
    "u09_insights_times": """
SELECT 'o_orderdate' AS "column", 'span_days' AS rule, CAST(datediff('day', min(o_orderdate), max(o_orderdate)) AS DOUBLE) AS value,
  CAST(NULL AS VARCHAR) AS label FROM orders
UNION ALL SELECT * FROM (SELECT 'o_orderdate', 'busiest_day_pct', round(100.0 * count(*) / (SELECT count(*) FROM orders), 6),
  dayname(o_orderdate) AS label FROM orders GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)""",
    **{f"u10_time_counts_{f.lower()}": _time_sql(f) for f in ("Day", "Week", "Month", "Quarter", "Year")},
    "u10_time_counts_auto": _time_sql("Quarter"),
}
