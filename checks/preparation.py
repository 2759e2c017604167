"""Queries that transform tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyscan.functions import text as X
from tidyscan.operators import encode as E, merge as J, missing as M, text as C, timeseries as D, types as T

from .common import EVENTS_GAPS, ORDERS_GAPS, cte, gaps, load, rounded, union

BLOCK = 2500  # small enough to cut even the smallest test tables into several blocks
TIME_ORDER = ["o_orderdate", "o_orderkey"]
EVENT_ORDER = ["ts", "event_id"]
# gaps in the values, none in the order key
EVENT_SERIES = [
    "event_id", "ts",
    "CASE WHEN user_id % 10 = 3 THEN NULL ELSE user_id END AS user_id",
    "CASE WHEN event_id % 10 < 3 OR event_id < 40 THEN NULL ELSE value END AS value",
    "CASE WHEN event_id % 4 > 0 THEN NULL ELSE event_type END AS event_type",
    "CASE WHEN event_id % 5 > 1 THEN NULL ELSE ts END AS seen",
]
# texts that hide numbers, dates and truth values, with bad cells in between
TEXT_TYPES = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR(20)) END AS whole",
    "CASE WHEN o_orderkey % 23 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR(20)) || '.5' END AS half",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN '2024-02-31' "
    "ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END AS day",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' WHEN o_orderkey % 37 = 0 THEN '?' ELSE ' n ' END AS flag",
    "o_orderstatus", "o_totalprice",
]
KEYS_LEFT = ["o_orderkey", "CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey END AS key", "o_orderstatus AS status"]
# some keys of either side have no partner, and few right keys are missing: missing keys multiply
KEYS_RIGHT = ["c_name", "CASE WHEN c_custkey % 500 = 0 THEN NULL ELSE c_custkey + 100 END AS key", "c_mktsegment AS status"]


HOT_KEY = "CASE WHEN l_orderkey % 3 = 0 THEN 1 WHEN l_orderkey % 97 = 1 THEN NULL ELSE l_suppkey + 50 END"


def events(s, d):
    return gaps(s, d, "events", EVENT_SERIES)


def orders(s, d):
    return gaps(s, d, "orders", ORDERS_GAPS)


def texts(s, d):
    return load(s, d, "orders").selectExpr(*[e.replace("VARCHAR(20)", "STRING") for e in TEXT_TYPES])


def fill(plan, digits=None, order=EVENT_ORDER, block=BLOCK):
    def run(s, d):
        got = M.fill_missing(events(s, d), plan, order, rows_per_block=block)
        return rounded(got, digits, "value") if digits else got

    return run


def sides(s, d):
    return gaps(s, d, "orders", KEYS_LEFT), gaps(s, d, "customer", KEYS_RIGHT)


def joined(how):
    return lambda s, d: J.merge(*sides(s, d), how, ["key"], ["key"])


def hot_joined(how):
    """A third of the right side has the key of one left row, and some keys of either side are missing."""

    def run(s, d):
        left = load(s, d, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_suppkey END AS key")
        right = load(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{HOT_KEY} AS key")
        return J.merge(left, right, how, ["key"], ["key"], small_bytes=0)

    return run


def joined_named(s, d):
    left, right = sides(s, d)
    return J.merge(left, right.withColumnRenamed("key", "cust"), "outer", ["key"], ["cust"], ("_l", "_r"))


def two_keys(s, d):
    return J.merge(
        load(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_name"),
        load(s, d, "nation").withColumnsRenamed({"n_nationkey": "s_nationkey"}),
        "outer", ["s_nationkey", "s_suppkey"], ["s_nationkey", "n_regionkey"],
    )


def cleaned(s, d):
    return C.clean_text(load(s, d, "documents").select("doc_id", "text"), "text").drop("text")


def cleaned_all(s, d):
    made = C.clean_text(
        load(s, d, "pages").select("page_id", "html"), "html", "plain", keep_unicode=True, numbers=True,
        extra_stopwords=["Page", "click"],
    )
    return made.drop("html")


def tokens(s, d):
    return C.token_counts(cleaned(s, d), "text_clean", 100)


def words(make):
    """Token lists as text, which every engine compares alike."""
    return lambda c: F.array_join(make(c), "|")


def column(name, key, text, make):
    return lambda s, d: load(s, d, name).select(key, make(F.col(text)).alias("out"))


def encoded(method, **options):
    def run(s, d):
        df = orders(s, d).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
        cols = ["o_orderstatus", "o_orderpriority"]
        if method == "target":
            return rounded(E.target_encode(df, cols, "o_totalprice"), 4, *cols).drop("o_totalprice")
        made = {"ordinal": E.ordinal_encode, "frequency": E.frequency_encode}[method](df, cols, **options)
        return made.drop("o_totalprice")

    return run


def topk(s, d):
    df = load(s, d, "events").select("event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id"))
    return E.topk_levels(df, "user_id", 10)


NESTED_KIND = "array(event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END)"


def topk_nested(s, d):
    return E.topk_levels(load(s, d, "events").selectExpr("event_id", f"{NESTED_KIND} AS kind"), "kind", 3, "top").drop("kind")


def default_key(s, d):
    left = load(s, d, "customer").selectExpr("c_custkey AS key", "c_name AS name")
    return J.merge(left, load(s, d, "orders").selectExpr("o_orderkey", "o_custkey AS key", "o_orderstatus AS name"))


def typed_series(s, d):
    day = "CASE WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS day"
    made = D.series(load(s, d, "orders").selectExpr("o_orderkey", day, "CAST(o_totalprice AS STRING) AS price"), "day", "price")
    return made.select("o_orderkey", F.col("__t").alias("time"), F.round("__v", 2).alias("value"))


def stemmed(s, d):
    return C.clean_text(load(s, d, "documents").select("doc_id", "text"), "text", stemmer=lambda w: w[:4]).drop("text")


def one_hot(s, d):
    df = load(s, d, "events").select(
        "event_id", "event_type", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind"),
    )
    return E.one_hot(df, ["kind"], 3)


def one_hot_drop(s, d):
    return E.encode(
        load(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"),
        {"o_orderstatus": "one_hot", "o_custkey": "drop", "o_orderpriority": "frequency"}, drop_first=True,
    )


def rolled(group, block):
    def run(s, d):
        got = D.rolling_features(events(s, d), EVENT_ORDER, ["value"], [3, 30], ["mean", "std", "min", "max", "sum"], group, block)
        names = [f"value_roll{w}_{f}" for w in (3, 30) for f in ("mean", "std", "min", "max", "sum")]
        return rounded(got, 6, *names).select("event_id", *names)

    return run


def kpis(s, d):
    return rounded(D.series_kpis(gaps(s, d, "events", EVENTS_GAPS), "ts", "value"), 9, "cov")


def slope(s, d):
    return D.trend_slope(orders(s, d), "o_orderdate", "o_totalprice", ["o_orderkey"], BLOCK).selectExpr(
        "round(slope, 6) AS slope", "round(intercept, 3) AS intercept"
    )


def line(s, d):
    return D.trend_line(orders(s, d), "o_orderdate", "o_totalprice", ["o_orderkey"], BLOCK).selectExpr(
        "o_orderkey", "round(trend, 3) AS trend"
    )


def smoothed(s, d):
    got = D.rolling_mean_auto(orders(s, d), "o_orderdate", "o_totalprice", ["o_orderkey"], BLOCK)
    return got.selectExpr("o_orderkey", "round(rolling_mean, 6) AS rolling_mean")


def parsed(s, d):
    return D.parse_datetime(texts(s, d).select("o_orderkey", "day"), "day")


def spacing(s, d):
    """Frequencies of the distinct months and days that have orders."""
    df = load(s, d, "orders")
    months = df.selectExpr("date_trunc('month', o_orderdate) AS t").distinct()
    days = df.selectExpr("date_format(o_orderdate, 'yyyy-MM-dd') AS t").distinct()
    named = lambda tag, got: got.select(F.lit(tag).alias("series"), "frequency")
    return named("months", D.infer_frequency(months, "t")).unionByName(named("days", D.infer_frequency(days, "t")))


SIMPLE = {"value": "mean", "user_id": "median", "event_type": "mode", "seen": "min"}
CONVERT = {
    "whole": {"to": "integer", "policy": "fill", "value": "-1"},
    "half": {"to": "integer"},
    "day": "datetime",
    "flag": {"to": "boolean", "policy": "drop"},
    "o_totalprice": "integer",
}

QUERIES = {
    "f01_drop_rows_and_column": fill({"value": "drop_rows", "user_id": "drop_rows", "event_type": "drop_column", "seen": "keep"}),
    "f02_to_f05_statistics": fill(SIMPLE, 6),
    "f05_max_timestamp": fill({"seen": "max"}),
    "f06_constant": fill(
        {"value": {"method": "constant", "value": "-1.5"}, "seen": {"method": "constant", "value": "2024-01-01 09:30"},
         "event_type": {"method": "constant", "value": "Unknown"}}
    ),
    "f07_forward_fill": fill({"value": "ffill", "event_type": "ffill", "seen": "ffill"}),
    "f08_backward_fill": fill({"value": "bfill", "event_type": "bfill", "seen": "bfill"}),
    "f09_fill_within_day": fill({"seen": {"method": "ffill", "within": "day", "time": "ts"}}, block=300),
    "f09_fill_back_within_month": fill({"seen": {"method": "bfill", "within": "month", "time": "ts"}}),
    "f09_own_bucket": fill({"seen": {"method": "ffill", "within": "day"}}),
    "f10_interpolate": fill({"value": "interpolate"}, 6),
    "f11_fill_preview": lambda s, d: M.fill_preview(events(s, d), {"value": "mean", "event_type": "mode"}),
    "t01_t02_t03_type_rates": lambda s, d: rounded(
        T.type_rates(texts(s, d)), 9, "boolean_rate", "numeric_rate", "whole_rate", "datetime_rate"
    ),
    "t04_recommend_types": lambda s, d: T.recommend_types(texts(s, d)),
    "t05_t06_convert_types": lambda s, d: T.convert_types(texts(s, d), CONVERT),
    "t07_conversion_report": lambda s, d: T.conversion_report(texts(s, d), CONVERT),
    "t07_conversion_preview": lambda s, d: T.conversion_preview(texts(s, d), "whole", CONVERT["whole"], ["o_orderkey"]),
    "j01_inner": joined("inner"),
    "j02_left": joined("left"),
    "j03_right": joined("right"),
    "j04_outer": joined("outer"),
    "j02_left_hot": hot_joined("left"),
    "j04_outer_hot": hot_joined("outer"),
    "j05_outer_named_keys": joined_named,
    "j05_outer_two_keys": two_keys,
    "x01_strip_html": column("pages", "page_id", "html", X.strip_html),
    "x02_remove_non_ascii": column("documents", "doc_id", "text", X.remove_non_ascii),
    "x03_remove_punct": column("documents", "doc_id", "text", X.remove_punct),
    "x04_remove_numbers": column("documents", "doc_id", "text", X.remove_numbers),
    "x05_normalize_ws": column("documents", "doc_id", "text", lambda c: X.normalize_ws(F.lower(c))),
    "x06_tokenize": column("documents", "doc_id", "text", words(X.tokenize)),
    "x07_remove_stopwords": column("documents", "doc_id", "text", words(lambda c: X.remove_stopwords(X.tokenize(c), ["Page"]))),
    "x09_clean_text": cleaned,
    "x09_clean_text_options": cleaned_all,
    "x10_token_counts": tokens,
    "x11_text_stats": lambda s, d: rounded(C.text_stats(cleaned(s, d), "text_clean"), 9, "mean_length"),
    "d02_series_kpis": kpis,
    "d03_trend_slope": slope,
    "d04_infer_frequency": spacing,
    "d05_rolling_mean": smoothed,
    "d06_trend_line": line,
    "d07_seasonality": lambda s, d: rounded(D.seasonality(orders(s, d), "o_orderdate"), 9, "share"),
    "d08_parse_datetime": parsed,
    "d09_calendar_features": lambda s, d: D.calendar_features(
        orders(s, d).select("o_orderkey", "o_orderdate"), "o_orderdate", D.CALENDAR
    ),
    "d10_rolling_global": rolled(None, BLOCK),
    "d10_rolling_by_group": rolled(["user_id"], None),
    "d10_rolling_by_type": rolled(["event_type"], 400),
    "e01_low_cardinality": lambda s, d: E.low_cardinality(
        texts(s, d).withColumn("name", F.expr("concat('order ', o_orderkey)"))
    ),
    "e02_topk_levels": topk,
    "e02_topk_nested": topk_nested,
    "j06_default_key": default_key,
    "d01_series": typed_series,
    "x08_stemmer": stemmed,
    "e03_one_hot": one_hot,
    "e04_ordinal": encoded("ordinal"),
    "e05_frequency": encoded("frequency"),
    "e06_target_mean": encoded("target"),
    "e07_encode_plan": one_hot_drop,
    "e08_encoding_advice": lambda s, d: E.encoding_advice(
        orders(s, d).withColumn("n", F.expr("o_custkey % 40")), ["o_orderstatus", "o_orderpriority", "n", "o_custkey"]
    ),
    "e09_encoding_plan": lambda s, d: E.encoding_plan(
        orders(s, d).withColumn("n", F.expr("o_custkey % 40")),
        {"o_orderstatus": "one_hot", "n": "one_hot", "o_orderpriority": "frequency", "o_custkey": "drop"}, drop_first=True,
    ),
}

# ---- SQL twins ---------------------------------------------------------------------------

_EV = cte("events", EVENT_SERIES)
_O = cte("orders", ORDERS_GAPS)
_T = cte("orders", TEXT_TYPES)
_KEEP = "event_id, ts"
_UP = "OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_DOWN = "OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)"


def _last(c: str, over: str) -> str:
    return f"last_value({c} IGNORE NULLS) {over} AS {c}"


def _within(unit: str, order: str) -> str:
    return f"OVER (PARTITION BY date_trunc('{unit}', ts) ORDER BY ts {order}, event_id {order} ROWS UNBOUNDED PRECEDING)"


_INTERPOLATE = f"""
, p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i FROM g),
w AS (SELECT *, last_value(value IGNORE NULLS) {_UP} AS v0,
  last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) {_UP} AS i0,
  last_value(value IGNORE NULLS) {_DOWN} AS v1,
  last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) {_DOWN} AS i1 FROM p)
SELECT event_id, ts, user_id, round(coalesce(value, v0 + (v1 - v0) * (i - i0) / nullif(CAST(i1 - i0 AS DOUBLE), 0), v0), 6) AS value,
  event_type, seen FROM w"""

_TRUE, _FALSE = "('true', 't', 'yes', 'y', '1')", "('false', 'f', 'no', 'n', '0')"
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _num(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{_NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def _date(c: str) -> str:
    return f"try_strptime(trim({c}), '%Y-%m-%d')"


_TEXT_COLS = ["whole", "half", "day", "flag", "o_orderstatus"]
_RATES = union(
    [
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, "
        f"round(count(*) FILTER (lower(trim({c})) IN {_TRUE} OR lower(trim({c})) IN {_FALSE}) / CAST(count({c}) AS DOUBLE), 9) AS boolean_rate, "
        f"round(count({_num(c)}) / CAST(count({c}) AS DOUBLE), 9) AS numeric_rate, "
        f"round(count(*) FILTER (abs({_num(c)} - round({_num(c)})) < 1e-9) / CAST(greatest(count({_num(c)}), 1) AS DOUBLE), 9) AS whole_rate, "
        f"round(count({_date(c)}) / CAST(count({c}) AS DOUBLE), 9) AS datetime_rate FROM g"
        for c in _TEXT_COLS
    ]
)
_RECOMMEND = (
    ", r AS (" + _RATES + "), u AS ("
    + union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS u FROM g" for c in _TEXT_COLS])
    + """), c AS (SELECT "column", CASE WHEN boolean_rate >= 0.95 THEN 'boolean' WHEN datetime_rate >= 0.85 THEN 'datetime'
    WHEN numeric_rate >= 0.9 AND whole_rate > 0.98 THEN 'integer' WHEN numeric_rate >= 0.9 THEN 'float' ELSE 'string' END AS best,
    u <= least(50, greatest(3, CAST(floor(0.2 * non_null) AS BIGINT))) AS few FROM r JOIN u USING ("column"))
SELECT "column", 'string' AS current, best AS recommended, CASE best WHEN 'boolean' THEN 'yes_no_words' WHEN 'datetime' THEN 'dates'
  WHEN 'integer' THEN 'whole_numbers' WHEN 'float' THEN 'numbers' ELSE CASE WHEN few THEN 'low_variety' ELSE 'free_text' END END AS reason,
  best <> 'string' AS needs_change FROM c
UNION ALL SELECT 'o_orderkey', 'integer', 'integer', 'already_typed', false
UNION ALL SELECT 'o_totalprice', 'float', 'float', 'already_typed', false"""
)
_FLAG = f"CASE WHEN lower(trim(flag)) IN {_TRUE} THEN true WHEN lower(trim(flag)) IN {_FALSE} THEN false END"
_WHOLE = f"coalesce(CAST(round_even({_num('whole')}, 0) AS BIGINT), -1)"

_LEFT = "SELECT " + ", ".join(KEYS_LEFT) + " FROM orders"
_RIGHT = "SELECT " + ", ".join(KEYS_RIGHT) + " FROM customer"


def _hot_join(how: str) -> str:
    return (
        "WITH l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_suppkey END AS key FROM supplier), "
        f"r AS (SELECT l_orderkey, l_linenumber, {HOT_KEY} AS key FROM lineitem) SELECT s_suppkey, coalesce(l.key, r.key) AS key, "
        f"l_orderkey, l_linenumber FROM l {how} JOIN r ON l.key IS NOT DISTINCT FROM r.key"
    )


def _join(how: str) -> str:
    return (
        f"WITH l AS ({_LEFT}), r AS ({_RIGHT}) SELECT o_orderkey, coalesce(l.key, r.key) AS key, l.status AS status_x, "
        f"c_name, r.status AS status_y FROM l {how} JOIN r ON l.key IS NOT DISTINCT FROM r.key"
    )


_BLANK = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]+"
_PUNCT = r"[^\p{L}\p{N}_\s\p{Z}'']"


def _re(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


def _html(c: str) -> str:
    blocks = r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>"
    return _re(_re(c, blocks, " "), "(?s)<.*?>", " ")


def _ws(c: str) -> str:
    return f"trim({_re(c, _BLANK, ' ')})"


def _stops(extra: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in [*X.STOP_WORDS, *extra]) + ")"


def _no_stops(c: str, extra: list[str] | None = None) -> str:
    return f"[t for t in string_split({c}, ' ') if t NOT IN {_stops(extra or [])}]"


_ASCII = r"[^\x00-\x7F]"
_CLEAN = f"array_to_string({_no_stops(_ws(_re('lower(' + _re(_html('text'), _ASCII, '') + ')', _PUNCT, ' ')))}, ' ')"
_PLAIN = _ws(_re(_re("lower(" + _html("html") + ")", _PUNCT, " "), r"\p{Nd}+", " "))


_RANK = (
    "(SELECT {c} AS k, row_number() OVER (ORDER BY count(*) DESC, {c} NULLS LAST) AS r, count(*) AS n, avg(o_totalprice) AS m "
    "FROM g GROUP BY {c})"
)


def _encoded_sql(value: str) -> str:
    a, b = _RANK.format(c="o_orderstatus"), _RANK.format(c="o_orderpriority")
    return _O + (
        f"SELECT o_orderkey, {value.format(t='a')} AS o_orderstatus, {value.format(t='b')} AS o_orderpriority FROM g "
        f"JOIN {a} a ON a.k IS NOT DISTINCT FROM o_orderstatus JOIN {b} b ON b.k IS NOT DISTINCT FROM o_orderpriority"
    )


def _rolled_sql(partition: str) -> str:
    parts = []
    for w in (3, 30):
        over = f"OVER ({partition} ORDER BY ts, event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("sum", "sum")):
            parts.append(
                f"CASE WHEN count(value) {over} >= {max(2, w // 3)} THEN round({fn}(value) {over}, 6) END AS value_roll{w}_{name}"
            )
    return _EV + f"SELECT event_id, {', '.join(parts)} FROM g"


_POS = ", p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM g WHERE o_orderdate IS NOT NULL) "
_CAL = (
    "year({t}) AS o_orderdate_year, quarter({t}) AS o_orderdate_quarter, month({t}) AS o_orderdate_month, "
    "weekofyear({t}) AS o_orderdate_week, isodow({t}) - 1 AS o_orderdate_dayofweek, day({t}) AS o_orderdate_day, "
    "({t}::DATE = last_day({t}))::INTEGER AS o_orderdate_is_month_end, (day({t}) = 1)::INTEGER AS o_orderdate_is_month_start"
)
_INTS = ["year", "quarter", "month", "week", "dayofweek", "day"]
_TOP_USERS = "SELECT user_id FROM g GROUP BY user_id ORDER BY count(*) DESC, user_id NULLS LAST LIMIT 10"


def _levels(cols: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS levels FROM n"
            for c in cols
        ]
    )


_N = _O.rstrip() + ", n AS (SELECT *, o_custkey % 40 AS n FROM g) "

ORACLES = {
    "f01_drop_rows_and_column": _EV + "SELECT event_id, ts, user_id, value, seen FROM g WHERE value IS NOT NULL AND user_id IS NOT NULL",
    "f02_to_f05_statistics": _EV
    + f"SELECT {_KEEP}, coalesce(CAST(user_id AS DOUBLE), (SELECT median(user_id) FROM g)) AS user_id, "
    "round(coalesce(value, (SELECT avg(value) FROM g)), 6) AS value, coalesce(event_type, (SELECT event_type FROM g WHERE event_type "
    "IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type, "
    "coalesce(seen, (SELECT min(seen) FROM g)) AS seen FROM g",
    "f05_max_timestamp": _EV + "SELECT * REPLACE (coalesce(seen, (SELECT max(seen) FROM g)) AS seen) FROM g",
    "f06_constant": _EV
    + "SELECT * REPLACE (coalesce(value, -1.5) AS value, coalesce(seen, TIMESTAMP '2024-01-01 09:30:00') AS seen, "
    "coalesce(event_type, 'Unknown') AS event_type) FROM g",
    "f07_forward_fill": _EV + f"SELECT {_KEEP}, user_id, {', '.join(_last(c, _UP) for c in ('value', 'event_type', 'seen'))} FROM g",
    "f08_backward_fill": _EV + f"SELECT {_KEEP}, user_id, {', '.join(_last(c, _DOWN) for c in ('value', 'event_type', 'seen'))} FROM g",
    "f09_fill_within_day": _EV + f"SELECT {_KEEP}, user_id, value, event_type, {_last('seen', _within('day', 'ASC'))} FROM g",
    "f09_fill_back_within_month": _EV + f"SELECT {_KEEP}, user_id, value, event_type, {_last('seen', _within('month', 'DESC'))} FROM g",
    "f09_own_bucket": _EV + "SELECT * FROM g",
    "f10_interpolate": _EV.rstrip() + _INTERPOLATE,
    "f11_fill_preview": _EV
    + union(
        [
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 2) "
            f"AS missing_pct, '{t}' AS dtype FROM g"
            for c, t in (("user_id", "bigint"), ("seen", "timestamp_ntz"))
        ]
    ),
    "t01_t02_t03_type_rates": _T + _RATES,
    "t04_recommend_types": _T.rstrip() + _RECOMMEND,
    "t05_t06_convert_types": _T
    + f"SELECT o_orderkey, {_WHOLE} AS whole, CAST(round_even({_num('half')}, 0) AS BIGINT) AS half, {_date('day')} AS day, "
    f"{_FLAG} AS flag, o_orderstatus, CAST(round_even(o_totalprice, 0) AS BIGINT) AS o_totalprice FROM g WHERE {_FLAG} IS NOT NULL",
    "t07_conversion_report": _T
    + union(
        [
            f"SELECT '{c}' AS \"column\", '{t}' AS target, count(*) FILTER ({c} IS NOT NULL AND {e} IS NULL) AS invalid FROM g"
            for c, t, e in (
                ("whole", "integer", _num("whole")), ("half", "integer", _num("half")), ("day", "datetime", _date("day")),
                ("flag", "boolean", _FLAG), ("o_totalprice", "integer", "o_totalprice"),
            )
        ]
    ),
    "t07_conversion_preview": _T + f"SELECT whole AS original, {_WHOLE} AS converted FROM g ORDER BY o_orderkey LIMIT 20",
    "j01_inner": _join("INNER"),
    "j02_left": _join("LEFT"),
    "j03_right": _join("RIGHT"),
    "j04_outer": _join("FULL"),
    "j02_left_hot": _hot_join("LEFT"),
    "j04_outer_hot": _hot_join("FULL"),
    "j05_outer_named_keys": f"WITH l AS ({_LEFT}), r AS ({_RIGHT}) SELECT o_orderkey, l.key, l.status AS status_l, c_name, "
    "r.key AS cust, r.status AS status_r FROM l FULL JOIN r ON l.key IS NOT DISTINCT FROM r.key",
    "j05_outer_two_keys": "SELECT s_suppkey, coalesce(s_nationkey, n_nationkey) AS s_nationkey, s_name, n_name, n_regionkey "
    "FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey AND s_suppkey = n_regionkey",
    "x01_strip_html": f"SELECT page_id, {_html('html')} AS out FROM pages",
    "x02_remove_non_ascii": f"SELECT doc_id, {_re('text', _ASCII, '')} AS out FROM documents",
    "x03_remove_punct": f"SELECT doc_id, {_re('text', _PUNCT, ' ')} AS out FROM documents",
    "x04_remove_numbers": "SELECT doc_id, " + _re("text", r"\p{Nd}+", " ") + " AS out FROM documents",
    "x05_normalize_ws": f"SELECT doc_id, {_ws('lower(text)')} AS out FROM documents",
    "x06_tokenize": f"SELECT doc_id, array_to_string([t for t in string_split({_ws('text')}, ' ') if t <> ''], '|') AS out FROM documents",
    "x07_remove_stopwords": f"SELECT doc_id, array_to_string({_no_stops(_ws('text'), ['page'])}, '|') AS out FROM documents",
    "x09_clean_text": f"SELECT doc_id, {_CLEAN} AS text_clean FROM documents",
    "x09_clean_text_options": f"SELECT page_id, array_to_string({_no_stops(_PLAIN, ['page', 'click'])}, ' ') AS plain FROM pages",
    "x10_token_counts": f"WITH c AS (SELECT {_CLEAN} AS t FROM documents), w AS (SELECT unnest(string_split(t, ' ')) AS token FROM c) "
    "SELECT token, count(*) AS \"count\", (SELECT count(*) FROM w WHERE token <> '') AS total FROM w WHERE token <> '' "
    "GROUP BY token ORDER BY count(*) DESC, token LIMIT 100",
    "x11_text_stats": f"SELECT count(*) AS rows, round(avg(length(t)), 9) AS mean_length, count(*) FILTER (t = '') AS empty "
    f"FROM (SELECT {_CLEAN} AS t FROM documents)",
    "d02_series_kpis": cte("events", EVENTS_GAPS)
    + "SELECT min(ts) AS start, max(ts) AS \"end\", count(*) AS rows, round(stddev_samp(value) / avg(value), 9) AS cov "
    "FROM g WHERE ts IS NOT NULL",
    "d03_trend_slope": _O.rstrip() + _POS + "SELECT round(regr_slope(o_totalprice, i), 6) AS slope, "
    "round(regr_intercept(o_totalprice, i), 3) AS intercept FROM p",
    "d04_infer_frequency": "SELECT 'months' AS series, CASE WHEN count(DISTINCT date_trunc('month', o_orderdate)) = "
    "datediff('month', min(o_orderdate), max(o_orderdate)) + 1 THEN 'MS' END AS frequency FROM orders UNION ALL "
    "SELECT 'days', CASE WHEN count(DISTINCT o_orderdate::DATE) = datediff('day', min(o_orderdate), max(o_orderdate)) + 1 "
    "THEN 'D' END FROM orders",
    "d05_rolling_mean": _O.rstrip() + _POS
    + ", k AS (SELECT greatest(5, least(30, CAST(floor(count(*) * 0.05) AS BIGINT))) AS w FROM p) "
    "SELECT a.o_orderkey, CASE WHEN count(b.o_totalprice) >= any_value(greatest(3, w // 3)) THEN round(avg(b.o_totalprice), 6) END "
    "AS rolling_mean FROM p a, k JOIN p b ON b.i > a.i - w AND b.i <= a.i GROUP BY a.o_orderkey",
    "d06_trend_line": _O.rstrip() + _POS
    + "SELECT o_orderkey, round((SELECT regr_slope(o_totalprice, i) FROM p) * i + (SELECT regr_intercept(o_totalprice, i) FROM p), 3) "
    "AS trend FROM p",
    "d07_seasonality": _O
    + union(
        [
            f"SELECT '{p}' AS part, {e}::INTEGER AS number, count(*) AS \"count\", "
            "round(count(*) / CAST(max(count(*)) OVER () AS DOUBLE), 9) AS share FROM g WHERE o_orderdate IS NOT NULL GROUP BY 2"
            for p, e in (("month", "month(o_orderdate)"), ("weekday", "(isodow(o_orderdate) - 1)"))
        ]
    ),
    "d08_parse_datetime": _T + f"SELECT o_orderkey, day, {_date('day')} AS day_dt FROM g",
    "d09_calendar_features": _O
    + "SELECT * REPLACE (" + ", ".join(f"o_orderdate_{f}::INTEGER AS o_orderdate_{f}" for f in _INTS)
    + f") FROM (SELECT o_orderkey, o_orderdate, {_CAL.format(t='o_orderdate')} FROM g)",
    "d10_rolling_global": _rolled_sql(""),
    "d10_rolling_by_group": _rolled_sql("PARTITION BY user_id"),
    "d10_rolling_by_type": _rolled_sql("PARTITION BY event_type"),
    "e01_low_cardinality": _T.rstrip()
    + ", h AS (SELECT *, 'order ' || o_orderkey AS name FROM g) "
    + union(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"unique\", count(DISTINCT {c}) > 0 AND count(DISTINCT {c}) <= "
            f"least(1000, 0.5 * count(*)) AND count({_date(c)}) / CAST(count({c}) AS DOUBLE) < 0.7 AS low FROM h"
            for c in [*_TEXT_COLS, "name"]
        ]
    ),
    "e02_topk_nested": """WITH g AS (SELECT event_id, '["' || event_type || '","' || (CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END) || '"]' AS kind
  FROM events), t AS (SELECT kind FROM g GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 3)
SELECT event_id, CASE WHEN kind IN (FROM t) THEN kind ELSE '__other__' END AS top FROM g""",
    "j06_default_key": "SELECT c_custkey AS key, c_name AS name_x, o_orderkey, o_orderstatus AS name_y FROM customer JOIN orders ON c_custkey = o_custkey",
    "d01_series": "SELECT o_orderkey, CAST(o_orderdate AS DATE)::TIMESTAMP AS time, round(o_totalprice, 2) AS value FROM orders WHERE o_orderkey % 11 <> 0",
    "x08_stemmer": f"SELECT doc_id, array_to_string(list_transform(string_split({_CLEAN}, ' '), lambda w: w[1:4]), ' ') AS text_clean FROM documents",
    "e02_topk_levels": "WITH g AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id FROM events), "
    f"t AS ({_TOP_USERS}) SELECT event_id, CASE WHEN t.user_id IS NULL AND g.user_id IS NOT NULL THEN '__other__' "
    "ELSE CAST(g.user_id AS VARCHAR) END AS user_id FROM g LEFT JOIN t ON t.user_id IS NOT DISTINCT FROM g.user_id",
    # at sf0.01 the missing level, click and signup are on top; the missing level gets no column
    "e03_one_hot": "WITH g AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind "
    "FROM events) SELECT event_id, event_type, coalesce((kind = 'click')::INTEGER, 0) AS kind_click, "
    "coalesce((kind = 'signup')::INTEGER, 0) AS kind_signup, coalesce((kind NOT IN ('click', 'signup'))::INTEGER, 0) AS kind___other__ FROM g",
    "e04_ordinal": _encoded_sql("{t}.r"),
    "e05_frequency": _encoded_sql("{t}.n"),
    "e06_target_mean": _encoded_sql("round(coalesce({t}.m, (SELECT avg(o_totalprice) FROM g)), 4)"),
    "e07_encode_plan": "SELECT o_orderkey, (o_orderstatus = 'O')::INTEGER AS \"o_orderstatus_O\", "
    "(o_orderstatus = 'P')::INTEGER AS \"o_orderstatus_P\", count(*) OVER (PARTITION BY o_orderpriority) AS o_orderpriority FROM orders",
    "e08_encoding_advice": _N.rstrip() + ", u AS (" + _levels(["o_orderstatus", "o_orderpriority", "n", "o_custkey"])
    + ") SELECT \"column\", levels, CASE WHEN levels <= 2 THEN 'binary_or_one_hot' WHEN levels <= 10 THEN 'one_hot' "
    "WHEN levels <= 50 THEN 'frequency_or_ordinal' ELSE 'target_mean_or_hash' END AS advice FROM u",
    "e09_encoding_plan": _N.rstrip() + ", u AS (" + _levels(["o_orderstatus", "n"])
    + ") SELECT \"column\", 'one_hot' AS method, CAST(least(10, levels) + CASE WHEN levels > 10 THEN 1 ELSE 0 END - 1 AS INTEGER) "
    "AS new_cols FROM u UNION ALL SELECT 'o_orderpriority', 'frequency', 1 UNION ALL SELECT 'o_custkey', 'drop', 0",
}

