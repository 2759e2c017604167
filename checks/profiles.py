"""Profile and missingness queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyscan.operators import missing as M, profile as P

from .common import EVENTS_GAPS, LINE_FLAGS, ORDERS_GAPS, cte, gaps, load, rounded, union

ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINE_COLS = ["l_returnflag", "l_linestatus", "l_quantity", "l_linenumber"]


def orders_gaps(s, d):
    return gaps(s, d, "orders", ORDERS_GAPS)


def line_flags(s, d):
    return gaps(s, d, "lineitem", LINE_FLAGS)


def structs(s, d):
    """Orders with a struct, an array and a map column."""
    return load(s, d, "orders").select(
        F.struct("o_orderstatus", "o_orderpriority").alias("pair"),
        F.array("o_orderpriority", "o_orderstatus").alias("list"),
        F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("o_orderstatus", "o_orderpriority")).alias("m"),
        (F.col("o_custkey") % 5).alias("k"),
    )


def entry_table(s, d):
    """Table overview next to the quick statistics of every column of lineitem."""
    df = load(s, d, "lineitem")
    stats = P.column_quick_stats(df).drop("time_min", "time_max")
    over = P.overview_stats(df).first()
    facts = {c: F.lit(over[c]).cast("bigint") for c in ("rows", "n_duplicates")}
    return rounded(stats.withColumns(facts), 6, "mean", "std")


def missing_sql(cols: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS missing, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM g"
            for c in cols
        ]
    )


def overview_sql(cols: list[str]) -> str:
    nulls = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in cols)
    return (
        f"SELECT CAST(sum(n) AS BIGINT) AS rows, {len(cols)} AS cols, "
        f"round(sum(nulls * n) * 100.0 / (sum(n) * {len(cols)}), 6) AS missing_pct, "
        f"CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n, max({nulls}) AS nulls "
        f"FROM g GROUP BY {', '.join(cols)})"
    )


def quick_numeric(s, d):
    got = P.column_quick_stats(load(s, d, "lineitem"))
    return rounded(got.filter("type = 'numeric'").select("column", "min", "p50", "max", "mean", "std"), 7, "mean", "std")


def quick_levels(s, d):
    got = P.column_quick_stats(orders_gaps(s, d))
    return got.filter("type = 'categorical'").select("column", "unique", "top")


def quick_times(s, d):
    got = P.column_quick_stats(gaps(s, d, "events", EVENTS_GAPS))
    return got.filter("type = 'datetime'").select("column", "time_min", "time_max")


def quick_logical(s, d):
    got = P.column_quick_stats(load(s, d, "labels"))
    return got.filter("type = 'boolean'").select("column", "true_count", "false_count")


def infer_orders(s, d):
    return P.infer_schema(orders_gaps(s, d)).drop("example")


def infer_documents(s, d):
    dated = load(s, d, "documents").withColumn("day", F.expr(
        "CASE WHEN doc_id % 11 = 0 THEN 'bad' ELSE CAST(DATE '2020-01-01' + CAST(doc_id % 700 AS INT) AS STRING) END"
    ))
    return P.infer_schema(dated).drop("example")


def actions(s, d):
    df = load(s, d, "events").select(
        "event_type", "value", "props", F.lit("x").alias("same"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("half"),
        F.when(F.col("value") > 20, "hi").otherwise("lo").alias("two"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )
    df = df.withColumn("day", F.when(F.col("value") < 0.5, "n/a").otherwise(F.col("day")))
    return rounded(P.suggest_actions(df), 6, "value")


def meta(s, d):
    return P.dataset_meta(load(s, d, "orders").withColumn("later", F.expr("o_orderdate + INTERVAL 400 DAYS")))


def comparison(s, d):
    tables = {n: load(s, d, n) for n in ("nation", "region", "customer", "labels")}
    return rounded(P.datasets_overview(tables), 6, "missing_pct")


QUERIES = {
    "s01_overview_stats": lambda s, d: rounded(P.overview_stats(orders_gaps(s, d)), 6, "missing_pct"),
    "s01_overview_duplicates": lambda s, d: rounded(P.overview_stats(line_flags(s, d)), 6, "missing_pct"),
    "s02_duplicate_count": lambda s, d: P.duplicate_count(line_flags(s, d)),
    "s02_duplicate_count_nested": lambda s, d: P.duplicate_count(structs(s, d)),
    "s03_missing_counts": lambda s, d: P.missing_counts(orders_gaps(s, d)),
    "s04_nunique": lambda s, d: P.nunique(orders_gaps(s, d)),
    "s04_nunique_nested": lambda s, d: P.nunique(structs(s, d)),
    "s05_infer_schema": infer_orders,
    "s05_infer_schema_text": infer_documents,
    "s06_quick_stats_numeric": quick_numeric,
    "s06_quick_stats_levels": quick_levels,
    "s06_quick_stats_times": quick_times,
    "s06_quick_stats_boolean": quick_logical,
    "s07_dataset_meta": meta,
    "s08_suggest_actions": actions,
    "s11_datasets_overview": comparison,
    "s12_cardinality": lambda s, d: P.cardinality(orders_gaps(s, d), ORDERS_COLS, "unique"),
    "s12_cardinality_missing": lambda s, d: P.cardinality(orders_gaps(s, d), ORDERS_COLS, "missing"),
    "s13_preview_head": lambda s, d: P.preview(load(s, d, "orders"), 25, "head", ["o_orderdate", "o_orderkey"]),
    "s13_preview_tail": lambda s, d: P.preview(load(s, d, "orders"), 25, "tail", ["o_orderdate", "o_orderkey"]),
    "s14_sample_rows": lambda s, d: P.sample_rows(load(s, d, "orders"), 500, ["o_orderkey"], 7),
    "m01_missing_by_column": lambda s, d: M.missing_by_column(orders_gaps(s, d), 5),
    "m01_missing_percent": lambda s, d: M.missing_by_column(orders_gaps(s, d), 5, "percent"),
    "m01_missing_totals": lambda s, d: M.missing_totals(orders_gaps(s, d)),
    "m02_missing_table": lambda s, d: M.missing_table(orders_gaps(s, d)),
}

_G = cte("orders", ORDERS_GAPS)
_L = cte("lineitem", LINE_FLAGS)
_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NESTED = (
    "WITH g AS (SELECT {'a': o_orderstatus, 'b': o_orderpriority} AS pair, [o_orderpriority, o_orderstatus] AS list, "
    "[o_orderstatus, o_orderpriority] AS m, o_custkey % 5 AS k FROM orders) "
)


def _unique_sql(cols):
    return union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"unique\" FROM g" for c in cols])


def _infer_sql(kinds: dict[str, str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", '{k}' AS type, count({c}) AS non_null, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS \"unique\" FROM g"
            for c, k in kinds.items()
        ]
    )


_TEXT_KIND = (
    "CASE WHEN (SELECT median(length({c})) > 40 AND count(DISTINCT {c}) > 30 FROM g) THEN 'text' ELSE 'categorical' END"
)


def _infer_documents_sql() -> str:
    head = (
        "WITH g AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'bad' ELSE "
        "strftime(DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER), '%Y-%m-%d') END AS day FROM documents) "
    )
    kinds = {
        "doc_id": "'numeric'", "text": _TEXT_KIND.format(c="text"), "lang": _TEXT_KIND.format(c="lang"),
        "source": _TEXT_KIND.format(c="source"), "n_chars": "'numeric'",
        "day": "CASE WHEN (SELECT avg(CASE WHEN try_strptime(day, '%Y-%m-%d') IS NULL THEN 0 ELSE 1 END) > 0.8 FROM g) "
        "THEN 'datetime' ELSE 'categorical' END",
    }
    return head + union(
        [
            f"SELECT '{c}' AS \"column\", {k} AS type, count({c}) AS non_null, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS \"unique\" FROM g"
            for c, k in kinds.items()
        ]
    )


_ACTIONS = """
WITH g AS (
  SELECT event_type, value, props, 'x' AS same, CASE WHEN event_id % 2 = 0 THEN user_id END AS half,
    CASE WHEN value > 20 THEN 'hi' ELSE 'lo' END AS two,
    CASE WHEN value < 0.5 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS day
  FROM events),
n AS (SELECT count(*) AS n FROM g),
u AS (
  SELECT 'event_type' AS "column", 'text' AS family, count(DISTINCT event_type) AS u, count(event_type) AS c,
    0.0 AS dates, median(length(event_type)) AS len FROM g
  UNION ALL SELECT 'value', 'number', count(DISTINCT value), count(value), 0, 0 FROM g
  UNION ALL SELECT 'props', 'text', count(DISTINCT props), count(props), 0, median(length(props)) FROM g
  UNION ALL SELECT 'same', 'text', count(DISTINCT same), count(same), 0, median(length(same)) FROM g
  UNION ALL SELECT 'half', 'number', count(DISTINCT half), count(half), 0, 0 FROM g
  UNION ALL SELECT 'two', 'text', count(DISTINCT two), count(two), 0, median(length(two)) FROM g
  UNION ALL SELECT 'day', 'text', count(DISTINCT day), count(day),
    avg(CASE WHEN try_strptime(day, '%Y-%m-%d') IS NULL THEN 0.0 ELSE 1.0 END), median(length(day)) FROM g),
t AS (
  SELECT *, CASE WHEN family = 'number' THEN 'numeric' WHEN dates > 0.8 THEN 'datetime'
    WHEN len > 40 AND u > 30 THEN 'text' ELSE 'categorical' END AS type FROM u),
q AS (
  SELECT 'value' AS "column", quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM g
  UNION ALL SELECT 'half', quantile_cont(half, 0.25), quantile_cont(half, 0.75) FROM g),
v AS (SELECT 'value' AS "column", value AS x FROM g UNION ALL SELECT 'half', half FROM g),
o AS (
  SELECT "column", count(x) AS n,
    avg(CASE WHEN x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) THEN 1.0 ELSE 0.0 END) FILTER (x IS NOT NULL) AS share
  FROM v JOIN q USING ("column") WHERE a <> b GROUP BY "column"),
dup AS (SELECT sum(n - 1) AS d FROM (SELECT count(*) AS n FROM g GROUP BY event_type, value, props, same, half, two, day))
SELECT rule, "column", round(value, 6) AS value FROM (
  SELECT 'mostly_missing' AS rule, "column", 100.0 * (n - c) / n AS value FROM t, n WHERE 100.0 * (n - c) / n >= 40
  UNION ALL SELECT 'high_cardinality', "column", u FROM t, n
    WHERE type IN ('categorical', 'text') AND u > greatest(1000, 0.5 * n)
  UNION ALL SELECT 'constant', "column", 1 FROM t WHERE u = 1
  UNION ALL SELECT 'near_binary', "column", u FROM t WHERE type = 'categorical' AND u <= 2
  UNION ALL SELECT 'date_as_text', "column", dates FROM t WHERE type = 'categorical' AND dates > 0.9
  UNION ALL SELECT 'duplicate_rows', NULL, d FROM dup WHERE d > 0
  UNION ALL SELECT 'outliers', "column", share FROM o WHERE n >= 30 AND share >= 0.03)
"""

ORACLES = {
    "s01_overview_stats": _G + overview_sql(ORDERS_COLS),
    "s01_overview_duplicates": _L + overview_sql(LINE_COLS),
    "s02_duplicate_count": _L + f"SELECT n_duplicates FROM ({overview_sql(LINE_COLS)})",
    "s02_duplicate_count_nested": _NESTED + f"SELECT n_duplicates FROM ({overview_sql(['pair', 'list', 'm', 'k'])})",
    "s03_missing_counts": _G + missing_sql(ORDERS_COLS),
    "s04_nunique": _G + _unique_sql(ORDERS_COLS),
    "s04_nunique_nested": _NESTED + _unique_sql(["pair", "list", "m", "k"]),
    "s05_infer_schema": _G
    + _infer_sql(
        {
            "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical",
            "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "categorical",
        }
    ),
    "s05_infer_schema_text": _infer_documents_sql(),
    "s06_quick_stats_numeric": union(
        [
            f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS \"min\", CAST(median({c}) AS DOUBLE) AS p50, "
            f"CAST(max({c}) AS DOUBLE) AS \"max\", round(avg({c}), 7) AS mean, round(stddev_pop({c}), 7) AS std FROM lineitem"
            for c in _NUM
        ]
    ),
    "s06_quick_stats_levels": _G
    + union(
        [
            f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM g) AS \"unique\", "
            f"(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top"
            for c in ("o_orderstatus", "o_orderpriority")
        ]
    ),
    "s06_quick_stats_times": cte("events", EVENTS_GAPS)
    + "SELECT 'ts' AS \"column\", min(ts) AS time_min, max(ts) AS time_max FROM g",
    "s06_quick_stats_boolean": union(
        [
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} = 1) AS true_count, "
            f"count(*) FILTER ({c} = 0) AS false_count FROM labels"
            for c in ("quality", "toxic")
        ]
    ),
    "s07_dataset_meta": "SELECT 3 AS n_numeric, 2 AS n_categorical, min(o_orderdate) AS time_min, "
    "max(o_orderdate) + INTERVAL 400 DAYS AS time_max, 'generic' AS profile FROM orders",
    "s08_suggest_actions": _ACTIONS,
    "s11_datasets_overview": union(
        [
            f"SELECT '{t}' AS dataset, * FROM (WITH g AS (SELECT * FROM {t}) {overview_sql(c)})"
            for t, c in {
                "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                "labels": ["doc_id", "quality", "toxic"],
                "nation": ["n_nationkey", "n_name", "n_regionkey"],
                "region": ["r_regionkey", "r_name"],
            }.items()
        ]
    ),
    "s12_cardinality": _G
    + union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS value FROM g" for c in ORDERS_COLS]),
    "s12_cardinality_missing": _G
    + union([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS value FROM g" for c in ORDERS_COLS]),
    "s13_preview_head": "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "s13_preview_tail": "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25",
    "m01_missing_by_column": _G
    + f"SELECT \"column\", CAST(missing AS DOUBLE) AS value FROM ({missing_sql(ORDERS_COLS)}) "
    "ORDER BY missing DESC, \"column\" LIMIT 5",
    "m01_missing_percent": _G
    + f"SELECT \"column\", missing_pct AS value FROM ({missing_sql(ORDERS_COLS)}) ORDER BY missing DESC, \"column\" LIMIT 5",
    "m01_missing_totals": _G
    + f"SELECT CAST(sum(missing) AS BIGINT) AS nulls, count(*) FILTER (missing > 0) AS affected FROM ({missing_sql(ORDERS_COLS)})",
    "m02_missing_table": _G
    + "SELECT \"column\", missing, missing_pct, CASE \"column\" WHEN 'o_orderstatus' THEN 'string' "
    f"WHEN 'o_totalprice' THEN 'double' ELSE 'timestamp_ntz' END AS dtype FROM ({missing_sql(ORDERS_COLS)}) WHERE missing > 0",
}
