"""Association queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyscan.operators import association as A
from tidyscan.operators.kendall import kendall

from .common import EVENTS_GAPS, ORDERS_GAPS, cte, gaps, load, rounded, union

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
FLAGS = ["l_returnflag", "l_linestatus"]
# l_quantity and l_returnflag get gaps, so that pairs differ in their complete rows
LINE_GAPS = [
    "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_linenumber",
    "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "l_linestatus",
]
EVENT_PAIRS = [*EVENTS_GAPS, "CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END AS two"]


def line(s, d):
    return gaps(s, d, "lineitem", LINE_GAPS)


def events(s, d):
    return gaps(s, d, "events", EVENT_PAIRS)


def orders(s, d):
    return gaps(s, d, "orders", ORDERS_GAPS)


def nine(df, col="value"):
    return rounded(df, 9, col)


QUERIES = {
    "a01_pearson": lambda s, d: nine(A.pearson(line(s, d), "l_quantity", "l_extendedprice")),
    "a02_spearman": lambda s, d: nine(A.spearman(line(s, d), "l_quantity", "l_extendedprice")),
    "a02_spearman_ties": lambda s, d: nine(A.spearman(events(s, d), "user_id", "value")),
    "a03_kendall": lambda s, d: nine(kendall(events(s, d), "user_id", "value")),
    "a03_kendall_ties": lambda s, d: nine(kendall(load(s, d, "lineitem"), "l_quantity", "l_discount")),
    "a04_point_biserial": lambda s, d: nine(A.point_biserial(events(s, d), "two", "value")),
    "a05_point_biserial_codes": lambda s, d: nine(A.point_biserial(events(s, d), "two", "value", form="pearson")),
    "a06_correlation_ratio": lambda s, d: nine(A.correlation_ratio(orders(s, d), "o_orderstatus", "o_totalprice")),
    "a06_correlation_ratio_many": lambda s, d: nine(
        A.correlation_ratio(events(s, d), "event_type", "value", form="matrix")
    ),
    "a07_cramers_v": lambda s, d: nine(A.cramers_v(line(s, d), "l_returnflag", "l_linestatus")),
    "a08_normalized_mi": lambda s, d: nine(A.normalized_mi(line(s, d), "l_quantity", "l_extendedprice")),
    "a08_normalized_mi_mixed": lambda s, d: nine(A.normalized_mi(line(s, d), "l_returnflag", "l_extendedprice")),
    "a09_associate": lambda s, d: nine(
        A.associate(line(s, d), "l_quantity", "l_tax")
        .unionByName(A.associate(events(s, d), "value", "two"))
        .unionByName(A.associate(events(s, d), "event_type", "value"))
        .unionByName(A.associate(line(s, d), "l_returnflag", "l_linestatus"))
    ),
    "a10_corr_matrix_pearson": lambda s, d: nine(A.corr_matrix(line(s, d), LINE)),
    "a10_corr_matrix_spearman": lambda s, d: nine(A.corr_matrix(load(s, d, "lineitem"), LINE, "spearman")),
    "a10_corr_matrix_spearman_nulls": lambda s, d: nine(
        A.corr_matrix(orders(s, d), ["o_orderkey", "o_custkey", "o_totalprice"], "spearman")
    ),
    "a10_corr_matrix_kendall": lambda s, d: nine(
        A.corr_matrix(load(s, d, "customer"), ["c_custkey", "c_nationkey", "c_acctbal"], "kendall")
    ),
    "a11_cramers_matrix": lambda s, d: nine(
        A.cramers_matrix(
            load(s, d, "lineitem").join(load(s, d, "orders"), F.expr("l_orderkey = o_orderkey")),
            ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority"],
        )
    ),
    "a12_association_matrix": lambda s, d: nine(A.association_matrix(line(s, d))),
    "a13_mean_by_category": lambda s, d: nine(A.mean_by_category(events(s, d), "event_type", "value"), "mean"),
    "a14_crosstab": lambda s, d: A.crosstab(orders(s, d), "o_orderstatus", "o_orderpriority"),
    "a14_crosstab_wide": lambda s, d: A.crosstab_wide(load(s, d, "lineitem"), "l_returnflag", "l_linestatus"),
    "a15_xy_grid": lambda s, d: A.xy_grid(events(s, d), "user_id", "value", 16),
    "a15_xy_points": lambda s, d: A.xy_points(events(s, d), "user_id", "value"),
    "s09_numeric_correlations": lambda s, d: nine(A.numeric_correlations(load(s, d, "lineitem"), 20, 0.001), "corr"),
}

_L = cte("lineitem", LINE_GAPS)
_E = cte("events", EVENT_PAIRS)
_O = cte("orders", ORDERS_GAPS)


def _spearman(x: str, y: str, t: str = "g") -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return (
        f"(SELECT round(corr(rx, ry), 9) FROM (SELECT {rank(x)} AS rx, {rank(y)} AS ry FROM {t} "
        f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"
    )


def _kendall(x: str, y: str, t: str) -> str:
    """Tau-b over distinct pairs with counts."""
    return f"""(WITH p AS (SELECT {x} AS x, {y} AS y, CAST(count(*) AS DOUBLE) AS w FROM {t}
    WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL),
  cd AS (SELECT sum(a.w * b.w * CASE WHEN b.y > a.y THEN 1 WHEN b.y < a.y THEN -1 ELSE 0 END) AS s FROM p a JOIN p b ON a.x < b.x),
  n AS (SELECT sum(w) * (sum(w) - 1) / 2 AS n0 FROM p),
  tx AS (SELECT sum(t * (t - 1) / 2) AS n1 FROM (SELECT sum(w) AS t FROM p GROUP BY x)),
  ty AS (SELECT sum(t * (t - 1) / 2) AS n2 FROM (SELECT sum(w) AS t FROM p GROUP BY y))
  SELECT round(s / (sqrt(n0 - n1) * sqrt(n0 - n2)), 9) FROM cd, n, tx, ty)"""


def _cramer(a: str, b: str, t: str = "g") -> str:
    return f"""(WITH ct AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
  ra AS (SELECT a, sum(o) AS r FROM ct GROUP BY a), cb AS (SELECT b, sum(o) AS c FROM ct GROUP BY b),
  f AS (SELECT (SELECT sum(o) FROM ct) AS n, (SELECT count(*) FROM ra) AS r, (SELECT count(*) FROM cb) AS k,
    (SELECT sum(power(coalesce(o, 0) - r * c / CAST((SELECT sum(o) FROM ct) AS DOUBLE), 2)
      / (r * c / CAST((SELECT sum(o) FROM ct) AS DOUBLE)))
     FROM ra, cb LEFT JOIN ct ON ct.a = ra.a AND ct.b = cb.b) AS chi2)
  SELECT round(sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1.0))
    / (least(r - power(r - 1, 2) / (n - 1.0), k - power(k - 1, 2) / (n - 1.0)) - 1)), 9) FROM f)"""


def _eta(c: str, z: str, t: str = "g") -> str:
    return f"""(WITH v AS (SELECT {c} AS c, CAST({z} AS DOUBLE) AS z FROM {t} WHERE {c} IS NOT NULL AND {z} IS NOT NULL),
  m AS (SELECT avg(z) AS mu, var_pop(z) * count(*) AS sst FROM v),
  l AS (SELECT count(*) AS n, avg(z) AS mean FROM v GROUP BY c)
  SELECT round(sqrt(sum(n * power(mean - mu, 2)) / any_value(sst)), 9) FROM l, m)"""


def _codes(c: str, z: str, low: str, t: str = "g") -> str:
    return f"(SELECT round(corr(CASE WHEN {c} = '{low}' THEN 0.0 WHEN {c} IS NOT NULL THEN 1.0 END, {z}), 9) FROM {t})"


_BISERIAL = """(SELECT round((avg(value) FILTER (two = 'b') - avg(value) FILTER (two = 'a')) / stddev_samp(value)
  * sqrt(count(*) FILTER (two = 'a') * count(*) FILTER (two = 'b') / power(count(*), 2)), 9)
  FROM g WHERE value IS NOT NULL AND two IS NOT NULL)"""


def _count(a: str, b: str) -> str:
    return f"(SELECT count(*) FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


def _triangle(cols, cell) -> str:
    return union(
        [
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, {cell(a, b)} AS value, {_count(a, b)} AS n"
            for i, a in enumerate(cols)
            for b in cols[i:]
        ]
    )


def _pearson(a: str, b: str) -> str:
    return f"(SELECT round(corr({a}, {b}), 9) FROM g)"


def _mixed(a: str, b: str) -> str:
    if a in FLAGS and b in FLAGS:
        return _cramer(a, b)
    if a in FLAGS or b in FLAGS:
        c, z = (a, b) if a in FLAGS else (b, a)
        return _codes(c, z, "F") if c == "l_linestatus" else _eta(c, z)
    return _pearson(a, b)


def _edges(c: str) -> str:
    """Distinct deciles of the whole column."""
    return f"(SELECT list_distinct(quantile_cont({c}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) FROM g)"


def _code(c: str) -> str:
    return f"len([e for e in list_sort({_edges(c)})[2:-2] if e < {c}])"


def _mi(a: str, b: str, where: str) -> str:
    return f"""WITH ct AS (SELECT a, b, count(*) AS o FROM (SELECT {a} AS a, {b} AS b FROM g WHERE {where}) GROUP BY ALL),
  n AS (SELECT sum(o) AS n FROM ct), ra AS (SELECT a, sum(o) / any_value(n) AS p FROM ct, n GROUP BY a),
  cb AS (SELECT b, sum(o) / any_value(n) AS p FROM ct, n GROUP BY b)
SELECT round((SELECT sum(o / n * (ln(o / n + 1e-12) - ln(ra.p + 1e-12) - ln(cb.p + 1e-12))) FROM ct, n, ra, cb
  WHERE ct.a = ra.a AND ct.b = cb.b) / greatest((SELECT -sum(p * ln(p)) FROM ra), (SELECT -sum(p * ln(p)) FROM cb)), 9) AS value"""


def _value(expr: str) -> str:
    return f"SELECT {expr} AS value"


_JOINED = "WITH g AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey) "
_GRID = """, s AS (SELECT min(CAST(user_id AS DOUBLE)) AS a0, max(user_id) - min(CAST(user_id AS DOUBLE)) AS a,
  min(value) AS b0, max(value) - min(value) AS b FROM g)
SELECT least(CAST(floor((user_id - a0) / a * 16) AS BIGINT), 15) AS x_bin,
  least(CAST(floor((value - b0) / b * 16) AS BIGINT), 15) AS y_bin, count(*) AS "count"
FROM g, s WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2"""

ORACLES = {
    "a01_pearson": _L + _value(_pearson("l_quantity", "l_extendedprice")),
    "a02_spearman": _L + _value(_spearman("l_quantity", "l_extendedprice")),
    "a02_spearman_ties": _E + _value(_spearman("user_id", "value")),
    "a03_kendall": _E + _value(_kendall("user_id", "value", "g")),
    "a03_kendall_ties": _value(_kendall("l_quantity", "l_discount", "lineitem")),
    "a04_point_biserial": _E + _value(_BISERIAL),
    "a05_point_biserial_codes": _E + _value(_codes("two", "value", "a")),
    "a06_correlation_ratio": _O + _value(_eta("o_orderstatus", "o_totalprice")),
    "a06_correlation_ratio_many": _E + _value(_eta("event_type", "value")),
    "a07_cramers_v": _L + _value(_cramer("l_returnflag", "l_linestatus")),
    "a08_normalized_mi": _L.rstrip()
    + ", "
    + _mi(_code("l_quantity"), _code("l_extendedprice"), "l_quantity IS NOT NULL").removeprefix("WITH "),
    "a08_normalized_mi_mixed": _L.rstrip()
    + ", "
    + _mi("l_returnflag", _code("l_extendedprice"), "l_returnflag IS NOT NULL").removeprefix("WITH "),
    "a09_associate": union(
        [
            f"SELECT 'Pearson' AS method, value FROM ({_L}{_value(_pearson('l_quantity', 'l_tax'))})",
            f"SELECT 'Point-biserial', value FROM ({_E}{_value(_BISERIAL)})",
            f"SELECT 'Correlation ratio', value FROM ({_E}{_value(_eta('event_type', 'value'))})",
            f"SELECT 'Cramers V', value FROM ({_L}{_value(_cramer('l_returnflag', 'l_linestatus'))})",
        ]
    ),
    "a10_corr_matrix_pearson": _L + _triangle(LINE, _pearson),
    "a10_corr_matrix_spearman": "WITH g AS (SELECT * FROM lineitem) " + _triangle(LINE, _spearman),
    "a10_corr_matrix_spearman_nulls": _O + _triangle(["o_orderkey", "o_custkey", "o_totalprice"], _spearman),
    "a10_corr_matrix_kendall": "WITH g AS (SELECT * FROM customer) "
    + _triangle(["c_custkey", "c_nationkey", "c_acctbal"], lambda a, b: _kendall(a, b, "g")),
    "a11_cramers_matrix": _JOINED
    + _triangle(["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority"], _cramer),
    "a12_association_matrix": _L + _triangle([*LINE, *FLAGS], _mixed),
    "a13_mean_by_category": _E + "SELECT event_type AS level, round(avg(value), 9) AS mean FROM g GROUP BY event_type",
    "a14_crosstab": _O + 'SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS "count" FROM g GROUP BY ALL',
    "a14_crosstab_wide": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", "
    "count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY l_returnflag",
    "a15_xy_grid": _E.rstrip() + _GRID,
    "a15_xy_points": _E + "SELECT CAST(user_id AS DOUBLE) AS x, value AS y FROM g",
    "s09_numeric_correlations": "WITH g AS (SELECT * FROM lineitem) SELECT col_a, col_b, value AS corr FROM ("
    + _triangle(
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        _pearson,
    )
    + ") WHERE col_a <> col_b AND abs(value) >= 0.001 ORDER BY abs(value) DESC, col_a, col_b LIMIT 20",
}
