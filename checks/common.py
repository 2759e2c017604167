"""Inputs shared by the queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The tables hold no missing values, so both engines derive some by the same expressions.
ORDERS_GAPS = [
    "o_orderkey",
    "o_custkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
    "CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_totalprice END AS o_totalprice",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate",
    "o_orderpriority",
]
EVENTS_GAPS = [
    "event_id",
    "user_id",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts",
    "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS event_type",
    "CASE WHEN event_id % 10 < 3 THEN NULL ELSE value END AS value",
]
LINE_FLAGS = [
    "l_returnflag",
    "l_linestatus",
    "CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS l_quantity",
    "l_linenumber",
]


def gaps(spark: SparkSession, sf_dir: str, name: str, exprs: list[str]) -> DataFrame:
    return load(spark, sf_dir, name).selectExpr(*exprs)


def cte(name: str, exprs: list[str], alias: str = "g") -> str:
    return f"WITH {alias} AS (SELECT {', '.join(exprs)} FROM {name}) "


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, digits) for c in cols})
