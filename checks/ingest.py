"""Ingest queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyscan.sources import files, manifest, records

from .common import load


def nested_orders(s, d):
    return load(s, d, "orders").select(
        "o_orderkey",
        F.struct("o_orderstatus", F.struct("o_totalprice", "o_orderdate").alias("detail")).alias("order"),
        F.array("o_custkey", "o_orderkey").alias("keys"),
    )


def flat_orders(s, d):
    """Flat orders; the list, which stays a cell, is shown as text."""
    return records.flatten(nested_orders(s, d)).withColumn("keys", F.expr("array_join(CAST(keys AS ARRAY<STRING>), ',')"))


def line_records(s, d):
    """The longer of two lists of records in each document."""
    pair = [F.struct(F.col("l_linenumber").alias("no"), F.struct(F.col(c).alias("v")).alias("m")) for c in ("l_quantity", "l_tax")]
    few = F.array(F.struct("l_orderkey"))
    doc = load(s, d, "lineitem").select(F.struct(few.alias("few"), F.array(*pair).alias("lines")).alias("d"))
    return records.explode_records(doc, records.best_record_path(doc))


#: Cells as text, some of them words for missing ones.
TEXT_CELLS = [
    "CAST(o_orderkey AS STRING) AS o_orderkey",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'NA' ELSE CAST(o_custkey AS STRING) END AS o_custkey",
    "CAST(o_totalprice AS STRING) AS o_totalprice",
    "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'False' END AS flag",
    "CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE o_orderpriority END AS o_orderpriority",
]


def named(s, d):
    names = load(s, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(".csv")).alias("name"))
    return manifest.unique_names(names, "name", ["o_orderkey"], rows_per_block=1000)


QUERIES = {
    "i02_typed_cells": lambda s, d: files.typed_cells(load(s, d, "orders").selectExpr(*TEXT_CELLS)),
    "i05_explode_records": line_records,
    "i06_flatten": flat_orders,
    "i07_read_parquet": lambda s, d: files.read_any(s, f"{d}/orders.parquet"),
    "i12_unique_names": named,
}

ORACLES = {
    "i02_typed_cells": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS o_custkey, o_totalprice, "
    "CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 2 = 0 END AS flag, "
    "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders",
    "i05_explode_records": "SELECT l_linenumber AS no, l_quantity AS m__v FROM lineitem UNION ALL SELECT l_linenumber, l_tax FROM lineitem",
    "i06_flatten": "SELECT o_orderkey, o_orderstatus AS order__o_orderstatus, o_totalprice AS order__detail__o_totalprice, "
    "o_orderdate AS order__detail__o_orderdate, o_custkey || ',' || o_orderkey AS keys FROM orders",
    "i07_read_parquet": "SELECT * FROM orders",
    "i12_unique_names": "SELECT o_orderkey, name, name || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS unique_name FROM ("
    "SELECT o_orderkey, o_orderpriority || '.csv' AS name, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n "
    "FROM orders)",
}
