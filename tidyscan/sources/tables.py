"""Catalog and remote tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quote_ident(name: str, mark: str = '"') -> str:
    """An identifier in quotes, with quotes inside doubled."""
    return mark + name.replace(mark, mark * 2) + mark


def table_query(catalog: str | None, schema: str | None, table: str, limit: int | None = None) -> str:
    """SQL text that reads a remote table."""
    name = ".".join(quote_ident(p) for p in (catalog, schema, table) if p)
    return f"SELECT * FROM {name}" + (f" LIMIT {int(limit)}" if limit else "")


def read_table(
    spark: SparkSession, catalog: str | None, schema: str | None, table: str,
    limit: int | None = None, **jdbc: str,
) -> DataFrame:
    """A catalog table, or with JDBC options (``url``, ``driver``, …) a remote one; all rows, or as many as ``limit`` says."""
    if jdbc:
        query = table_query(catalog, schema, table, limit)
        return spark.read.format("jdbc").options(**jdbc).option("query", query).load()
    df = spark.table(".".join(quote_ident(p, "`") for p in (catalog, schema, table) if p))
    return df.limit(limit) if limit else df
