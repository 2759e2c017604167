"""Readers for delimited text, JSON and Parquet, with dispatch by name and content."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import schema as S
from .records import best_record_path, explode_records, flatten

PREVIEW_ROWS = 250_000

# File kinds, delimiters, and the spellings of a missing or logical cell.
EXTENSIONS = ["csv", "tsv", "txt", "json", "jsonl", "ndjson", "parquet"]
DELIMITERS = ",;\t|"
SNIFF_CHARS = 64 * 1024
SNIFF_LINES = 2000
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
LOGICAL_WORDS = ["True", "TRUE", "true", "False", "FALSE", "false"]
_BAD = "__bad_line"


def is_supported(path: Column) -> Column:
    """Whether a path names a table that can be read."""
    return F.lower(path).rlike(r"\.(" + "|".join(EXTENSIONS) + r")$")


def _kind(path: str) -> str | None:
    name = path.lower().rstrip("/")
    name = name[:-3] if name.endswith(".gz") else name
    ending = name.rsplit(".", 1)[-1]
    if ending in ("jsonl", "ndjson"):
        return "jsonl"
    if ending in ("json", "parquet"):
        return ending
    return "csv" if ending in EXTENSIONS else None


def _head(spark: SparkSession, path: str) -> list[str]:
    """The first lines of the file, cut off at the sniffing size."""
    lines, size = [], 0
    for r in spark.read.text(path).limit(SNIFF_LINES).collect():
        lines.append(r[0])
        size += len(r[0]) + 1
        if size > SNIFF_CHARS:
            break
    return lines


def read_any(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Read a table by its kind; ``.gz`` files are unpacked by Spark, ZIP archives give their first table."""
    if path.lower().endswith(".zip"):
        from .archives import archive_tables

        tables = archive_tables(spark, path)
        if not tables:
            raise ValueError(f"no table in {path}")
        first = next(iter(tables.values()))
        return first.limit(max_rows) if max_rows else first
    kind = _kind(path)
    if kind == "parquet":
        return read_parquet(spark, path, max_rows)
    if kind == "jsonl":
        return read_jsonl(spark, path, max_rows)
    lines = [line for line in _head(spark, path) if line.strip()]
    if kind == "json" or (lines and lines[0].lstrip("﻿ \t")[:1] in ("{", "[")):
        first = lines[0].strip() if lines else ""
        by_line = len(lines) > 1 and first.startswith("{") and first.endswith("}")
        return (read_jsonl if by_line else read_json)(spark, path, max_rows)
    return read_csv(spark, path, max_rows)


def read_preview(spark: SparkSession, path: str) -> DataFrame:
    return read_any(spark, path, PREVIEW_ROWS)


def read_parquet(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.limit(max_rows) if max_rows else df


# ---- delimited text ----------------------------------------------------------------------


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter of the sample, else of its first line, else a comma."""
    for sample in ("\n".join(lines), lines[0] if lines else ""):
        try:
            return csv.Sniffer().sniff(sample, delimiters=DELIMITERS).delimiter
        except csv.Error:
            continue
    return ","


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Delimited text with a header line.

    The delimiter is found in the first lines; Latin-1 is used if some line is not UTF-8.  Short
    lines are filled with missing cells, lines with too many cells are left out.  Column types
    are the narrowest of integer, number, logical and text that fit all cells.
    """
    sep = sniff_delimiter(_head(spark, path))
    # one pass tells whether the text is UTF-8 and whether quoted cells span lines
    odd = "length(value) - length(replace(value, '\"', ''))"
    facts = spark.read.text(path).selectExpr(
        "bool_or(NOT is_valid_utf8(value)) AS other", f"bool_or(({odd}) % 2 = 1) AS spans"
    ).first()
    options = {
        "header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": bool(facts["spans"]),
        "encoding": "ISO-8859-1" if facts["other"] else "UTF-8", "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _BAD,
        "columnPruning": False,  # a line's fit must not depend on the columns a query reads
    }
    names = spark.read.options(**options).csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BAD]])
    raw = spark.read.options(**options).schema(text).csv(path)
    # a line that does not fit is either short or long: count its cells outside quotes
    bare = F.regexp_replace(F.col(_BAD), r'"[^"]*"', "")
    cells = F.size(F.split(bare, "[" + ("\\t" if sep == "\t" else "\\" + sep) + "]"))
    # Spark refuses plans that read the bad-line column alone, so the test also names a data column
    short = (cells <= len(names)) & (F.length(F.coalesce(S.q(names[0]), F.lit(""))) >= 0)
    kept = raw.filter(F.col(_BAD).isNull() | short).drop(_BAD)
    df = typed_cells(kept)
    return df.limit(max_rows) if max_rows else df


def typed_cells(raw: DataFrame) -> DataFrame:
    """Text cells to missing values and to the narrowest fitting column types, by one aggregation."""
    words = ", ".join(S.sql_text(w) for w in MISSING_WORDS)
    names = raw.columns
    blank = raw.selectExpr(*[f"CASE WHEN {S.sql_name(c)} NOT IN ({words}) THEN {S.sql_name(c)} END AS {S.sql_name(c)}" for c in names])
    logical = ", ".join(S.sql_text(w) for w in LOGICAL_WORDS)
    aggs = []
    for i, name in enumerate(names):
        c = S.sql_name(name)
        x = S.number_sql(c)
        aggs += [
            f"count({c}) AS n{i}", f"count({x}) AS x{i}", f"count_if({c} IN ({logical})) AS b{i}",
            f"coalesce(bool_and({c} RLIKE r'^\\s*[+-]?\\d+$' AND try_cast(trim({c}) AS BIGINT) IS NOT NULL), false) AS i{i}",
            f"coalesce(bool_and(({x}) = rint({x}) AND abs({x}) < 9e15), false) AS w{i}",
        ]
    facts = blank.selectExpr(*aggs).first()
    cast = []
    for i, name in enumerate(names):
        c = S.sql_name(name)
        n = facts[f"n{i}"]
        if n and facts[f"i{i}"]:
            e = f"CAST(trim({c}) AS BIGINT)"
        elif n and facts[f"x{i}"] == n:
            e = f"CAST({S.number_sql(c)} AS BIGINT)" if facts[f"w{i}"] else S.number_sql(c)
        elif n and facts[f"b{i}"] == n:
            e = f"CAST(lower({c}) AS BOOLEAN)"
        else:
            e = c
        cast.append(f"{e} AS {c}")
    return blank.selectExpr(*cast)


# ---- JSON --------------------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """One JSON value per line: objects become flat columns, anything else one ``value`` column.

    Blank and broken lines are left out; the first line that is not blank must be JSON.
    """
    lines = spark.read.text(path).filter("trim(value) <> ''")
    first = lines.selectExpr("try_parse_json(value) IS NOT NULL AS ok").first()
    if first is None or not first["ok"]:
        raise ValueError(f"{path} does not start with a line of JSON")
    values = lines.selectExpr("try_parse_json(value) AS v").filter("v IS NOT NULL")
    other = values.filter("NOT startswith(schema_of_variant(v), 'OBJECT')").take(1)
    if other:
        df = values.selectExpr("CAST(v AS STRING) AS value")
    else:
        df = flatten(spark.read.option("mode", "DROPMALFORMED").json(path))
    return df.limit(max_rows) if max_rows else df


def read_json(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """One JSON document: an array of objects, an array of values, or an object.

    An object gives the records of its longest list of objects, or itself as one flat row.
    """
    lines = [line.lstrip("﻿ \t") for line in _head(spark, path) if line.strip()]
    if not lines or lines[0][:1] not in ("{", "["):
        raise ValueError(f"{path} holds no JSON document")
    df = spark.read.option("multiLine", True).json(path)
    if df.columns == ["_corrupt_record"]:
        whole = spark.read.text(path, wholetext=True)
        values = whole.selectExpr("try_parse_json(value) AS v").filter("v IS NOT NULL")
        if not values.take(1):
            raise ValueError(f"{path} is not valid JSON")
        items = values.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        df = items.select(F.col("value").cast("string").alias("value"))
    elif lines[0].startswith("{"):
        found = best_record_path(df)
        df = explode_records(df, found) if found else flatten(df)
    else:
        df = flatten(df)
    return df.limit(max_rows) if max_rows else df
