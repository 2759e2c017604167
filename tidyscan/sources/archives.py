"""Tables inside ZIP archives.

Archives are spread over the cluster as whole files; each task unpacks its own.  Only the list of
members, not their content, reaches the driver.
"""

from __future__ import annotations

import csv
import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import EXTENSIONS, _kind, sniff_delimiter, typed_cells
from .records import best_record_path, explode_records, flatten

MEMBERS = "archive string, no int, entry string, content binary"


def _unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for archive, content in zip(part["path"], part["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for no, info in enumerate(z.infolist()):
                    name = info.filename.lower()
                    plain = name[:-3] if name.endswith(".gz") else name
                    if info.is_dir() or not (name.endswith(".gz") or plain.rsplit(".", 1)[-1] in EXTENSIONS):
                        continue
                    try:
                        data = z.read(info)
                        data = gzip.decompress(data) if name.endswith(".gz") else data
                    except (zipfile.BadZipFile, OSError, EOFError, RuntimeError):
                        continue  # an unreadable member does not spoil the others
                    yield pd.DataFrame({"archive": [archive], "no": [no], "entry": [info.filename], "content": [data]})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, no, entry, content): one row per readable member, already unpacked."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_unpack, MEMBERS)


def _decode(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin1")


def _cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for content in part["content"]:
            text = _decode(content)
            sep = sniff_delimiter(text[: 64 * 1024].splitlines())
            rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
            if rows:
                yield pd.DataFrame({"no": range(len(rows)), "cells": pd.Series(rows, dtype=object)})


def _csv_table(member: DataFrame) -> DataFrame | None:
    rows = member.mapInPandas(_cells, "no long, cells array<string>")
    header = rows.filter("no = 0").first()
    if header is None:
        return None
    names = header["cells"]
    body = rows.filter(f"no > 0 AND size(cells) <= {len(names)}")
    return typed_cells(body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]))


def _json_table(spark: SparkSession, member: DataFrame) -> DataFrame:
    text = member.select(F.decode("content", "UTF-8").alias("t"))
    lines = text.select(F.explode(F.split("t", r"\r?\n")).alias("t")).filter("trim(t) <> ''")
    by_line = lines.selectExpr("count_if(try_parse_json(t) IS NULL) = 0 AND count(1) > 1").first()[0]
    docs = lines if by_line else text
    df = spark.read.option("mode", "DROPMALFORMED").json(docs.rdd.map(lambda r: r[0]))
    if not by_line and df.columns:
        opening = text.selectExpr("substring(trim(t), 1, 1) AS c").first()
        found = best_record_path(df) if opening and opening["c"] == "{" else None
        if found:
            return explode_records(df, found)
    return flatten(df) if df.columns else df


def _parquet_table(member: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import from_arrow_schema

    def shape(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                found = pq.read_schema(io.BytesIO(content)).remove_metadata()
                yield pd.DataFrame({"schema": [found.serialize().to_pybytes()]})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from pq.ParquetFile(io.BytesIO(content.as_py())).iter_batches()

    stored = member.mapInPandas(shape, "schema binary").first()["schema"]
    schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(stored))))
    return member.select("content").mapInArrow(rows, schema)


def archive_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of the archives under a path by unique file name; empty ones are left out."""
    listed = read_archives(spark, path).select("archive", "no", "entry").orderBy("archive", "no")
    out: dict[str, DataFrame] = {}
    for r in listed.collect():
        member = read_archives(spark, r["archive"]).filter(F.col("no") == r["no"])
        kind = _kind(r["entry"])
        if kind == "parquet":
            table = _parquet_table(member)
        elif kind in ("json", "jsonl"):
            table = _json_table(spark, member)
        else:
            table = _csv_table(member)
        if table is None or not table.columns or not table.take(1):
            continue
        base = r["entry"].rsplit("/", 1)[-1]
        name, k = base, 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out[name] = table
    return out
