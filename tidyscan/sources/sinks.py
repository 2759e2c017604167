"""Writers for prepared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import schema as S


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and quotes doubled; nested cells are written as JSON text."""
    cols = [
        S.stable_json(S.q(f.name), f.dataType).alias(f.name) if S.is_nested(f.dataType) else S.q(f.name) for f in df.schema
    ]
    df.select(*cols).write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
