"""Nested records to flat columns, by walking the schema only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import schema as S

SEPARATOR = "__"


def _leaves(dt: T.StructType, c: Column | None, name: str, sep: str) -> list[Column]:
    out = []
    for f in dt:
        inner = S.q(f.name) if c is None else c.getField(f.name)
        path = f.name if c is None else name + sep + f.name
        if isinstance(f.dataType, T.StructType):
            out += _leaves(f.dataType, inner, path, sep)
        else:
            out.append(inner.alias(path))
    return out


def flatten(df: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """Struct fields become columns named by their path; lists stay cells."""
    return df.select(*_leaves(df.schema, None, "", sep))


def _record_lists(dt: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    out = []
    for f in dt:
        here = (*path, f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append(here)
        elif isinstance(f.dataType, T.StructType):
            out += _record_lists(f.dataType, here)
    return out


def _at(path: tuple[str, ...]) -> Column:
    c = S.q(path[0])
    for name in path[1:]:
        c = c.getField(name)
    return c


def best_record_path(df: DataFrame) -> tuple[str, ...] | None:
    """Path of the longest list of records; the first of several equally long ones."""
    paths = _record_lists(df.schema)
    if not paths:
        return None
    sizes = df.agg(*[F.max(F.size(_at(p))).alias(f"s{i}") for i, p in enumerate(paths)]).first()
    best = max(range(len(paths)), key=lambda i: (sizes[f"s{i}"] or 0, -i))
    return paths[best] if (sizes[f"s{best}"] or 0) > 0 else None


def explode_records(df: DataFrame, path: tuple[str, ...], sep: str = SEPARATOR) -> DataFrame:
    """The records of one list as flat rows."""
    return flatten(df.select(F.inline(_at(path))), sep)
