"""Column kinds, missing-value normalisation and groupable forms of nested cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
STRING_TYPES = (T.StringType, T.CharType, T.VarcharType)
NESTED_TYPES = (T.StructType, T.ArrayType, T.MapType)


def is_integer(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGER_TYPES)


def is_float(dt: T.DataType) -> bool:
    return isinstance(dt, FLOAT_TYPES)


def is_number(dt: T.DataType) -> bool:
    """Numeric without booleans."""
    return is_integer(dt) or is_float(dt) or isinstance(dt, T.DecimalType)


def is_numeric(dt: T.DataType) -> bool:
    """Numeric in the wide sense: booleans count as numbers."""
    return is_number(dt) or isinstance(dt, T.BooleanType)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, STRING_TYPES)


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, NESTED_TYPES)


# Many-column operators state their aggregates as SQL text: one call per expression keeps the
# driver from spending longer on building a plan than the cluster on running it.


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(value: float | None) -> str:
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    if value in (float("inf"), float("-inf")):
        return f"CAST('{'-' if value < 0 else ''}Infinity' AS DOUBLE)"
    return f"CAST({value!r} AS DOUBLE)" if "e" not in repr(value) else f"{value!r}D"


def q(name: str) -> Column:
    """Column by its exact name, dots and blanks included."""
    return F.col(sql_name(name))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_number(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def association_kind(dt: T.DataType) -> str:
    return "num" if is_numeric(dt) else "cat"


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value: NaN in float columns becomes null."""
    if not any(is_float(f.dataType) for f in df.schema):
        return df
    return df.select(
        *[
            F.nanvl(q(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if is_float(f.dataType)
            else q(f.name)
            for f in df.schema
        ]
    )


# Fixed value: the accepted spelling of a number in text.
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def double_sql(df: DataFrame, name: str) -> str:
    """SQL text of a column as double: NaN and text that is no number become null."""
    dt, c = dtype_of(df, name), sql_name(name)
    if isinstance(dt, T.DoubleType):
        return f"nanvl({c}, CAST(NULL AS DOUBLE))"
    if isinstance(dt, T.FloatType):
        return f"CAST(nanvl({c}, CAST(NULL AS FLOAT)) AS DOUBLE)"
    if is_numeric(dt):
        return f"CAST({c} AS DOUBLE)"
    if is_string(dt):
        return number_sql(c)
    raise TypeError(f"column {name!r} of type {dt.simpleString()} cannot be read as a number")


def as_double(df: DataFrame, name: str) -> Column:
    return F.expr(double_sql(df, name))


def number_sql(c: str) -> str:
    return f"CASE WHEN {c} RLIKE r'{NUMBER_PATTERN}' THEN try_cast(trim({c}) AS DOUBLE) END"


def has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return True
    if isinstance(dt, T.ArrayType):
        return has_map(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(has_map(f.dataType) for f in dt)
    return False


def groupable(c: Column, dt: T.DataType) -> Column:
    """Same-value form that Spark can group by: maps become sorted entry arrays."""
    if not has_map(dt):
        return c
    if isinstance(dt, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.struct(
                e.getField("key").alias("key"),
                groupable(e.getField("value"), dt.valueType).alias("value"),
            ),
        )
        return F.array_sort(entries)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda e: groupable(e, dt.elementType))
    fields = [groupable(c.getField(f.name), f.dataType).alias(f.name) for f in dt]
    return F.when(c.isNotNull(), F.struct(*fields))


def group_column(df: DataFrame, name: str) -> Column:
    return groupable(q(name), dtype_of(df, name))


def stable_json(c: Column, dt: T.DataType) -> Column:
    """Readable text of a nested cell, with the keys of maps in order at every depth."""
    return F.to_json(_sorted_maps(c, dt))


def _sorted_maps(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(
            e["key"].alias("key"), _sorted_maps(e["value"], dt.valueType).alias("value")))
        keyed = lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(entries, keyed))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _sorted_maps(x, dt.elementType))
    if isinstance(dt, T.StructType):
        fields = [_sorted_maps(c.getField(f.name), f.dataType).alias(f.name) for f in dt]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def require(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
