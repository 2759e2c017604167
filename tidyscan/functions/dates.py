"""Text to timestamp by an explicit list of formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import schema as S

# Accepted date/time spellings, as (pattern, format) in order of trial.
ISO_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"),
    (r"^\d{8}$", "yyyyMMdd"),
]
MONTH_FIRST_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$", "M/d/yyyy HH:mm:ss"),
]
DAY_FIRST_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$", "d/M/yyyy HH:mm:ss"),
]

# Strftime directives and their Spark pattern letters.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%z": "XX",
}


def spark_format(fmt: str) -> str:
    """Spark pattern of a strftime format; a format without ``%`` is taken as it is."""
    if "%" not in fmt:
        return fmt
    out, i = "", 0
    while i < len(fmt):
        directive = fmt[i : i + 2]
        if directive in STRFTIME:
            out, i = out + STRFTIME[directive], i + 2
        elif fmt[i].isalpha():
            out, i = out + f"'{fmt[i]}'", i + 1
        else:
            out, i = out + fmt[i], i + 1
    return out


def timestamp_sql(c: str, fmt: str | None = None, day_first: bool = False) -> str:
    """SQL text of a text cell as timestamp, null when no format fits."""
    if fmt:
        return f'try_to_timestamp(trim({c}), "{spark_format(fmt)}")'
    formats = ISO_FORMATS + (DAY_FIRST_FORMATS if day_first else MONTH_FIRST_FORMATS)
    # every format starts with a digit, and the pattern test keeps the parser away from cells that cannot fit
    words = f"WHEN ltrim({c}) < '0' OR ltrim({c}) >= ':' THEN NULL"
    cases = " ".join(f"""WHEN trim({c}) RLIKE r'{p}' THEN try_to_timestamp(trim({c}), "{f}")""" for p, f in formats)
    return f"CASE {words} {cases} END"


def datetime_sql(
    df: DataFrame, name: str, fmt: str | None = None, day_first: bool = False, utc: bool = False
) -> str:
    """SQL text of any column as a time: zone-free unless ``utc`` asks for an instant."""
    dt, c = S.dtype_of(df, name), S.sql_name(name)
    if isinstance(dt, T.TimestampType):
        return c
    if S.is_datetime(dt):
        ts = f"CAST({c} AS TIMESTAMP_NTZ)"
    elif S.is_string(dt):
        ts = f"CAST({timestamp_sql(c, fmt, day_first)} AS TIMESTAMP_NTZ)"
    else:
        raise TypeError(f"column {name!r} of type {dt.simpleString()} holds no dates")
    return f"CAST(convert_timezone('UTC', current_timezone(), {ts}) AS TIMESTAMP)" if utc else ts


def to_datetime(
    df: DataFrame, name: str, fmt: str | None = None, day_first: bool = False, utc: bool = False
) -> Column:
    return F.expr(datetime_sql(df, name, fmt, day_first, utc))
