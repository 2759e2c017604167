"""Missing values: where they are and what replaces them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dates, frequency, schema as S
from ..functions.quantiles import quantiles
from ..plans import ordered
from .profile import missing_counts

# Calendar buckets that can limit a fill.
FILL_BUCKETS = ("minute", "hour", "day", "week", "month", "quarter", "year")

_EVERY = ["keep", "drop_column", "drop_rows"]
CHOICES = {
    "datetime": [*_EVERY, "ffill", "bfill", "mode", "min", "max", "constant"],
    "numeric": [*_EVERY, "mean", "median", "mode", "ffill", "bfill", "interpolate", "constant"],
    "other": [*_EVERY, "mode", "ffill", "bfill", "constant"],
}


def missing_by_column(df: DataFrame, top: int | None = None, metric: str = "count") -> DataFrame:
    """(column, value): missing cells per column, most first; of all columns, or the first ``top``."""
    value = F.col("missing").cast("double") if metric == "count" else F.col("missing_pct")
    ranked = missing_counts(df).orderBy(F.col("missing").desc(), "column")
    return (ranked.limit(top) if top else ranked).select("column", value.alias("value"))


def missing_totals(df: DataFrame) -> DataFrame:
    """(nulls, affected): all missing cells and the number of columns that have any."""
    return missing_counts(df).agg(
        F.sum("missing").alias("nulls"), F.count_if(F.col("missing") > 0).alias("affected")
    )


def missing_table(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct, dtype) of the affected columns."""
    dtype = F.element_at(
        F.create_map(*[F.lit(v) for f in df.schema for v in (f.name, f.dataType.simpleString())]), F.col("column")
    )
    found = missing_counts(df).filter(F.col("missing") > 0)
    return found.select("column", "missing", "missing_pct", dtype.alias("dtype")).orderBy(
        F.col("missing").desc(), "column"
    )


def _family(dt: T.DataType) -> str:
    if S.is_datetime(dt):
        return "datetime"
    return "numeric" if S.is_numeric(dt) else "other"


def missing_choices(df: DataFrame) -> dict[str, list[str]]:
    """Fill methods that fit the type of each column."""
    return {f.name: CHOICES[_family(f.dataType)] for f in df.schema}


def _constant(df: DataFrame, name: str, value) -> Column:
    """The constant in the column's type; text that does not parse fills nothing."""
    dt = S.dtype_of(df, name)
    if value is None or S.is_string(dt):
        return F.lit("" if value is None and S.is_string(dt) else value).cast(dt)
    if S.is_datetime(dt):
        made = F.expr(dates.timestamp_sql(S.sql_text(value))) if isinstance(value, str) else F.lit(value)
        return made.cast("timestamp_ntz").cast(dt)
    if S.is_numeric(dt) and isinstance(value, str):
        return F.expr(S.number_sql(S.sql_text(value)))
    return F.lit(value)


def fill_missing(
    df: DataFrame,
    plan: dict[str, str | dict],
    order_by: list[str] | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Apply one method per column in a single pass.

    A method is a name or ``{"method": …, "value": …, "within": bucket, "time": column}``.
    Statistics come from the whole input; rows to drop are dropped once, at the end; a column
    without missing cells is left alone whatever its method.  Ordered methods (ffill, bfill,
    interpolate) need ``order_by``: a key and a unique tie-break.
    """
    steps = {c: {"method": m} if isinstance(m, str) else dict(m) for c, m in plan.items()}
    S.require(df, list(steps))
    df = S.nan_to_null(df)
    for c, step in steps.items():
        allowed = CHOICES[_family(S.dtype_of(df, c))]
        if step["method"] not in allowed:
            raise ValueError(f"{step['method']!r} does not fit column {c!r}: choose from {allowed}")

    want = lambda *methods: [c for c, s in steps.items() if s["method"] in methods]
    aggs = [f"count({S.sql_name(c)}) AS n{i}" for i, c in enumerate(steps)]
    aggs += [f"avg({S.double_sql(df, c)}) AS {S.sql_name('mean ' + c)}" for c in want("mean")]
    aggs += [f"{m}({S.sql_name(c)}) AS {S.sql_name(m + ' ' + c)}" for m in ("min", "max") for c in want(m)]
    medians, facts = quantiles(df, {c: S.double_sql(df, c) for c in want("median")}, [0.5], aggs)
    gaps = {c for i, c in enumerate(steps) if facts[f"n{i}"] < facts["rows"]}
    steps = {c: s for c, s in steps.items() if c in gaps}
    tops = frequency.mode_values(df, want("mode")) if want("mode") else {}

    exprs: dict[str, Column] = {}
    for c, step in steps.items():
        dt, method, col = S.dtype_of(df, c), step["method"], S.q(c)
        if method in ("mean", "median"):
            value = facts[f"mean {c}"] if method == "mean" else medians[c][0]
            exprs[c] = F.coalesce(col.cast("double"), F.lit(value).cast("double"))
        elif method == "mode":
            exprs[c] = F.coalesce(col, F.lit(tops[c]).cast(dt))
        elif method in ("min", "max"):
            exprs[c] = F.coalesce(col, F.lit(facts[f"{method} {c}"]).cast(dt))
        elif method == "constant":
            exprs[c] = F.coalesce(col, _constant(df, c, step.get("value")))
    dropped = [c for c, s in steps.items() if s["method"] == "drop_rows"]
    lost = [c for c, s in steps.items() if s["method"] == "drop_column"]

    names = df.columns
    out = df.withColumns({f"__f{names.index(c)}": e for c, e in exprs.items()}) if exprs else df
    filled = {c: F.col(f"__f{names.index(c)}") for c in exprs}
    buckets: dict[tuple, list[str]] = {}
    for c, s in steps.items():
        if s["method"] in ("ffill", "bfill", "interpolate"):
            buckets.setdefault((s.get("within"), s.get("time", c)) if s.get("within") else (None, None), []).append(c)
    for no, ((within, time), members) in enumerate(buckets.items()):
        if not order_by:
            raise ValueError("ffill, bfill and interpolate need order_by: a key and a unique tie-break column")
        out = _ordered_fill(out, steps, members, within, time, order_by, rows_per_block, no, facts["rows"])
        filled.update({c: F.col(f"__o{no}_{i}") for i, c in enumerate(members)})
    if dropped:
        present = F.lit(True)
        for c in dropped:
            present = present & S.q(c).isNotNull()
        out = out.filter(present)
    return out.select(*[filled.get(c, S.q(c)).alias(c) for c in names if c not in lost])


def _ordered_fill(
    df: DataFrame, steps: dict, members: list[str], within: str | None, time: str | None,
    order_by: list[str], rows_per_block: int | None, no: int, rows: int,
) -> DataFrame:
    group: list[str] = []
    if within:
        if within not in FILL_BUCKETS:
            raise ValueError(f"within is one of {FILL_BUCKETS}")
        df = df.withColumn("__bucket", F.date_trunc(within, S.q(time).cast("timestamp_ntz")))
        group = ["__bucket"]
    b = ordered.blocks(df, order_by, group, rows_per_block, rows)
    lines = {c: i for i, c in enumerate(members) if steps[c]["method"] == "interpolate"}
    if lines:
        b = ordered.position(b, "__pos")
    carried: dict[str, tuple[Column, str]] = {}
    for i, c in enumerate(members):
        if c in lines:
            point = F.when(S.q(c).isNotNull(), F.struct(S.as_double(b.df, c).alias("v"), F.col("__pos").alias("p")))
            carried[f"__a{i}"], carried[f"__z{i}"] = (point, "forward"), (point, "backward")
        else:
            way = "forward" if steps[c]["method"] == "ffill" else "backward"
            carried[f"__o{no}_{i}"] = (S.q(c), way)
    out = ordered.finish(ordered.carry(b, carried))
    for c, i in lines.items():
        a, z = F.col(f"__a{i}"), F.col(f"__z{i}")
        run = (z["p"] - a["p"]).cast("double")
        inner = a["v"] + (z["v"] - a["v"]) * (F.col("__pos") - a["p"]) / F.nullif(run, F.lit(0.0))
        out = out.withColumn(f"__o{no}_{i}", F.coalesce(S.as_double(df, c), inner, a["v"]))
    spare = ["__pos", "__bucket", *[f"__{t}{i}" for t in "az" for i in lines.values()]]
    return out.drop(*spare)


def fill_preview(df: DataFrame, plan: dict, order_by: list[str] | None = None) -> DataFrame:
    """(column, missing, missing_pct, dtype) that remain after the plan."""
    return missing_table(fill_missing(df, plan, order_by))
