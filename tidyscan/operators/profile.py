"""Table and column profiles: overview, logical types, quick statistics, advice, previews."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import dates, frequency, schema as S
from ..functions.quantiles import quantiles
from ..functions.wide import per_column, percent
from ..plans.settle import settle

# Limits of the logical types and of the advice rules.
DATETIME_SHARE = 0.8
TEXT_LENGTH = 40
TEXT_LEVELS = 30
ADVICE_MISSING_PCT = 40.0
ADVICE_LEVELS = 1000
ADVICE_LEVEL_SHARE = 0.5
ADVICE_OUTLIER_ROWS = 30
ADVICE_OUTLIER_SHARE = 0.03
ADVICE_DATE_SHARE = 0.9

#: Repeated digests, two longs each, up to which they are sent to all tasks.
BROADCAST_DIGESTS = 500_000

# Column names that mark a domain (all of the first, any of the others).
RETAIL_COLUMNS = {"order_id", "customer_id", "sku"}
TELEMETRY_COLUMNS = {"device_id", "battery_health"}
CLOUD_COST_COLUMNS = {"cost", "azure", "gcp", "snowflake"}


# ---- whole table -------------------------------------------------------------------------


@dataclass(frozen=True)
class RowFacts:
    """Rows, missing cells, and rows beyond the first of each group of identical rows."""

    rows: int
    missing: int
    duplicates: int


def row_facts(df: DataFrame) -> RowFacts:
    """Counts over whole rows: 128-bit digests first, and the rows themselves only where a digest comes again.

    Two longs and two counts a row are shuffled, however wide the table is."""
    nulls = " + ".join(f"int({S.sql_name(c)} IS NULL)" for c in df.columns) or "0"
    cells = [S.groupable(S.q(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema)]
    keyed = S.nan_to_null(df).select(*cells, F.expr(nulls).alias("__nulls"))
    names = [f"c{i}" for i in range(len(cells))]
    # hashes pass over nulls, so where they are is hashed, too
    parts = [*[F.col(c).isNull() for c in names], *names]
    keyed = keyed.withColumns({"__d1": F.xxhash64(F.lit(1), *parts), "__d2": F.xxhash64(F.lit(2), *parts)})
    digests = keyed.groupBy("__d1", "__d2").agg(F.count(F.lit(1)).alias("n"), F.sum("__nulls").alias("nulls"))
    again = settle(digests.groupBy((F.col("n") > 1).alias("again"), F.when(F.col("n") > 1, F.col("__d1")).alias("__d1"),
                                   F.when(F.col("n") > 1, F.col("__d2")).alias("__d2")).agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"),
                                                                                          F.count(F.lit(1)).alias("digests")))
    head = again.agg(F.sum("n"), F.sum("nulls"), F.count_if("again")).first()
    if not head[0]:
        return RowFacts(0, 0, 0)
    if not head[2]:
        return RowFacts(head[0], head[1], 0)
    seen = again.filter("again").select("__d1", "__d2")
    met = keyed.join(F.broadcast(seen) if head[2] <= BROADCAST_DIGESTS else seen, ["__d1", "__d2"], "left_semi")
    copies = met.groupBy("__d1", "__d2", *names).agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.sum("more")).first()[0]
    return RowFacts(head[0], head[1], copies or 0)


def overview_stats(df: DataFrame, facts: RowFacts | None = None) -> DataFrame:
    """rows, cols, missing_pct of all cells and n_duplicates."""
    facts = facts or row_facts(df)
    cells = facts.rows * len(df.columns)
    row = (facts.rows, len(df.columns), facts.missing * 100.0 / cells if cells else 0.0, facts.duplicates)
    return df.sparkSession.createDataFrame([row], "rows long, cols int, missing_pct double, n_duplicates long")


def size_estimate_mb(df: DataFrame) -> float:
    """Spark's own size estimate of the plan, in MB."""
    return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1024**2


def duplicate_count(df: DataFrame) -> DataFrame:
    """n_duplicates: rows beyond the first of each group of identical rows."""
    return overview_stats(df).select("n_duplicates")


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, rows, non_null, missing, missing_pct) for every column in one aggregation."""
    cols = list(df.columns if cols is None else cols)
    S.require(df, cols)
    found = per_column(S.nan_to_null(df), cols, {"rows": "count(1)", "non_null": "count({c})"})
    missing = F.col("rows") - F.col("non_null")
    return found.select("*", missing.alias("missing"), percent(missing, F.col("rows")).alias("missing_pct"))


def nunique(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, unique): distinct non-missing values."""
    return frequency.distinct_counts(df, cols, approx).select("column", "unique")


def cardinality(df: DataFrame, cols: list[str] | None = None, metric: str = "unique") -> DataFrame:
    """(column, value): distinct, missing or non-missing counts of the chosen columns (all by default)."""
    cols = list(cols or df.columns)
    if metric == "unique":
        return nunique(df, cols).select("column", F.col("unique").alias("value")).orderBy("column")
    if metric not in ("missing", "non_null"):
        raise ValueError("metric is one of unique, missing, non_null")
    return missing_counts(df, cols).select("column", F.col(metric).alias("value")).orderBy("column")


# ---- logical types -----------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnProfile:
    column: str
    type: str
    rows: int
    non_null: int
    unique: int
    has_null: bool
    date_share: float
    example: str | None

    @property
    def missing_pct(self) -> float:
        return 100.0 * (self.rows - self.non_null) / self.rows if self.rows else 0.0


def _example_sql(df: DataFrame, name: str) -> str:
    dt, c = S.dtype_of(df, name), S.sql_name(name)
    if S.is_nested(dt) or isinstance(dt, (T.BinaryType, T.BooleanType)):
        text = f"to_json({c})" if S.is_nested(dt) else f"CAST({c} AS STRING)"
        return f"min({text})"
    return f"CAST(min({c}) AS STRING)"


def profile_columns(df: DataFrame, approx: bool = False, count_numbers: bool = True) -> list[ColumnProfile]:
    """The profile every report of this module starts from; its jobs do not grow with the columns.

    Without ``count_numbers`` the distinct values of numeric and time columns, which no
    statistic but the count itself needs, stay uncounted (-1).
    """
    df = S.nan_to_null(df)
    text = [f.name for f in df.schema if S.is_string(f.dataType)]
    whole = [f.name for f in df.schema if S.is_integer(f.dataType)]
    aggs = ["count(1) AS rows"]
    for i, f in enumerate(df.schema):
        c = S.sql_name(f.name)
        aggs += [f"count({c}) AS n{i}", f"{_example_sql(df, f.name)} AS e{i}"]
        if f.name in whole:
            aggs.append(f"coalesce(bool_and({c} IN (0, 1)), true) AS b{i}")
        if f.name in text:
            aggs += [f"count({dates.timestamp_sql(c)}) AS d{i}", f"max(length({c})) AS l{i}"]
    facts = df.selectExpr(*aggs).first().asDict()
    # a column of short strings is no text whatever its median
    long = [f.name for i, f in enumerate(df.schema) if (facts.get(f"l{i}") or 0) > TEXT_LENGTH]
    medians = quantiles(df, {c: f"length({S.sql_name(c)})" for c in long}, [0.5])[0] if long else {}
    counted = [f.name for f in df.schema if count_numbers or not (S.is_numeric(f.dataType) or S.is_datetime(f.dataType))]
    found = {r["column"]: r for r in frequency.distinct_counts(df, counted, approx).collect()} if counted else {}
    out = []
    for i, f in enumerate(df.schema):
        n = facts[f"n{i}"]
        unique = found[f.name]["unique"] if f.name in found else -1
        date_share = facts[f"d{i}"] / n if f.name in text and n else 0.0
        if isinstance(f.dataType, T.BooleanType) or facts.get(f"b{i}"):
            kind = "boolean"
        elif S.is_number(f.dataType):
            kind = "numeric"
        elif S.is_datetime(f.dataType) or date_share > DATETIME_SHARE:
            kind = "datetime"
        elif S.is_nested(f.dataType):
            kind = "nested"
        elif f.name in long and n and medians[f.name][0] > TEXT_LENGTH and unique > TEXT_LEVELS:
            kind = "text"
        else:
            kind = "categorical"
        out.append(
            ColumnProfile(
                f.name, kind, facts["rows"], n, unique, n < facts["rows"], date_share, facts[f"e{i}"]
            )
        )
    return out


def infer_schema(df: DataFrame, profile: list[ColumnProfile] | None = None) -> DataFrame:
    """(column, type, non_null, missing_pct, unique, example) with the logical type of every column."""
    profile = profile or profile_columns(df)
    rows = [(p.column, p.type, p.non_null, p.missing_pct, p.unique, p.example) for p in profile]
    made = df.sparkSession.createDataFrame(
        rows, "column string, type string, non_null bigint, missing_pct double, unique bigint, example string"
    )
    return made.withColumn("missing_pct", F.round("missing_pct", 2))


QUICK_STATS = (
    "column string, type string, min double, p50 double, max double, mean double, std double, "
    "time_min timestamp_ntz, time_max timestamp_ntz, true_count bigint, false_count bigint, "
    "unique bigint, top string"
)


def column_quick_stats(df: DataFrame, profile: list[ColumnProfile] | None = None) -> DataFrame:
    """Statistics by logical type; columns that do not apply to a type stay null."""
    profile = profile or profile_columns(df, count_numbers=False)
    kinds = {p.column: p for p in profile}
    numeric = [p.column for p in profile if p.type == "numeric"]
    times = [p.column for p in profile if p.type == "datetime"]
    logical = [p.column for p in profile if p.type == "boolean"]
    levels = [p.column for p in profile if p.type in ("categorical", "text")]
    at = {c: i for i, c in enumerate(df.columns)}
    aggs = ["count(1) AS rows"]
    for c in numeric:
        for name, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop")):
            aggs.append(f"{fn}({S.double_sql(df, c)}) AS {name}{at[c]}")
    for c in times:
        t = f"CAST({dates.datetime_sql(df, c)} AS TIMESTAMP_NTZ)"
        aggs += [f"min({t}) AS tmin{at[c]}", f"max({t}) AS tmax{at[c]}"]
    for c in logical:
        v = f"CAST({S.sql_name(c)} AS INT)"
        aggs += [f"count_if({v} = 1) AS yes{at[c]}", f"count_if({v} = 0) AS no{at[c]}"]
    medians, facts = quantiles(df, {c: S.double_sql(df, c) for c in numeric}, [0.5], aggs)
    tops = frequency.mode_values(df, levels) if levels else {}
    rows = []
    for c in df.columns:
        get = lambda name: facts.get(f"{name}{at[c]}")
        other = kinds[c].type in ("categorical", "text", "nested")
        rows.append(
            (
                c, kinds[c].type, get("min"), medians.get(c, [None])[0], get("max"), get("mean"), get("std"),
                get("tmin"), get("tmax"), get("yes"), get("no"),
                kinds[c].unique if other else None,
                str(tops[c]) if tops.get(c) is not None else None,
            )
        )
    return df.sparkSession.createDataFrame(rows, QUICK_STATS)


def domain_profile(cols: list[str]) -> str:
    lower = {c.lower() for c in cols}
    if RETAIL_COLUMNS <= lower:
        return "retail"
    if TELEMETRY_COLUMNS & lower:
        return "telemetry"
    return "cloud-cost" if CLOUD_COST_COLUMNS & lower else "generic"


def dataset_meta(df: DataFrame, profile: list[ColumnProfile] | None = None) -> DataFrame:
    """(n_numeric, n_categorical, time_min, time_max, profile) of the table."""
    profile = profile or profile_columns(df, count_numbers=False)
    # a 0/1 column has a logical type of its own, but a time column is one by type or by content
    times = [p.column for p in profile if S.is_datetime(S.dtype_of(df, p.column)) or p.date_share > DATETIME_SHARE]
    stamps = [f"CAST({dates.datetime_sql(df, c)} AS TIMESTAMP_NTZ)" for c in times]
    none = ["CAST(NULL AS TIMESTAMP_NTZ)"] * 2
    return df.selectExpr(
        f"{sum(p.type == 'numeric' for p in profile)} AS n_numeric",
        f"{sum(p.type == 'categorical' for p in profile)} AS n_categorical",
        f"least({', '.join([f'min({t})' for t in stamps] + none)}) AS time_min",
        f"greatest({', '.join([f'max({t})' for t in stamps] + none)}) AS time_max",
        f"max({S.sql_text(domain_profile(df.columns))}) AS profile",
    )


def suggest_actions(df: DataFrame, profile: list[ColumnProfile] | None = None, facts: RowFacts | None = None) -> DataFrame:
    """(rule, column, value): what deserves attention before analysis."""
    profile = profile or profile_columns(df)
    rows: list[tuple[str, str | None, float]] = []
    n = profile[0].rows if profile else 0
    for p in profile:
        if round(p.missing_pct, 2) >= ADVICE_MISSING_PCT:
            rows.append(("mostly_missing", p.column, p.missing_pct))
        if p.type in ("categorical", "text") and p.unique > max(ADVICE_LEVELS, ADVICE_LEVEL_SHARE * n):
            rows.append(("high_cardinality", p.column, float(p.unique)))
        if p.unique == 1:
            rows.append(("constant", p.column, 1.0))
        if p.type == "categorical" and p.unique <= 2:
            rows.append(("near_binary", p.column, float(p.unique)))
        if p.type == "categorical" and p.date_share > ADVICE_DATE_SHARE:
            rows.append(("date_as_text", p.column, p.date_share))
    copies = (facts or row_facts(df)).duplicates
    if copies:
        rows.append(("duplicate_rows", None, float(copies)))
    from .outliers import iqr_outlier_shares

    shares = iqr_outlier_shares(df, S.number_columns(df))
    for c, (values, share) in shares.items():
        if values >= ADVICE_OUTLIER_ROWS and share >= ADVICE_OUTLIER_SHARE:
            rows.append(("outliers", c, share))
    return df.sparkSession.createDataFrame(rows, "rule string, column string, value double")


# ---- schema only -------------------------------------------------------------------------


def dtypes_table(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string")


def type_counts(df: DataFrame) -> DataFrame:
    """(kind, columns): booleans count as numeric and as categorical, as in the column pickers."""
    kinds = {
        "numeric": [f for f in df.schema if S.is_numeric(f.dataType)],
        "categorical": [f for f in df.schema if S.is_string(f.dataType) or isinstance(f.dataType, T.BooleanType)],
        "datetime": [f for f in df.schema if S.is_datetime(f.dataType)],
        "boolean": [f for f in df.schema if isinstance(f.dataType, T.BooleanType)],
    }
    return df.sparkSession.createDataFrame([(k, len(v)) for k, v in kinds.items()], "kind string, columns int")


# ---- several tables, previews ------------------------------------------------------------


def datasets_overview(datasets: dict[str, DataFrame]) -> DataFrame:
    """One overview row per named table."""
    parts = [overview_stats(df).select(F.lit(name).alias("dataset"), "*") for name, df in sorted(datasets.items())]
    return reduce(DataFrame.unionByName, parts)


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """Repeatable sample of n rows: the smallest hashes of the key win."""
    S.require(df, key)
    mixed = F.xxhash64(*[S.q(k) for k in key], F.lit(seed))
    return df.orderBy(mixed, *[S.q(k) for k in key]).limit(n)


def preview(df: DataFrame, n: int = 20, how: str = "head", order_by: list[str] | None = None) -> DataFrame:
    """First, last or random n rows; an order makes head and tail repeatable."""
    if how == "random":
        return sample_rows(df, n, list(order_by or df.columns))
    if how == "head" and not order_by:
        return df.limit(n)
    if not order_by:
        raise ValueError("tail needs order_by")
    keys = [S.q(c).asc_nulls_last() if how == "head" else S.q(c).desc_nulls_first() for c in order_by]
    rows = df.orderBy(*keys).limit(n)
    return rows if how == "head" else rows.orderBy(*[S.q(c).asc_nulls_last() for c in order_by])
