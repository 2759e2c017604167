"""Categorical encoders.  A missing value is a level of its own in all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dates, frequency, schema as S
from ..plans import ordered
from ..plans.settle import settle

# Limits of the encoders.
TOP_LEVELS = 10
OTHER = "__other__"
LOW_CARDINALITY = 1000
LOW_CARDINALITY_SHARE = 0.5
LOW_CARDINALITY_DATES = 0.7
# A level table up to this many bytes is sent to every task; above it, the join is shuffled.
BROADCAST_BYTES = 16 * 1024**2
LEVEL_BYTES = 64  # of a row besides its text

METHODS = ("none", "drop", "one_hot", "ordinal", "frequency", "target")


def low_cardinality(df: DataFrame) -> DataFrame:
    """(column, unique, low): text columns with few levels that do not look like dates."""
    cols = [f.name for f in df.schema if S.is_string(f.dataType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, unique bigint, low boolean")
    aggs = [f"count({dates.timestamp_sql(S.sql_name(c))}) AS d{i}" for i, c in enumerate(cols)]
    aggs += [f"count({S.sql_name(c)}) AS n{i}" for i, c in enumerate(cols)]
    facts = df.selectExpr("count(1) AS rows", *aggs).first()
    shares = {c: facts[f"d{i}"] / facts[f"n{i}"] if facts[f"n{i}"] else 0.0 for i, c in enumerate(cols)}
    limit = min(LOW_CARDINALITY, LOW_CARDINALITY_SHARE * facts["rows"])
    plain = [c for c in cols if shares[c] < LOW_CARDINALITY_DATES]
    few = (F.col("unique") > 0) & (F.col("unique") <= limit) & F.col("column").isin(plain)
    return frequency.distinct_counts(df, cols).select("column", "unique", few.alias("low"))


def candidates(df: DataFrame) -> list[str]:
    """Columns worth encoding: booleans and text with few levels."""
    low = {r["column"] for r in low_cardinality(df).filter("low").collect()}
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType) or f.name in low]


# ---- levels ------------------------------------------------------------------------------


def _level_type(df: DataFrame, col: str) -> str:
    return next(iter(frequency.families(df, [col])))


def _level(df: DataFrame, col: str) -> Column:
    """The value levels are counted by."""
    dt = S.dtype_of(df, col)
    if S.is_nested(dt):
        return S.groupable(S.q(col), dt)
    return S.as_double(df, col) if S.is_float(dt) else S.q(col).cast(_level_type(df, col))


def _top_levels(df: DataFrame, cols: list[str], k: int) -> dict[str, tuple[list, bool]]:
    """The k most frequent levels of each column, and whether there are more; one job per type family."""
    out: dict[str, tuple[list, bool]] = {}
    for family, members in frequency.families(df, cols).items():
        counts = frequency.level_counts(df, members, family)
        best = ordered_head(counts, k + 1)
        found: dict[int, list] = {}
        for r in best.orderBy("column_no", "place").collect():
            found.setdefault(r["column_no"], []).append(r["value"])
        for i, c in enumerate(members):
            levels = found.get(i, [])
            out[c] = (levels[:k], len(levels) > k)
    return out


def ordered_head(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent levels per column; each task keeps only its own k before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("column_no").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def _as_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """The table with nested columns as the text of their cells, which is one of a kind for equal cells and can be compared."""
    nested = [c for c in cols if S.is_nested(S.dtype_of(df, c))]
    return df.withColumns({c: S.stable_json(S.q(c), S.dtype_of(df, c)) for c in nested}) if nested else df


def topk_levels(df: DataFrame, col: str, k: int = TOP_LEVELS, out: str | None = None) -> DataFrame:
    """Map levels outside the k most frequent to ``__other__``; levels of nested columns are shown as text."""
    if out and S.is_nested(S.dtype_of(df, col)):
        made = topk_levels(df.withColumn(out, S.q(col)), out, k)
        return made.select(*[S.q(c) for c in dict.fromkeys([*df.columns, out])])
    df = _as_text(df, [col])
    levels, _ = _top_levels(df, [col], k)[col]
    x = _level(df, col)
    known = [v for v in levels if v is not None]
    keep = x.isin(*known) if known else F.lit(False)
    if None in levels:
        keep = keep | x.isNull()
    return df.withColumn(out or col, F.when(F.coalesce(keep, F.lit(False)), S.q(col).cast("string")).otherwise(F.lit(OTHER)))


def _one_hot(df: DataFrame, col: str, levels: list, more: bool, drop_first: bool) -> DataFrame:
    x = _level(df, col)
    known = {str(v): x.eqNullSafe(F.lit(v)) for v in levels if v is not None}
    if more:
        kept = x.isin(*[v for v in levels if v is not None]) if known else F.lit(False)
        kept = F.coalesce(kept, F.lit(False))
        # a missing value outside the top levels belongs to the rest, inside them it has no column
        known[OTHER] = ~kept & (x.isNotNull() if None in levels else F.lit(True))
    names = sorted(known)[1 if drop_first else 0 :]
    rest = [S.q(c) for c in df.columns if c != col]
    return df.select(*rest, *[known[n].cast("int").alias(f"{col}_{n}") for n in names])


def _lookup(df: DataFrame, col: str, levels: DataFrame, value: str, alias: str) -> DataFrame:
    """Attach one value per level; missing equals missing."""
    keyed = levels.select(F.struct(F.col("value").alias("k")).alias("__level"), F.col(value).alias(alias))
    text = F.coalesce(F.octet_length(F.to_json(F.struct("value"))), F.lit(0))
    if (levels.agg(F.sum(text + LEVEL_BYTES)).first()[0] or 0) <= BROADCAST_BYTES:
        keyed = F.broadcast(keyed)
    return df.join(keyed, F.struct(_level(df, col).alias("k")) == F.col("__level"), "left").drop("__level")


def _replace(df: DataFrame, col: str, made: str) -> DataFrame:
    return df.select(*[F.col(made).alias(col) if c == col else S.q(c) for c in df.columns if c != made])


def level_ranks(df: DataFrame, cols: list[str], rows_per_block: int | None = None) -> dict[str, DataFrame]:
    """(value, n, rank) of each column, rank 1 for the most frequent level."""
    out = {}
    for family, members in frequency.families(df, cols).items():
        counts = settle(frequency.level_counts(df, members, family).withColumn("neg", -F.col("n")))
        b = ordered.blocks(counts, ["neg", "value"], ["column_no"], rows_per_block)
        ranked = ordered.finish(ordered.position(b, "rank"))
        for i, c in enumerate(members):
            out[c] = ranked.filter(F.col("column_no") == i).select("value", "n", "rank")
    return out


# ---- encoders ----------------------------------------------------------------------------


def one_hot(df: DataFrame, cols: list[str], k: int = TOP_LEVELS, drop_first: bool = False) -> DataFrame:
    """Replace each column by ``<col>_<level>`` indicators of its top levels and of the rest."""
    S.require(df, cols)
    df = _as_text(df, cols)
    found = _top_levels(df, cols, k)
    for c in cols:
        df = _one_hot(df, c, *found[c], drop_first)
    return df


def ordinal_encode(df: DataFrame, cols: list[str], rows_per_block: int | None = None) -> DataFrame:
    """Replace levels by their popularity rank; ties go to the smaller value, missing last."""
    S.require(df, cols)
    ranks = level_ranks(df, cols, rows_per_block)
    for c in cols:
        df = _replace(_lookup(df, c, ranks[c], "rank", "__e"), c, "__e")
    return df


def frequency_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace levels by their number of rows."""
    S.require(df, cols)
    source = df
    for c in cols:
        counts = frequency.level_counts(source, [c], _level_type(source, c))
        df = _replace(_lookup(df, c, counts, "n", "__e"), c, "__e")
    return df


def target_encode(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Replace levels by the mean of the target; a level without one gets the overall mean."""
    S.require(df, [*cols, target])
    overall = df.agg(F.avg(S.as_double(df, target))).first()[0]
    source = df
    for c in cols:
        levels = source.select(_level(source, c).alias("value"), S.as_double(source, target).alias("__y"))
        means = levels.groupBy("value").agg(F.avg("__y").alias("m"))
        df = _lookup(df, c, means, "m", "__e")
        df = _replace(df.withColumn("__e", F.coalesce("__e", F.lit(overall).cast("double"))), c, "__e")
    return df


def encode(
    df: DataFrame, plan: dict[str, str], target: str | None = None, k: int = TOP_LEVELS, drop_first: bool = False
) -> DataFrame:
    """Apply one method per column, from left to right."""
    S.require(df, list(plan))
    for c, method in plan.items():
        if method not in METHODS:
            raise ValueError(f"column {c!r}: method is one of {METHODS}")
        if method == "drop":
            df = df.drop(c)
        elif method == "one_hot":
            df = one_hot(df, [c], k, drop_first)
        elif method == "ordinal":
            df = ordinal_encode(df, [c])
        elif method == "frequency":
            df = frequency_encode(df, [c])
        elif method == "target":
            if not target:
                raise ValueError("target encoding needs a target column")
            df = target_encode(df, [c], target)
    return df


# ---- advice ------------------------------------------------------------------------------


def _levels_with_null() -> Column:
    return F.col("unique") + F.col("has_null").cast("int")


def encoding_advice(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, levels, advice): what fits the number of levels, a missing value counted as one."""
    cols = list(cols or candidates(df))
    n = F.col("levels")
    advice = (
        F.when(n <= 2, "binary_or_one_hot").when(n <= 10, "one_hot").when(n <= 50, "frequency_or_ordinal")
        .otherwise("target_mean_or_hash")
    )
    found = frequency.distinct_counts(df, cols).select("column", _levels_with_null().cast("bigint").alias("levels"))
    return found.withColumn("advice", advice)


def encoding_plan(df: DataFrame, plan: dict[str, str], k: int = TOP_LEVELS, drop_first: bool = False) -> DataFrame:
    """(column, method, new_cols): how many columns each step is expected to add."""
    found = frequency.distinct_counts(df, list(plan)).collect()
    rows = []
    for r in found:
        method, n = plan[r["column"]], r["unique"] + int(r["has_null"])
        add = min(k, n) + (1 if n > k else 0) if method == "one_hot" else int(method in ("ordinal", "frequency", "target"))
        if method == "one_hot" and drop_first and add:
            add -= 1
        rows.append((r["column"], method, add))
    return df.sparkSession.createDataFrame(rows, "column string, method string, new_cols int")
