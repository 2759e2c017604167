"""Measures of association for one pair of columns or for all pairs at once.

Every measure uses the rows where both columns are present.  Matrices come in long form
``(col_a, col_b, value, n)``: the upper triangle with the diagonal.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import schema as S
from ..functions.pairwise import gram, pair_counts
from ..functions.quantiles import quantiles
from ..functions.stats import both, pearson_expr
from ..plans import ordered
from ..plans.settle import settle
from .profile import sample_rows

# Fixed values of the measures.
MI_EPSILON = 1e-12
MI_BINS = 10
CRAMER_FLOOR = 1e-12
MATRIX_SCHEMA = "col_a string, col_b string, value double, n bigint"


def _level(df: DataFrame, name: str) -> Column:
    """A category as text; text forms of one type are distinct for distinct values."""
    dt = S.dtype_of(df, name)
    if S.is_nested(dt):
        return S.stable_json(S.q(name), dt)
    if isinstance(dt, T.BinaryType):
        return F.hex(S.q(name))
    if S.is_float(dt):
        return S.as_double(df, name).cast("string")
    return S.q(name).cast("string")


def _one(df: DataFrame, value) -> DataFrame:
    return df.sparkSession.createDataFrame([(None if value is None else float(value),)], "value double")


def binary_levels(df: DataFrame, cols: list[str]) -> dict[str, tuple | None]:
    """The two levels (smaller, larger) of each column that has exactly two, from two small jobs."""
    clean = S.nan_to_null(df)
    ok = [c for c in cols if not S.has_map(S.dtype_of(df, c))]
    if not ok:
        return {c: None for c in cols}
    ends = clean.selectExpr(
        *[f"{fn}({S.sql_name(c)}) AS {t}{i}" for i, c in enumerate(ok) for t, fn in (("a", "min"), ("z", "max"))]
    ).first()
    bound = {c: (ends[f"a{i}"], ends[f"z{i}"]) for i, c in enumerate(ok)}
    simple = [c for c in ok if not S.is_nested(S.dtype_of(df, c)) and bound[c][0] is not None and bound[c][0] != bound[c][1]]
    out: dict[str, tuple | None] = {c: None for c in cols}
    if simple:
        row = clean.agg(
            *[F.count_if(~S.q(c).isin(*[F.lit(v) for v in bound[c]])).alias(f"m{i}") for i, c in enumerate(simple)]
        ).first()
        out.update({c: bound[c] for i, c in enumerate(simple) if row[f"m{i}"] == 0})
    return out


# ---- two numeric columns -----------------------------------------------------------------


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(pearson_expr(S.as_double(df, x), S.as_double(df, y)).alias("value"))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct (x, y) with their multiplicity: repeated values collapse before any shuffle."""
    a, b = S.as_double(df, x), S.as_double(df, y)
    kept = df.select(a.alias("x"), b.alias("y")).filter(both(F.col("x"), F.col("y")))
    return kept.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))


def average_ranks(counts: DataFrame, value: str, weight: str, group: list[str] | None = None,
                  rows_per_block: int | None = None) -> DataFrame:
    """Adds ``rank``, the mean position of each distinct value, from values and their counts."""
    b = ordered.blocks(counts, [value], group, rows_per_block)
    b = ordered.running_total(b, F.col(weight), "__before", inclusive=False)
    rank = F.col("__before") + (F.col(weight) + 1) / 2.0
    return ordered.finish(b).withColumn("rank", rank).drop("__before")


def spearman(df: DataFrame, x: str, y: str, rows_per_block: int | None = None) -> DataFrame:
    """Pearson r of average ranks, computed on distinct pairs with their counts."""
    pairs = settle(_pairs(df, x, y))
    ranked = pairs
    for side, name in (("x", "rx"), ("y", "ry")):
        counts = settle(pairs.groupBy(side).agg(F.sum("w").alias("t")))
        ranks = average_ranks(counts, side, "t", rows_per_block=rows_per_block)
        ranked = ranked.join(ranks.select(F.col(side).alias("__k"), F.col("rank").alias(name)), F.col(side) == F.col("__k")).drop("__k")
    n = F.sum("w")
    sums = ranked.agg(
        n.alias("n"),
        F.sum(F.col("w") * F.col("rx")).alias("sx"), F.sum(F.col("w") * F.col("ry")).alias("sy"),
        F.sum(F.col("w") * F.col("rx") * F.col("ry")).alias("sxy"),
        F.sum(F.col("w") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("w") * F.col("ry") * F.col("ry")).alias("syy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.nullif(F.col("n"), F.lit(0))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.nullif(F.col("n"), F.lit(0))
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.nullif(F.col("n"), F.lit(0))
    return sums.select(F.when((vx > 0) & (vy > 0), cov / (F.sqrt(vx) * F.sqrt(vy))).alias("value"))


# ---- a category and a measure ------------------------------------------------------------


def point_biserial(df: DataFrame, x: str, y: str, form: str = "deviation") -> DataFrame:
    """Binary column against a numeric one; ``form='pearson'`` is r on 0/1 codes.

    The default form divides the difference of means by the sample deviation, so the two differ
    by sqrt((n - 1) / n).
    """
    found = binary_levels(df, [x, y])
    if found[x] and S.is_numeric(S.dtype_of(df, y)):
        cat, num = x, y
    elif found[y] and S.is_numeric(S.dtype_of(df, x)):
        cat, num = y, x
    else:
        return _one(df, None)
    df = S.nan_to_null(df)
    level, z = S.q(cat), S.as_double(df, num)
    ok = level.isNotNull() & z.isNotNull()
    low, high = ok & (level == F.lit(found[cat][0])), ok & (level == F.lit(found[cat][1]))
    n0, n1 = F.count_if(low).cast("double"), F.count_if(high).cast("double")
    m0, m1 = F.avg(F.when(low, z)), F.avg(F.when(high, z))
    n = n0 + n1
    if form == "pearson":
        code = F.when(high, 1.0).when(low, 0.0)
        value = pearson_expr(code, z, min_rows=3)
    else:
        s = F.stddev_samp(F.when(ok, z))
        r = F.try_divide(m1 - m0, s) * F.sqrt(F.try_divide(n0 * n1, n * n))
        value = F.when((n >= 3) & (n0 > 0) & (n1 > 0), F.when(s == 0, F.lit(0.0)).otherwise(r))
    return df.agg(value.alias("value"))


def correlation_ratio(df: DataFrame, cat: str, num: str, form: str = "pair") -> DataFrame:
    """Eta: the share of the measure's variation that lies between categories, as a root.

    A flat measure gives 0 for a pair and null in a matrix.
    """
    z = S.as_double(df, num)
    kept = df.select(S.group_column(S.nan_to_null(df), cat).alias("c"), z.alias("z")).filter("c IS NOT NULL AND z IS NOT NULL")
    mean = kept.agg(F.avg("z")).first()[0]
    if mean is None:
        return _one(df, None)
    levels = kept.groupBy("c").agg(F.count("z").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.lit(mean), 2))
    within = F.sum(F.col("n") * F.col("v"))
    flat = F.lit(0.0) if form == "pair" else F.lit(None).cast("double")
    value = F.when(between + within > 0, F.sqrt(between / (between + within))).otherwise(flat)
    if form == "pair":
        value = F.when((F.sum("n") >= 2) & (F.count(F.lit(1)) >= 2), value)
    return levels.agg(value.alias("value"))


def mean_by_category(df: DataFrame, cat: str, num: str) -> DataFrame:
    """(level, mean), largest first; a missing level keeps its own row."""
    z = S.as_double(df, num)
    means = S.nan_to_null(df).groupBy(S.q(cat).alias("level")).agg(F.avg(z).alias("mean"))
    return means.orderBy(F.col("mean").desc_nulls_last(), F.col("level").asc_nulls_last())


# ---- two categories ----------------------------------------------------------------------


def _contingency(df: DataFrame, levels: list[Column], pairs: list[tuple[int, int]]) -> DataFrame:
    """(pair, a, b, o, r, c): observed cells of pairs of levels with their row and column totals."""
    plain = df.select(*[c.alias(f"c{i}") for i, c in enumerate(levels)])
    cells = ", ".join(f"struct({no} AS pair, c{i} AS a, c{j} AS b)" for no, (i, j) in enumerate(pairs))
    long = plain.selectExpr(f"inline(array({cells}))").filter("a IS NOT NULL AND b IS NOT NULL")
    table = long.groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("o"))
    rows = table.groupBy("pair", "a").agg(F.sum("o").alias("r"))
    cols = table.groupBy("pair", "b").agg(F.sum("o").alias("c"))
    return table.join(rows, ["pair", "a"]).join(cols, ["pair", "b"])


def _totals(cells: DataFrame, keys: list[str] = ["pair"]) -> DataFrame:
    """Sums over the observed cells that the measures are made of, one row per pair."""
    # a level's cells share one total: o / total adds up to 1 per level
    return cells.groupBy(*keys).agg(
        F.sum("o").alias("n"),
        F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("s"),
        F.round(F.sum(F.col("o") / F.col("r").cast("double"))).cast("bigint").alias("levels_a"),
        F.round(F.sum(F.col("o") / F.col("c").cast("double"))).cast("bigint").alias("levels_b"),
    )


def _cramer(matrix: bool) -> Column:
    """Bias-corrected V; only observed cells are needed, since chi2 / n = sum(o^2 / (r c)) - 1."""
    n, r, k = F.col("n").cast("double"), F.col("levels_a").cast("double"), F.col("levels_b").cast("double")
    phi2 = F.greatest(F.col("s") - 1.0, F.lit(0.0))
    less = F.greatest(n - 1, F.lit(1.0))
    corrected = F.greatest(phi2 - (k - 1) * (r - 1) / less, F.lit(0.0))
    smaller = F.least(r - F.pow(r - 1, 2) / less - 1, k - F.pow(k - 1, 2) / less - 1)
    if matrix:
        return F.when((n > 1) & (smaller > 0), F.sqrt(F.try_divide(corrected, smaller)))
    return F.when((r >= 2) & (k >= 2), F.sqrt(corrected / F.greatest(smaller, F.lit(CRAMER_FLOOR))))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    sums = _totals(_contingency(df, [_level(df, a), _level(df, b)], [(0, 1)]))
    return sums.agg(F.max(_cramer(matrix=False)).alias("value"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, count) of the observed combinations."""
    return S.nan_to_null(df).groupBy(S.q(a).alias("a"), S.q(b).alias("b")).agg(F.count(F.lit(1)).alias("count"))


def crosstab_wide(df: DataFrame, a: str, b: str) -> DataFrame:
    """The same as a table with one column per level of ``b``; absent combinations count 0."""
    pairs = S.nan_to_null(df).select(S.q(a).alias("__a"), S.q(b).alias("__b"))
    wide = pairs.groupBy("__a").pivot("__b").agg(F.count(F.lit(1)))
    return wide.select(S.q("__a").alias(a), *[F.coalesce(S.q(c), F.lit(0)).alias(c) for c in wide.columns[1:]])


# ---- mutual information ------------------------------------------------------------------


def quantile_bins(df: DataFrame, cols: list[str], bins: int = MI_BINS) -> dict[str, Column]:
    """Number of each value's quantile bin, right-closed with the lowest value included; equal edges merge."""
    x = {c: S.double_sql(df, c) for c in cols}
    grid = lambda parts: [i / parts for i in range(parts + 1)]
    sketches = [f"approx_count_distinct({x[c]}) AS u{i}" for i, c in enumerate(cols)]
    edges, info = quantiles(df, x, grid(bins), sketches)
    # the sketch only tells few values from many; few are counted exactly and get fewer bins
    few = [c for i, c in enumerate(cols) if info[f"u{i}"] <= 20 * bins]
    if few:
        row = df.selectExpr(*[f"count(DISTINCT {x[c]}) AS u{i}" for i, c in enumerate(few)]).first()
        levels = {c: row[f"u{i}"] for i, c in enumerate(few) if row[f"u{i}"] < bins}
        redo = {c: grid(n) for c, n in levels.items() if n >= 2}
        edges.update({c: [] for c in levels})
        if redo:
            edges.update(quantiles(df, {c: x[c] for c in redo}, redo)[0])
    out = {}
    for c in cols:
        above = " + ".join(f"int({x[c]} > {S.sql_double(e)})" for e in sorted(set(edges[c]) - {None})[1:-1]) or "0"
        out[c] = F.expr(f"CASE WHEN {x[c]} IS NOT NULL THEN {above} END")
    return out


def _binned(df: DataFrame, cols: list[str]) -> list[Column]:
    numbers = [c for c in dict.fromkeys(cols) if S.is_numeric(S.dtype_of(df, c))]
    made = quantile_bins(df, numbers) if numbers else {}
    return [made[c].cast("string") if c in made else _level(df, c) for c in cols]


def normalized_mi(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information over the larger entropy, numeric columns cut at quantiles."""
    cells = settle(_contingency(df, _binned(df, [x, y]), [(0, 1)]))
    n = cells.agg(F.sum("o")).first()[0]
    if not n:
        return _one(df, None)
    p, px, py = (F.col(c) / F.lit(float(n)) for c in ("o", "r", "c"))
    e = F.lit(MI_EPSILON)
    information = F.sum(p * (F.log(p + e) - F.log(px + e) - F.log(py + e)))
    # each level's cells carry shares of its total, so the sums run over levels
    hx, hy = -F.sum(p * F.log(px)), -F.sum(p * F.log(py))
    top = F.greatest(hx, hy)
    levels_a = F.round(F.sum(F.col("o") / F.col("r").cast("double")))
    levels_b = F.round(F.sum(F.col("o") / F.col("c").cast("double")))
    value = F.when((levels_a >= 2) & (levels_b >= 2), F.coalesce(F.when(top > 0, information / top), F.lit(0.0)))
    return cells.agg(value.alias("value"))


# ---- routing -----------------------------------------------------------------------------


def associate(df: DataFrame, x: str, y: str, method: str = "Auto") -> DataFrame:
    """(method, value): the named measure, or the one that fits the kinds of both columns."""
    kx, ky = (S.association_kind(S.dtype_of(df, c)) for c in (x, y))
    if method == "Auto":
        if kx == ky == "num":
            method = "Pearson"
        elif kx == ky == "cat":
            method = "Cramers V"
        else:
            cat = x if kx == "cat" else y
            method = "Point-biserial" if binary_levels(df, [cat])[cat] else "Correlation ratio"
    from .kendall import kendall

    if method == "Correlation ratio":
        if kx == ky:
            got = _one(df, None)
        else:
            got = correlation_ratio(df, *((x, y) if kx == "cat" else (y, x)))
    else:
        routes = {
            "Pearson": pearson, "Spearman": spearman, "Kendall": kendall, "Point-biserial": point_biserial,
            "Cramers V": cramers_v, "Normalized MI": normalized_mi,
        }
        if method not in routes:
            raise ValueError(f"method is Auto, Correlation ratio or one of {sorted(routes)}")
        got = routes[method](df, x, y)
    return got.select(F.lit(method).alias("method"), "value")


# ---- matrices ----------------------------------------------------------------------------


def _pearson_pairs(df: DataFrame, x: dict[str, str], min_rows: int) -> DataFrame:
    """All pairs of the named expressions from one Gram table, of values shifted by the column means to stay exact."""
    cols = list(x)
    means = df.selectExpr(*[f"avg({x[c]}) AS m{i}" for i, c in enumerate(cols)]).first()
    shift = [m if m is not None and math.isfinite(m) else 0.0 for m in means]
    sums = gram(df.selectExpr(*[f"{x[c]} - {S.sql_double(m)} AS d{i}" for i, (c, m) in enumerate(zip(cols, shift))]))
    va, vb = F.expr("qi - si * si / n"), F.expr("qj - sj * sj / n")
    # a constant column is left with rounding noise only
    ok = (F.col("n") >= max(1, min_rows)) & (va > F.col("qi") * 1e-13) & (vb > F.col("qj") * 1e-13)
    r = F.when(ok, F.expr("p - si * sj / n") / (F.sqrt(va) * F.sqrt(vb)))
    return _named_pairs(df, cols, sums.select("i", "j", r.alias("value"), "n"))


def _named_pairs(df: DataFrame, cols: list[str], found: DataFrame) -> DataFrame:
    """(col_a, col_b, value, n) for every pair of columns, of rows (i, j, value, n) of those that have any."""
    pairs = [(i, j, cols[i], cols[j]) for i, j in combinations_with_replacement(range(len(cols)), 2)]
    names = df.sparkSession.createDataFrame(pairs, "i int, j int, col_a string, col_b string")
    out = names.join(F.broadcast(found), ["i", "j"], "left")  # a row for each pair of columns, whatever the rows
    return out.select("col_a", "col_b", "value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _rank_columns(df: DataFrame, cols: list[str], rows_per_block: int | None) -> DataFrame:
    """The rank of each cell within its column, null for a missing cell."""
    plain = df.selectExpr(*[f"{S.double_sql(df, c)} AS x{i}" for i, c in enumerate(cols)])
    values = ", ".join(f"struct({i} AS no, x{i} AS v)" for i in range(len(cols)))
    long = plain.selectExpr(f"inline(array({values}))").filter("v IS NOT NULL")
    counts = settle(long.groupBy("no", "v").agg(F.expr("count(1) AS t")))
    ranks = settle(average_ranks(counts, "v", "t", ["no"], rows_per_block))
    out = plain
    for i in range(len(cols)):
        side = ranks.filter(F.col("no") == i).select(F.col("v").alias("__k"), F.col("rank").alias(f"r{i}"))
        out = out.join(side, F.col(f"x{i}") == F.col("__k"), "left").drop("__k", f"x{i}")
    return out


def corr_matrix(
    df: DataFrame, cols: list[str] | None = None, method: str = "pearson", rows_per_block: int | None = None
) -> DataFrame:
    """(col_a, col_b, value, n) over the numeric columns, booleans excluded."""
    cols = list(cols or S.number_columns(df))
    S.require(df, cols)
    pairs = list(combinations_with_replacement(cols, 2))
    x = {c: S.double_sql(df, c) for c in cols}
    if method == "pearson":
        return _pearson_pairs(df, x, 2)
    if method == "spearman":
        counts = df.selectExpr("count(1) AS rows", *[f"count({x[c]}) AS n{i}" for i, c in enumerate(cols)]).first()
        full = [c for i, c in enumerate(cols) if counts[f"n{i}"] == counts["rows"]]
        # a column ranks alike in all pairs of complete columns; other pairs rank their common rows
        parts = []
        if full:
            ranks = _rank_columns(df, full, rows_per_block)
            made = {c: f"r{i}" for i, c in enumerate(full)}
            parts.append(_pearson_pairs(ranks, made, 2))
        rest = [p for p in pairs if not (p[0] in full and p[1] in full)]
        one = lambda a, b: spearman(df, a, b, rows_per_block)
    elif method == "kendall":
        from .kendall import kendall

        parts, rest, one = [], pairs, lambda a, b: kendall(df, a, b)
    else:
        raise ValueError("method is one of pearson, spearman, kendall")
    if rest:
        n = df.selectExpr(
            *[f"count_if({x[a]} IS NOT NULL AND {x[b]} IS NOT NULL) AS n{i}" for i, (a, b) in enumerate(rest)]
        ).first()
        for i, (a, b) in enumerate(rest):
            names = F.lit(a).alias("col_a"), F.lit(b).alias("col_b")
            parts.append(one(a, b).select(*names, "value", F.lit(n[f"n{i}"]).cast("bigint").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numeric_correlations(df: DataFrame, top_k: int = 20, min_abs: float = 0.4) -> DataFrame:
    """(col_a, col_b, corr): the strongest Pearson pairs; none without numeric columns."""
    if not S.numeric_columns(df):
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    strong = corr_matrix(df).filter((F.col("col_a") != F.col("col_b")) & (F.abs("value") >= min_abs))
    ranked = strong.orderBy(F.abs("value").desc(), "col_a", "col_b").limit(top_k)
    return ranked.select("col_a", "col_b", F.col("value").alias("corr"))


def cramers_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, value, n) over the non-numeric columns, the diagonal by the same formula."""
    cols = list(cols or [f.name for f in df.schema if not S.is_numeric(f.dataType)])
    S.require(df, cols)
    table = settle(pair_counts(df.select(*[_level(df, c).alias(f"c{i}") for i, c in enumerate(cols)])))
    # a level's totals in a pair count the rows that have both columns
    rows = table.groupBy("i", "j", "a").agg(F.sum("o").alias("r"))
    columns = table.groupBy("i", "j", "b").agg(F.sum("o").alias("c"))
    sums = _totals(table.join(rows, ["i", "j", "a"]).join(columns, ["i", "j", "b"]), ["i", "j"])
    return _named_pairs(df, cols, sums.select("i", "j", _cramer(matrix=True).alias("value"), "n"))


def _mixed_pairs(df: DataFrame, cats: list[str], nums: list[str]) -> DataFrame:
    """Point-biserial for two-level categories, else eta, for every category and measure.

    Both follow from the level means: r on 0/1 codes is eta with the sign of the difference.
    """
    plain = df.select(
        *[S.as_double(df, c).alias(f"z{j}") for j, c in enumerate(nums)],
        *[_level(df, c).alias(f"c{i}") for i, c in enumerate(cats)],
    )
    at = ", ".join(f"struct({i} AS cat, c{i} AS level)" for i in range(len(cats)))
    values = [f"z{j}" for j in range(len(nums))]
    wide = plain.selectExpr(*values, f"inline(array({at}))").filter("level IS NOT NULL")
    aggs = [
        F.expr(f"{fn}({v}) AS {t}{j}")
        for j, v in enumerate(values)
        for t, fn in (("n", "count"), ("m", "avg"), ("v", "var_pop"))
    ]
    levels = wide.groupBy("cat", "level").agg(*aggs)
    cells = ", ".join(f"struct({j} AS num, n{j} AS n, m{j} AS m, v{j} AS v)" for j in range(len(nums)))
    long = levels.selectExpr("cat", "level", f"inline(array({cells}))")
    filled = F.col("n") > 0
    means = long.groupBy("cat", "num").agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mu"),
        F.count(F.lit(1)).alias("levels"),
        F.count_if(filled).alias("present"),
        (F.max_by("m", F.when(filled, F.col("level"))) - F.min_by("m", F.when(filled, F.col("level")))).alias("diff"),
    )
    # one row per pair of columns: its size is set by the schema
    sums = (
        long.filter(filled).select("cat", "num", F.col("n").alias("k"), "m", "v")
        .join(F.broadcast(means), ["cat", "num"])
        .groupBy("cat", "num", "n", "levels", "present", "diff")
        .agg(F.sum(F.col("k") * F.pow(F.col("m") - F.col("mu"), 2)).alias("ssb"), F.sum(F.col("k") * F.col("v")).alias("ssw"))
    )
    eta = F.when(F.col("ssb") + F.col("ssw") > 0, F.sqrt(F.col("ssb") / (F.col("ssb") + F.col("ssw"))))
    signed = (F.col("levels") == 2) & (F.col("present") == 2) & (F.col("n") >= 3)
    value = F.when(signed, F.signum("diff") * eta).otherwise(eta)
    name = lambda names, c: F.element_at(F.lit(names), F.col(c) + 1)
    return sums.select(name(cats, "cat").alias("c"), name(nums, "num").alias("z"), value.alias("value"), "n")


def association_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, value, n) over columns of any kind, values within [-1, 1]."""
    cols = list(cols or df.columns)
    S.require(df, cols)
    kind = {c: S.association_kind(S.dtype_of(df, c)) for c in cols}
    nums, cats = [c for c in cols if kind[c] == "num"], [c for c in cols if kind[c] == "cat"]
    parts = []
    if nums:
        x = {c: S.double_sql(df, c) for c in nums}
        parts.append(_pearson_pairs(df, x, 3))
    if cats:
        parts.append(cramers_matrix(df, cats))
    if nums and cats:
        found = _mixed_pairs(df, cats, nums)
        order = [(c, z, *sorted((c, z), key=cols.index)) for c in cats for z in nums]
        names = df.sparkSession.createDataFrame(order, "c string, z string, col_a string, col_b string")
        parts.append(
            names.join(found, ["c", "z"], "left").select(
                "col_a", "col_b", "value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", F.when(F.col("value").isNotNull(), F.greatest(F.least("value", F.lit(1.0)), F.lit(-1.0))))


# ---- points ------------------------------------------------------------------------------


def xy_points(df: DataFrame, x: str, y: str, sample_n: int | None = None, key: list[str] | None = None) -> DataFrame:
    """(x, y) as numbers, of all rows or of a repeatable sample."""
    rows = sample_rows(df, sample_n, key or [x, y]) if sample_n else df
    return rows.select(S.as_double(df, x).alias("x"), S.as_double(df, y).alias("y"))


def xy_grid(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(x_bin, y_bin, count) of the occupied cells of an even grid: the scatter of any number of rows."""
    a, b = S.as_double(df, x), S.as_double(df, y)
    r = df.agg(F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1")).first()
    if r["a0"] is None or r["b0"] is None:
        return df.sparkSession.createDataFrame([], "x_bin bigint, y_bin bigint, count bigint")

    def cell(v: Column, lo: float, hi: float) -> Column:
        if lo == hi:
            return F.lit(0).cast("bigint")
        return F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1).cast("bigint"))

    rows = df.filter(a.isNotNull() & b.isNotNull())
    return rows.groupBy(cell(a, r["a0"], r["a1"]).alias("x_bin"), cell(b, r["b0"], r["b1"]).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
