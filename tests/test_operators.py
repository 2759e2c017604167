"""Edge cases on hand-made tables, checked against pandas or against plain definitions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidyscan.functions import schema as S
from tidyscan.operators import (
    association as A, encode as E, merge as J, missing as M, outliers as O, profile as P, report, text as C,
    timeseries as D, types as T, univariate as U,
)
from tidyscan.operators.kendall import count_rising, kendall


def one(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(
        [
            (1, 5.0, None, float("nan"), 0, None, {"a": 1, "b": 2}, "x"),
            (2, 5.0, None, 1.0, 1, None, {"b": 2, "a": 1}, None),
            (3, 5.0, None, None, 1, None, None, "x"),
        ],
        "id long, flat double, none double, holes double, bit int, empty_int int, m map<string,int>, s string",
    ).cache()


def test_missing_values_of_both_kinds(edge):
    got = {r["column"]: r["missing"] for r in P.missing_counts(edge).collect()}
    assert got == {"id": 0, "flat": 0, "none": 3, "holes": 2, "bit": 0, "empty_int": 3, "m": 1, "s": 1}
    over = P.overview_stats(edge).first()
    assert (over["rows"], over["cols"], over["n_duplicates"]) == (3, 8, 0)
    assert over["missing_pct"] == pytest.approx(100 * 10 / 24)
    assert P.duplicate_count(edge.select("m", "flat")).first()[0] == 1  # maps compare by content


def test_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string, t timestamp_ntz")
    over = P.overview_stats(df).first()
    assert (over["rows"], over["missing_pct"], over["n_duplicates"]) == (0, 0.0, 0)
    assert {r["column"]: r["unique"] for r in P.nunique(df).collect()} == {"a": 0, "b": 0, "t": 0}
    assert P.infer_schema(df).count() == 3
    assert P.suggest_actions(df).filter("rule <> 'near_binary'").count() == 0
    assert U.histogram(df, "a").count() == 0
    assert one(A.pearson(df, "a", "a")) is None and one(kendall(df, "a", "a")) is None
    assert O.compute_bounds(df, ["a"]) == {"a": (-math.inf, math.inf)}


def test_logical_types(spark, edge):
    got = {r["column"]: r["type"] for r in P.infer_schema(edge).collect()}
    assert got == {
        "id": "numeric", "flat": "numeric", "none": "numeric", "holes": "numeric", "bit": "boolean",
        "empty_int": "boolean", "m": "nested", "s": "categorical",
    }
    long = spark.createDataFrame([(f"word {i} " * 12, f"2024-01-{i % 28 + 1:02d}") for i in range(40)], "t string, d string")
    assert [r["type"] for r in P.infer_schema(long).collect()] == ["text", "datetime"]


def test_quick_stats(edge):
    got = {r["column"]: r for r in P.column_quick_stats(edge).collect()}
    assert (got["flat"]["std"], got["flat"]["p50"], got["none"]["min"]) == (0.0, 5.0, None)
    assert (got["bit"]["true_count"], got["bit"]["false_count"]) == (2, 1)
    assert (got["s"]["unique"], got["s"]["top"], got["m"]["unique"]) == (1, "x", 1)


def test_schema_tables(edge):
    assert {r["kind"]: r["columns"] for r in P.type_counts(edge).collect()} == {
        "numeric": 6, "categorical": 1, "datetime": 0, "boolean": 0,
    }
    assert P.dtypes_table(edge).first()["dtype"] == "bigint"
    assert P.domain_profile(["Order_ID", "customer_id", "SKU", "x"]) == "retail"
    assert P.domain_profile(["device_id"]) == "telemetry" and P.domain_profile(["gcp"]) == "cloud-cost"
    assert P.domain_profile(["a"]) == "generic"


def test_approximate_counts(spark):
    df = spark.range(1000).selectExpr("id % 10 AS a", "CASE WHEN id % 2 = 0 THEN 'x' END AS b")
    assert {r["column"]: r["unique"] for r in P.nunique(df, approx=True).collect()} == {"a": 10, "b": 1}


def test_sampling_repeats(spark):
    df = spark.range(500)
    a = P.sample_rows(df, 50, ["id"], 3).collect()
    assert a == P.sample_rows(df.repartition(7), 50, ["id"], 3).collect()
    assert a != P.sample_rows(df, 50, ["id"], 4).collect()
    assert [r["id"] for r in P.preview(df, 3, "tail", ["id"]).collect()] == [497, 498, 499]


def test_report_tables(spark, edge):
    got = report.summary_report(edge, {"edge": edge})
    assert {k: v.count() for k, v in got.items() if k != "advice"} == {
        "overview": 1, "meta": 1, "schema": 8, "preview": 3, "logical_types": 8, "cardinality": 8,
        "quick_stats": 8, "correlations": 1, "datasets": 1,
    }


# ---- missing values ----------------------------------------------------------------------


def test_fill_rules(spark):
    df = spark.createDataFrame(
        [(1, None, None, "a", None), (2, 4, 1.0, None, None), (3, None, 5.0, "a", None), (4, 7, None, "b", None)],
        "id long, n int, x double, s string, full double",
    )
    got = M.fill_missing(df, {"n": "mean", "x": "drop_rows", "s": "mode", "id": "drop_column"})
    # the mean is taken before rows are dropped; id has no gaps, so its plan has no effect
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(2, 4.0, 1.0, "a", None), (3, 5.5, 5.0, "a", None)]
    kept = M.fill_missing(df, {"n": {"method": "constant", "value": "many"}, "full": "mode"})
    assert [r["n"] for r in kept.orderBy("id").collect()] == [None, 4, None, 7]
    assert kept.filter("full IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        M.fill_missing(df, {"n": "ffill"})
    with pytest.raises(ValueError):
        M.fill_missing(df, {"s": "mean"})
    assert "interpolate" in M.missing_choices(df)["x"] and "mean" not in M.missing_choices(df)["s"]


def test_interpolation_edges(spark):
    vals = [None, 1.0, None, None, 7.0, None, 3.0, None, None]
    df = spark.createDataFrame(list(enumerate(vals)), "i long, v double")
    for block in (2, 3, None):
        got = [r["v"] for r in M.fill_missing(df, {"v": "interpolate"}, ["i"], block).orderBy("i").collect()]
        assert got == [None, 1.0, 3.0, 5.0, 7.0, 5.0, 3.0, 3.0, 3.0]


# ---- outliers and distributions ----------------------------------------------------------


def test_flat_column_has_no_bounds(spark):
    df = spark.createDataFrame([(3.0,)] * 9 + [(None,)], "x double")
    assert O.compute_bounds(df, ["x"], "zscore")["x"] == (-math.inf, math.inf)
    assert O.compute_bounds(df, ["x"], "mad")["x"] == (-math.inf, math.inf)
    assert O.compute_bounds(df, ["x"], "percentile", p_low=60, p_high=40)["x"] == (-math.inf, math.inf)
    assert O.compute_bounds(df, ["x"])["x"] == (3.0, 3.0)
    assert O.treat_outliers(df, ["x"]).filter("x IS NULL").count() == 1
    assert O.treat_outliers(df, ["x"], action="drop").count() == 9
    assert O.treat_outliers(df, ["x"], action="drop", keep_nulls=True).count() == 10


@pytest.mark.parametrize("rule", ["auto", "sqrt", "sturges", "rice", "fd", "doane"])
def test_histogram_rules(spark, rule):
    rnd = np.random.default_rng(4)
    for values in (rnd.normal(size=300), rnd.exponential(size=257) * 10, np.array([2.0] * 20)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        counts, edges = np.histogram(values, bins=rule)
        got = U.histogram(df, "x", rule).orderBy("bin_no").collect()
        assert [r["count"] for r in got] == counts.tolist()
        assert np.allclose([r["bin"] for r in got], (edges[:-1] + edges[1:]) / 2)


def test_histogram_of_whole_numbers(spark):
    values = np.array([1, 1, 2, 2, 2, 3, 4, 4, 7] * 30)
    df = spark.createDataFrame([(int(v),) for v in values], "x long")
    assert [r["count"] for r in U.histogram(df, "x").orderBy("bin_no").collect()] == np.histogram(values, "auto")[0].tolist()


def test_value_counts_with_ties_and_maps(spark, edge):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("b",), ("c",)], "s string")
    assert [tuple(r) for r in U.value_counts(df, "s", 3).collect()] == [("a", 2, 33.33), ("b", 2, 33.33), ("c", 1, 16.67)]
    assert [r["count"] for r in U.value_counts(edge, "m").collect()] == [2, 1]


# ---- association -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        g = rnd.choice(["u", "v", None])
        k = rnd.choice(["p", "q", "r"])
        x = None if rnd.random() < 0.1 else rnd.randint(0, 12) + (4 if g == "u" else 0)
        y = None if rnd.random() < 0.1 else round(rnd.gauss(0, 2) + (x or 0), 1)
        rows.append((x, y, g, k, 1.0))
    schema = "x int, y double, g string, k string, flat double"
    df = spark.createDataFrame(rows, schema).cache()
    pdf = pd.DataFrame(rows, columns=["x", "y", "g", "k", "flat"])
    return df, pdf


def tau_b(x, y):
    c = d = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            c, d = c + (s > 0), d + (s < 0)
            tx, ty = tx + (x[i] == x[j]), ty + (y[i] == y[j])
    n = len(x) * (len(x) - 1) / 2
    return (c - d) / math.sqrt((n - tx) * (n - ty))


def test_numeric_measures(pairs):
    df, pdf = pairs
    full = pdf.dropna(subset=["x", "y"])
    assert one(A.pearson(df, "x", "y")) == pytest.approx(full["x"].corr(full["y"]))
    rho = full["x"].rank().corr(full["y"].rank())
    for block in (11, None):
        assert one(A.spearman(df, "x", "y", block)) == pytest.approx(rho)
    tau = tau_b(full["x"].tolist(), full["y"].tolist())
    for block in (20, 70, 200_000):
        assert one(kendall(df, "x", "y", block)) == pytest.approx(tau)
    for measure in (A.pearson, A.spearman, kendall):
        assert one(measure(df, "x", "flat")) is None


def test_rising_pairs_by_brute_force():
    rnd = np.random.default_rng(8)
    for n in (1, 2, 3, 17, 64, 100):
        a, b, w = rnd.integers(0, 8, n).astype(float), rnd.integers(0, 8, n).astype(float), rnd.integers(1, 4, n)
        want = sum(w[i] * w[j] for i in range(n) for j in range(n) if a[i] < a[j] and b[i] < b[j])
        assert count_rising(a, b, w) == want


def test_level_measures(pairs):
    df, pdf = pairs
    part = pdf.dropna(subset=["g", "y"])
    m1, m0 = part[part.g == "v"].y, part[part.g == "u"].y
    r = (m1.mean() - m0.mean()) / part.y.std() * math.sqrt(len(m0) * len(m1) / len(part) ** 2)
    assert one(A.point_biserial(df, "g", "y")) == pytest.approx(r)
    codes = (part.g == "v").astype(float)
    assert one(A.point_biserial(df, "y", "g", form="pearson")) == pytest.approx(codes.corr(part.y))
    assert one(A.point_biserial(df, "k", "y")) is None
    assert one(A.point_biserial(df, "g", "flat")) == 0.0
    part = pdf.dropna(subset=["k", "y"])
    mu = part.y.mean()
    between = sum(len(v) * (v.mean() - mu) ** 2 for _, v in part.groupby("k")["y"])
    assert one(A.correlation_ratio(df, "k", "y")) == pytest.approx(math.sqrt(between / ((part.y - mu) ** 2).sum()))
    assert one(A.correlation_ratio(df, "k", "flat")) == 0.0
    assert one(A.correlation_ratio(df, "k", "flat", form="matrix")) is None


def test_category_measures(pairs, spark):
    df, _ = pairs
    assert one(A.cramers_v(df, "g", "g")) == pytest.approx(1.0)
    assert one(A.cramers_v(df, "g", "flat")) is None
    assert one(A.normalized_mi(df, "k", "k")) == pytest.approx(1.0)
    assert one(A.normalized_mi(df, "k", "flat")) is None
    m = {(r["col_a"], r["col_b"]): r["value"] for r in A.association_matrix(df).collect()}
    assert len(m) == 15
    assert m[("y", "g")] == pytest.approx(one(A.point_biserial(df, "g", "y", form="pearson")))
    assert m[("y", "k")] == pytest.approx(one(A.correlation_ratio(df, "k", "y")))
    assert m[("x", "flat")] is None and m[("flat", "flat")] is None and m[("x", "x")] == pytest.approx(1.0)
    assert all(v is None or -1.0 <= v <= 1.0 for v in m.values())
    got = {r["method"] for x, y in (("x", "y"), ("g", "y"), ("y", "k"), ("g", "k")) for r in A.associate(df, x, y).collect()}
    assert got == {"Pearson", "Point-biserial", "Correlation ratio", "Cramers V"}
    for n in (0, 1, 2):
        small = df.limit(n)
        assert one(A.cramers_v(small, "g", "k")) is None or n == 2
        assert one(A.point_biserial(small, "g", "y")) is None


# ---- types, merges -----------------------------------------------------------------------


def test_dates(spark):
    texts = [
        "2024-02-29", "2023-02-29", "2024-01-05 10:30", "2024-01-05 10:30:15", "2024-01-05 10:30:15.25",
        "2024-01-05T10:30:15", "2024/01/05", "20240105", "03/04/2024", "2024", "word", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    show = lambda d: [str(r[0]) if r[0] else None for r in d.orderBy("i").select("t_dt").collect()]
    assert show(D.parse_datetime(df, "t")) == [
        "2024-02-29 00:00:00", None, "2024-01-05 10:30:00", "2024-01-05 10:30:15", "2024-01-05 10:30:15.250000",
        "2024-01-05 10:30:15", "2024-01-05 00:00:00", "2024-01-05 00:00:00", "2024-03-04 00:00:00", None, None, None,
    ]
    assert show(D.parse_datetime(df, "t", day_first=True))[8] == "2024-04-03 00:00:00"
    assert show(D.parse_datetime(df, "t", fmt="%d/%m/%Y"))[8] == "2024-04-03 00:00:00"
    utc = D.parse_datetime(df, "t", utc=True, replace=True)
    assert dict(utc.dtypes)["t"] == "timestamp"


def test_conversion(spark):
    df = spark.createDataFrame(
        [("1", "2.5", "yes"), (" 2 ", "3.5", "0"), ("nan", "1e3", "maybe"), (None, "x", None), ("1d", "inf", "T")],
        "a string, b string, c string",
    )
    got = T.convert_types(df, {"a": "float", "b": "integer", "c": "boolean"}).collect()
    assert [tuple(r) for r in got] == [
        (1.0, 2, True), (2.0, 4, False), (None, 1000, None), (None, None, None), (None, None, True)
    ]
    report_ = {r["column"]: r["invalid"] for r in T.conversion_report(df, {"a": "float", "b": "integer", "c": "boolean"}).collect()}
    assert report_ == {"a": 2, "b": 2, "c": 1}
    assert T.convert_types(df, {"a": {"to": "float", "policy": "drop"}, "c": {"to": "boolean", "policy": "drop"}}).count() == 3
    filled = T.convert_types(df, {"c": {"to": "boolean", "policy": "fill", "value": "no"}}).collect()
    assert [r["c"] for r in filled] == [True, False, False, None, True]
    rec = T.recommend_types(df)
    assert T.search_recommendations(rec, "free").count() + T.search_recommendations(rec, "low_v").count() >= 1


def test_merge_names(spark):
    a = spark.createDataFrame([(1, "p", 10), (None, "q", 20)], "k int, b string, v int")
    c = spark.createDataFrame([(1, "s", 7), (None, "t", 8), (5, "u", 9)], "k int, b string, w int")
    out = J.merge(a, c, "outer", ["k"], ["k"])
    assert out.columns == ["k", "b_x", "v", "b_y", "w"]
    assert sorted(map(str, ((r["k"], r["b_x"], r["b_y"]) for r in out.collect()))) == sorted(
        map(str, [(1, "p", "s"), (None, "q", "t"), (5, None, "u")])
    )
    assert J.merge(a, c).columns == ["k", "v", "k_y", "w"][:0] + ["k_x", "b", "v", "k_y", "w"]
    # the right key's name is also a column on the left: both get suffixes
    d = c.withColumnsRenamed({"k": "v", "b": "z"})
    assert J.merge(a, d, "left", ["k"], ["v"]).columns == ["k", "b", "v_x", "v_y", "z", "w"]
    with pytest.raises(ValueError):
        J.merge(a, c, "inner", ["k"], ["k"], ("", ""))
    with pytest.raises(ValueError):
        J.merge(a, c, "inner", ["k", "b"], ["k"])
    assert J.common_columns(a, c) == ["b", "k"]


# ---- text, time, encoding ----------------------------------------------------------------


def test_text_pipeline(spark):
    rows = [
        (None,), ("",), ("<script>var x = 1;</script><b>Don't</b> STOP the Café 42!",), ("The quick\tThe  fox_1",),
    ]
    df = spark.createDataFrame(rows, "t string")
    clean = lambda **o: [r[0] for r in C.clean_text(df, "t", "o", **o).select("o").collect()]
    assert clean() == ["", "", "don't stop caf 42", "quick fox_1"]
    assert clean(keep_unicode=True, numbers=True) == ["", "", "don't stop café", "quick fox_"]
    assert clean(lowercase=False, html=False, punct=False, stopwords=True)[3] == "The quick The fox_1"
    assert clean(stemmer=lambda w: w[:3], extra_stopwords=["STOP"]) == ["", "", "don caf 42", "qui fox"]
    done = C.clean_text(df, "t", in_place=True)
    assert done.columns == ["t"]
    assert [tuple(r) for r in C.token_counts(done, "t", 2).collect()] == [("42", 1, 6), ("caf", 1, 6)]
    assert tuple(C.text_stats(done, "t").first()) == (4, 7.0, 2)


FREQ = {
    "D": pd.date_range("2024-01-01", periods=10, freq="D"),
    "2D": pd.date_range("2024-01-01", periods=10, freq="2D"),
    "h": pd.date_range("2024-01-01", periods=30, freq="h"),
    "15min": pd.date_range("2024-01-01 00:07", periods=30, freq="15min"),
    "W-MON": pd.date_range("2024-01-01", periods=10, freq="W-MON"),
    "MS": pd.date_range("2024-01-01", periods=10, freq="MS"),
    "ME": pd.date_range("2024-01-31", periods=10, freq="ME"),
    "QS-OCT": pd.date_range("2024-01-01", periods=6, freq="QS"),
    "YE-DEC": pd.date_range("2020-12-31", periods=4, freq="YE"),
    "B": pd.bdate_range("2024-01-03", periods=12),
    "none": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-05", "2024-01-09"]),
    "twice": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-02", "2024-01-03"]),
    "short": pd.to_datetime(["2024-01-01", "2024-01-02"]),
}


@pytest.mark.parametrize("name", list(FREQ))
def test_frequencies(spark, name):
    df = spark.createDataFrame([(str(t),) for t in FREQ[name]], "t string")
    want = None if name in ("none", "twice", "short") else name
    assert one(D.infer_frequency(df, "t")) == want
    if want and len(FREQ[name]) > 2:
        assert pd.infer_freq(FREQ[name]) == want


def test_calendar(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2024-12-30",), (None,)], "t string")
    got = D.calendar_features(df, "t", D.CALENDAR).collect()
    assert list(got[0])[1:] == [2024, 1, 2, 9, 3, 29, 1, 0]
    assert got[1]["t_week"] == 1 and got[2]["t_year"] is None
    with pytest.raises(ValueError):
        D.calendar_features(df, "t", ["hour"])


def test_encoders(spark):
    rows = [(i, s, b, float(i)) for i, (s, b) in enumerate(
        [("a", True), ("a", False), ("b", True), (None, None), (None, True), ("c", False), ("b", True), ("a", True)]
    )]
    df = spark.createDataFrame(rows, "i long, s string, b boolean, y double")
    hot = E.one_hot(df, ["s"], 2).orderBy("i")
    # the levels on top are a and b; the missing level and c fall into the rest
    assert hot.columns == ["i", "b", "y", "s___other__", "s_a", "s_b"]
    assert [tuple(r)[3:] for r in hot.collect()][3:6] == [(1, 0, 0), (1, 0, 0), (1, 0, 0)]
    whole = E.one_hot(df, ["s"], 10)
    assert whole.columns[3:] == ["s_a", "s_b", "s_c"]
    assert {sum(tuple(r)[3:]) for r in whole.filter("i IN (3, 4)").collect()} == {0}
    assert E.one_hot(df, ["b"], 10, drop_first=True).columns == ["i", "s", "y", "b_True"]
    rank = lambda c: [r[c] for r in E.ordinal_encode(df, [c]).orderBy("i").collect()]
    assert rank("s") == [1, 1, 2, 3, 3, 4, 2, 1] and rank("b") == [1, 2, 1, 3, 1, 2, 1, 1]
    assert [r["s"] for r in E.frequency_encode(df, ["s"]).orderBy("i").collect()] == [3, 3, 2, 2, 2, 1, 2, 3]
    part = df.withColumn("y", F.when(F.col("s") != "c", F.col("y")))
    means = [r["s"] for r in E.target_encode(part, ["s"], "y").orderBy("i").collect()]
    assert means[0] == pytest.approx(8 / 3) and means[5] == pytest.approx((0 + 1 + 2 + 6 + 7) / 5)
    assert [r["s"] for r in E.topk_levels(df, "s", 1).orderBy("i").collect()] == ["a", "a"] + ["__other__"] * 5 + ["a"]
    advice = {r["column"]: r["levels"] for r in E.encoding_advice(df, ["s", "b"]).collect()}
    assert advice == {"s": 4, "b": 3} and E.candidates(df) == ["s", "b"]
    planned = {r["column"]: r["new_cols"] for r in E.encoding_plan(df, {"s": "one_hot", "b": "target", "i": "none"}, k=3).collect()}
    assert planned == {"s": 4, "b": 1, "i": 0}


def test_names_with_dots_and_quotes(spark):
    df = spark.createDataFrame([(1.0, "it's"), (2.0, "x"), (None, "x")], ["a.b", "c 'd'"])
    assert P.column_quick_stats(df).count() == 2
    assert P.missing_counts(df).filter("missing = 1").first()["column"] == "a.b"
    assert U.describe(df, ["a.b"]).first()["mean"] == 1.5
    assert A.association_matrix(df).count() == 3
    assert M.fill_missing(df, {"a.b": "median"}).filter("`a.b` IS NULL").count() == 0
    assert S.q("a.b") is not None


def test_defaults_take_every_column(spark):
    wide = spark.range(40).selectExpr("id AS k", *[f"id * {i + 1} % 17 AS c{i}" for i in range(24)])
    assert O.outlier_table(wide).select("column").distinct().count() == 25
    assert P.cardinality(wide).count() == 25 and M.missing_by_column(wide).count() == 25
    assert A.association_matrix(wide.select(*wide.columns[:23])).select("col_a").distinct().count() == 23


def test_nested_maps_dotted_names_and_no_numbers(spark):
    df = spark.sql("SELECT named_struct('m', map('a', 1, 'b', 2)) AS s UNION ALL SELECT named_struct('m', map('b', 2, 'a', 1))")
    assert U.value_counts(df, "s").count() == 1
    texts = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p")], ["a.b", "c.d"])
    assert A.numeric_correlations(texts).count() == 0
    assert {tuple(r) for r in A.crosstab_wide(texts, "a.b", "c.d").collect()} == {("x", 1, 1), ("y", 1, 0)}


def test_quantiles_with_infinite_values(spark, monkeypatch):
    """A third of the values infinite, at both ends, through the narrowing passes."""
    from tidyscan.functions import quantiles

    monkeypatch.setattr(quantiles, "INSIDE_LIMIT", 50)
    cell = "CASE id % 10 WHEN 0 THEN double('Infinity') WHEN 1 THEN double('Infinity') WHEN 2 THEN -double('Infinity') ELSE double(id) END AS v"
    df = spark.range(3000).selectExpr(cell)
    want = sorted(r["v"] for r in df.collect())
    probs = [0.0, 0.05, 0.3, 0.5, 0.75, 0.9, 1.0]
    found, info = quantiles.quantiles(df, {"v": "v"}, probs)
    assert info["n"]["v"] == 3000
    for p, got in zip(probs, found["v"]):
        place = p * 2999
        low, high = want[math.floor(place)], want[math.ceil(place)]
        assert got == pytest.approx(low if low == high else low + (place - math.floor(place)) * (high - low))


def test_outer_merge_leaves_no_full_join(spark):
    """A hot key and missing keys on both sides; each half of the join can be split by adaptive execution."""
    left = spark.range(60).selectExpr("CASE WHEN id < 20 THEN 1 WHEN id >= 30 THEN id END AS k", "id AS a")
    right = spark.range(9).selectExpr("CASE WHEN id < 3 THEN 1 WHEN id >= 6 THEN id + 55 END AS k", "id AS b")
    found = J.merge(left, right, "outer", ["k"], ["k"])
    assert "FullOuter" not in found._jdf.queryExecution().toString()
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == 20 * 3 + 10 * 3 + 30 + 3 and (61, None, 6) in rows and (None, 20, 3) in rows and (35, 35, None) in rows
    assert found.columns == ["k", "a", "b"] and found.dtypes[0] == ("k", "bigint")
