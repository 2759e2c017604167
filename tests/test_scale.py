"""Plans that must hold at any size: splitters, Gram tables, pair counts, digests, joins with hot keys, sparse histograms."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyscan.functions import pairwise
from tidyscan.operators import association as A, merge as J, profile as P, text as C, univariate as U
from tidyscan.plans import ordered as O


@pytest.mark.parametrize("ranges", [1000, 4])
def test_blocks_follow_the_whole_key(spark, monkeypatch, ranges):
    """Keys that agree in many characters and in the first column; blocks beyond the driver's ranges are cut in the cluster."""
    monkeypatch.setattr(O, "MAX_RANGES", ranges)
    rnd = random.Random(3)
    keys = [("Customer#" + "0" * 20 + f"{rnd.randint(0, 200):06d}" if rnd.random() < 0.9 else None, i) for i in range(3000)]
    df = spark.createDataFrame([(i, k, -t) for i, (k, t) in enumerate(keys)], "id long, k string, t long")
    b = O.position(O.blocks(df, ["k", "t"], rows_per_block=50), "place")
    found = {r["id"]: (r["place"], r[O.BLOCK]) for r in b.df.collect()}
    order = sorted(range(3000), key=lambda i: (keys[i][0] is None, keys[i][0] or "", -keys[i][1]))
    assert [found[i][0] for i in order] == list(range(1, 3001))
    blocks = [found[i][1] for i in order]
    sizes = collections.Counter(blocks)
    assert blocks == sorted(blocks) and 20 < len(sizes) <= 3 * 60 and max(sizes.values()) < 400


def test_the_sample_for_borders_is_bounded(spark, monkeypatch):
    """Whatever the number of blocks, no more than some twenty keys for each of the driver's ranges are read there."""
    monkeypatch.setattr(O, "MAX_RANGES", 5)
    frame = type(spark.range(1))
    read, collect = [], frame.collect

    def watched(self):
        rows = collect(self)
        read.append(len(rows))
        return rows

    monkeypatch.setattr(frame, "collect", watched)
    for rows_per_block in (2000, 20):
        read.clear()
        O.blocks(spark.range(20_000), ["id"], rows_per_block=rows_per_block)
        assert max(read) <= 5 * O.SAMPLE_PER_BLOCK * 3


def test_hot_groups_are_cut_and_others_whole(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 30 = 0 THEN NULL ELSE concat('g', id % 99) END AS g")
    b = O.position(O.blocks(df, ["id"], ["g"], rows_per_block=200), "place")
    rows = b.df.collect()
    want = collections.Counter()
    for r in sorted(rows, key=lambda r: r["id"]):
        want[r["g"]] += 1
        assert r["place"] == want[r["g"]]
    assert len({r[O.BLOCK] for r in rows if r["g"] == "hot"}) > 5 and {r[O.BLOCK] for r in rows if r["g"] == "g3"} == {O._WHOLE}


def test_gram_table_of_columns_with_gaps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[7, 5] = np.inf
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"c{i} double" for i in range(6)))
    for r in pairwise.gram(df).collect():
        a, b = x[:, r["i"]], x[:, r["j"]]
        ok = ~np.isnan(a) & ~np.isnan(b)
        a, b = a[ok], b[ok]
        assert r["n"] == ok.sum() and (math.isnan(r["p"]) == np.isinf(a * b).any())
        if not np.isinf(a * b).any():
            assert np.allclose([r["si"], r["sj"], r["qi"], r["qj"], r["p"]], [a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()])


def test_matrix_plans_do_not_grow_with_the_pairs(spark):
    """Eighty columns: the plan has the columns once or twice, not the 3,240 pairs."""

    def plan(width):
        df = spark.range(200).selectExpr(*[f"sin(id * {i + 1}) AS c{i}" for i in range(width)])
        return pairwise.gram(df)._jdf.queryExecution().optimizedPlan().toString()

    small, large = plan(8), plan(80)
    assert len(large) < 15 * len(small)
    df = spark.range(200).selectExpr(*[f"sin(id * {i + 1}) AS c{i}" for i in range(80)])
    found = A.corr_matrix(df)
    assert found.count() == 3240
    x = np.array([[math.sin(k * (i + 1)) for i in range(80)] for k in range(200)])
    want = np.corrcoef(x, rowvar=False)
    for r in found.filter("col_a = 'c3'").collect():
        assert abs(r["value"] - want[3, int(r["col_b"][1:])]) < 1e-9


def test_pair_counts_equal_counting(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [tuple(rnd.choice(["a", "b", "é", None, f"x{rnd.randint(0, 40)}"]) for _ in range(4)) for _ in range(800)]
    df = spark.createDataFrame(rows, "p string, q string, r string, s string").withColumn("s", F.lit(None).cast("string"))
    want = collections.Counter()
    for row in rows:
        row = (*row[:3], None)
        for i in range(4):
            for j in range(i, 4):
                if row[i] is not None and row[j] is not None:
                    want[i, j, row[i], row[j]] += 1
    for dense in (pairwise.DENSE, 4):
        monkeypatch.setattr(pairwise, "DENSE", dense)
        assert {tuple(r)[:4]: r["o"] for r in pairwise.pair_counts(df).collect()} == dict(want)


def test_duplicates_by_digest(spark):
    """Nulls in other places, repeats of wide rows, signed zeros and NaN; digests of two longs are what is shuffled."""
    rows = [(None, "a", 0.0), ("a", None, 0.0), ("a", None, -0.0), ("b", "b", float("nan")), ("b", "b", float("nan")), ("c", "c", 1.0)] + [("w" * 500, "z", 2.0)] * 4
    df = spark.createDataFrame(rows, "x string, y string, z double")
    facts = P.row_facts(df)
    assert (facts.rows, facts.duplicates) == (10, 1 + 1 + 3) and facts.missing == 3 + 2
    assert P.row_facts(df.limit(0)) == P.RowFacts(0, 0, 0) and P.row_facts(spark.range(50)).duplicates == 0
    assert tuple(P.overview_stats(df.limit(0)).first()) == (0, 3, 0.0, 0)


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_hot_keys_make_parts_that_can_be_split(spark, how):
    left = spark.range(40).selectExpr("CASE WHEN id % 8 = 0 THEN NULL ELSE id % 20 END AS k", "id AS a")
    right = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 50 = 1 THEN NULL ELSE id % 70 + 15 END AS k", "id AS b")
    plain = J.merge(left, right, how, ["k"], ["k"])
    if how == "right":
        left, right = right.withColumnRenamed("b", "a"), left.withColumnRenamed("a", "b")
        plain = J.merge(left, right, how, ["k"], ["k"])
    parts = J.merge(left, right, how, ["k"], ["k"], small_bytes=0)
    text = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in text and "RightOuter" not in text and "FullOuter" not in text and "Inner" in text
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, plain.collect()))
    assert J.has_hot_key(spark.range(500).selectExpr("id % 250 AS k"), ["k"], 0) is False


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_keys_of_many_pairs_are_dealt_to_a_grid(spark, how, monkeypatch):
    """Missing keys on both sides, few rows that make most pairs: all went to one task.  Rows that repeat stay as often as they are."""
    left = spark.range(1200).selectExpr("CASE WHEN id % 4 = 0 THEN NULL WHEN id % 7 = 0 THEN 5 ELSE id END AS k", "id % 500 AS a")
    right = spark.range(600).selectExpr("CASE WHEN id % 5 = 0 THEN NULL WHEN id % 9 = 0 THEN 5 ELSE 2 * id END AS k", "CAST(id % 250 AS DOUBLE) AS b")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        plain = J.merge(left, right, how, ["k"], ["k"])
        monkeypatch.setattr(J, "PAIRS_AT_ONCE", 500)
        dealt = J.merge(left, right, how, ["k"], ["k"], small_bytes=0)
        assert sorted(map(repr, dealt.collect())) == sorted(map(repr, plain.collect())) and dealt.dtypes == plain.dtypes
        matched = dealt.filter("k IS NULL AND a IS NOT NULL AND b IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()
        assert len(matched) > 2 and max(r["count"] for r in matched) < 300 * 120 / 2  # was one task
    finally:
        for name in conf:
            spark.conf.unset(name)


def test_sparse_histogram_has_runs_of_empty_bins(spark):
    df = spark.range(400).selectExpr("CASE WHEN id = 7 THEN 5000.0D ELSE sqrt(id) END AS v")
    dense = {r["bin_no"]: r["count"] for r in U.histogram(df, "v", "fd").collect()}
    sparse = U.sparse_histogram(df, "v", "fd").orderBy("bin_no").collect()
    spread = {r["bin_no"] + k: r["count"] for r in sparse for k in range(r["bins"])}
    assert spread == dense and len(sparse) < len(dense) / 10
    assert all(a["bin_no"] + a["bins"] == b["bin_no"] and abs(a["high"] - b["low"]) < 1e-9 for a, b in zip(sparse, sparse[1:]))
    far = spark.range(400).selectExpr("CASE WHEN id = 7 THEN 1e15 ELSE sqrt(id) END AS v")
    with pytest.raises(ValueError):
        U.histogram(far, "v", "fd")
    assert U.sparse_histogram(far, "v", "fd").agg(F.sum("count")).first()[0] == 400
    assert U.sparse_histogram(far.limit(0), "v", "fd").count() == 0


def test_token_counts_in_two_steps(spark):
    df = spark.createDataFrame([("b a a",), ("a c",), (None,), ("",)], "t string")
    assert [tuple(r) for r in C.token_counts(df, "t", 2).collect()] == [("a", 3, 5), ("b", 1, 5)]
    assert C.token_counts(df, "t", None).count() == 3 and C.token_counts(df.limit(0), "t", 2).count() == 0
