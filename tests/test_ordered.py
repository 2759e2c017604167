"""Block-wise ordered computations equal the plain window in every row."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tidyscan.functions import quantiles as Q
from tidyscan.plans import ordered as O


def table(spark, n, seed, ties, groups=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = rnd.choice([None, 5.0, 5.0, 5.0]) if ties and rnd.random() < 0.5 else rnd.random() * 100
        value = None if rnd.random() < 0.4 else rnd.randint(0, 50)
        g = None if groups and rnd.random() < 0.1 else (0 if rnd.random() < 0.5 else rnd.randint(1, max(1, groups)))
        rows.append((i, key, value, g))
    return spark.createDataFrame(rows, "id long, key double, v int, g int")


CASES = [(False, 0, 7), (True, 0, 40), (False, 4, 7), (True, 4, 60), (True, 4, 100_000)]


@pytest.mark.parametrize("ties,groups,size", CASES)
def test_blocks_match_plain_window(spark, ties, groups, size):
    df = table(spark, 400, 3, ties, groups).coalesce(2).cache()
    group = ["g"] if groups else []
    w = Window.partitionBy(*group).orderBy(F.col("key").asc_nulls_last(), F.col("id").asc_nulls_last())
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    down = w.rowsBetween(0, Window.unboundedFollowing)
    names = ["pos", "fwd", "bwd", "roll", "low"]
    expected = {
        r["id"]: [r[c] for c in names]
        for r in df.select(
            "*",
            F.row_number().over(w).alias("pos"),
            F.last("v", ignorenulls=True).over(up).alias("fwd"),
            F.first("v", ignorenulls=True).over(down).alias("bwd"),
            F.sum("v").over(w.rowsBetween(-8, 0)).alias("roll"),
            F.min("v").over(w.rowsBetween(-2, 0)).alias("low"),
        ).collect()
    }
    b = O.blocks(df, ["key", "id"], group, rows_per_block=size)
    assert b.split == (size < 400)
    got = {}
    filled = O.carry(O.position(b, "pos"), {"fwd": (F.col("v"), "forward"), "bwd": (F.col("v"), "backward")})
    for r in filled.df.collect():
        got[r["id"]] = [r["pos"], r["fwd"], r["bwd"]]
    rolled = O.rolling(b, 9, lambda f: [F.sum("v").over(f(9)).alias("roll"), F.min("v").over(f(3)).alias("low")])
    count = 0
    for r in rolled.collect():
        got[r["id"]] += [r["roll"], r["low"]]
        count += 1
    assert count == 400
    assert got == expected


@pytest.mark.parametrize("kind", ["string", "date", "timestamp_ntz", "timestamp"])
def test_order_key_types(spark, kind):
    base = spark.range(300).select("id", (F.col("id") * 7919 % 300).alias("m"))
    made = {
        "string": F.format_string("key-%05d", "m"),
        "date": F.date_add(F.lit("2020-01-01"), F.col("m").cast("int")),
        "timestamp_ntz": F.make_interval(days=F.col("m").cast("int")) + F.lit("2020-01-01").cast("timestamp_ntz"),
        "timestamp": F.timestamp_seconds(F.col("m") * 1000),
        "long": F.col("m"),
    }[kind]
    df = base.withColumn("k", made)
    b = O.position(O.blocks(df, ["k", "id"], rows_per_block=20), "pos")
    assert b.df.select(O.BLOCK).distinct().count() > 5
    assert b.df.filter(F.col("pos") != F.col("m") + 1).count() == 0


def test_global_order_has_no_row_sized_single_partition(spark):
    df = spark.range(5000).withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id")))
    b = O.carry(O.blocks(df, ["id"], rows_per_block=500), {"f": (F.col("v"), "forward")})
    plan = b.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # only the table of block ends
    assert "Python" not in plan


@pytest.mark.parametrize("limit", [400, 100_000])
def test_exact_quantiles(spark, monkeypatch, limit):
    import numpy as np

    monkeypatch.setattr(Q, "INSIDE_LIMIT", limit)
    monkeypatch.setattr(Q, "PARTS", 16 if limit < 1000 else 4096)
    rnd = random.Random(9)
    rows = [
        (
            rnd.gauss(0, 1),
            7.0 if rnd.random() < 0.4 else rnd.random() * 10,
            None if rnd.random() < 0.9 else rnd.randint(0, 3),
            None,
            4.0,
        )
        for _ in range(3000)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, e double").cache()
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got, info = Q.quantiles(df, {c: c for c in df.columns}, probs, ["max(a) AS top"])
    for i, c in enumerate("abcde"):
        vals = [r[i] for r in rows if r[i] is not None]
        assert info["n"][c] == len(vals)
        if not vals:
            assert got[c] == [None] * 7
        else:
            assert np.allclose(got[c], np.percentile(vals, [100 * p for p in probs]), atol=1e-12)
    assert info["top"] == max(r[0] for r in rows)


def test_quantiles_of_values_of_all_sizes(spark, monkeypatch):
    """Doubles of every exponent and sign, with repeats, nulls, NaN and the least and greatest ones; selection down to single values."""
    import numpy as np

    monkeypatch.setattr(Q, "INSIDE_LIMIT", 1)
    rnd = random.Random(4)
    values = [rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.randint(-320, 307) for _ in range(2000)]
    values += [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 1.0 + 2**-52] * 5
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)] * 50, "v double")
    probs = [i / (len(values) - 1) for i in (0, 1, 5, 700, 1000, 1019, 1020, 1500, len(values) - 2, len(values) - 1)]
    got, info = Q.quantiles(df, {"v": "v"}, probs)
    assert info["n"]["v"] == len(values)
    exact = sorted(values)
    near = [exact[round(p * (len(values) - 1))] for p in probs]
    assert all(a == b or abs(a - b) <= 1e-9 * abs(b) for a, b in zip(got["v"], near))


def test_quantiles_of_many_columns_send_short_rows(spark, monkeypatch):
    """What reaches the driver is a row of six numbers for each wanted rank, whatever the columns; the jobs don't grow with them."""
    monkeypatch.setattr(Q, "INSIDE_LIMIT", 20)
    rows, seen = [], Q._pass

    def watched(*args):
        out = seen(*args)
        rows.append((len(out.columns), out.count(), len(args[2])))
        return out

    monkeypatch.setattr(Q, "_pass", watched)
    passes = {}
    for width in (2, 30):
        df = spark.range(3000).selectExpr(*[f"sin(id * {i + 1}) * {i + 1} AS c{i}" for i in range(width)])
        got, _ = Q.quantiles(df, {c: c for c in df.columns}, [0.5])
        assert len(got) == width and all(abs(v[0]) < 2 for v in got.values())
        assert all(columns == 6 and n <= 2 * width for columns, n, _ in rows)
        passes[width] = len(rows)
        rows.clear()
    assert passes[30] <= passes[2] + 1
