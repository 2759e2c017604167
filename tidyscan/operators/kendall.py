"""Kendall's tau-b on any number of rows.

Distinct (x, y) pairs with counts are cut into value blocks along both axes; ties never span
blocks.  A concordant pair of rows is then counted exactly once:

* blocks differ on both axes: from the counts per grid cell, by prefix sums;
* same x block: inside that block;
* same y block but different x blocks: inside that y block.

The last two count order within one bounded block at a time, by merging, without making pairs.
A value that alone exceeds a block gets a block of its own, in which nothing needs counting.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans import ordered
from ..plans.settle import settle
from .association import _pairs

ROWS_PER_BLOCK = 200_000
MAX_BLOCKS = 4096
SAMPLE_PER_BLOCK = 100


def count_rising(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> float:
    """Weighted number of row pairs in which both keys rise strictly."""
    if len(first) < 2:
        return 0.0
    # within equal first keys the second falls, so a later larger second implies a larger first
    order = np.lexsort((-second, first))
    rank = np.unique(second, return_inverse=True)[1][order].astype(np.int64)
    w = weight[order].astype(np.float64)
    n, top = len(rank), int(rank.max()) + 1
    place = np.arange(n)
    total, size = 0.0, 1
    while size < n:
        node, right = place // (2 * size), (place // size) % 2 == 1
        key = node * top + rank
        left = np.argsort(key[~right], kind="stable")
        sorted_key = key[~right][left]
        cum = np.concatenate(([0.0], np.cumsum(w[~right][left])))
        upto = cum[np.searchsorted(sorted_key, key[right], "left")]
        start = cum[np.searchsorted(sorted_key, node[right] * top, "left")]
        total += float(((upto - start) * w[right]).sum())
        size *= 2
    return total


def _blocked(pairs: DataFrame, side: str, count: int, share: float) -> tuple[DataFrame, int]:
    """Rows with the number of their block along one axis, and how many blocks there are."""
    cuts: list[float] = []
    if count > 1:
        sample = sorted(pairs.select(side).sample(fraction=share, seed=31).toArrow()[side].to_pylist())
        picks = [sample[len(sample) * i // count] for i in range(1, count)] if sample else []
        repeated = {a for a, b in zip(picks, picks[1:]) if a == b}
        cuts = sorted(set(picks) | {math.nextafter(v, math.inf) for v in repeated})
    return ordered.bucket(pairs, side, cuts, f"b{side}"), len(cuts) + 1


def kendall(df: DataFrame, x: str, y: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    pairs = settle(_pairs(df, x, y))
    ties = lambda c: F.sum(c.cast("double") * (c - 1)) / 2
    head = pairs.agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("n"), ties(F.col("w")).alias("t")).first()
    spark = df.sparkSession
    if not head["rows"] or head["n"] < 2:
        return spark.createDataFrame([(None,)], "value double")
    tied = [
        pairs.groupBy(s).agg(F.sum("w").alias("t")).agg(F.lit(s).alias("side"), ties(F.col("t")).alias("t"))
        for s in ("x", "y")
    ]
    tie = {r["side"]: r["t"] for r in tied[0].unionAll(tied[1]).collect()}
    count = min(math.ceil(head["rows"] / rows_per_block), MAX_BLOCKS)
    share = min(1.0, 1.2 * SAMPLE_PER_BLOCK * count / head["rows"])
    cells, wide = _blocked(pairs, "x", count, share)
    cells, high = _blocked(cells, "y", count, share)

    def inside_x(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": [count_rising(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())]})

    def inside_y(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": [count_rising(pdf["bx"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())]})

    rising = _several_values(cells, "x").select("bx", "x", "y", "w").groupBy("bx").applyInPandas(inside_x, "c double")
    if count > 1:
        rising = rising.unionAll(
            _several_values(cells, "y").select("by", "bx", "y", "w").groupBy("by").applyInPandas(inside_y, "c double")
        )
        rising = rising.unionAll(_grid_pairs(cells, wide, high))
    concordant = rising.agg(F.sum("c")).first()[0] or 0.0
    every = head["n"] * (head["n"] - 1) / 2
    untied = every - tie["x"] - tie["y"] + head["t"]
    scale = math.sqrt(every - tie["x"]) * math.sqrt(every - tie["y"])
    value = (2 * concordant - untied) / scale if scale else None
    return spark.createDataFrame([(value,)], "value double")


def _several_values(cells: DataFrame, side: str) -> DataFrame:
    """Rows of the blocks that hold more than one value; the others contain only ties."""
    mixed = cells.groupBy(f"b{side}").agg(F.min(side).alias("lo"), F.max(side).alias("hi")).filter("lo < hi")
    keep = F.broadcast(mixed.select(F.col(f"b{side}").alias("__b")))  # at most MAX_BLOCKS * 2 rows
    return cells.join(keep, F.col(f"b{side}") == F.col("__b"), "left_semi")


def _grid_pairs(cells: DataFrame, wide: int, high: int) -> DataFrame:
    """Pairs of rows whose blocks rise strictly on both axes, one sum per column of the grid."""
    found = cells.groupBy((F.col("bx") * F.lit(high).cast("bigint") + F.col("by")).alias("cell"))
    found = found.agg(F.sum("w").cast("double").alias("w"))
    grid = cells.sparkSession.range(wide * high).join(found, F.col("id") == F.col("cell"), "left")
    grid = grid.select(
        F.floor(F.col("id") / high).alias("bx"), (F.col("id") % high).alias("by"), F.coalesce("w", F.lit(0.0)).alias("w")
    )
    below = Window.partitionBy("bx").orderBy("by").rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy("by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    summed = grid.withColumn("d", F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    summed = summed.withColumn("c", F.coalesce(F.sum("d").over(left), F.lit(0.0)) * F.col("w"))
    return summed.groupBy("bx").agg(F.sum("c").alias("c")).select("c")
