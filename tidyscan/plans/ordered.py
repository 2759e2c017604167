"""Ordered computations (positions, running totals, fills, rolling windows) over any number of rows.

A window without a partition, or one over a group that holds a third of the table, would put its
rows into one task.  Here such groups are cut into blocks by ranges of the order key:

* block borders come from a random sample of the whole order key; they steer only the balance of
  the blocks, never the result, because every row's block is a fixed function of its key.  The driver sees a bounded sample
  for at most ``MAX_RANGES`` ranges; more blocks are cut out of these inside the cluster;
* windows run inside (group, block);
* a summary of one row per (group, block) carries totals or last values across the borders.

Groups below the block size stay whole and take no part in the summary.  The order must be total: give a
key plus a unique tie-break column.  Missing keys sort last.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import schema as S
from .settle import settle

ROWS_PER_BLOCK = 250_000
SAMPLE_PER_BLOCK = 20
#: Blocks up to which their summary, a row each, is sent to every task; above it, the join is left to Spark.
BROADCAST_BLOCKS = 100_000
BLOCK = "__block"
#: Ranges that borders from the driver's sample cut; more blocks than these are cut again inside the cluster.
MAX_RANGES = 1000
_INF = float("inf")
_WHOLE = -1  # block of the groups that are not cut


@dataclass(frozen=True)
class Blocks:
    """Rows tagged with their block, and how they are grouped and ordered."""

    df: DataFrame
    group: tuple[str, ...]
    order: tuple[str, ...]
    split: bool  # whether any group spans several blocks
    count: int = 1  # blocks of the whole table

    def window(self, reverse: bool = False):
        keys = [_descending(c) if reverse else _ascending(c) for c in self.order]
        return Window.partitionBy(*[S.q(g) for g in self.group], BLOCK).orderBy(*keys)

    def order_key(self) -> Column:
        return _key_of(self.order)

    def key_columns(self) -> list[str]:
        return [*self.group, BLOCK]

    def per_block(self, df: DataFrame):
        """Rows of the groups that are cut, by group and block; whole groups need no summary."""
        return df.filter(F.col(BLOCK) > _WHOLE).groupBy(*[S.q(k) for k in self.key_columns()])


def _ascending(name: str) -> Column:
    return S.q(name).asc_nulls_last()


def _descending(name: str) -> Column:
    return S.q(name).desc_nulls_first()


def bucket(df: DataFrame, name: str, borders: list[float], out: str) -> DataFrame:
    """Number of the half-open range between borders that each value falls into."""
    inner = sorted({b for b in borders if -_INF < b < _INF})
    if not inner:
        return df.withColumn(out, F.lit(0))
    cut = Bucketizer(splits=[-_INF, *inner, _INF], inputCol=name, outputCol=out, handleInvalid="keep")
    return cut.transform(df).withColumn(out, F.col(out).cast("int"))


def group_key(cols: list[str]) -> Column:
    """All group columns as one hashable join key, in which missing equals missing."""
    return F.struct(*[S.q(c).alias(f"k{i}") for i, c in enumerate(cols)])


def blocks(
    df: DataFrame,
    order_by: list[str],
    group_by: list[str] | None = None,
    rows_per_block: int | None = None,
    rows: int | None = None,
) -> Blocks:
    """Tag every row with its block; ``rows`` is the number of rows if the caller knows it."""
    limit = rows_per_block or ROWS_PER_BLOCK
    group, order = tuple(group_by or ()), tuple(order_by)
    if not order:
        raise ValueError("an ordered operator needs order_by: a key and a unique tie-break column")
    S.require(df, [*group, *order])
    whole = Blocks(df.withColumn(BLOCK, F.lit(0).cast("long")), group, order, False)

    rows = df.count() if rows is None else rows
    if rows <= limit:
        return whole
    count = math.ceil(rows / limit)  # blocks keep their size, so their number follows the rows
    hot = hot_count = None
    if group:
        sizes = df.groupBy(*[S.q(g) for g in group]).agg(F.count(F.lit(1)).alias("__n"))
        hot = settle(sizes.filter(F.col("__n") > limit).drop("__n"))  # at most rows / limit groups
        hot_count = hot.count()
        if not hot_count:
            return whole
    tagged = df.withColumn(BLOCK, _range_number(df, order, count, rows))
    if count > MAX_RANGES:
        tagged = _cut_again(tagged, order, count, rows)
    if hot is not None:
        marks = hot.select(group_key(list(group)).alias("__hot"))
        marks = F.broadcast(marks) if hot_count <= BROADCAST_BLOCKS else marks
        block = F.when(F.col("__hot").isNotNull(), F.col(BLOCK)).otherwise(F.lit(_WHOLE).cast("long"))
        tagged = tagged.join(marks, group_key(list(group)) == F.col("__hot"), "left")
        tagged = tagged.withColumn(BLOCK, block).drop("__hot")
    return Blocks(tagged, group, order, True, count)


def _range_number(df: DataFrame, order: tuple[str, ...], count: int, rows: int) -> Column:
    """Number of the range of the whole order key, out of at most ``MAX_RANGES``, by a search among borders from a bounded sample."""
    ranges = min(count, MAX_RANGES)
    share = min(1.0, 1.2 * SAMPLE_PER_BLOCK * ranges / rows)
    picked = df.select(*[S.q(c) for c in order]).sample(fraction=share, seed=29)
    # the sample is sorted by Spark, whose order of strings, decimals and missing keys is the one that counts
    sample = picked.orderBy(*[_ascending(c) for c in order]).collect()
    borders = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    if not borders:
        return F.lit(0).cast("long")
    types = [S.dtype_of(df, c) for c in order]
    lit = lambda row: F.struct(*[e for v, t in zip(row, types) for e in (F.lit(v is None), F.lit(v).cast(t))])
    return _place(F.array(*[lit(b) for b in borders]), F.lit(len(borders)), _key_of(order), len(borders)).cast("long")


def _key_of(order: tuple[str, ...]) -> Column:
    """The whole order as one comparable value, missing parts last."""
    return F.struct(*[e for c in order for e in (S.q(c).isNull(), S.q(c))])


def _place(borders: Column, n: Column, key: Column, most: int) -> Column:
    """How many of the n sorted borders are not above the key, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(most, 1).bit_length()))])
    further = lambda at, step: (at + step <= n) & (F.get(borders, at + step - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def _cut_again(tagged: DataFrame, order: tuple[str, ...], count: int, rows: int) -> DataFrame:
    """Every range in parts of its own, by borders that are sampled, sorted and joined in the cluster."""
    share = min(1.0, 1.2 * SAMPLE_PER_BLOCK * count / rows)
    parts = math.ceil(count / MAX_RANGES)
    sample = tagged.select(F.col(BLOCK).alias("__range"), _key_of(order).alias("__k")).sample(fraction=share, seed=31)
    keys = sample.groupBy("__range").agg(F.sort_array(F.collect_list("__k")).alias("__keys"))  # some 20 keys a part
    every = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("__keys", F.floor(F.size("__keys") * i / parts).cast("int")))
    borders = settle(keys.select("__range", F.array_distinct(every).alias("__borders")))
    joined = tagged.join(borders, F.col(BLOCK) == F.col("__range"), "left")
    part = F.coalesce(_place(F.col("__borders"), F.size("__borders"), _key_of(order), parts), F.lit(0))
    return joined.withColumn(BLOCK, F.col(BLOCK) * parts + part).drop("__range", "__borders")


def _attach(b: Blocks, rows: DataFrame, summary: DataFrame, names: list[str]) -> DataFrame:
    """Summary columns next to each row of their (group, block)."""
    keys = b.key_columns()
    side = summary.select(group_key(keys).alias("__key"), *names)
    if not b.group and b.count <= BROADCAST_BLOCKS:
        side = F.broadcast(side)  # a row for each block
    return rows.join(side, group_key(keys) == F.col("__key"), "left").drop("__key")


def _before(b: Blocks):
    w = Window.partitionBy(*[S.q(g) for g in b.group]).orderBy(BLOCK)
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _after(b: Blocks):
    w = Window.partitionBy(*[S.q(g) for g in b.group]).orderBy(F.col(BLOCK).desc())
    return w.rowsBetween(Window.unboundedPreceding, -1)


def running_total(b: Blocks, value: Column, out: str, inclusive: bool = True) -> Blocks:
    """Sum of ``value`` over all rows up to this one within the group."""
    w = b.window().rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    tagged = b.df.withColumn("__add", value)
    inside = F.sum("__add").over(w) - (F.lit(0) if inclusive else F.col("__add"))
    rows = tagged.withColumn("__within", inside)
    if not b.split:
        return Blocks(rows.withColumn(out, F.col("__within")).drop("__add", "__within"), b.group, b.order, False)
    totals = b.per_block(tagged).agg(F.sum("__add").alias("__sum"))
    summary = totals.withColumn("__offset", F.coalesce(F.sum("__sum").over(_before(b)), zero))
    done = _attach(b, rows, summary, ["__offset"]).withColumn(out, F.col("__within") + F.coalesce("__offset", zero))
    return Blocks(done.drop("__add", "__within", "__offset"), b.group, b.order, True, b.count)


def position(b: Blocks, out: str) -> Blocks:
    """Row number from 1 within the group."""
    return running_total(b, F.lit(1).cast("long"), out)


def carry(b: Blocks, cols: dict[str, tuple[Column, str]]) -> Blocks:
    """Last (``forward``) or next (``backward``) non-missing value of each expression, this row included."""
    n = range(len(cols))
    forward = [direction == "forward" for _, direction in cols.values()]
    tagged = b.df.select("*", *[e.alias(f"__s{i}") for i, (e, _) in enumerate(cols.values())])

    def inside(i: int) -> Column:
        # backward runs as a forward pass over the reversed order: frames that end at the
        # partition's last row are evaluated quadratically
        w = b.window(reverse=not forward[i]).rowsBetween(Window.unboundedPreceding, 0)
        return F.last(f"__s{i}", ignorenulls=True).over(w)

    rows = tagged.select("*", *[inside(i).alias(f"__w{i}") for i in n])
    values = [F.col(f"__w{i}") for i in n]
    spare = [f"__{t}{i}" for t in "sw" for i in n]
    if b.split:

        def edge(i: int) -> Column:
            at = F.when(F.col(f"__s{i}").isNotNull(), b.order_key())
            return (F.max_by if forward[i] else F.min_by)(F.col(f"__s{i}"), at)

        def across(i: int) -> Column:
            return F.last(f"__e{i}", ignorenulls=True).over(_before(b) if forward[i] else _after(b))

        ends = b.per_block(tagged).agg(*[edge(i).alias(f"__e{i}") for i in n])
        ends = ends.select("*", *[across(i).alias(f"__c{i}") for i in n])
        names = [f"__c{i}" for i in n]
        rows = _attach(b, rows, ends, names)
        spare += names
        values = [F.coalesce(f"__w{i}", f"__c{i}") for i in n]
    done = rows.withColumns(dict(zip(cols, values))).drop(*spare)
    return Blocks(done, b.group, b.order, b.split, b.count)


def rolling(b: Blocks, width: int, make) -> DataFrame:
    """Trailing windows of up to ``width`` rows.

    ``make(frame)`` maps a frame function (rows -> WindowSpec) to the output columns, so that
    windows of several widths share one sort; ``width`` is the widest of them.
    """
    if not b.split:
        return b.df.select("*", *make(_frames(b.window()))).drop(BLOCK)
    with_pos = running_total(b, F.lit(1).cast("long"), "__pos")
    sizes = b.per_block(b.df).agg(F.count(F.lit(1)).alias("__n"))
    ahead = (
        Window.partitionBy(*[S.q(g) for g in b.group]).orderBy(BLOCK).rowsBetween(1, max(1, width - 1))
    )
    # the rows before each later block; a block reads the last width - 1 rows ahead of it, which may
    # come from several small blocks
    summary = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(_before(b)), F.lit(0).cast("long")))
    later = F.collect_list(F.struct(F.col(BLOCK).alias("block"), F.col("__offset").alias("offset"))).over(ahead)
    reach = F.col("__offset") + F.col("__n") + F.lit(width - 1)
    summary = summary.withColumn("__later", later).withColumn(
        "__later", F.filter("__later", lambda t: t.getField("offset") < reach)
    )
    rows = _attach(b, with_pos.df, summary.select(*[S.q(k) for k in b.key_columns()], "__later"), ["__later"])
    none = F.array().cast("array<struct<block:bigint,offset:bigint>>")
    copies = F.filter(F.coalesce("__later", none), lambda t: t.getField("offset") < F.col("__pos") + F.lit(width - 1))
    targets = F.concat(F.array(F.col(BLOCK)), F.transform(copies, lambda t: t.getField("block")))
    spread = rows.withColumn("__home", F.col(BLOCK)).withColumn(BLOCK, F.explode(targets))
    w = Window.partitionBy(*[S.q(g) for g in b.group], BLOCK).orderBy("__pos")
    done = spread.select("*", *make(_frames(w))).filter(F.col("__home") == F.col(BLOCK))
    return done.drop(BLOCK, "__home", "__pos", "__later")


def _frames(w):
    return lambda rows: w.rowsBetween(-(rows - 1), 0)


def finish(b: Blocks) -> DataFrame:
    return b.df.drop(BLOCK)
