"""Exact quantiles of many columns without sorting or gathering a column.

The wanted order statistics are found by selection inside the cluster, the columns in long form.  Each pass counts the values of every open
bracket by a key that never falls as the value rises: first by sign and logarithm, then by even parts of the bracket, at last by
the values themselves.  Only counts travel, with each key's least and greatest value; running totals tell which key holds a wanted rank, and
that key's values are the next bracket.  A key of one value is the answer.  All columns share each pass, so the
number of jobs does not grow with them, no task holds a column, and one short row for each wanted rank reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from .schema import sql_double

#: Parts of an octave in the first pass, and of a bracket in those that follow.
OCTAVE_PARTS = 256
PARTS = 4096
#: Values up to which a bracket is counted by its values.
INSIDE_LIMIT = 100_000


@dataclass(frozen=True)
class _Bracket:
    """Values from ``lo`` to ``hi`` of a column, all of them without these; ``below`` are less."""

    name: str
    below: int
    inside: int
    lo: float | None = None
    hi: float | None = None

    def key(self, x: str) -> str:
        """A double that never falls as x rises."""
        if self.inside <= INSIDE_LIMIT:
            return x
        if self.lo is None:
            # logarithms of doubles lie between -1075 and 1024, so that the place is always positive
            place = f"floor(least(log2(abs({x})), 5000D) * {OCTAVE_PARTS}D) + 300000"
            return f"CASE WHEN {x} = 0 THEN 0D ELSE CAST(signum({x}) * ({place}) AS DOUBLE) END"
        lo, hi = sql_double(self.lo), sql_double(self.hi)
        return f"CAST(floor(({x} - {lo}) / ({hi} - {lo}) * {PARTS}D) AS DOUBLE)"

    def holds(self, x: str) -> str:
        if self.lo is None:
            return f"{x} IS NOT NULL"
        return f"{x} BETWEEN {sql_double(self.lo)} AND {sql_double(self.hi)}"


def _positions(n: int, p: float) -> tuple[float, int, int]:
    pos = p * (n - 1)
    return pos, math.floor(pos), math.ceil(pos)


def quantiles(
    df: DataFrame,
    exprs: dict[str, str],
    probs: list[float] | dict[str, list[float]],
    extra: list[str] | None = None,
) -> tuple[dict[str, list[float | None]], dict]:
    """Exact, linearly interpolated quantiles of each SQL expression over its values that are neither null nor NaN.

    Returns the quantiles per name, and a dictionary with the number of values of each name
    under ``n`` and the values of the ``extra`` aggregates, which ride on the counting job.
    """
    names = list(exprs)
    per_name = probs if isinstance(probs, dict) else {k: list(probs) for k in names}
    # adding zero makes -0.0 equal to 0.0
    cells = [f"nullif(CAST({exprs[k]} AS DOUBLE) + 0D, double('NaN')) AS __q{i}" for i, k in enumerate(names)]
    base = df.selectExpr("*", *cells)
    x = {k: f"__q{i}" for i, k in enumerate(names)}
    counts = [f"count({x[k]}) AS __n{i}" for i, k in enumerate(names)]
    head = base.selectExpr("count(1) AS __rows", *counts, *(extra or [])).first().asDict()
    n = {k: head.pop(f"__n{i}") for i, k in enumerate(names)}
    info = {"rows": head.pop("__rows"), "n": n, **head}

    wanted = {k: {r for p in per_name[k] for r in _positions(n[k], p)[1:]} for k in names if n[k] and per_name[k]}
    order = _select(base.select(*x.values()), x, {_Bracket(k, 0, n[k]): ranks for k, ranks in wanted.items()})
    result: dict[str, list[float | None]] = {}
    for k in names:
        values: list[float | None] = []
        for p in per_name[k]:
            if not n[k]:
                values.append(None)
                continue
            pos, i, j = _positions(n[k], p)
            a, b = order[k, i], order[k, j]
            values.append(a if i == j or a == b else (j - pos) * a + (pos - i) * b)
        result[k] = values
    return result, info


def _select(df: DataFrame, x: dict[str, str], brackets: dict[_Bracket, set[int]]) -> dict[tuple[str, int], float]:
    """The values at the wanted ranks of each bracket's column."""
    found: dict[tuple[str, int], float] = {}
    while brackets:
        numbered = list(brackets)
        following: dict[_Bracket, set[int]] = {}
        for row in _pass(df, x, numbered, [brackets[b] for b in numbered]).collect():
            b = numbered[row["b"]]
            if row["lo"] == row["hi"]:
                found[b.name, row["rank"]] = row["lo"]
            else:
                part = _Bracket(b.name, b.below + row["below"], row["n"], row["lo"], row["hi"])
                following.setdefault(part, set()).add(row["rank"])
        brackets = following
    return found


def _pass(df: DataFrame, x: dict[str, str], brackets: list[_Bracket], ranks: list[set[int]]) -> DataFrame:
    """Rows (b, rank, below, n, lo, hi): for each wanted rank of each bracket the key that holds it."""
    cells = []
    for name in dict.fromkeys(b.name for b in brackets):
        c = x[name]
        # the brackets of a column are disjoint
        cases = " ".join(f"WHEN {b.holds(c)} THEN struct({i} AS b, {b.key(c)} AS k, {c} AS v)" for i, b in enumerate(brackets) if b.name == name)
        cells.append(f"CASE {cases} END")
    rows = df.selectExpr(f"inline(filter(array({', '.join(cells)}), c -> c IS NOT NULL))")
    keys = rows.groupBy("b", "k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # a bracket has no more keys than the parts or values that it is cut into
    before = Window.partitionBy("b").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = keys.withColumn("below", F.sum("n").over(before) - F.col("n"))
    wanted = [(i, r, r - b.below) for i, b in enumerate(brackets) for r in sorted(ranks[i])]
    places = df.sparkSession.createDataFrame(wanted, "b int, rank long, place long")
    here = (F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.col("n"))
    return keys.join(F.broadcast(places), "b").filter(here).select("b", "rank", "below", "n", "lo", "hi")
