"""Sums and counts over all pairs of columns, in plans whose size grows with the columns and not with their pairs.

Tasks see a batch of rows as one block of all columns: sums of products are a matrix product, counts of pairs of levels are
counts of combined whole-number codes.  Each task sends one small table for all its rows, or for a batch of
them; rows themselves are never multiplied by the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Combined codes up to which counts are an array of that length; above it they are sorted.
DENSE = 1 << 18
GRAM = "i int, j int, n long, si double, sj double, qi double, qj double, p double"


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = s = q = p = odd = None
    for batch in batches:
        # columns beside each other; null becomes NaN
        x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        there = ~np.isnan(x)
        infinite = np.isinf(x)
        m, x = there.astype(float), np.where(there & ~infinite, x, 0.0)
        new = (m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x, infinite.T.astype(float) @ m)
        n, s, q, p, odd = new if n is None else (a + b for a, b in zip((n, s, q, p, odd), new))
    if n is None:
        return
    # sums that meet an infinite value are no numbers
    p = np.where((odd > 0) | (odd.T > 0), np.nan, p)
    i, j = np.triu_indices(len(n))
    columns = [i, j, n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
    types = [pa.int32(), pa.int32(), pa.int64()] + [pa.float64()] * 5
    yield pa.record_batch([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types)], ["i", "j", "n", "si", "sj", "qi", "qj", "p"])


def gram(df: DataFrame) -> DataFrame:
    """(i, j, n, si, sj, qi, qj, p) for the columns' numbers i <= j: over the rows that have both, their number, the sums of either
    and of its squares, and the sum of products."""
    sums = df.mapInArrow(_products, GRAM).groupBy("i", "j")
    return sums.agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "qi", "qj", "p")])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = [c.dictionary_encode() for c in batch.columns]
        codes = [np.asarray(c.indices.fill_null(-1), dtype=np.int64) for c in coded]
        names = [c.dictionary for c in coded]
        parts: list[tuple] = []
        for i, a in enumerate(codes):
            for j in range(i, len(codes)):
                b, wide = codes[j], max(len(names[j]), 1)
                if i == j:
                    both, high = a[a >= 0], len(names[i])
                else:
                    both, high = (a * wide + b)[(a >= 0) & (b >= 0)], len(names[i]) * wide
                if high <= DENSE:
                    counts = np.bincount(both, minlength=1)
                    found = np.flatnonzero(counts)
                    counts = counts[found]
                else:
                    found, counts = np.unique(both, return_counts=True)
                at, beside = (found, found) if i == j else (found // wide, found % wide)
                if len(found):
                    where = [pa.array(np.full(len(found), k, np.int32)) for k in (i, j)]
                    parts.append((*where, names[i].take(pa.array(at)), names[j].take(pa.array(beside)), pa.array(counts.astype(np.int64))))
        if parts:
            yield pa.record_batch([pa.concat_arrays([p[k] for p in parts]) for k in range(5)], ["i", "j", "a", "b", "o"])


def pair_counts(df: DataFrame) -> DataFrame:
    """(i, j, a, b, o): how often level a of column i meets level b of column j >= i, of text columns; nulls meet nothing."""
    met = df.mapInArrow(_codes, "i int, j int, a string, b string, o long")
    return met.groupBy("i", "j", "a", "b").agg(F.sum("o").alias("o"))
