"""Hard negatives of anchor vectors, found by segment summaries.

Every vector is cut into segments, of which mean and deviation are kept.  For two vectors a segment of m components adds to their
product at least m * (mean * mean - deviation * deviation) and at most m * (mean * mean + deviation * deviation).  Sums over the segments
bound the product; segments are halved until the bounds tell that a row can't be among those sought, and only the rest is scored exactly.

Rows are dealt into blocks of about ``ROWS`` by a hash of their id, anchors into blocks of ``ANCHORS``, and every block of anchors meets every
block of rows in one group, both of bounded size whatever a label's share.  First each group gives each anchor's best rows of its label, from
which its positives are taken; then, with each positive's bounds of score known, the best rows of other labels between them.

Rows without id, label or vector, or with a component that is null or not finite, take no part.  Rows that repeat an id count as one, that of the least
label and components.  A shorter vector counts as if filled up with zeros.  Ties go to the smaller id.  Components must be below 2^31
after scaling and products below 2^63; beyond that the operator raises.  Very long vectors only make blocks larger.  Columns
other than the three named don't matter.  Without anchors, or without rows of another label, the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import settled, ship

ship(__name__)

#: Rows and anchors that meet in one group.
ROWS = 32768
ANCHORS = 8192
#: Anchors whose bounds are looked at together.
TOGETHER = 32
#: Segments of the first look; each further look has twice as many, up to half the components.
FIRST_SEGMENTS = 8
POSITIVES = 5
NEGATIVES = 10

FOUND = "anchor_id long, positive_id long, row_id long, score long, positive_score long"


def whole_vectors(table: DataFrame, scale: int, flip: bool) -> DataFrame:
    """vec_id, label and components as whole numbers, of the rows that take part."""
    label = F.col("label").cast("long")
    if flip:
        label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    wide = F.transform("embedding", lambda x: x.cast("double"))
    fit = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = table.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fit)
    row = F.struct(label.alias("label"), F.transform(wide, lambda x: F.floor(x * scale)).alias("v"))
    return known.groupBy("vec_id").agg(F.min(row).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Whole numbers of list cells as one matrix, short ones filled up with zeros."""
    cells = column.combine_chunks()
    if isinstance(cells, pa.ChunkedArray):
        cells = pa.concat_arrays(cells.chunks) if cells.num_chunks else pa.array([], column.type)
    sizes = np.asarray(cells.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(cells.flatten(), dtype=np.int64)
    if len(flat) and np.abs(flat).max() >= 2**31:
        raise ValueError("a component is too large for exact products")
    made = np.zeros((len(sizes), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    made[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return made


def _width(*columns: pa.ChunkedArray) -> int:
    return max([pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns] + [1])


def summaries(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each vector's segments, each times the root of the segment's length, so that products of them add up."""
    cuts = np.array_split(np.arange(v.shape[1]), segments)
    means = np.stack([v[:, c].mean(axis=1) * len(c) ** 0.5 for c in cuts], axis=1)
    spread = np.stack([v[:, c].std(axis=1) * len(c) ** 0.5 for c in cuts], axis=1)
    return means, spread


class Bounded:
    """Row vectors with their summaries at every level, and exact products."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        self.rows, self.anchors = rows, anchors
        most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * rows.shape[1]
        if most >= 2.0**63:
            raise ValueError("products of these components may not fit a long")
        self.light = most < 2.0**52  # then products of doubles are exact
        if self.light:
            self.rows = rows.astype(np.float64)
        levels, n = [], min(FIRST_SEGMENTS, rows.shape[1])
        while True:
            levels.append(n)
            if n * 4 > rows.shape[1]:
                break
            n *= 2
        self.levels = [(summaries(rows, n), summaries(anchors, n)) for n in levels]
        #: Summaries are doubles: what they may be off by.
        self.slack = 1.0 + most * 1e-9

    def first(self, of: slice) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of some anchors' products with all rows."""
        (rm, rs), (am, as_) = self.levels[0]
        middle, reach = am[of] @ rm.T, as_[of] @ rs.T + self.slack
        return middle - reach, middle + reach

    def closer(self, level: int, anchor: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (rm, rs), (am, as_) = self.levels[level]
        middle, reach = rm[at] @ am[anchor], rs[at] @ as_[anchor] + self.slack
        return middle - reach, middle + reach

    def exact(self, anchor: int, at: np.ndarray) -> np.ndarray:
        if self.light:
            return (self.rows[at] @ self.anchors[anchor].astype(np.float64)).astype(np.int64)
        return self.rows[at] @ self.anchors[anchor]


def top_between(b: Bounded, anchor: int, ids: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, spans: list[tuple[float, float]], k: int):
    """For each span of scores, the k best rows among ``at`` within it, best first: a list of (places, scores).

    ``low`` and ``high`` bound the rows' scores.  Some rows with the highest bounds are scored first; from the k-th of them on, a
    lower row can be left out, and only rows that a span may still need are looked at more closely.
    """
    keep = np.zeros(len(at), bool)
    for least, most in spans:
        keep |= (high >= least) & (low <= most)
    at, low, high = at[keep], low[keep], high[keep]
    spans = list(spans)
    for level in range(1, len(b.levels) + 1):
        if len(at) <= 8 * k:
            break
        floors = []
        for least, most in spans:  # the k-th best of a few sure ones is a bound for all
            likely = (low + high) / 2
            fit = np.flatnonzero((high >= least) & (low <= most) & (likely <= most))
            if len(fit) > 4 * k:
                fit = fit[np.argpartition(-likely[fit], 4 * k)[: 4 * k]]
            s = b.exact(anchor, at[fit])
            s = np.sort(s[(s >= least) & (s <= most)])
            floors.append((max(least, float(s[-k])) if len(s) >= k else least, most))
        spans = floors
        keep = np.zeros(len(at), bool)
        for least, most in spans:
            keep |= (high >= least) & (low <= most)
        at, low, high = at[keep], low[keep], high[keep]
        if level < len(b.levels) and len(at):
            near_low, near_high = b.closer(level, anchor, at)
            low, high = np.maximum(low, near_low), np.minimum(high, near_high)
    scores = b.exact(anchor, at)
    found = []
    for least, most in spans:
        fit = np.flatnonzero((scores >= least) & (scores <= most))
        fit = fit[np.lexsort((ids[at[fit]], -scores[fit]))][:k]
        found.append((at[fit], scores[fit]))
    return found


def _long(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column, dtype=np.int64) if len(column) else np.zeros(0, np.int64)


def _table(parts: list[tuple]) -> pa.Table:
    names = ["anchor_id", "positive_id", "row_id", "score", "positive_score"]
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(5)]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def best_same(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Each anchor's best rows of its own label in one group."""
    if not anchors.num_rows or not rows.num_rows:
        return _table([])
    width = _width(anchors["anchor_v"], rows["v"])
    ids, labels, a_ids, a_labels = _long(rows["vec_id"]), _long(rows["label"]), _long(anchors["anchor_id"]), _long(anchors["anchor_label"])
    b = Bounded(_matrix(rows["v"], width), _matrix(anchors["anchor_v"], width))
    parts, everywhere = [], [(-np.inf, np.inf)]
    for start in range(0, len(a_ids), TOGETHER):
        low, high = b.first(slice(start, start + TOGETHER))
        for i in range(start, min(start + TOGETHER, len(a_ids))):
            at = np.flatnonzero((labels == a_labels[i]) & (ids != a_ids[i]))
            ((places, scores),) = top_between(b, i, ids, at, low[i - start, at], high[i - start, at], everywhere, POSITIVES)
            none = np.zeros(len(places), np.int64)
            parts.append((none + a_ids[i], ids[places], ids[places], scores, scores))
    return _table(parts)


def best_other(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The best rows of other labels for each positive of each anchor in one group, within the positive's bounds."""
    if not anchors.num_rows or not rows.num_rows:
        return _table([])
    width = _width(anchors["anchor_v"], rows["v"])
    ids, labels, a_ids, a_labels = _long(rows["vec_id"]), _long(rows["label"]), _long(anchors["anchor_id"]), _long(anchors["anchor_label"])
    positives = anchors["positives"].to_pylist()
    b = Bounded(_matrix(rows["v"], width), _matrix(anchors["anchor_v"], width))
    parts = []
    for start in range(0, len(a_ids), TOGETHER):
        low, high = b.first(slice(start, start + TOGETHER))
        for i in range(start, min(start + TOGETHER, len(a_ids))):
            spans = [(-(-30 * p["score"] // 100), 90 * p["score"] // 100) for p in positives[i]]
            at = np.flatnonzero(labels != a_labels[i])
            every = top_between(b, i, ids, at, low[i - start, at], high[i - start, at], spans, NEGATIVES)
            for p, (places, scores) in zip(positives[i], every):
                none = np.zeros(len(places), np.int64)
                parts.append((none + a_ids[i], none + p["row_id"], ids[places], scores, none + p["score"]))
    return _table(parts)


def _met(anchors: DataFrame, rows: DataFrame, row_blocks: int, anchor_blocks: int, task) -> DataFrame:
    """Every block of anchors with every block of rows."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    a = anchors.withColumn("a", dealt("anchor_id", anchor_blocks)).withColumn("b", each(row_blocks))
    r = rows.withColumn("row_b", dealt("vec_id", row_blocks)).withColumn("row_a", each(anchor_blocks))
    return a.groupBy("a", "b").cogroup(r.groupBy("row_a", "row_b")).applyInArrow(task, FOUND)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key; each block has already sent its own k best alone."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "row_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(table: DataFrame, scale: int = 256, every: int = 100, flip: bool = True) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose id is divisible by ``every``; components are scaled by ``scale`` and cut to whole numbers; ``flip`` moves
    the label of ids divisible by seven to the next of ten.
    """
    rows = settled(whole_vectors(table, scale, flip))
    named = [F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("anchor_v")]
    anchors = rows.filter(F.col("vec_id") % every == 0).select(*named)
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    row_blocks, anchor_blocks = -(-n // ROWS) or 1, -(-n_anchors // ANCHORS) or 1
    # no group has more than two executors' worth of the rows of a small table either
    row_blocks = max(row_blocks, min(8, -(-n // 1024)))
    best = _best(_met(anchors, rows, row_blocks, anchor_blocks, best_same), ["anchor_id"], POSITIVES)
    chosen = best.groupBy("anchor_id").agg(F.collect_list(F.struct("row_id", "score")).alias("positives"))
    with_positives = settled(anchors.join(chosen, "anchor_id"))
    negatives = _best(_met(with_positives, rows, row_blocks, anchor_blocks, best_other), ["anchor_id", "positive_id"], NEGATIVES)
    return negatives.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


ORACLE_SQL = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vecs AS (
  SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same,
         list_sum(list_transform(range(1, greatest(len(a.v), len(r.v)) + 1), lambda i: coalesce(a.v[i], 0) * coalesce(r.v[i], 0)))::BIGINT AS score
  FROM vecs a JOIN vecs r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.row_id)::INTEGER AS rank,
         s.row_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT * FROM ranked WHERE rank <= 10
"""
