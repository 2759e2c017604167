"""Quality by Bradley-Terry ranking: scores learnt from preference pairs, cut at a quantile of the scores.

A good text is preferred to a bad one.  The chance that text i is preferred to j is the logistic function of the difference of
their scores, and a score is linear in the text's features, so the model is a logistic regression on feature differences of
pairs.  Texts count as good from the quantile of the training scores at the share of bad ones.

Fitting takes a bounded sample of labelled rows (``MOST_ROWS``, those with the least hashes of their id, the same at every run)
and ``PAIRS`` pairs of them, chosen with a fixed seed; scoring is an expression over all rows.

Edge cases: a null text is an empty one and gets a score like any other; a null ``doc_id`` is never learnt from and not held
out; a null label is no label; repeated rows get equal scores and count once in the fit; empty tables of documents give an empty
result; without labels, or with labels of one kind only, every score is the neutral one at the cut; extra columns are ignored.
Very long texts are measured whole.  Texts that tie at the cut are predicted alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .quality_rules import measured

MOST_ROWS = 20_000
PAIRS = 200_000
#: Weight decay of the regression, and the score at the cut.
DECAY = 1e-3
CUT_SCORE = 0.3
FEATURES = ["log_words", "symbols", "capitals", "repeats", "dup_lines", "word_length", "variety", "marks", "stops",
            "any_symbols", "any_repeats", "any_capitals"]


def features(m: str = "m") -> list[Column]:
    """The model's inputs, from the counts of a text only; all bounded."""
    c = lambda n: F.col(f"{m}.{n}").cast("double")
    words, chars, lines = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))
    share = lambda x: F.least(x, F.lit(1.0))
    symbols, repeats, capitals = share(c("n_symbols") / words), share(c("n_repeat_words") / words), share(c("n_capitals") / chars)
    return [
        F.log1p(words) / 10, symbols, capitals, repeats, share(c("n_dup_lines") / lines), share(chars / words / 20),
        c("n_distinct_words") / words, share(c("n_marks") / words), share(c("n_stops") / words),
        (symbols > 0.1).cast("double"), (repeats > 0.2).cast("double"), (capitals > 0.5).cast("double"),
    ]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, most: int = MOST_ROWS) -> DataFrame:
    """A bounded sample (doc_id, label) of the labels that may be learnt from; an id with several labels takes the least."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.min(label).alias("label"))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


@dataclass(frozen=True)
class Ranking:
    weights: list[float]
    cut: float

    def raw(self, x: list[Column]) -> Column:
        total = F.lit(0.0)
        for w, column in zip(self.weights, x):
            total = total + F.lit(w) * column
        return total

    def score(self, x: list[Column]) -> Column:
        """Between 0 and 1, rising with the ranking; ``CUT_SCORE`` at the cut."""
        shift = float(np.log(CUT_SCORE / (1 - CUT_SCORE)))
        return 1 / (1 + F.exp(-(self.raw(x) - F.lit(self.cut) + F.lit(shift))))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Weights by Newton's method on the logistic loss of the feature differences, and the cut."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking([0.0] * len(FEATURES), 0.0)
    rng = np.random.default_rng(seed)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        slope = d.T @ (p - 1) / pairs + DECAY * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + DECAY * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Ranking([float(v) for v in w], float(np.quantile(x @ w, len(bad) / (len(good) + len(bad)))))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Ranking:
    sample = training_labels(labels.select("doc_id", "quality"), "quality", most)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``most`` rows of two numbers
    m = measured(chosen).select("row.doc_id", F.col("row.label").alias("label"), F.array(*features()).alias("x"))
    # one row for each id: ids that repeat would pass the bound
    rows = m.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).orderBy("doc_id").collect()
    return fit_pairs(np.array([r["r"]["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["r"]["label"] for r in rows]))


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """One row for each document: its score, and whether that reaches the cut."""
    model = fit(docs, labels, most)
    m = measured(docs.select("doc_id", "text"))
    out = m.select("row.doc_id", F.array(*features()).alias("x"))
    score = model.score([F.get("x", i) for i in range(len(FEATURES))])
    return out.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= CUT_SCORE).cast("int"))
