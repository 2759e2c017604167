"""Toxicity by a counterfactually regularised classifier.

A logistic regression on which words a text has, and which beginnings one, two or three of its words share: languages that
compound and inflect show an abusive stem in many forms.  Identity terms have no beginnings, so that a swap changes the two
terms' features and no others.  Each labelled text that mentions identity terms is also seen with
them swapped for others of their group, and the fit penalises the change of its score, so that the mere mention of a group
neither raises nor lowers a score.

Fitting takes a bounded sample of labelled rows (``MOST_ROWS``) and a bounded vocabulary (``MOST_WORDS``), chosen by how
surely a word's share of toxic texts differs from the overall share; scoring is an expression over all rows.

Edge cases: a null or empty text has no words and gets the score of the intercept; a null ``doc_id`` is never learnt from and not
held out; a null label is no label; repeated rows get equal scores and count once in the fit; empty tables of documents
give an empty result; without labels, or with none toxic, every score is next to 0; extra columns are ignored.  Very long texts
are read whole.  Words that tie for the last place of the vocabulary go by spelling.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import let, text_of
from .ranking import MOST_ROWS, held_out, training_labels

#: Words of the model, and the least number of sampled texts that must have one.
MOST_WORDS, LEAST_TEXTS = 800, 5
#: Weights of the penalties for large weights, and for score changes under swapped identity terms.
DECAY, SWAP_PENALTY = 1.0, 10.0
#: Terms that may stand for each other in a sentence without changing how toxic it is.
IDENTITY_GROUPS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["female", "male", "transgender"],
    ["gay", "straight", "lesbian", "bisexual"],
    ["black", "white", "asian", "latino"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["old", "young"],
    ["deaf", "blind", "disabled"],
    ["femmes", "hommes"],
    ["frauen", "männer"],
    ["mujeres", "hombres"],
]
#: Lengths of the beginnings of words.  They are written with a star for each of the text's distinct words that has one, up to three.
BEGINNINGS = (4, 5)
WORD_BREAK = r"[^\p{L}\p{M}\p{N}']+"


def word_set(text: Column) -> Column:
    """The distinct words of a text and their beginnings, other than those of identity terms."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != ""))

    def shared(starts: Column, k: int) -> Column:
        """Beginnings of more than k words, with k + 1 stars."""
        many = F.filter(starts, lambda x, i: F.get(starts, i - k) == x) if k else starts
        return F.transform(F.array_distinct(many), lambda x: F.concat(x, F.lit("*" * (k + 1))))

    def begun(w: Column, n: int) -> Column:
        starts = F.sort_array(F.filter(F.transform(w, lambda x: F.substring(x, 1, n)), lambda x: F.length(x) == n))
        return let(starts, lambda b: F.concat(*[shared(b, k) for k in range(3)]))

    terms = F.array(*[F.lit(t) for g in IDENTITY_GROUPS for t in g])
    return let(F.struct(words.alias("all"), F.array_except(words, terms).alias("rest")), lambda w: F.concat(
        w["all"], *[begun(w["rest"], n) for n in BEGINNINGS]))


@dataclass(frozen=True)
class Classifier:
    intercept: float
    weights: dict[str, float]

    def score(self, words: Column) -> Column:
        """Chance that a text with these (distinct) words is toxic."""
        if not self.weights:
            return F.lit(1 / (1 + float(np.exp(-self.intercept))))
        names = sorted(self.weights)
        known = F.array(*[F.lit(w) for w in names])
        by_word = F.create_map(*[x for w in names for x in (F.lit(w), F.lit(self.weights[w]))])
        total = F.aggregate(F.array_intersect(words, known), F.lit(self.intercept), lambda t, w: t + by_word[w])
        return 1 / (1 + F.exp(-total))


def swaps(present: set[str]) -> list[tuple[str, str]]:
    """(term, its replacement) for each identity term of a text and each other term of its group that the text lacks."""
    return [(a, b) for group in IDENTITY_GROUPS for a in group if a in present for b in group if b not in present]


def fit_words(texts: list[list[str]], y: np.ndarray, words: list[str]) -> Classifier:
    """Newton's method on the logistic loss plus both penalties.  ``texts`` has each text's words of the vocabulary."""
    if not len(y) or y.min() == y.max():
        return Classifier(-20.0 if not len(y) or y.max() == 0 else 20.0, {})
    place = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(texts), len(words) + 1), np.float32)
    x[:, -1] = 1
    changes: Counter = Counter()
    for i, t in enumerate(texts):
        x[i, [place[w] for w in t]] = 1
        changes.update(swaps(set(t)))
    curve = np.zeros((len(words) + 1, len(words) + 1))
    curve[np.arange(len(words)), np.arange(len(words))] = DECAY
    for (a, b), n in changes.items():  # a swap changes the score by w[b] - w[a]
        if a in place and b in place:
            i, j, c = place[a], place[b], SWAP_PENALTY * n
            curve[i, i] += c
            curve[j, j] += c
            curve[i, j] -= c
            curve[j, i] -= c
    w = np.zeros(len(words) + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + curve @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None].astype(np.float32)).T.astype(np.float64) @ x + curve + 1e-9 * np.eye(len(w)), slope)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(float(w[-1]), {t: float(v) for t, v in zip(words, w)})


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Classifier:
    sample = training_labels(labels.select("doc_id", "toxic"), "toxic", most)
    chosen = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")  # at most ``most`` rows of two numbers
    chosen = chosen.groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("r"))
    rows = chosen.select("doc_id", F.col("r.label").alias("label"), word_set(F.col("r.text")).alias("words"))
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    share = (toxic or 0) / max(1, n)
    by_word = rows.select(F.explode("words").alias("word"), "label").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
    surely = F.abs(F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    best = by_word.filter(F.col("n") >= LEAST_TEXTS).orderBy(surely.desc(), "word").limit(MOST_WORDS).collect()
    words = sorted({r["word"] for r in best} | {t for g in IDENTITY_GROUPS for t in g})
    known = F.array(*[F.lit(w) for w in words])
    seen = rows.select("doc_id", "label", F.array_intersect("words", known).alias("words")).orderBy("doc_id").collect()
    return fit_words([r["words"] for r in seen], np.array([r["label"] for r in seen], float), words)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """One row for each document: its score, and whether it counts as toxic."""
    model = fit(docs, labels, most)
    out = docs.select("doc_id", held_out().alias("held_out"), model.score(word_set(text_of())).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
