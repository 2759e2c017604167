"""Weak supervision of quality: rules vote or abstain, and expectation-maximisation weighs them.

Nine rules look at a text and vote good (1), bad (-1) or abstain (0).  No rule decides by itself.  A rule that looks for a
defect abstains where it sees none.  The label model estimates each rule's accuracy from the votes of all documents, no label
is used, starting from a stated belief; a text's posterior probability of being good follows from its votes.

Only the numbers of documents per pattern of votes leave the cluster, at most 3^9 rows whatever the input;
expectation-maximisation runs on those.

Edge cases: a null text is an empty one; an empty text has no words and fails the base rule; rows that
repeat are judged alike, each by itself; a null ``doc_id`` stays; an empty table gives an empty result; extra columns are
left alone and may have any names.  Very long texts are counted whole.  A posterior of exactly ``KEEP_FROM`` keeps the text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SHINGLE_WORDS, let, settled, text_of, word_list

SYMBOLS = "#*$%&|<>"
MARKS = "!?"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rounds of expectation-maximisation, the posterior from which a text is kept.
ROUNDS = 25
KEEP_FROM = 0.5
#: What the model believes before it has seen votes: the share of good texts; how often each rule votes good and bad on good
#: texts, and good and bad on bad ones; and the number of documents that this belief weighs as much as, whatever the input.  A
#: bad text mostly has one defect of several.
PRIOR_GOOD, PRIOR_DOCUMENTS = 0.8, 100
_STYLE, _DEFECT = (0.95, 0.01, 0.7, 0.1), (0.0, 0.01, 0.0, 0.4)
BELIEFS = {
    "length": _STYLE, "sentences": _STYLE, "word_length": _STYLE,
    "symbols": _DEFECT, "letters": _DEFECT, "capitals": _DEFECT, "repeats": _DEFECT, "lines": _DEFECT, "variety": _DEFECT,
}


def without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, n: int = SHINGLE_WORDS) -> Column:
    """Number of words that lie in an n-word window occurring twice or more in the text."""
    none = F.lit(0)

    def of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - n)
        grams = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(F.size(h) >= n, let(grams, repeats)).otherwise(none)

    def repeats(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), none).otherwise(let(placed, twins))

    def twins(placed: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(placed, k)["g"] == x["g"], F.lit(False))
        found = F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda s, k: F.least(F.lit(n), F.coalesce(F.get(starts, k + 1) - s, F.lit(n))))
        return F.aggregate(reach, none, lambda total, x: total + x)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def measures(text: Column) -> Column:
    """A struct of counts of one text; all long."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = word_list(text)
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
    )
    of_lines = lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return let(
        text,
        lambda t: F.struct(
            without(t, SYMBOLS).cast("long").alias("n_symbols"),
            without(t, CAPITALS).cast("long").alias("n_capitals"),
            without(t, MARKS).cast("long").alias("n_marks"),
            without(t, ".").cast("long").alias("n_stops"),
            let(words, of_words).alias("w"),
            let(lines, of_lines).alias("l"),
        ),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_distinct_words", "n_lines",
            "n_marks", "n_stops"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (row, m): the whole input row, and its counts."""
    m = docs.select(F.struct("*").alias("row"), measures(text_of(text)).alias("x"))
    fields = [F.coalesce(F.col(p + c), F.lit(0)).alias(c) for c in MEASURES
              for p in ("x.w." if c in ("n_words", "word_chars", "n_repeat_words", "n_distinct_words")
                        else "x.l." if c in ("n_lines", "n_dup_lines") else "x.",)]
    return m.select("row", F.struct(*fields).alias("m"))


def base_failed(m: str = "m") -> Column:
    words = F.col(f"{m}.n_words")
    return (words < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * words)


def rules(m: str = "m") -> dict[str, Column]:
    """The rules' votes, by name."""
    words, chars, symbols, dup, repeat, capitals, distinct, lines, marks, stops = (F.col(f"{m}.{c}") for c in MEASURES)
    defect = lambda bad: F.when(bad, -1).otherwise(0)
    either = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    return {
        "length": either(words >= 30, words < 10),
        "sentences": either((50 * stops >= words) & (2 * stops <= words), (stops == 0) & (words >= 50)),
        "word_length": either((chars >= 3 * words) & (chars <= 12 * words), (chars < 2 * words) | (chars > 20 * words)),
        "symbols": defect(5 * symbols > words),
        "letters": defect(100 * (symbols + marks) > 8 * chars),
        "capitals": defect((2 * capitals > chars) & (words >= 5)),
        "repeats": defect(5 * repeat > words),
        "lines": defect(10 * dup > 3 * lines),
        "variety": defect((5 * distinct < words) & (words >= 50)),
    }


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts; of each rule the chances of a good and a bad vote on good texts, and on bad ones."""

    good: float
    chances: dict[str, tuple[float, float, float, float]]

    def weight(self, rule: str, vote: int) -> float:
        """Logarithm of how much likelier the vote (0: abstains) is on good texts than on bad ones."""
        a, b, c, d = self.chances[rule]
        on_good, on_bad = {1: (a, c), -1: (b, d), 0: (1 - a - b, 1 - c - d)}[vote]
        return math.log((on_good + 1e-3) / (on_bad + 1e-3))

    def posterior(self, votes: dict[str, Column]) -> Column:
        total = F.lit(math.log(self.good / (1 - self.good)))
        for name, v in votes.items():
            weights = [F.lit(self.weight(name, k)) for k in (1, -1, 0)]
            total = total + F.when(v == 1, weights[0]).when(v == -1, weights[1]).otherwise(weights[2])
        return 1 / (1 + F.exp(-total))


def fit(measured_docs: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """Estimate the label model from the votes of all rows."""
    votes = rules()
    names = list(votes)
    counts = measured_docs.select(*[v.alias(n) for n, v in votes.items()]).groupBy(*names).count()
    return estimate(sorted(tuple(r) for r in counts.collect()), names, rounds)  # at most 3^9 rows


def estimate(patterns: list[tuple[int, ...]], names: list[str], rounds: int = ROUNDS) -> LabelModel:
    """The label model of patterns of votes, each followed by how many rows have it, by expectation-maximisation."""
    total = sum(p[-1] for p in patterns)
    belief = PRIOR_DOCUMENTS
    model = LabelModel(PRIOR_GOOD, dict(BELIEFS))
    for _ in range(rounds):
        good = 0.0
        seen = {n: [0.0] * 4 for n in names}
        for *vote, n in patterns:
            odds = math.log(model.good / (1 - model.good)) + sum(model.weight(r, v) for r, v in zip(names, vote))
            p = 1 / (1 + math.exp(-odds))
            good += n * p
            for rule, v in zip(names, vote):
                if v:
                    seen[rule][0 if v == 1 else 1] += n * p
                    seen[rule][2 if v == 1 else 3] += n * (1 - p)
        sizes = [good + belief * PRIOR_GOOD, total - good + belief * (1 - PRIOR_GOOD)]
        chances = {
            n: tuple((seen[n][k] + BELIEFS[n][k] * (belief * PRIOR_GOOD if k < 2 else belief * (1 - PRIOR_GOOD))) / sizes[k // 2]
                     for k in range(4))
            for n in names
        }
        model = LabelModel(min(0.999, max(0.001, sizes[0] / (total + belief))), chances)
    return model


def judged(docs: DataFrame, model: LabelModel | None = None, text: str = "text") -> DataFrame:
    """Rows (row, m, base_failed, posterior, kept): every input row with its counts and the verdict.

    Without a model one is fitted to the votes of these rows; they are settled with their counts, as counting costs more than writing.
    """
    m = measured(docs, text) if model else settled(measured(docs, text))
    model = model or fit(m)
    out = m.select("row", "m", base_failed().alias("base_failed"), model.posterior(rules()).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each document: counts, verdict and posterior.  The counts are made once and settled."""
    m = settled(measured(docs.select("doc_id", "text")).select(F.struct("row.doc_id").alias("row"), "m"))
    model = fit(m)
    out = m.select(
        "row.doc_id", *[f"m.{c}" for c in MEASURES[:5]], base_failed().alias("base_failed"),
        model.posterior(rules()).alias("posterior"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    return judged(docs).filter("kept").select("row.*")
