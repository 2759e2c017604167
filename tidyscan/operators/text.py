"""The text cleaning pipeline and what it leaves."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import schema as S, text as X
from ..plans.settle import settle


def clean_text(
    df: DataFrame,
    col: str,
    out: str | None = None,
    *,
    html: bool = True,
    keep_unicode: bool = False,
    lowercase: bool = True,
    punct: bool = True,
    numbers: bool = False,
    stopwords: bool = True,
    extra_stopwords: Iterable[str] = (),
    stemmer: Callable[[str], str] | None = None,
    in_place: bool = False,
) -> DataFrame:
    """Clean a text column into ``<col>_clean``, another name, or in place; missing text becomes empty.

    The steps always run in this order: markup, non-ASCII, case, punctuation, numbers, blanks,
    stop words, stems.  All but a caller's stemmer are expressions of one projection.
    """
    S.require(df, [col])
    c = F.coalesce(S.q(col).cast("string"), F.lit(""))
    if html:
        c = X.strip_html(c)
    if not keep_unicode:
        c = X.remove_non_ascii(c)
    if lowercase:
        c = F.lower(c)
    c = X.simplify(c, punct, numbers)
    if stopwords:
        c = F.array_join(X.remove_stopwords(F.split(c, " "), extra_stopwords), " ")
    if stemmer is not None:

        @F.pandas_udf("string")
        def stems(texts: pd.Series) -> pd.Series:
            known: dict[str, str] = {}

            def one(word: str) -> str:
                if word not in known:
                    known[word] = stemmer(word)
                return known[word]

            return texts.map(lambda t: " ".join(one(w) for w in t.split(" ")) if t else t)

        c = stems(c)
    return df.withColumn(col if in_place else out or f"{col}_clean", c)


def token_counts(df: DataFrame, col: str, top: int | None = 100) -> DataFrame:
    """(token, count, total): most frequent tokens next to the number of all tokens."""
    words = df.select(F.explode(F.split(S.q(col), X.BLANK_PATTERN)).alias("token")).filter("token <> ''")
    # the texts are read once; the total is that of the counts
    counts = settle(words.groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total")).first()["total"]
    first = counts.orderBy(F.col("count").desc(), "token")
    return (first if top is None else first.limit(top)).withColumn("total", F.lit(total).cast("bigint"))


def text_stats(df: DataFrame, col: str) -> DataFrame:
    """(rows, mean_length, empty) of a cleaned column."""
    length = F.length(S.q(col))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(length).alias("mean_length"), F.count_if(length == 0).alias("empty")
    )
