"""Text cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# The built-in English stop words, in their published order.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with you your "
    "yours me my we our ours they their this those these i"
).split()

# What counts as markup, punctuation, digits and blanks.
BLOCK_PATTERN = r"(?is)<(script|style).*?>.*?(</\1>)"
TAG_PATTERN = r"(?s)<.*?>"
NON_ASCII_PATTERN = r"[^\x00-\x7F]"
PUNCTUATION_PATTERN = r"[^\p{L}\p{N}_\s\p{Z}']"
DIGIT_PATTERN = r"\p{Nd}+"
BLANK_PATTERN = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"


def strip_html(c: Column) -> Column:
    """Script and style blocks, then tags, become a blank."""
    cleaned = F.regexp_replace(F.regexp_replace(c, BLOCK_PATTERN, " "), TAG_PATTERN, " ")
    return F.when(F.contains(c, F.lit("<")), cleaned).otherwise(c)


def remove_non_ascii(c: Column) -> Column:
    return F.regexp_replace(c, NON_ASCII_PATTERN, "")


def remove_punct(c: Column) -> Column:
    """Keep letters, digits, underscores, blanks and apostrophes."""
    return F.regexp_replace(c, PUNCTUATION_PATTERN, " ")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, DIGIT_PATTERN, " ")


def normalize_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANK_PATTERN, " "))


def simplify(c: Column, punct: bool, numbers: bool) -> Column:
    """Punctuation and numbers, if asked for, and blanks in one pass: whole runs become one blank."""
    if punct:
        runs = r"(?:[^\p{L}\p{N}_']|\p{Nd})+" if numbers else r"[^\p{L}\p{N}_']+"
    elif numbers:
        runs = BLANK_PATTERN.replace(r"\s\p{Z}", r"\s\p{Z}\p{Nd}")
    else:
        runs = BLANK_PATTERN
    return F.trim(F.regexp_replace(c, runs, " "))


def tokenize(c: Column) -> Column:
    return F.filter(F.split(c, BLANK_PATTERN), lambda t: t != "")


def remove_stopwords(tokens: Column, extra: Iterable[str] = ()) -> Column:
    """Drop the built-in and the given words; tokens are compared as they are."""
    words = sorted({*STOP_WORDS, *(w.lower() for w in extra)})
    return F.filter(tokens, lambda t: ~t.isin(*words))
