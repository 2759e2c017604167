"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

from .common import SHINGLE_WORDS, ship

ship(__name__)

#: Characters of the texts that a task looks at together.
CHARACTERS = 2_000_000
#: No shingle has this hash.
EMPTY = np.uint64(2**64 - 1)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (2**64 - 1) | 1) for k in range(SHINGLE_WORDS)]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' shingles in order, and where each text's begin (one more than texts)."""
    n, words, ends = SHINGLE_WORDS, [], [0]
    for t in texts:
        words += WORD.findall(t)
        ends.append(len(words))
    starts = np.array(ends, dtype=np.int64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)
    counts = np.maximum(np.diff(starts) - (n - 1), 0)
    first = np.concatenate(([0], np.cumsum(counts)))
    at = np.repeat(starts[:-1] - first[:-1], counts) + np.arange(first[-1])
    mixed = np.zeros(len(at), np.uint64)
    for k, m in enumerate(MULTIPLIERS):
        mixed += h[at + k] * m
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return np.minimum(mixed, EMPTY - np.uint64(1)), first


def portions(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts with their first index, of about ``CHARACTERS`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARACTERS or i == len(texts) - 1:
            yield start, [x or "" for x in texts[start : i + 1]]
            start, size = i + 1, 0
