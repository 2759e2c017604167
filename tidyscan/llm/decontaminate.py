"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is leaked by a document that has at least ``SIMILARITY`` of the item's five-word shingles.  Short items vanish in long documents
as far as Jaccard similarity goes, so sizes are brought together first:

* items are partitioned by size: class c has those of up to 2^c and more than 2^(c-1) shingles;
* for each class every document is cut into windows of 1.5 x 2^c shingles, one starting every half 2^c, so a passage of an item's
  length lies whole in one of them, and the similarity of item and window stays above a quarter;
* a window's MinHash signature has the least hash in each of ``BINS`` bins (one hash per shingle).  Half-size
  segments are hashed once; windows, and the segments of larger classes, are minima of those;
* a window and an item of its class that agree in any bin are a candidate pair, verified at once by the exact share of
  the item's shingles among all the document's.

Items come in blocks of at most ``BLOCK`` shingles; the index of one block has a proven size and travels to the tasks, and all
documents pass by it.  Nothing is shuffled, so neither copies nor hot sources matter.

Edge cases: null texts, and texts and items of fewer than five words, have no shingles and match nothing; repeated rows and
items match each by itself; null ids stay; empty tables give an empty result; extra columns are kept by ``clean_of``.
Very long texts have more windows.  Ties don't occur, as every pair that meets the similarity is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SIMILARITY, ship
from .shingles import EMPTY, portions, shingles

ship(__name__)

BINS = 64
#: Most shingles of the items in one block.
BLOCK = 4_000_000


def size_class(size: int) -> int:
    return max(3, int(size - 1).bit_length())


class Index:
    """The items of one block: shingles, and by size class the least hash of each bin."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        hashes, first = shingles(texts)
        self.sets = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]
        keys: dict[int, dict[int, list[int]]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                bins = (s >> np.uint64(58)).astype(np.int64)
                least = s[np.concatenate(([True], bins[1:] != bins[:-1]))]  # sorted: a bin's first is its least
                for v in least.tolist():
                    keys.setdefault(size_class(len(s)), {}).setdefault(v, []).append(i)
        self.classes = sorted(keys)
        self.keys = keys
        self.sieve = {c: self._bits(np.array(list(k), np.uint64)) for c, k in keys.items()}

    @classmethod
    def of(cls, values: dict) -> Index:
        made = cls.__new__(cls)
        made.__dict__.update(values)
        return made

    @staticmethod
    def _bits(values: np.ndarray) -> np.ndarray:
        """A table that says "maybe" for the values and "no" for most others."""
        table = np.zeros(1 << 20, bool)
        table[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return table

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all pairs that meet the similarity."""
        if not self.classes:
            return []
        hashes, first = shingles(texts)
        if not len(hashes):
            return []
        counts = np.diff(first)
        owner = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(hashes)) - first[:-1][owner]
        half = 1 << (self.classes[0] - 1)
        per_text = -(-counts // half)
        begin = np.concatenate(([0], np.cumsum(per_text)))
        segment = begin[owner] + place // half
        least = np.full(int(begin[-1]) * BINS, EMPTY, np.uint64)
        np.minimum.at(least, segment * BINS + (hashes >> np.uint64(58)).astype(np.int64), hashes)
        least = least.reshape(-1, BINS)
        of = np.repeat(np.arange(len(texts)), per_text)
        pairs: set[tuple[int, int]] = set()
        for c in range(self.classes[0], self.classes[-1] + 1):
            if c in self.keys:
                pairs |= self._candidates(c, least, of)
            if c < self.classes[-1]:  # segments of the next class are pairs of these
                number = np.arange(len(of)) - np.searchsorted(of, of, "left")
                heads = np.flatnonzero(number % 2 == 0)
                least, of = np.minimum.reduceat(least, heads, axis=0), of[heads]
        found = []
        known: tuple[int, np.ndarray] = (-1, hashes[:0])
        for t, i in sorted(pairs):
            if known[0] != t:
                known = (t, np.unique(hashes[first[t] : first[t + 1]]))
            shared = int(np.isin(self.sets[i], known[1], assume_unique=True).sum())
            if shared >= SIMILARITY * len(self.sets[i]) - 1e-9:
                found.append((t, i, shared))
        return found

    def _candidates(self, c: int, least: np.ndarray, of: np.ndarray) -> set[tuple[int, int]]:
        windows = least
        for ahead in (1, 2):
            if len(of) > ahead:
                windows = windows.copy() if windows is least else windows
                same = np.flatnonzero(of[ahead:] == of[:-ahead])
                windows[same] = np.minimum(windows[same], least[same + ahead])
        maybe = self.sieve[c][(windows & np.uint64((1 << 20) - 1)).astype(np.int64)] & (windows != EMPTY)
        rows, columns = np.nonzero(maybe)
        found = set()
        for t, v in zip(of[rows].tolist(), windows[rows, columns].tolist()):
            found.update((t, i) for i in self.keys[c].get(v, ()))
        return found


def blocks_of(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items, a block at a time; the driver holds no more than one block's texts."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1] or "")
        size += len(texts[-1]) // 2 + 1  # a word and its blank take two characters at least
        if size >= BLOCK:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Index(ids, texts)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_shingles, containment) of documents and the items they leak."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, n_shared bigint, n_shingles bigint, containment double"
    item_arrow = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = spark.createDataFrame([], schema)
    for index in blocks_of(benchmark):
        held = spark.sparkContext.broadcast(vars(index))  # plain values: workers need not have the package

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index.of(held.value)
            for batch in batches:
                for start, texts in portions(batch.column(1).to_pylist()):
                    found = index.search(texts)
                    ids = batch.column(0).take(pa.array([start + t for t, _, _ in found], pa.int64()))
                    sizes = [len(index.sets[i]) for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([index.ids[i] for _, i, _ in found], item_arrow),
                         pa.array([n for _, _, n in found], pa.int64()), pa.array(sizes, pa.int64()),
                         pa.array([n / m for (_, _, n), m in zip(found, sizes)], pa.float64())],
                        names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"],
                    )

        out = out.union(docs.select("doc_id", "text").mapInArrow(search, schema))
    return out


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    spark = docs.sparkSession
    for index in blocks_of(benchmark):
        held = spark.sparkContext.broadcast(vars(index))  # plain values: workers need not have the package

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index.of(held.value)
            for batch in batches:
                kept = np.ones(batch.num_rows, bool)
                for start, texts in portions(batch.column(batch.num_columns - 1).to_pylist()):
                    kept[[start + t for t, _, _ in index.search(texts)]] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(kept))

        names = list(docs.columns)
        looked = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("__searched"))
        docs = looked.mapInArrow(keep, docs.schema)
    return docs


ORACLE_SQL = f"""
WITH w AS (SELECT doc_id, row_no, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT *, row_number() OVER () AS row_no FROM documents)),
v AS (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT DISTINCT row_no, doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM w)),
b AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM v)),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n)::BIGINT AS n_shingles, count(*) / any_value(n)::DOUBLE AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY row_no, doc_id, item_id HAVING count(*) >= {SIMILARITY} * any_value(n)
"""
