"""How the sources of each language differ in their words, over the terms that enough documents hold.

The terms to keep are found by iceberg prefix refinement: a term in ``threshold`` documents has only beginnings in as many. Level by level
longer byte prefixes of the terms are counted, only of terms whose shorter prefix reached the threshold; a term not
longer than the level's prefix is complete and kept if it reaches it too. That ends when no incomplete prefix is left. Between levels travels a
membership map of at most 4 MiB of the surviving prefixes; it only saves counting, and thresholds are decided on exact counts.

Pairs of sources are compared in blocks: terms in buckets, sources in blocks of ``SIDE``, every pair of source blocks on each bucket.  Groups give the sum
over terms that occur in either block; terms that neither has add the same value each, by their number.

Nulls of text, lang and source count as ''.  Empty texts make their group occur, without terms.  Very long texts and terms are taken
whole.  Repeated rows are documents of their own.  Ties of a value go to the smaller item in UTF-8.  A language without kept terms has
pairs of value 0 and no terms; one of a single source has no pairs.  Columns other than the three named don't matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SLICES, SLICE_BITS, membership, settled, ship

ship(__name__)

THRESHOLD = 10
#: Length of the first prefixes in bytes, and how many times longer each level's are.
FIRST_PREFIX = 6
LONGER = 8
#: Entries, and languages or groups, that a task counts before it sends them on.
HELD = 500_000
LANGS = 5_000
#: Groups of language and source up to which their table, a short row each, is sent to all tasks.
FEW_GROUPS = 200_000
#: Terms in a bucket and sources in a block of the comparison.
BUCKET = 4096
SIDE = 64
TOP = 10
#: Bytes of UTF-8 to lower-case letters and blanks: those of characters outside ASCII stand for themselves.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Ends a complete term's prefix; no term has it.
STOP = b"\x00"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class Prefixes(dict):
    """From a term of one language to its prefix of the level, or to None if its beginning is known to be too rare; filled as asked."""

    def __init__(self, bits: bytes | None, lang: bytes, before: int, length: int):
        super().__init__()
        self.bits, self.seed, self.before, self.length = bits, xxhash.xxh64_intdigest(lang, 42), before, length

    def alive(self, prefix: bytes) -> bool:
        h = xxhash.xxh64_intdigest(prefix, self.seed)
        place = (h - 2**64 if h >= 2**63 else h) % (SLICES * SLICE_BITS)
        return bool(self.bits[place >> 3] >> (place & 7) & 1)

    def __missing__(self, term: bytes) -> bytes | None:
        if len(self) > HELD:
            self.clear()
        found = term[: self.length] if len(term) > self.length else term + STOP
        if self.bits is not None and not (len(term) > self.before and self.alive(term[: self.before])):
            found = None  # complete at an earlier level, or too rare
        self[term] = found
        return found


class Kept(Prefixes):
    """From a term of one language to whether it may be a kept one."""

    def __missing__(self, term: bytes) -> bool:
        found = self[term] = self.alive(term + STOP)
        return found


def _texts(batch: pa.RecordBatch, *names: str) -> list[list[bytes]]:
    return [batch.column(batch.schema.get_field_index(n)).cast(pa.binary()).to_pylist() for n in names]


def _same(value: bytes, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(value.decode(), pa.string()), n)


def prefix_counter(bits, before: int, length: int):
    """A task that gives lang, prefix and the number of its documents with a term of that prefix."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes: dict[bytes, Prefixes] = {}
        counts: dict[bytes, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                columns = [_same(lang, len(c)), pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())]
                yield pa.record_batch(columns, ["lang", "prefix", "docs"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(*_texts(batch, "lang", "text")):
                cut = prefixes.get(lang)
                if cut is None:
                    if len(prefixes) > LANGS:
                        prefixes.clear()
                    cut = prefixes[lang] = Prefixes(bits.value if bits else None, lang, before, length)
                found = set(map(cut.__getitem__, set(terms_of(text))))
                found.discard(None)
                held = counts[lang]
                held.update(found)
                if len(held) > HELD or len(counts) > LANGS:
                    yield from out()
        yield from out()

    return task


def term_counter(bits):
    """A task that gives lang, source, term and count of the terms that may be kept ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
        before = held = 0

        def out() -> Iterator[pa.RecordBatch]:
            known: dict[bytes, Kept] = {}
            for (lang, source), c in counts.items():
                may = known.get(lang) or known.setdefault(lang, Kept(bits.value, lang, 0, 0))
                terms = [w for w in c if may[w]]
                columns = [_same(lang, len(terms)), _same(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string())]
                yield pa.record_batch([*columns, pa.array(map(c.__getitem__, terms), pa.int64())], ["lang", "source", "term", "n"])
            counts.clear()

        for batch in batches:
            for lang, source, text in zip(*_texts(batch, "lang", "source", "text")):
                group = counts[lang, source]
                before = len(group)
                group.update(terms_of(text))
                held += len(group) - before
                if held > HELD or len(counts) > LANGS:
                    yield from out()
                    held = 0
        yield from out()

    return task


def _bits(keys: DataFrame, *names: str):
    """A broadcast membership map, one bounded piece of bytes."""
    made = bytearray(SLICES * SLICE_BITS // 8)
    for row in membership(F.xxhash64(*names), keys).collect():  # at most SLICES rows
        made[row["slice"] * SLICE_BITS // 8 : (row["slice"] + 1) * SLICE_BITS // 8] = row["bits"]
    return keys.sparkSession.sparkContext.broadcast(bytes(made))


def kept_terms(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """lang and term (both text) of the terms in at least ``threshold`` documents of their language."""
    found, bits, before, length = [], None, 0, FIRST_PREFIX
    while True:
        counted = docs.select("lang", "text").mapInArrow(prefix_counter(bits, before, length), "lang string, prefix binary, docs long")
        enough = counted.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= threshold)
        level = settled(enough.withColumn("whole", F.expr("right(hex(prefix), 2) = '00'")))
        found.append(level.filter("whole").select("lang", F.expr("substring(prefix, 1, length(prefix) - 1)").cast("string").alias("term")))
        incomplete = level.filter("not whole")
        if bits:
            bits.unpersist()
        if incomplete.isEmpty():
            return reduce(DataFrame.union, found)
        bits, before, length = _bits(incomplete, "lang", "prefix"), length, length * LONGER


def _parts_of(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (n + 2 * v)) in whole numbers of any size."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", whole(count + 2) * F.lit(10**9).cast("decimal(10,0)"), whole(n + 2 * v)) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def block_sums(key, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums over a bucket's terms for the pairs of two blocks of sources: what each term adds beyond a term that neither has."""
    lang, _, a, b = key
    if terms.empty:
        return _sums_frame(lang, [], [], [])
    groups = groups.sort_values("i")
    place = {i: k for k, i in enumerate(groups["i"])}
    none = groups["none"].to_numpy(np.int64)
    codes, names = pd.factorize(terms["term"])
    p = np.repeat(none[:, None], len(names), axis=1)
    p[terms["i"].map(place).to_numpy(), codes] = terms["p"].to_numpy(np.int64)
    f = lambda x, y: (x - y) * (x - y) // (x + y)
    at = groups["i"].to_numpy()
    mine = np.flatnonzero(at // SIDE == a)
    theirs = np.flatnonzero(at // SIDE == b)
    i, j, sums = [], [], []
    for k in mine:
        others = theirs[at[theirs] > at[k]] if a == b else theirs
        more = (f(p[k], p[others]) - f(none[k], none[others])[:, None]).sum(axis=1)
        i += [int(at[k])] * len(others)
        j += at[others].tolist()
        sums += more.tolist()
    return _sums_frame(lang, i, j, sums)


def _sums_frame(lang: str, i: list[int], j: list[int], sums: list[int]) -> pd.DataFrame:
    names = pd.Series([lang] * len(i), dtype=object)
    return pd.DataFrame({"lang": names, "i": np.array(i, np.int32), "j": np.array(j, np.int32), "more": np.array(sums, np.int64)})


def audit(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank: how far each source is from the others of its language, and
    its most overused terms."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    docs = docs.select(text("lang"), text("source"), text("text"))
    kept = settled(kept_terms(docs, threshold))
    bits = _bits(kept.select("lang", F.concat(F.col("term").cast("binary"), F.lit(STOP)).alias("prefix")), "lang", "prefix")
    counted = docs.mapInArrow(term_counter(bits), "lang string, source string, term string, n long")
    counts = settled(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"]))
    bits.unpersist()

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    none = F.when(F.col("v") > 0, _parts_of(F.lit(0), F.col("total"), F.col("v")))
    groups = settled(groups.withColumn("i", number).withColumn("none", none))
    few = groups.count() <= FEW_GROUPS
    small = lambda df: F.broadcast(df) if few else df  # noqa: E731  (no more rows than groups)
    side = lambda c: F.floor(F.col(c) / SIDE).cast("int")
    langs = settled(groups.groupBy("lang").agg(F.max(side("i")).alias("last"), F.sum("total").alias("whole")))
    parts = counts.join(small(groups), ["lang", "source"]).withColumn("p", _parts_of(F.col("n"), F.col("total"), F.col("v")))
    parts = settled(parts.join(small(langs), "lang").select("lang", "source", "i", "v", "last", "whole", "term", "n", "p"))

    # pairs: buckets of terms with pairs of source blocks
    buckets = F.ceil(F.col("v") / BUCKET).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    cell = [F.least(side("i"), F.col("o")).alias("a"), F.greatest(side("i"), F.col("o")).alias("b")]
    spread = parts.select("*", other.alias("o")).select("lang", F.pmod(F.xxhash64("term"), buckets).cast("int").alias("bucket"), *cell, "i", "term", "p")
    sides = groups.filter("v > 0").join(small(langs), "lang").select("*", other.alias("o")).select(
        F.col("lang").alias("l"), F.explode(F.sequence(F.lit(0), buckets - 1)).alias("k"), *cell, F.col("i").alias("i"), "none"
    ).withColumnsRenamed({"a": "x", "b": "y"})
    sums = spread.groupBy("lang", "bucket", "a", "b").cogroup(sides.groupBy("l", "k", "x", "y")).applyInPandas(
        block_sums, "lang string, i int, j int, more long"
    ).groupBy("lang", "i", "j").agg(F.sum("more").alias("more"))
    both = F.explode(F.array(F.struct("i", "j", "more"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "more"))).alias("s")
    sums = sums.select("lang", both).select("lang", "s.*")
    left = groups.select("lang", "source", "i", "v", F.col("none").alias("p"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("i").alias("j"), F.col("none").alias("q"))
    pairs = left.join(small(right), "lang").filter("i <> j").join(sums, ["lang", "i", "j"], "left")
    base = F.col("v") * _divergence(F.col("p"), F.col("q"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(base, F.lit(0)) + F.coalesce("more", F.lit(0)))

    # terms: against the whole language
    language = parts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.first("whole").alias("whole"), F.first("v").alias("v"))
    q = language.select("lang", "term", _parts_of(F.col("n"), F.col("whole"), F.col("v")).alias("q"))
    over = parts.join(q, ["lang", "term"]).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.toDF("lang", "source", "part", "item", "value").withColumn("rank", rank)
    return pairs.union(over.withColumn("rank", rank).filter(F.col("rank") <= TOP))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0)::HUGEINT AS v, coalesce(total, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes USING (lang) LEFT JOIN totals USING (lang, source)
), parts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(t.total) + 2 * any_value(s.v)) AS q
  FROM counts JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) t USING (lang) JOIN sizes s USING (lang) GROUP BY lang, term
), sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM parts x JOIN parts y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM parts JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM (FROM pairs UNION ALL FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
