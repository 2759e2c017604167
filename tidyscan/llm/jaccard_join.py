"""N-gram Jaccard join by chosen paths.

Texts whose sets of five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more are linked.

* **Runs.**  A run chooses shared tokens (shingles) by their hash, with a chance that is the reverse of the set's size, so two sets
  of the wanted similarity share a chosen token with a chance of 1 - exp(-0.8) or more.  Runs have slices of the hash range of
  their own; all are made at once, as many as the target recall asks for (``runs_for``).  What a set
  chooses in all runs is its sample.
* **Paths.**  Sets that chose the same token meet in a bucket.  Buckets of at most ``SMALL`` sets are brute-forced: their pairs pass
  if their samples agree enough.
* **Dense buckets** have more.  A set leaves them if less than ``PLAUSIBLE`` of its sample is in dense buckets: of any similar set it shares
  more than that but for chance, so both have met in a small one.  What stays is counted again, so buckets only shrink and become small, and no round
  has more rows than the one before.
* **Hubs.**  Sets that still stay are held against the least set of each dense bucket, and chained to it if their samples agree.  Then
  only buckets with sets of different chains are open, and a set stays for as long as enough of its sample is in open ones.
* **All shingles.**  Of the few sets that stay all shingles are counted: a set leaves unless ``SIMILARITY`` of its shingles occur in other
  chains, which texts that share a notice don't reach.  The rest, texts that are nearly similar, all to each other, is chained as it is.
* All edges make groups, and within a group **all** pairs are compared by exact Jaccard similarity, in blocks of
  ``BLOCK`` sets.  A task sees two blocks at most and returns for each set its number of links and one edge to its component, never the pairs.

Equal texts are one set with a multiplicity throughout.

Edge cases: a null text is an empty one; a text without words links to nothing and is a class of its own; a text of one to four
words has one shingle, all its words; repeated rows are copies of each other; a null ``doc_id`` is kept and a class's id is
the least one that isn't null; an empty table gives an empty result; extra columns are ignored, and kept by ``one_of_each``.
Very long texts have a set of all their shingles, in one task's memory.  Of documents that tie for the least id, rows of one id and text, one stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SIMILARITY, components, freed, maybe_in, membership, settled, settled_alone, ship, text_of
from .shingles import WORD, portions, shingles

ship(__name__)

RECALL = 0.99999
#: Sets in a bucket that is brute-forced, and times that what dense buckets hold is counted anew as long as it gets less.
SMALL, ROUNDS = 16, 6
#: Share of the samples' tokens, of both or of one, below which a pair cannot plausibly have the wanted similarity.
PLAUSIBLE = 0.4
#: Sets in a block, and columns of an incidence matrix.
BLOCK, COLUMNS = 256, 4096


def runs_for(recall: float, similarity: float = 0.8) -> int:
    """Runs of one chosen token each after which a pair is missed with a chance of 1 - recall at most; half as many again serve
    the plausibility test."""
    return math.ceil(1.5 * -math.log(1 - recall) / similarity)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, first = shingles(texts)
    out = []
    for t, a, b in zip(texts, first, first[1:]):
        if a < b:
            out.append(np.unique(hashes[a:b]))
        else:
            words = WORD.findall(t)
            out.append(pd.util.hash_array(np.array([" ".join(words)], dtype=object), categorize=False) if words else hashes[:0])
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.unhex(F.md5(text_of())).alias("key"), text_of().alias("text"))


def _sets(docs: DataFrame, runs: int) -> DataFrame:
    """Rows (key, size, sample) of the distinct texts with words."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, texts in portions(batch.column(1).to_pylist()):
                rows = {}
                for k, s in zip(keys[start : start + len(texts)], shingle_sets(texts)):
                    if len(s):
                        chosen = s[: np.searchsorted(s, np.uint64(min(2**64 - 1, 2**64 * runs // len(s))), "right")]
                        rows[k] = (len(s), chosen.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.keys(), pa.binary()), pa.array([n for n, _ in rows.values()], pa.int32()),
                     pa.array([c for _, c in rows.values()], pa.list_(pa.int64()))], names=["key", "size", "sample"])

    made = _keyed(docs).mapInArrow(sample, "key binary, size int, sample array<bigint>")
    return made.groupBy("key").agg(F.any_value("size").alias("size"), F.any_value("sample").alias("sample"))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of the paths that two sets or more have, with that number."""
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = settled(counts)
    kept = maybe_in(rows, F.col("path"), membership(F.col("path"), counts))
    return settled(kept.join(counts, "path"))


def _pairs(bucketed: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets in small buckets whose sizes allow the similarity, a < b."""
    met = bucketed.filter(F.col("n") <= SMALL).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("key", "size"))).alias("m"))
    both = F.flatten(F.transform("m", lambda x, i: F.transform(
        F.filter(F.slice("m", i + 2, SMALL), lambda y: (5 * F.least(x["size"], y["size"]) >= 4 * F.greatest(x["size"], y["size"]))),
        lambda y: F.struct(x["key"].alias("a"), y["key"].alias("b")))))
    return met.select(F.explode(both).alias("p")).select("p.a", "p.b").distinct()


def _plausible(pairs: DataFrame, sets: DataFrame, runs: int) -> DataFrame:
    """Pairs whose samples agree enough in the part of the hash range that both have sampled."""
    one = sets.select(F.col("key").alias("a"), F.col("size").alias("size_a"), F.col("sample").alias("sample_a"))
    two = sets.select(F.col("key").alias("b"), F.col("size").alias("size_b"), F.col("sample").alias("sample_b"))
    low = F.greatest("size_a", "size_b")
    # the hash as an unsigned number, compared by its upper 52 bits, which a double holds
    bound = F.lit(float(2**52)) * runs / low
    within = lambda c: F.filter(c, lambda t: F.shiftrightunsigned(t, 12).cast("double") < bound)
    near = pairs.join(one, "a").join(two, "b").select("a", "b", within("sample_a").alias("x"), within("sample_b").alias("y"))
    return near.filter(F.size(F.array_intersect("x", "y")) >= PLAUSIBLE * F.size(F.array_union("x", "y"))).select("a", "b")


def _staying(rows: DataFrame, share: float) -> DataFrame:
    """The rows of the sets that have so much of their ``tokens`` among them."""
    kept = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.any_value("tokens").alias("tokens")).filter(F.col("n") >= share * F.col("tokens"))
    return rows.join(kept.select("key"), "key")


def _rounds(rows: DataFrame, once: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows after as many rounds as leave less of them, ``ROUNDS`` at most; more would only leave less to compare."""
    before = None
    for _ in range(ROUNDS):
        rows = settled(once(rows))
        n = rows.count()
        if not n or before is not None and n > 0.9 * before:
            break
        before = n
    freed(rows.sparkSession)
    return rows


def _open(rows: DataFrame, share: float) -> DataFrame:
    """Rows (path, key, tokens, root) of the sets that have so much in common with sets of other roots."""
    several = rows.groupBy("path").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("path")
    return _staying(rows.join(several, "path"), share)


def _to_hubs(rows: DataFrame) -> DataFrame:
    """Edges (a, b) from the least set of each path to its others."""
    hubs = rows.groupBy("path").agg(F.min("key").alias("a"))
    return rows.join(hubs, "path").filter("key <> a").select("a", F.col("key").alias("b")).distinct()


def _edges(sets: DataFrame, runs: int, tokens: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges between sets that may be similar: pairs of small buckets, and chains through dense ones.

    ``tokens`` gives of rows with a key each one once for every shingle (path) of its set; without it sets stay by their samples alone."""
    found: list[DataFrame] = []

    def dense(rows: DataFrame) -> DataFrame:
        bucketed = _counted(rows)
        found.append(_pairs(bucketed))
        return _staying(bucketed.filter(F.col("n") > SMALL).drop("n"), PLAUSIBLE)

    rows = _rounds(sets.select(F.explode("sample").alias("path"), "key", "size", F.size("sample").alias("tokens")), dense)
    chains = settled(_plausible(_to_hubs(rows), sets, runs))
    edges = _plausible(reduce(DataFrame.union, found).distinct(), sets, runs).union(chains)
    if rows.isEmpty():
        return edges
    roots = components(chains).withColumnsRenamed({"node": "key"})
    rooted = rows.join(roots, "key", "left").select("path", "key", "tokens", F.coalesce("root", "key").alias("root"))
    rows = _rounds(rooted, lambda r: _open(r, PLAUSIBLE))
    if tokens and not rows.isEmpty():
        left = settled(rows.select("key", "root").distinct())
        every = settled(tokens(left.join(sets.select("key", F.col("size").alias("tokens")), "key")))
        every = _rounds(every, lambda r: _open(r, SIMILARITY))
        rows = rows.join(every.select("key").distinct(), "key", "left_semi")
    return edges.union(_to_hubs(rows))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of sets (or within one): for each set their number, and the least set of its component."""
    n = len(pdf)
    order = np.argsort(pdf["side"].to_numpy(), kind="stable")
    keys = [pdf["key"].iloc[i] for i in order]
    side = pdf["side"].to_numpy()[order]
    copies = pdf["copies"].to_numpy()[order].astype(np.int64)
    tokens = [np.frombuffer(pdf["tokens"].iloc[i], np.uint64) for i in order]
    sizes = np.array([len(t) for t in tokens], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    names, place, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    kept = times[place] > 1
    owner, place = owner[kept], column[place[kept]]
    by_place = np.argsort(place, kind="stable")
    owner, place = owner[by_place], place[by_place]
    common = np.zeros((n, n), np.float32)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [start, start + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[a:b], place[a:b] - start] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    linked = 9 * common >= 4 * (sizes[:, None] + sizes[None, :])  # intersection over union of 4/5 or more
    np.fill_diagonal(linked, False)
    if side[0] != side[-1]:  # two blocks: pairs inside each are seen elsewhere
        linked &= side[:, None] != side[None, :]
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            reached = np.zeros(n, bool)
            reached[i] = True
            front = reached
            while front.any():
                front = linked[front].any(axis=0) & ~reached
                reached |= front
            root[reached] = i
    return pd.DataFrame({"key": keys, "links": linked @ copies, "root": [keys[r] for r in root]})


def linked_sets(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Rows (key, copies, least_id, size, links, root) of the distinct texts: how many documents have it, the least of their ids,
    the number of documents with other texts that it links to, and its class."""
    runs = runs_for(recall)
    sets = settled(_sets(docs, runs))
    texts = docs.select("doc_id", F.unhex(F.md5(text_of())).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, part in portions(batch.column(1).to_pylist()):
                rows = {k: s.tobytes() for k, s in zip(keys[start : start + len(part)], shingle_sets(part))}
                yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.binary()), pa.array(rows.values(), pa.binary())], names=["key", "tokens"])

    def held_of(wanted: DataFrame) -> DataFrame:
        texts = maybe_in(_keyed(docs), F.xxhash64("key"), membership(F.xxhash64("key"), wanted)).dropDuplicates(["key"])
        return texts.mapInArrow(shingled, "key binary, tokens binary")

    def every(wanted: DataFrame) -> DataFrame:
        at = F.sequence(F.lit(1), F.length("held"), F.lit(8))
        held = held_of(wanted).withColumnRenamed("tokens", "held").join(wanted, "key")
        return held.select(*wanted.columns, F.explode(F.transform(at, lambda i: F.substring("held", i, F.lit(8)))).alias("path"))

    groups = components(_edges(sets, runs, every)).withColumnsRenamed({"node": "key", "root": "grp"})
    blocks = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = groups.join(blocks, "grp").select("key", "grp", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    placed = settled(placed)
    held = held_of(placed)
    # every two blocks of a group meet once: a block goes to all pairs (i, j) with i <= j that it is in
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), (F.col("block") > j).cast("int").alias("side")))
    spread = placed.join(texts, "key").select("key", "grp", "copies", F.explode(met).alias("at")).join(held, "key")
    spread = spread.select("key", "grp", "copies", "tokens", "at.i", "at.j", "at.side")
    out = spread.groupBy("grp", "i", "j").applyInPandas(_compare, "key binary, links bigint, root binary")
    out = settled(out)
    links = out.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(out.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    sized = texts.join(sets.select("key", "size"), "key", "left").join(links, "key", "left")
    sized = sized.join(roots.withColumnRenamed("node", "key"), "key", "left")
    return sized.select("key", "copies", "least_id", F.coalesce("size", F.lit(0)).alias("size"),
                        F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root"))


def _classes(docs: DataFrame, recall: float) -> DataFrame:
    """Rows (key, size, n_links, class_id, class_key) of the distinct texts; class_key is the key of the text that has class_id."""
    found = settled_alone(docs.sparkSession, lambda: linked_sets(docs, recall))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("no_id"), "least_id", "key")).alias("first"))
    return found.join(first, "root").select(
        "key", "size", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("first.least_id").alias("class_id"),
        F.col("first.key").alias("class_key"))


def jaccard_join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row for each document: its class, named by the class's least id, and its number of links."""
    classes = _classes(docs, recall)
    rows = docs.select("doc_id", F.unhex(F.md5(text_of())).alias("key"))
    alone = F.col("size") == 0
    return rows.join(classes, "key").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents without all but one of each class: that of the least id stays.  Texts without words all stay."""
    classes = _classes(docs, recall)
    chosen = classes.filter((F.col("size") == 0) | (F.col("key") == F.col("class_key")))
    chosen = chosen.select(F.col("key").alias("__key"), F.when(F.col("size") > 0, F.struct("class_id")).alias("__one"))
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(text_of())).alias("__key")).join(chosen, "__key")
    rows = rows.filter(F.col("__one").isNull() | F.col("row.doc_id").eqNullSafe(F.col("__one.class_id")))
    single = rows.filter(F.col("__one").isNotNull()).groupBy("__key").agg(F.any_value("row").alias("row"))
    return rows.filter(F.col("__one").isNull()).select("row.*").union(single.select("row.*"))


ORACLE_SQL = """
WITH w AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, count(*) AS copies, min(doc_id) AS least_id FROM w WHERE len(w) > 0 GROUP BY ALL),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
links AS (
  SELECT a, b FROM (SELECT x.k AS a, y.k AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.k <> y.k GROUP BY ALL)
  JOIN n p ON p.k = a JOIN n q ON q.k = b WHERE 9 * c >= 4 * (p.n + q.n)),
reach AS (
  WITH RECURSIVE hop(k, root) USING KEY (k) AS (
    SELECT k, least_id FROM t
    UNION (SELECT a, min(h.root) FROM links JOIN hop h ON h.k = b JOIN recurring.hop own ON own.k = a GROUP BY a, own.root HAVING min(h.root) < own.root))
  SELECT * FROM hop),
degree AS (SELECT a AS k, sum(copies) AS links FROM links JOIN t ON t.k = b GROUP BY a)
SELECT w.doc_id, CASE WHEN len(w.w) = 0 THEN w.doc_id ELSE root END AS class_id,
  CASE WHEN len(w.w) = 0 THEN 0 ELSE copies - 1 + coalesce(links, 0) END::BIGINT AS n_links
FROM w LEFT JOIN t ON t.k = array_to_string(w.w, ' ') AND len(w.w) > 0 LEFT JOIN reach ON reach.k = t.k LEFT JOIN degree ON degree.k = t.k
"""
