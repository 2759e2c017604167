"""Suffix-array dedup: remove every byte that a repeated ``SIZE``-byte string covers.

Equal strings have to meet in one shard, whichever documents they come from:

1. Every ``SIZE``-byte string (window) has a least hash among its ``GRAM``-byte substrings, the same for equal strings.  A maximal
   run of windows with one such hash is a segment.  Windows whose hash is that of one place only cannot be repeated; hashes of two places or more go
   into a membership map of fixed size.  Where a hash has more than ``HOT`` places, a second hash function cuts its runs further.
2. Equal segments are one, with the number of places; in several places, all its windows are repeated.
3. Different segments of one hash go to one shard.  Its suffix array is built by induced sorting, and the permuted
   common prefixes tell which windows start twice (``induced``).
4. The repeated windows go back to the texts; only texts with some are read again.

Equal texts are one text: if it has ``SIZE`` bytes or more and several documents, all its bytes go.

Edge cases: a null text is an empty one; texts shorter than ``SIZE`` bytes lose nothing; matches never cross documents; repeated rows
are copies of each other; a null ``doc_id`` stays; an empty table gives an empty result; extra columns are ignored.
Very long texts are cut into windows like others.  Ties don't occur: every occurrence of a repeated string goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_BITS, flagged, maybe_in, membership, settled, ship, text_of
from .induced import repeated_starts

ship(__name__)

SIZE, GRAM = 200, 64
#: Places of a hash beyond which a second hash splits it; bytes of a shard; bytes looked at together.
HOT, SHARD, PORTION = 2_000, 1 << 20, 1 << 19
#: Slices of the membership maps, 16 MiB each.
SLICES = 4096
MIX = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A mixed hash of the ``GRAM`` bytes from each place on (those past the end are wrong)."""
    h = (data.astype(np.uint64) + np.uint64(1 + seed)) * MIX
    h ^= h >> np.uint64(32)
    factor, span = np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while span < GRAM:
            h[:-span] = h[:-span] * factor + h[span:]
            factor, span = factor * factor, 2 * span
        h ^= h >> np.uint64(29)
        h *= MIX
        h ^= h >> np.uint64(32)
    return h


def extreme(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` values from a place on (those past the end are wrong)."""
    span, out = 1, x.copy()
    while 2 * span <= width:
        out[:-span] = best(out[:-span], out[span:])
        span *= 2
    rest = width - span
    if rest:
        out[:-rest] = best(out[:-rest], out[rest:])
    return out


def least_of(h: np.ndarray) -> np.ndarray:
    """The least hash in each window of ``SIZE`` bytes."""
    return extreme(h, SIZE - GRAM + 1, np.minimum)


def chosen(values: list[bytes]) -> np.ndarray:
    """The hashes of all places whose hash is the least of a window, once for each place."""
    sizes = np.array([len(v) for v in values], np.int64)
    if not (sizes >= SIZE).any():
        return np.empty(0, np.uint64)
    h = gram_hashes(np.frombuffer(b"".join(values), np.uint8), 0)
    windows = np.repeat(np.tile([True, False], len(values)), np.stack([np.maximum(sizes - SIZE + 1, 0), np.minimum(sizes, SIZE - 1)], 1).ravel())
    key = np.where(windows, least_of(h), np.uint64(0))
    width = SIZE - GRAM + 1
    # windows that hold a place all have a hash as small as its own; it is the least of one if the greatest equals it
    most = extreme(np.concatenate([np.zeros(width - 1, np.uint64), key]), width, np.maximum)[: len(h)]
    return h[(most == h) & (most > 0)]


def holds_twice(segments: list[bytes]) -> np.ndarray:
    """Whether a segment has its least hash in two places, without which its windows all differ."""
    grams = np.array([len(s) for s in segments], np.int64) - GRAM + 1
    h = gram_hashes(np.frombuffer(b"".join(segments), np.uint8), 0)
    starts = np.cumsum(grams + GRAM - 1) - (grams + GRAM - 1)
    first = np.cumsum(grams) - grams
    h = h[np.repeat(starts - first, grams) + np.arange(grams.sum())]
    least = np.repeat(np.minimum.reduceat(h, first), grams)
    return np.add.reduceat((h == least).astype(np.int64), first) > 1


def portions(values: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, v in enumerate(values):
        size += len(v)
        if size >= PORTION or i == len(values) - 1:
            yield start, values[start : i + 1]
            start, size = i + 1, 0


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys & np.uint64(SLICES * SLICE_BITS - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def runs(values: list[bytes], hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in the text, number of windows, hash) of the runs of all texts."""
    sizes = np.array([len(v) for v in values], np.int64)
    windows = np.maximum(sizes - SIZE + 1, 0)
    if not windows.sum():
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64),)
    data = np.frombuffer(b"".join(values), np.uint8)
    key = least_of(gram_hashes(data, 0))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(values)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    key = key[starts[owner] + place]
    if hot is not None:
        much = _in(hot, key)
        if much.any():
            second = least_of(gram_hashes(data, 77))[starts[owner] + place]
            key = np.where(much, (key ^ (second * MIX)) * MIX, key)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], place[at], np.diff(np.append(at, len(key))), key[at]


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [v.as_buffer().to_pybytes() for v in column]


def _map(spark, keys: DataFrame):
    """A broadcast membership map of hashes, for tasks in Python: 16 MiB at any size of the input."""
    bits = np.zeros(SLICES * SLICE_BITS // 8, np.uint8)
    for r in membership(F.col("h"), keys, SLICES).collect():
        bits[r["slice"] * SLICE_BITS // 8 : (r["slice"] + 1) * SLICE_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows (key, start, end): byte ranges of the distinct texts (by digest) that repeated windows cover; they may overlap."""
    spark = docs.sparkSession
    texts = docs.select(F.unhex(F.md5(text_of())).alias("key"), text_of().alias("text")).filter(F.octet_length("text") >= SIZE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values in portions(_bytes_of(batch.column(0))):
                names, n = np.unique(chosen(values), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = texts.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    counted = settled(counted.filter("n > 1"))
    hot, several = _map(spark, counted.filter(F.col("n") > HOT)), _map(spark, counted)

    def kept(values: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """Runs whose first hash occurs elsewhere; hot ones by both hashes."""
        firsts = runs(values, None)
        wanted = _in(several.value, firsts[3])
        much = _in(hot.value, firsts[3])
        for t, p, n, h in zip(*[x[wanted & ~much].tolist() for x in (*firsts[:3], firsts[3].view(np.int64))]):
            yield t, p, n, h
        if much.any():
            # cut the hot runs alone: each as a text of its own
            t, p, n = (x[much] for x in firsts[:3])
            pieces = [values[a][b : b + c + SIZE - 1] for a, b, c in zip(t.tolist(), p.tolist(), n.tolist())]
            second = runs(pieces, hot.value)
            for i, q, m, h in zip(*[x.tolist() for x in (*second[:3], second[3].view(np.int64))]):
                yield int(t[i]), int(p[i]) + q, m, h

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values in portions(_bytes_of(batch.column(0))):
                found = {}
                for t, p, n, h in kept(values):
                    s = values[t][p : p + n + SIZE - 1]
                    found[hashlib.blake2b(s, digest_size=16).digest()] = (h, s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in found.values()], pa.int64()), pa.array(found.keys(), pa.binary()),
                     pa.array([s for _, s in found.values()], pa.binary())], names=["h", "segment", "bytes"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            for start, values in portions(_bytes_of(batch.column(0))):
                rows = set()
                for t, p, n, _ in kept(values):
                    s = hashlib.blake2b(values[t][p : p + n + SIZE - 1], digest_size=16).digest()
                    rows.add((s, keys[start + t], p, n))
                columns = list(zip(*rows)) or [(), (), (), ()]
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["segment", "key", "start", "n"])

    segments = texts.select("text").mapInArrow(cut, "h bigint, segment binary, bytes binary")
    segments = segments.groupBy("h", "segment").agg(F.any_value("bytes").alias("bytes"))
    places = settled(texts.select("text", "key").mapInArrow(locate, "segment binary, key binary, start bigint, n bigint").distinct())
    often = places.groupBy("segment").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("segment")
    whole = places.join(often, "segment").select("key", "start", (F.col("start") + F.col("n") + SIZE - 1).alias("end"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards of whole groups, in the order of their hashes."""
        held: list[tuple[int, bytes, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held and row[0] != held[-1][0] and size >= SHARD:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield shard(held)

    def shard(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        hashes = np.array([h for h, _, _ in rows])
        alone = np.ones(len(rows), bool)  # the only segment of its hash has nothing to be compared with
        alone[1:] &= hashes[1:] != hashes[:-1]
        alone[:-1] &= hashes[1:] != hashes[:-1]
        alone &= ~holds_twice([b for _, _, b in rows])
        rows = [r for r, a in zip(rows, alone.tolist()) if not a]
        out: tuple[list, list, list] = ([], [], [])
        if rows:
            for (_, segment, _), at in zip(rows, repeated_starts([b for _, _, b in rows], SIZE)):
                if len(at):
                    first = np.flatnonzero(np.append(True, np.diff(at) > 1))
                    last = np.append(first[1:] - 1, len(at) - 1)
                    out[0].extend([segment] * len(first))
                    out[1].extend(at[first].tolist())
                    out[2].extend((at[last] + SIZE).tolist())
        kinds = (pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["segment", "from", "to"])

    shards = segments.repartition("h").sortWithinPartitions("h").mapInArrow(sort, "segment binary, from bigint, to bigint")
    part = places.join(shards, "segment").select("key", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))
    return whole.union(part)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: bytes, removed bytes, removed runs, and the digest of the bytes that stay."""
    spans = repeated_spans(docs).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = settled(spans)
    rows = docs.select("doc_id", F.unhex(F.md5(text_of())).alias("key"), text_of().alias("text"))
    number = F.xxhash64("key")
    texts = maybe_in(rows.select("key", "text"), number, membership(number, spans)).groupBy("key").agg(F.any_value("text").alias("text"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for value, pairs in zip(batch.column(1), batch.column(2)):
                data = value.as_buffer().to_pybytes()
                flat = pairs.values
                first, last = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                step = np.bincount(first, minlength=len(data) + 1) - np.bincount(last, minlength=len(data) + 1)
                gone = np.cumsum(step)[:-1] > 0
                number_of = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((int(gone.sum()), number_of, hashlib.sha256(rest).hexdigest()))
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["key", "n_removed", "n_spans", "kept"])

    less = texts.join(spans, "key").select("key", "text", "spans").mapInArrow(remove, "key binary, n_removed bigint, n_spans bigint, kept string")
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    slim = rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    out = slim.join(less, "key", "left").join(copies, "key", "left")
    every = F.col("copies").isNotNull() & (F.col("n_bytes") >= SIZE)
    return out.select(
        "doc_id", "n_bytes",
        F.when(every, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(every, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(every, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "own")).alias("kept_sha256"))
