"""What several operators share: word lists, shingles, cut lineage, membership maps and components."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Blanks between words: the ASCII space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: Words in a shingle, and the similarity from which texts count as near copies.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Task functions of the module travel by value: workers need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def gram_hashes(words: Column, n: int = SHINGLE_WORDS) -> Column:
    """64-bit hashes of the n-word windows, in order; none if there are fewer than n words."""

    def grams(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - n)
        return F.when(
            F.size(h) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        ).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.  Only a local session without one gets one of its own; a
    cluster without one is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


#: Tables settled in each scratch that is open.
_OPEN: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted at the end.  What goes on from there must have been written elsewhere."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing refers to any more; by itself it looks every half hour."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Delete the table of a settled result that nothing reads any more."""
    for tables in _OPEN:
        tables[:] = [t for t in tables if t != df.settled_at]
    _delete(df.sparkSession, df.settled_at)


def settled(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a result as a table to the shared folder, and go on from the table.

    That cuts the lineage: lost executors lose nothing of it.  Unlike a checkpointed frame, a table has its true
    size, whereas the sizes that joins estimate are multiplied from round to round of a loop until they take seconds to compute.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path, compression=compression)
    if _OPEN:
        _OPEN[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def settled_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """A settled result.  What was settled on the way to it is deleted at once, with its shuffle files, rather than when a scratch ends."""
    _OPEN.append([])
    try:
        result = settled(make())
        _OPEN[-1].remove(result.settled_at)
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)
    if _OPEN:
        _OPEN[-1].append(result.settled_at)
    freed(spark)
    return result


#: Bits of one slice of a membership map, as Spark's bitmap functions have them, and slices in a map.
SLICE_BITS = 32768
SLICES = 1024


def membership(keys: Column, df: DataFrame, slices: int = SLICES) -> DataFrame:
    """A map of which 64-bit keys occur: at most ``slices`` rows (slice int, bits binary of 4 KiB).

    Its size never exceeds ``slices`` x 4 KiB (4 MiB by default), however many keys there are, so it may be broadcast.
    A key that occurs is always found.  One that doesn't may be found too, the oftener the fuller the
    map: use it only to leave work out early, never to decide.
    """
    place = F.pmod(keys, F.lit(slices * SLICE_BITS))
    at = df.select(F.floor(place / SLICE_BITS).cast("int").alias("slice"), (place % SLICE_BITS).alias("bit"))
    return at.groupBy("slice").agg(F.bitmap_construct_agg("bit").alias("bits"))


def flagged(df: DataFrame, keys: Column, members: DataFrame, slices: int = SLICES) -> DataFrame:
    """All rows with a boolean ``__maybe``: the key may be in the map.  A broadcast join with the few slices and a look at one bit."""
    m = members.select(F.col("slice").alias("__slice"), F.col("bits").alias("__bits"))
    place = F.pmod(keys, F.lit(slices * SLICE_BITS))
    bit = place % SLICE_BITS
    found = "shiftright(cast(conv(hex(substring(__bits, cast(__byte as int) + 1, 1)), 16, 10) as int), cast(__bit as int)) & 1 = 1"
    looked = df.withColumns({"__at": F.floor(place / SLICE_BITS).cast("int"), "__byte": F.floor(bit / 8), "__bit": bit % 8})
    looked = looked.join(F.broadcast(m), F.col("__at") == F.col("__slice"), "left")
    looked = looked.withColumn("__maybe", F.coalesce(F.expr(found), F.lit(False)))
    return looked.drop("__slice", "__bits", "__at", "__byte", "__bit")


def maybe_in(df: DataFrame, keys: Column, members: DataFrame, slices: int = SLICES) -> DataFrame:
    """Rows whose key may be in the map."""
    return flagged(df, keys, members, slices).filter("__maybe").drop("__maybe")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) edges, of any type with an order: rows (node, root), root the least node.

    Every node points to a node, first to itself.  Each round a node, and the node that it points to, may
    point to the least node that a neighbour reaches in two steps, and every node to where its own two steps lead; so trees hook onto
    trees and flatten, and rounds grow as the logarithm of the longest chain.  They end when nothing changes: only one
    fingerprint of all pointers reaches the driver.
    """
    links = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    labels, before = settled(labels), None
    for _ in range(rounds):
        far = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        reach = labels.join(far, "root")
        near = links.join(reach.select(F.col("node").alias("b"), "far"), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("near"))
        both = reach.join(near, "node").select(F.explode(F.array(
            F.struct(F.col("node"), F.least("far", "near").alias("root")), F.struct(F.col("root").alias("node"), F.col("near").alias("root")),
        )).alias("p"))
        old, labels = labels, settled(both.groupBy("p.node").agg(F.min("p.root").alias("root")))
        dropped(old)
        now = labels.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root"))).first()
        if now == before:
            dropped(links)
            return labels
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
