"""What has been ingested: content hashes of files and unique names for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import schema as S
from ..plans import ordered
from ..plans.settle import settle


def ingest_manifest(spark: SparkSession, path: str, seen: DataFrame | None = None) -> DataFrame:
    """(path, base, length, sha1) of files with new content; of equal files the first path stays."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.sha1("content").alias("sha1"))
    new = files.groupBy("sha1").agg(F.min_by(F.struct("path", "length"), "path").alias("f"))
    if seen is not None:
        new = new.join(seen.select("sha1").distinct(), "sha1", "left_anti")
    base = F.regexp_extract("f.path", r"([^/]+)$", 1)
    return new.select(F.col("f.path").alias("path"), base.alias("base"), F.col("f.length").alias("length"), "sha1")


def unique_names(
    df: DataFrame, name_col: str, order_by: list[str], out: str = "unique_name", rows_per_block: int | None = None
) -> DataFrame:
    """Adds base, base_2, base_3, … in order; numbers that would spell another base are left out."""
    b = ordered.position(ordered.blocks(df, order_by, [name_col], rows_per_block), "__no")
    numbered = settle(ordered.finish(b))
    # the j-th taken number t shifts all later free numbers by one: those from t - j on
    bases = df.select(S.q(name_col).alias("base")).distinct()
    parsed = bases.select(
        F.regexp_extract("base", r"^(.*)_([1-9]\d{0,17})$", 1).alias("stem"),
        F.regexp_extract("base", r"^(.*)_([1-9]\d{0,17})$", 2).try_cast("bigint").alias("t"),
    ).filter("t >= 2")
    taken = parsed.join(bases, F.col("stem") == F.col("base"), "left_semi")
    if not taken.take(1):
        number = F.col("__no")
    else:
        order = ordered.position(ordered.blocks(taken, ["t"], ["stem"], rows_per_block), "__j")
        marks = ordered.finish(order).select(F.col("stem").alias("g"), (F.col("t") - F.col("__j") + 1).alias("at"))
        rows = numbered.select(
            S.q(name_col).alias("g"), F.col("__no").alias("at"), F.lit(1).alias("is_row"), F.struct("*").alias("row")
        )
        marks = marks.select("g", "at", F.lit(0).alias("is_row"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
        both = ordered.blocks(rows.unionByName(marks), ["at", "is_row"], ["g"], rows_per_block)
        shifted = ordered.finish(ordered.running_total(both, (1 - F.col("is_row")).cast("long"), "__shift"))
        numbered = shifted.filter("is_row = 1").select("row.*", "__shift")
        number = F.when(F.col("__no") == 1, F.lit(1)).otherwise(F.col("__no") + F.col("__shift"))
    name = F.when(F.col("__no") == 1, S.q(name_col)).otherwise(F.concat(S.q(name_col), F.lit("_"), number.cast("string")))
    return numbered.withColumn(out, name).drop("__no", "__shift")
