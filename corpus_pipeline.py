"""A training corpus from raw documents: quality rules, line dedup, one of each group of near copies, decontamination, tokens.

Each stage is written as Parquet and read again as the next one's documents, then deleted; all but the last keep the columns of documents.
The tables may have nulls, empty and very long texts, ties and repeated rows, or be empty; what a stage does with them stands in its
operator's docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidyscan.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from tidyscan.llm.common import dropped, freed, scratch, shared_folder, table
from tidyscan.llm.queries import tokenizer_file


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return quality_rules.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before, alike or nearly so.  Of a document all of whose lines go nothing is left, so it
    goes too, as the later copies of a text do."""
    return line_dedup.with_lines_left(docs)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean_of(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's tokens."""
    return bpe.encode(docs, tokenizer_file())


STAGES = [
    ("quality_rules", good),
    ("line_dedup", fresh_lines),
    ("jaccard_join", single),
    ("decontamination", uncontaminated),
    ("bpe_encoding", tokens),
]
#: SimHash, minimum hashes and byte-pair merges have no SQL form; the tests hold ``run`` against a plain form of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}/{name}"
        with scratch(spark):  # what the stage settled goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path, compression="zstd")
        docs = spark.read.parquet(path)
        docs.settled_at = path
        if before:  # the stage before was read for this one alone
            dropped(before)
        before = docs
        freed(spark)
    return docs
