"""The operators with production parameters on their whole tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate as benchmark, hard_negatives, html_extract, jaccard_join as joins, license_scan as licenses, line_dedup, quality_rules as rules, ranking, secret_scan as secrets, source_audit, suffix_dedup
from . import toxicity
from .common import table


def _on_documents(operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, "documents"))

    return query


def _on(name: str, operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, name))

    return query


def _on_both(operator, other: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, other))

    return query


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {
    "op1_secret_scan": _on_documents(secrets.secret_scans),
    "op2_quality_rules": _on_documents(rules.quality_rules),
    "op3_jaccard_join": _on_documents(joins.jaccard_join),
    "op4_benchmark_decontamination": _on_both(benchmark.decontaminate, "benchmark"),
    "op5_license_scan": _on_documents(licenses.license_scan),
    "op6_bpe_encoding": _on_documents(lambda docs: bpe.encode(docs, tokenizer_file())),
    "op7_line_dedup": _on_documents(line_dedup.line_dedup),
    "op8_suffix_dedup": _on_documents(suffix_dedup.suffix_dedup),
    "op9_quality_ranking": _on_both(ranking.quality, "labels"),
    "op10_toxicity": _on_both(toxicity.toxicity, "labels"),
    "op11_source_audit": _on_documents(source_audit.audit),
    "op12_hard_negatives": _on("embeddings", hard_negatives.hard_negatives),
    "op13_html_extraction": _on("pages", html_extract.extract),
}
ORACLES = {
    "op1_secret_scan": secrets.ORACLE_SQL,
    "op3_jaccard_join": joins.ORACLE_SQL,
    "op4_benchmark_decontamination": benchmark.ORACLE_SQL,
    "op5_license_scan": licenses.ORACLE_SQL,
    "op11_source_audit": source_audit.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
}
