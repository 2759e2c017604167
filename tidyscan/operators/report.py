"""The full profile as a set of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .association import numeric_correlations
from .profile import (
    column_quick_stats, dataset_meta, datasets_overview, dtypes_table, infer_schema, overview_stats, preview, row_facts,
    profile_columns, suggest_actions,
)

# Size of the preview.
PREVIEW_ROWS = 20
PREVIEW_COLUMNS = 10


def summary_report(df: DataFrame, datasets: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All tables of the summary, sharing one column profile and one count of the rows."""
    profile, facts = profile_columns(df), row_facts(df)
    schema = infer_schema(df, profile)
    cardinality = schema.select("column", F.col("unique")).orderBy(F.col("unique").desc(), "column")
    report = {
        "overview": overview_stats(df, facts),
        "meta": dataset_meta(df, profile),
        "schema": dtypes_table(df),
        "preview": preview(df.select(*[f"`{c}`" for c in df.columns[:PREVIEW_COLUMNS]]), PREVIEW_ROWS),
        "logical_types": schema,
        "cardinality": cardinality,
        "quick_stats": column_quick_stats(df, profile),
        "correlations": numeric_correlations(df),
        "advice": suggest_actions(df, profile, facts),
    }
    if datasets:
        report["datasets"] = datasets_overview(datasets)
    return report
