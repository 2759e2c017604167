"""Time the headline queries: one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window, functions as F  # noqa: E402

from checks import registry  # noqa: E402
from checks.common import gaps, load  # noqa: E402
from tidyscan.operators import (  # noqa: E402
    association as A, missing as M, outliers as O, profile as P, text as C, timeseries as D, univariate as U,
)

HEADLINE = [
    "s01_overview_stats", "s05_infer_schema", "s08_suggest_actions", "m02_missing_table", "u04_histogram_auto",
    "u10_time_counts_month", "a03_kendall", "a08_normalized_mi", "a12_association_matrix", "f10_interpolate",
    "t04_recommend_types", "j04_outer", "e03_one_hot", "e04_ordinal", "x09_clean_text", "d03_trend_slope",
]
PRICE_GAPS = ["l_orderkey", "l_linenumber", "l_shipdate", "CASE WHEN l_orderkey % 10 < 3 THEN NULL ELSE l_extendedprice END AS price"]


def line(s, d):
    return load(s, d, "lineitem")


def fill_blocks(s, d):
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return M.fill_missing(gaps(s, d, "lineitem", PRICE_GAPS), {"price": "ffill"}, order)


def fill_window(s, d):
    """The plain window that the block plan replaces: everything in one task."""
    w = Window.orderBy("l_shipdate", "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    df = gaps(s, d, "lineitem", PRICE_GAPS)
    return df.withColumn("price", F.last("price", ignorenulls=True).over(w))


CASES = {
    "overview_lineitem": lambda s, d: P.overview_stats(line(s, d)),
    "quick_stats_lineitem": lambda s, d: P.column_quick_stats(line(s, d)),
    "corr_pearson_lineitem": lambda s, d: A.corr_matrix(line(s, d)),
    "corr_spearman_lineitem": lambda s, d: A.corr_matrix(
        line(s, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "spearman"
    ),
    "cramers_matrix_lineitem": lambda s, d: A.cramers_matrix(line(s, d), ["l_returnflag", "l_linestatus"]),
    **{
        f"outliers_{m}_lineitem": (lambda m: lambda s, d: O.outlier_table(line(s, d), method=m))(m)
        for m in ("iqr", "zscore", "mad", "percentile")
    },
    "describe_lineitem": lambda s, d: U.describe(line(s, d)),
    "ffill_blocks": fill_blocks,
    "ffill_plain_window": fill_window,
    "rolling_by_user": lambda s, d: D.rolling_features(load(s, d, "events"), ["ts", "event_id"], ["value"], group_by=["user_id"]),
    "token_counts": lambda s, d: C.token_counts(C.clean_text(load(s, d, "documents"), "text"), "text_clean"),
    **{name: make for name, make in registry.queries().items() if name in HEADLINE},
}


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    run(P.overview_stats(load(spark, sf_dir, "nation")))  # start-up cost belongs to no query
    times = {}
    for name, make in CASES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.perf_counter()
        run(make(spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {times[name]:7.3f}", file=sys.stderr, flush=True)
    total = round(sum(t for n, t in times.items() if n != "ffill_plain_window"), 3)
    print(json.dumps({"metric": "headline queries, total time", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
