"""The registry is complete, and a query of each family equals its SQL twin on the smallest tables."""

import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQLS = entry.queries(), entry.oracle_sql()
SOME = [
    "s01_overview_duplicates", "s08_suggest_actions", "m02_missing_table", "o03_mad_table", "u04_histogram_fd",
    "a03_kendall_ties", "a11_cramers_matrix", "a12_association_matrix", "f07_forward_fill", "f10_interpolate",
    "t05_t06_convert_types", "j04_outer", "x09_clean_text", "d10_rolling_by_type", "e04_ordinal", "i12_unique_names",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_registry():
    assert len(QUERIES) > 120 and set(SQLS) <= set(QUERIES)
    others = {n for n in QUERIES if n == "pipeline" or re.match(r"op\d+_", n)}  # tested by themselves
    assert set(QUERIES) - set(SQLS) - others == {"s14_sample_rows"}


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQLS[name], SF_DIR).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() == 11


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_a_query_needs(spark):
    from checks.common import load
    from tidyscan.operators import outliers as O, univariate as U

    line = load(spark, SF_DIR, "lineitem")
    scan = plan(O.outlier_table(line, ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in scan
    scan = plan(U.value_counts(line.filter("l_tax > 0.05"), "l_returnflag"))
    assert "GreaterThan(l_tax,0.05)" in scan and "ReadSchema: struct<l_tax:double,l_returnflag:string>" in scan


def test_top_levels_are_limited_before_the_shuffle(spark):
    from checks.common import load
    from tidyscan.functions import frequency
    from tidyscan.operators import encode as E

    counts = frequency.level_counts(load(spark, SF_DIR, "events"), ["user_id"], "bigint")
    assert "WindowGroupLimit" in plan(E.ordered_head(counts, 5))


def test_expressions_stay_in_the_engine(spark):
    from checks.common import load
    from tidyscan.operators import text as C, timeseries as D

    assert "Python" not in plan(C.clean_text(load(spark, SF_DIR, "documents"), "text"))
    rolled = D.rolling_features(load(spark, SF_DIR, "events"), ["ts", "event_id"], ["value"], rows_per_block=200)
    # twice one row per block: the offsets of the blocks, and which later blocks read from each
    assert "Python" not in plan(rolled) and plan(rolled).count("SinglePartition") <= 2


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """With that part's folder deleted, whether or not its pipeline is, the entry imports and has all other queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name, left_out in (("folder", {"llm"}), ("both", {"llm", "corpus_pipeline.py"})):
        copy = tmp_path / name
        shutil.copytree(root, copy, ignore=lambda _, names: [n for n in names if n in left_out | {".git", "__pycache__"}])
        script = "import __spark_entry__ as e; q = set(e.queries()); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= q)"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", script], cwd=copy, env=env, capture_output=True, text=True, timeout=170)
        assert done.stdout.split()[1:] == ["False", "True"] and int(done.stdout.split()[0]) > 120, done.stderr[-2000:]
