"""Task functions run on workers that cannot import the package."""

import os
import subprocess
import sys

import tidyscan

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from tidyscan.operators.kendall import kendall
from tidyscan.sources.archives import archive_tables
df = spark.range(50).selectExpr("id AS x", "id * id % 17 AS y")
assert kendall(df, "x", "x").first()[0] == 1.0
import zipfile
with zipfile.ZipFile({zip!r}, "w") as z:
    z.writestr("a.csv", "p,q\\n1,2\\n")
assert archive_tables(spark, {zip!r})["a.csv"].first()["q"] == 2
print("workers ran")
"""


def test_workers_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(tidyscan.__file__))
    script = SCRIPT.format(root=root, zip=str(tmp_path / "a.zip"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=170
    )
    assert "workers ran" in done.stdout, done.stderr[-2000:]
