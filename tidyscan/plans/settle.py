"""Cutting the lineage of results that several later steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the session's checkpoint folder, so that it is computed once.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, so a lost executor loses
    nothing.  Only a local session without one gets a folder of its own; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidyscan-"))
    return df.checkpoint()
