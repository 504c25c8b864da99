"""Cutting lineage safely: results between rounds go to the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """df, checkpointed in spark.checkpoint.dir. Where that is unset, as in tests, in a temporary folder, but only if executors are
    threads of this machine; a cluster has to name its folder."""
    session, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="meshloom-"))
    return df.checkpoint()
