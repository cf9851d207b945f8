"""Cutting of lineage in loops."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as written to the cluster's checkpoint folder.

    Where none is set a session in one process (tests) gets a temporary one; on a cluster that would lose data and is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is not set: rounds need a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/quern-checkpoints")
    return df.checkpoint()
