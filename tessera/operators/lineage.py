"""Cutting a plan's lineage where several later steps read it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written once as a checkpoint under spark.checkpoint.dir, which the cluster names; later steps read the files and
    survive lost executors. Only where that is unset and Spark runs in one process is a temporary folder used."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return df.checkpoint()
