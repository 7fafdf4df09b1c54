"""The session's shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it in spark.checkpoint.dir. Where that is
    unset, as in tests, a temporary folder takes its place on a local master; elsewhere executors could not read it, and
    it is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="fieldspark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept where all executors can read it: a lost executor does not bring its work back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
