"""What a run keeps between stages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a session whose tasks run in the driver's own process takes a temporary
    folder; on a cluster it is an error, as executors and driver share no local folder.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folioscope-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
