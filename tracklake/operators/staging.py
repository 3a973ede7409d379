"""Tables computed once, in a folder that all of a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Only where it names none and all runs in one process a folder is made; a folder of one machine would be lost to the others,
    so a cluster without one is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stages-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """The table, computed once and kept in the folder that the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
