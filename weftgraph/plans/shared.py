"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """That of spark.checkpoint.dir. Where none is set, a local session gets a temporary one; on a cluster that is an error, since no
    folder of one machine would do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        chosen = spark.conf.get("spark.checkpoint.dir", None)
        if chosen is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(chosen or tempfile.mkdtemp(prefix="weftgraph-"))
    return sc.getCheckpointDir()


def local(spark: SparkSession) -> str:
    """The same as a plain path, for what the driver writes itself."""
    return folder(spark).removeprefix("file:")
