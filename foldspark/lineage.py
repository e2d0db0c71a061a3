"""Cutting long plans: a table that is written to the shared checkpoint folder and read from there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a local session without it a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foldspark-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df, computed once into the folder of spark.checkpoint.dir, with a plan of one step.

    What several aggregations read is then made once, survives lost executors, and keeps later plans small. Only a
    local session, whose tasks share the driver's disk, gets a temporary folder where none is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
