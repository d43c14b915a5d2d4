"""Cutting lineage between the rounds of an iteration, in the folder that the cluster shares."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine, where it is unset, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
