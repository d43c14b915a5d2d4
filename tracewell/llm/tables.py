"""Cutting lineage in the folder that the cluster shares."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of its own where that is unset, as in tests on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not (spark.conf.get("spark.checkpoint.dir", None) or context.master.startswith("local[") or context.master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
