"""Running a stream over what there is, and reading its result as a table."""

import uuid

from pyspark.sql import DataFrame

from ..operators.settle import shared_folder


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input there is now. Results and checkpoints are in the shared folder; a rerun batch overwrites its own."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        # a complete result replaces the ones before it
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)
