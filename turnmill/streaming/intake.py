"""Durable intake of a stream: every element once, late or redelivered ones included."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from turnmill.runtime import checkpoint_dir


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """A table of parquet files as a stream; a bounded number of files a micro-batch is its backpressure."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def take_in(stream: DataFrame, key: str, shared: str | None = None) -> DataFrame:
    """What there is of a stream, appended to a log in the shared folder, each ``key`` once; the log is the result.

    Offsets and seen keys are checkpointed, so a run that is broken off goes on
    where it stopped (T7), and the log holds committed batches only.
    """
    spark = stream.sparkSession
    base = f"{shared or checkpoint_dir(spark)}/intake-{uuid.uuid4().hex}"
    query = (
        stream.dropDuplicates([key]).writeStream.format("parquet").option("path", f"{base}/log").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/log")
