"""Resumable evaluation as a stream of files: each file of items is handled once, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def start(spark: SparkSession, source: str, schema: str, handle: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Read new JSON-lines files of `source`, apply `handle`, append to `sink`, and stop when all that is there is done. The
    checkpoint makes a second start skip what the first has finished; sink folders are named by batch, so a batch that is
    repeated after a failure replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").json(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
