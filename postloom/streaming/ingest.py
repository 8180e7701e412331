"""Messages as they arrive.  Every stage is stateless, so batch plans run unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schemas import MESSAGE


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the JSON message files that come into a folder."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(path)


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """``plan`` over the stream into Parquet; calls are made once per committed batch at best."""
    writer = plan(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
