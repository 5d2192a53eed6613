"""Frames as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.boxes import newest


def frame_files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1, latest_first: bool = False) -> DataFrame:
    """A stream of frame files, ``per_trigger`` at a time; with ``latest_first``, new files go before a backlog."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return reader.option("latestFirst", str(latest_first).lower()).parquet(path)


def newest_only(then):
    """A ``foreachBatch`` sink that hands on the newest frame of each sequence and drops what came before it."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        then(newest(batch, "seq", "frame"), batch_id)

    return sink
