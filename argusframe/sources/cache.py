"""Results of slow stages kept by sequence, and the weights of small models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .sequences import _exists


def append_frames(rows: DataFrame, path: str) -> None:
    """Add frames' results to a cache with a folder for each sequence."""
    rows.write.mode("append").partitionBy("seq").parquet(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache, empty before the first write."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def still_to_do(frames: DataFrame, cache: DataFrame) -> DataFrame:
    """Frames ``(seq, frame, ..)`` that the cache has nothing of: where a run that broke off goes on."""
    return frames.join(cache.select("seq", "frame").distinct(), ["seq", "frame"], "left_anti")


def save_weights(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> None:
    """Named arrays as rows of a Parquet table."""
    rows = [(name, [int(n) for n in a.shape], np.asarray(a, dtype=np.float64).ravel().tolist()) for name, a in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
