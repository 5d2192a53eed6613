"""The driver's tables in the roles of the engine's own.

There is no video here. ``embeddings`` stands for labelled observations (label: person; item order: time),
``lineitem`` for detections (order: frame; quantity and discount: corner), ``events`` for sightings (user:
object; hour: frame; value: detector score), ``labels`` and ``documents`` for truth and scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vec import normalise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, person, track, frame, vec`` (unit, double); four tracks a person."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("item_id"), F.col("label").cast("long").alias("person"),
        (F.col("label") * 4 + F.col("vec_id") % 4).cast("long").alias("track"), F.col("vec_id").alias("frame"), normalise(F.col("embedding")).alias("vec"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations on short tracks: one a person and fifty items."""
    track = F.col("person") * 100_000 + F.floor(F.col("item_id") / 50)
    return observations(spark, sf_dir).withColumn("track", track.cast("long"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, det_idx, x1, y1, x2, y2, score, class_id``; boxes of side 10."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    y = F.col("l_discount") * 100
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.row_number().over(w).cast("long").alias("det_idx"), F.col("l_quantity").alias("x1"), y.alias("y1"),
        (F.col("l_quantity") + 10).alias("x2"), (y + 10).alias("y2"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "N").cast("int").alias("class_id"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, us (microseconds), hour, value, event_type``, with a box that wanders with the value."""
    ts = F.col("ts").cast("timestamp")
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.unix_micros(ts).alias("us"), F.floor(F.unix_micros(ts) / 3_600_000_000).cast("long").alias("hour"), "value", "event_type",
        v.alias("x1"), (v / 2).alias("y1"), (v + 10).alias("x2"), (v / 2 + 20).alias("y2"),
    )


def truth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, score, y``: a document's length against its quality label."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("key"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y")
    )
