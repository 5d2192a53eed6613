"""Labelled sequences on disk: label rows, metadata, frames, annotations in, training labels out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed columns of a label file, without header.
LABELS = "frame int, id long, x double, y double, w double, h double, keep int, cls int, visibility double"
TRUTH = "seq string, frame int, id long, x1 double, y1 double, x2 double, y2 double, visibility double"
PEOPLE = (1,)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read_labels(spark: SparkSession, path: str, keep_classes: tuple[int, ...] = PEOPLE) -> DataFrame:
    """Label files under ``path`` (a file, a folder, or a glob) as truth boxes.

    ``keep`` must be over 0 and the class wanted, where there are such columns; visibility is 1 where it is
    missing. ``seq`` is the folder two above the file. Nothing there: an empty frame.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], TRUTH)
    rows = spark.read.schema(LABELS).csv(path).withColumn("file", F.input_file_name())
    rows = rows.where("frame is not null and coalesce(keep, 1) > 0")
    rows = rows.where(F.col("cls").isNull() | F.col("cls").isin(list(keep_classes)))
    return rows.select(
        F.element_at(F.split("file", "/"), -3).alias("seq"), "frame", "id", F.col("x").alias("x1"), F.col("y").alias("y1"),
        (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.coalesce("visibility", F.lit(1.0)).alias("visibility"),
    )


def read_sequences(spark: SparkSession, root: str) -> DataFrame:
    """``path, seq, fps, length, width, height`` of each sequence under ``root``, itself included, by name.

    A sequence is a folder with a ``seqinfo.ini``. Rate is 30 and sizes 0 unless given; a missing length is
    an error, as is a root without sequences.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "seqinfo.ini").load(root)
    text = F.decode("content", "UTF-8")
    value = lambda key: F.nullif(F.regexp_extract(text, rf"(?im)^\s*{key}\s*[=:]\s*(.*?)\s*$", 1), F.lit(""))
    rows = files.select(
        F.regexp_replace("path", "/seqinfo.ini$", "").alias("path"), value("name").alias("name"), value("frameRate").cast("double").alias("fps"),
        value("seqLength").cast("int").alias("length"), value("imWidth").cast("int").alias("width"), value("imHeight").cast("int").alias("height"),
    )
    if rows.isEmpty():
        raise FileNotFoundError(f"no seqinfo.ini under {root}")
    missing = F.raise_error(F.concat(F.lit("no seqLength in "), F.col("path")))
    return rows.select(
        "path", F.coalesce("name", F.element_at(F.split("path", "/"), -1)).alias("seq"), F.coalesce("fps", F.lit(30.0)).alias("fps"),
        F.when(F.col("length").isNotNull(), F.col("length")).otherwise(missing).alias("length"),
        F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"),
    ).orderBy("path")


def read_frames(spark: SparkSession, sequence: str) -> DataFrame:
    """``frame, image`` of a sequence's numbered pictures, decoded by Spark (bytes B, G, R)."""
    images = spark.read.format("image").option("dropInvalid", "false").load(f"{sequence}/img1")
    return images.select(F.regexp_extract("image.origin", r"(\d+)\.\w+$", 1).cast("int").alias("frame"), "image")


def missing_frames(frames: DataFrame, length: int) -> DataFrame:
    """Numbers from 1 to ``length`` that have no frame."""
    every = frames.sparkSession.range(1, length + 1).select(F.col("id").cast("int").alias("frame"))
    return every.join(frames.select("frame"), "frame", "left_anti")


def visible(truth: DataFrame, frames: DataFrame, least: float) -> DataFrame:
    """Truth boxes seen well enough; a frame without any keeps one row of nulls."""
    return frames.join(truth.where(F.col("visibility") >= least), ["seq", "frame"], "left")


def read_annotations(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """Scene annotations (JSON samples with relative boxes) as label rows.

    The class is its place in ``classes``, 0 where unknown; boxes of occlusion 2 are not kept, those of
    occlusion 1 half visible.
    """
    box = "struct<label: string, bounding_box: array<double>, occlusion: int>"
    sample = f"struct<scene: string, frame: int, width: int, height: int, detections: array<{box}>>"
    rows = spark.read.option("multiLine", "true").schema(f"samples array<{sample}>").json(path)
    one = rows.select(F.explode("samples").alias("s")).select("s.*").select("scene", "frame", "width", "height", F.posexplode("detections").alias("nth", "d"))
    names = F.array(*[F.lit(c) for c in classes])
    side = lambda i, by: F.col("d.bounding_box")[i] * F.col(by)
    occluded = F.coalesce(F.col("d.occlusion"), F.lit(0))
    return one.select(
        "scene", "frame", F.col("nth").cast("long").alias("id"), side(0, "width").alias("x"), side(1, "height").alias("y"), side(2, "width").alias("w"),
        side(3, "height").alias("h"), (1 - (occluded == 2).cast("int")).alias("keep"),
        F.greatest(F.array_position(names, F.col("d.label")) - 1, F.lit(0)).cast("int").alias("cls"), (1 - 0.5 * (occluded == 1).cast("double")).alias("visibility"),
    )


def training_labels(truth: DataFrame, sizes: DataFrame, class_id: int = 0, least_visible: float = 0.1) -> DataFrame:
    """``seq, frame, id, line``: class, centre and size as fractions of the frame, six decimals.

    Boxes seen too little, and those whose size isn't over 0 and up to 1, are dropped; centres are clamped.
    ``sizes(seq, width, height)``.
    """
    t = truth.where(F.col("visibility") >= least_visible).join(F.broadcast(sizes), "seq")
    f = t.select(
        "seq", "frame", "id", ((F.col("x1") + F.col("x2")) / 2 / F.col("width")).alias("cx"), ((F.col("y1") + F.col("y2")) / 2 / F.col("height")).alias("cy"),
        ((F.col("x2") - F.col("x1")) / F.col("width")).alias("w"), ((F.col("y2") - F.col("y1")) / F.col("height")).alias("h"),
    ).where("w > 0 and w <= 1 and h > 0 and h <= 1")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    return f.select("seq", "frame", "id", F.format_string(f"{class_id} %.6f %.6f %.6f %.6f", clamp("cx"), clamp("cy"), "w", "h").alias("line"))


def write_training_labels(labels: DataFrame, sides: DataFrame, path: str) -> None:
    """One folder a split and frame with its label lines; ``sides(seq, split)`` must not overlap."""
    if not sides.groupBy("seq").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a sequence is in two splits")
    rows = labels.join(F.broadcast(sides), "seq").select("split", F.concat_ws("_", "seq", F.lpad(F.col("frame").cast("string"), 6, "0")).alias("stem"), "line")
    rows.repartition("split", "stem").write.mode("overwrite").partitionBy("split", "stem").text(path)
