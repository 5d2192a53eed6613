"""Queries over files: tables written in the engine's file formats and read back through its sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory
from ..sources import cache, sequences
from ..sources.store import Store
from .queries import observations, query
from .standins import detections, table


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, under ``spark.checkpoint.dir``; a local one only where both are one
    process. It goes when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(root or tempfile.mkdtemp(prefix='argusframe-')).rstrip('/')}/files-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file by name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


@query
def label_files(spark, d) -> DataFrame:
    """Detections as the label files of four sequences; boxes not kept or of another class don't come back."""
    root = scratch(spark, "labels")
    x = detections(spark, d)
    rows = x.select(
        (F.col("frame") % 4).alias("part"), "frame", "det_idx", "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"),
        (F.col("det_idx") % 5 != 0).cast("int").alias("keep"), (2 - F.col("class_id")).alias("cls"), (F.col("det_idx") / 8).alias("visibility"),
    )
    for k in range(4):
        rows.where(F.col("part") == k).drop("part").write.csv(f"{root}/s{k}/gt")
    t = sequences.read_labels(spark, f"{root}/*/gt/*.csv")
    return t.select("seq", F.col("frame").cast("long").alias("frame"), "id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "visibility")])


@query
def sequence_files(spark, d) -> DataFrame:
    """Nations as sequences with metadata files, of which every third says nothing of its rate."""
    root = scratch(spark, "sequences")
    for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():  # 25 rows at any scale
        rate = "" if r.n_nationkey % 3 == 0 else f"frameRate = {20 + r.n_regionkey}\n"
        write_text(spark, f"{root}/n{r.n_nationkey:02d}/seqinfo.ini", f"[Sequence]\nname={r.n_name}\n{rate}seqLength={r.n_nationkey + 1}\nimWidth=640\n")
    return sequences.read_sequences(spark, root).select("seq", "fps", "length", "width", "height")


@query
def frame_cache(spark, d) -> DataFrame:
    """Frames that a run that broke off has still to do: of the orders those without a cached line."""
    root = scratch(spark, "cache")
    x = detections(spark, d).select(F.format_string("s%d", F.col("frame") % 3).alias("seq"), "frame", "det_idx")
    for part in (0, 1):
        cache.append_frames(x.where(F.col("frame") % 4 == part), root)
    done = cache.read_cache(spark, root, "seq string, frame long, det_idx long")
    return cache.still_to_do(x.select("seq", "frame").distinct(), done)


@query
def store_round_trip(spark, d) -> DataFrame:
    """Identities and exemplars saved twice and loaded; a row without vectors and vectors without a row are gone."""
    store = Store(spark, scratch(spark, "store"))
    e = observations(spark, d).select("item_id", F.col("person").alias("identity_id"), "vec")
    facts = e.groupBy("identity_id").agg(F.min("item_id").cast("double").alias("first_seen"), F.max("item_id").cast("double").alias("last_seen"), F.count("*").alias("appearances"))
    ids = facts.join(memory.prototypes(e).select("identity_id", F.col("v").alias("prototype")), "identity_id").withColumn("label", F.lit("person"))
    store.save(ids, e.limit(0))
    bare = ids.where("identity_id = 0").withColumn("identity_id", F.lit(1000).cast("long"))
    store.save(ids.where("identity_id != 3").unionByName(bare), e)
    loaded, kept = store.load()
    n = kept.groupBy("identity_id").agg(F.count("*").alias("exemplars"))
    return loaded.join(n, "identity_id").select("identity_id", "label", "first_seen", "last_seen", "appearances", "exemplars", F.size("prototype").cast("long").alias("width"))
