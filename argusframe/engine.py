"""One object for a memory on disk and what is asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import anomaly, memory, search
from .operators.binding import BinderConfig
from .operators.tracking import TrackerConfig
from .operators.tracks import track_frames
from .sources.store import Store


class Engine:
    """Reads the store's last version; each change saves a new one."""

    def __init__(self, spark: SparkSession, root: str, tracker: TrackerConfig = TrackerConfig(), binder: BinderConfig = BinderConfig(), min_score: float = 0.22):
        self.spark, self.store = spark, Store(spark, root)
        self.tracker, self.binder, self.min_score = tracker, binder, min_score

    def process(self, detections: DataFrame, fps: float = 30.0, fold_on_death: bool = True) -> DataFrame:
        """Tracks and identities of whole sequences."""
        return track_frames(detections, self.tracker, self.binder, fps, fold_on_death)

    def remember(self, seen: DataFrame) -> str:
        return self.store.save(*memory.remember(*self.store.load(), seen, self.binder.exemplars))

    def merge(self, merges: DataFrame) -> str:
        return self.store.save(*memory.merge(*self.store.load(), merges, self.binder.exemplars))

    def forget(self, ids: DataFrame) -> str:
        return self.store.save(*memory.forget(*self.store.load(), ids))

    def similar(self, views: DataFrame, label: str, k: int) -> DataFrame:
        """``views(query_id, vec)``: the ``k`` identities most like the mean view, of which those of ``label``."""
        identities, exemplars = self.store.load()
        marked = exemplars.withColumn("item_id", -F.col("item_id") - 1)  # no exemplar is the query itself
        return search.of_label(search.similar(views, marked, k), identities, label)

    def find(self, texts: DataFrame, index: DataFrame, k: int) -> DataFrame:
        """``texts(query_id, vec)`` against descriptions ``index(identity_id, vec)``: cut at ``k``, then the floor,
        then identities that still exist."""
        items = index.select(F.col("identity_id").alias("item_id"), "vec")
        found = search.at_least(search.top_k(texts, items, k), self.min_score).withColumnRenamed("item_id", "identity_id")
        return search.still_known(found, self.store.load()[0])

    def _normals(self, label: str) -> DataFrame:
        identities, exemplars = self.store.load()
        return exemplars.join(identities.where(F.col("label") == label), "identity_id", "left_semi").select("item_id", "vec")

    def anomalies(self, rows: DataFrame, label: str, method: str = "knn", least: int = 8, **settings) -> DataFrame | None:
        """``rows(item_id, vec)`` scored against a label's exemplars; None where there are too few."""
        normal = self._normals(label)
        return None if normal.count() < least else anomaly.build_detector(method, normal, **settings)(rows)

    def baseline(self, label: str, k: int = 5) -> DataFrame:
        """The exemplars' own scores, each counted among its neighbours."""
        normal = self._normals(label)
        return anomaly.knn_scores(normal, normal, k)

    def pending(self, index: DataFrame, thumbnails: DataFrame) -> DataFrame:
        return memory.pending(self.store.load()[0], index, thumbnails)
