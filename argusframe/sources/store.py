"""Identity tables on disk, in versions: a write never touches what readers have open."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.memory import reconcile

IDENTITIES = "identity_id long, label string, first_seen double, last_seen double, appearances long, prototype array<double>"
EXEMPLARS = "item_id long, identity_id long, vec array<double>"
TABLES = {"identities": IDENTITIES, "exemplars": EXEMPLARS}


class Store:
    """A folder with a version folder for each save and a pointer file to the last complete one.

    Both tables of a version are written first and the pointer is then replaced by a rename, so a save that
    dies halfway leaves the last one in place. A version name may be given (a batch id): saving it again,
    as a replayed batch does, writes the same place.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def version(self) -> str | None:
        if not self._fs.exists(self._path("CURRENT")):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0]

    def load(self, check: bool = True) -> tuple[DataFrame, DataFrame]:
        """Both tables, empty before the first save; rows without vectors and vectors without rows go."""
        version = self.version()
        if version is None:
            tables = [self.spark.createDataFrame([], s) for s in TABLES.values()]
        else:
            tables = [self.spark.read.schema(s).parquet(f"{self.root}/{version}/{t}") for t, s in TABLES.items()]
        return reconcile(*tables) if check else (tables[0], tables[1])

    def save(self, identities: DataFrame, exemplars: DataFrame, version: str | None = None) -> str:
        version = version or uuid.uuid4().hex
        for df, (table, schema) in zip((identities, exemplars), TABLES.items()):
            names = [c.split()[0] for c in schema.split(", ")]
            df.select(*names).write.mode("overwrite").parquet(f"{self.root}/{version}/{table}")
        fresh = self._path(f"CURRENT.{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(version.encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration())
        array = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = options
        context.rename(fresh, self._path("CURRENT"), array)
        return version


def upsert_batch(store: Store, fold):
    """A ``foreachBatch`` sink: ``fold(identities, exemplars, batch)`` gives the new tables. A replayed batch
    starts from the version before it, so nothing counts twice."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        current = store.version()
        if current == f"batch-{batch_id}":
            return
        store.save(*fold(*store.load(), batch), version=f"batch-{batch_id}")

    return sink
