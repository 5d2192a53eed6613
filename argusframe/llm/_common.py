"""Shared plumbing of the training-data operators: scratch storage, joins that survive hot keys, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local folder is made and set if driver and executors are one process (tests, a laptop);
    on a cluster, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jdir.isDefined() and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = jdir.get() if jdir.isDefined() else tempfile.mkdtemp(prefix="argusframe-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_FOLDER = f"argusframe-{uuid.uuid4().hex}"  # this driver's own, in the shared folder
_passing: list[list[str]] = []  # what is written within each open ``temporary``


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def give_back(spark: SparkSession) -> None:
    """The driver's JVM gives memory that it freed, but that its allocator holds, back to the system.

    What compilers, codecs and hundreds of threads freed outside the heap stays with the allocator's arenas else, and
    grows from query to query. Does nothing where the JVM has no such command (before 17.0.9, or not on glibc).
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = array(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface's method: the server's own class is closed to reflection
        kind = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        next(m for m in kind.getMethods() if m.getName() == "invoke").invoke(server, call)
    except Py4JJavaError:
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: an executor lost later costs no recomputation of what stands before. An empty
    frame comes back empty, with the same schema. The files go with the ``temporary`` around, else when the
    session's file systems are closed, at the latest as the driver's JVM ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/{_FOLDER}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back(spark)
    if _passing:
        _passing[-1].append(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """What is ``stored`` within goes at the end; results must be stored outside, by ``lasting``.

    The shuffles of queries that have ended go as well, at the JVM's next collection, which is asked for here: it may
    be far off on a driver that does little, while the executors' disks fill.
    """
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            _delete(spark, path)
        spark._jvm.System.gc()
        give_back(spark)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """``stored``, to outlive the innermost ``temporary``."""
    inner = _passing.pop() if _passing else None
    try:
        return stored(df, name)
    finally:
        if inner is not None:
            _passing.append(inner)


def join_weighted(left: DataFrame, right: DataFrame, keys: list[str], weight: str, share: int = 2000) -> DataFrame:
    """Inner join on ``keys``, of which no task gets more than a ``share``-th of the work by one key.

    ``right`` has one row a key and in ``weight`` how many rows of ``left`` may have that key. Keys with more than
    a ``share``-th of all weight are fewer than ``share`` by that alone, so they are broadcast and ``left``'s rows
    with them stay where they are; the rest is shuffled. Null keys match nothing. ``right`` is read some times over.
    """
    total = right.agg(F.sum(weight)).first()[0]
    if not total:
        return left.join(right, keys)
    hot = right.where(F.col(weight) * share > total)
    if hot.isEmpty():
        return left.join(right, keys)
    heavy = left.join(F.broadcast(hot), keys)
    light = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(weight) * share <= total), keys)
    return heavy.unionByName(light)


BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after holding the session's Arrow batches to at most ``BATCH_ROWS`` rows.

    The default of 10,000 is meant for numbers: of whole documents, one such batch is many megabytes, several
    times over, in the executor and in each of its Python workers.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return df


def told(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A stored ``df`` of a few numbers a row, to be broadcast if it is counted to have ``most`` rows or fewer; else as it is."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


_served: list[str | None] = [None]  # the module that this worker works for
_caches: weakref.WeakSet = weakref.WeakSet()


def tidy(each):
    """``each`` for ``mapInArrow``: a worker that is done gives the memory that it freed back to the system.

    Workers serve one stage after the other; what their allocators hold back, and what they remember for other
    operators than the one that they work for now, would add up on an executor.
    """

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        if _served[0] != each.__module__:
            _served[0] = each.__module__
            for cache in list(_caches):
                cache.forget()
        try:
            yield from each(batches)
        finally:
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


class Remembered(dict):
    """key -> ``make(key)``, remembered in two generations of at most ``limit`` short keys each.

    ``turn()`` between texts starts a new generation when the young one is full; what is still in use then
    comes over from the old one, so frequent keys are never made again.
    """

    LONGEST = 48

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}
        _caches.add(self)

    def __hash__(self) -> int:
        return id(self)

    def __eq__(self, other) -> bool:
        return self is other

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.LONGEST:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first()
    return tuple(row)


def spanning_heads(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component, by labels that spread and jump."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, heads = spanning_heads(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(heads)], ["node", "component"])

    return edges.coalesce(1).mapInArrow(tidy(run), "node long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = 1_000_000) -> DataFrame:
    """Components of the graph with edges ``(a, b)`` of longs: one row ``(node, component)`` a node.

    Up to ``one_task`` edges (16 MB) are settled in one task. More are brought to stars in rounds:
    these alternate the large-star and small-star steps of Kiveris et al. (2014) until the edges no longer
    change; they are then stars around each component's smallest node. Minima are partial aggregates and
    joined back, so a hub with a third of all edges is split by the skew join and never gathered. Every
    round is stored in the shared folder. Self-loops, repeated and null edges are ignored.
    """
    e = (
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = stored(e, "edges")
    before = _signature(e)
    if before[0] <= one_task:
        return stored(_in_one_task(e), "components")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = stored(small, "edges")
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
