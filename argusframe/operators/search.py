"""Exact nearest neighbours by inner product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import normalise

QUERY_BOUND = 20_000  # queries that are sent to every task; more are dealt in blocks


def _best(pairs: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """The ``k`` best a query, ties by item. The rank window keeps k rows a task before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.col(item))
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def meet_blocks(
    left: DataFrame, right: DataFrame, score, schema: str, block: int = 4096, on: tuple[str, ...] = (), key: str = "item_id", sent_key: str = "query_id"
) -> DataFrame:
    """``score(left rows, right rows)`` over all pairs of blocks, as frames of ``schema``; no pair of rows is ever formed by Spark.

    Up to ``QUERY_BOUND`` rows of ``right`` are counted and sent to ``left``'s tasks; more are dealt, like ``left``'s, in
    blocks of about ``block`` rows, and each pair of blocks is one group. ``on`` names columns that both sides must share:
    blocks are then cut within their values, by the value's own number of rows.
    """
    spark = left.sparkSession
    head = None if on else right.limit(QUERY_BOUND + 1).toPandas()
    if head is not None and len(head) <= QUERY_BOUND:
        if head.empty:
            return spark.createDataFrame([], schema)
        sent = spark.sparkContext.broadcast(head)

        def run(batches):
            for pdf in batches:
                for at in range(0, len(pdf), block):
                    yield score(pdf.iloc[at : at + block], sent.value)

        return left.mapInPandas(run, schema)
    left, right = (df.select([F.col(c).alias(c) for c in df.columns]) for df in (left, right))  # sides of one table need names of their own
    if on:
        count = lambda df, n: df.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("long").alias(n))
        sizes = count(left, "__nl").join(count(right, "__nr"), [*on])
        left, right = left.join(sizes, [*on]), right.join(sizes, [*on])
    else:
        blocks = lambda df: max(1, -(-df.count() // block))
        nl, nr = F.lit(blocks(left)).cast("long"), F.lit(blocks(right)).cast("long")
        left, right = (df.withColumns({"__nl": nl, "__nr": nr}) for df in (left, right))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = left.withColumn("__l", F.pmod(F.xxhash64(key), F.col("__nl"))).withColumn("__r", every("__nr")).drop("__nl", "__nr")
    right = right.withColumn("__r", F.pmod(F.xxhash64(sent_key), F.col("__nr"))).withColumn("__l", every("__nl")).drop("__nl", "__nr")
    by = [*on, "__l", "__r"]
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return score(a, b) if len(a) and len(b) else pd.DataFrame({c: [] for c in names})

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, schema)


def _best_owners(queries: DataFrame, gallery: DataFrame, k: int, digits: int, exclude_self: bool, block: int) -> DataFrame:
    """``gallery(item_id, owner, vec)``: ``query_id, rank, owner, score`` of the ``k`` owners with the best items.

    A pair of blocks gives its own ``k`` best owners: an owner among the best of all is among those of the block
    where its best item is.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")

    def best_of(items: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["owner", "item_id"], kind="stable")
        owner, gid, g = items["owner"].to_numpy(), items["item_id"].to_numpy(), _matrix(items["vec"])
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        qid, q, parts = sought["query_id"].to_numpy(), _matrix(sought["vec"]), []
        for i in range(0, len(qid), 512):
            s = np.round(q[i : i + 512] @ g.T, digits)
            if exclude_self:
                s[qid[i : i + 512, None] == gid[None, :]] = -np.inf
            s = s if len(first) == len(owner) else np.maximum.reduceat(s, first, axis=1)
            pick = np.argsort(-s, axis=1, kind="stable")[:, :k]
            got = pd.DataFrame({"query_id": np.repeat(qid[i : i + 512], pick.shape[1]), "owner": owner[first][pick].ravel(), "score": np.take_along_axis(s, pick, 1).ravel()})
            parts.append(got[np.isfinite(got["score"])])
        return pd.concat(parts)

    queries, gallery = (df.where("vec is not null") for df in (queries, gallery))
    found = meet_blocks(gallery.select("item_id", "owner", "vec"), queries.select("query_id", "vec"), best_of, "query_id long, owner long, score double", block)
    best = found.groupBy("query_id", "owner").agg(F.max("score").alias("score"))
    return _best(best, "query_id", "owner", k).select("query_id", "rank", "owner", "score")


def top_k(
    queries: DataFrame, gallery: DataFrame, k: int, digits: int = 6, exclude_self: bool = False, block: int = 4096
) -> DataFrame:
    """``queries(query_id, vec)`` x ``gallery(item_id, vec)`` -> ``query_id, rank, item_id, score``.

    Scores are inner products in double, rounded to ``digits`` before ranking; ties go to the smaller id.
    Null vectors are left out; ``k`` of 0 or less is an error. A query has fewer rows where the gallery is
    smaller than ``k``. Neither side is crossed with the other: queries up to ``QUERY_BOUND`` are counted
    and sent to the gallery's tasks as a matrix, more are met block by block; each pair of blocks gives
    its k best only.
    """
    found = _best_owners(queries, gallery.withColumn("owner", F.col("item_id")), k, digits, exclude_self, block)
    return found.withColumnRenamed("owner", "item_id")


def identity_top_k(queries: DataFrame, exemplars: DataFrame, k: int, digits: int = 6, block: int = 4096) -> DataFrame:
    """``exemplars(item_id, identity_id, vec)``: the ``k`` identities whose best exemplar is closest.

    An identity's score is the maximum over its exemplars, without the query itself, taken before ranking, so one
    identity can't crowd out the others. In blocks, as ``top_k``.
    """
    gallery = exemplars.select("item_id", F.col("identity_id").alias("owner"), "vec")
    return _best_owners(queries, gallery, k, digits, True, block).withColumnRenamed("owner", "identity_id")


def at_least(ranked: DataFrame, floor: float) -> DataFrame:
    """A score floor on what top-k returned; the two commute."""
    return ranked.where(F.col("score") >= floor)


def of_label(ranked: DataFrame, identities: DataFrame, label: str) -> DataFrame:
    """Keep one label after the cut at k: fewer than k may be left, and no others move up."""
    return ranked.join(identities.where(F.col("label") == label).select("identity_id"), "identity_id", "left_semi")


def still_known(ranked: DataFrame, identities: DataFrame) -> DataFrame:
    """Drop found ids that no longer exist, after the cut."""
    return ranked.join(identities.select("identity_id"), "identity_id", "left_semi")


def similar(views: DataFrame, exemplars: DataFrame, k: int) -> DataFrame:
    """``views(query_id, vec)``, a track's recent views: its mean, not normalised again, against identities."""
    mean = mean_vector(views, "query_id").withColumnRenamed("v", "vec")
    return identity_top_k(mean, exemplars, k)


def mean_vector(rows: DataFrame, *by: str) -> DataFrame:
    """``by, n, v``: component-wise mean of ``vec``, as partial sums for each position."""
    long = rows.where("vec is not null").select(*by, F.posexplode("vec").alias("pos", "x"))
    sums = long.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return sums.groupBy(*by).agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v")
    )


def unit(rows: DataFrame, column: str = "vec") -> DataFrame:
    return rows.withColumn(column, normalise(F.col(column)))
