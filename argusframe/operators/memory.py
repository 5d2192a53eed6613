"""The identity memory as two tables: ``identities`` and ``exemplars``, each operation a new pair of tables.

``identities(identity_id, label, first_seen, last_seen, appearances, prototype array<double>)`` and
``exemplars(item_id, identity_id, vec array<double>)``. An exemplar carries its vector, so rows and vectors
can't come apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import normalise
from .search import mean_vector


def diverse_order(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of ``k`` spread vectors: first the closest to the mean, then always the one whose best cosine
    to those chosen is least. All, in order, if there are no more than ``k``; ties go to the first."""
    n = len(vectors)
    if k <= 0:
        return np.zeros(0, dtype=np.int64)
    if n <= k:
        return np.arange(n)
    sims = np.round(vectors @ vectors.T, 9)
    picked = [int(np.argmax(np.round(vectors @ vectors.mean(0), 9)))]
    nearest = sims[picked[0]].copy()
    while len(picked) < k:
        nearest[picked] = np.inf
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sims[picked[-1]])
    return np.array(picked)


def select_diverse(exemplars: DataFrame, k: int) -> DataFrame:
    """The ``k`` most spread exemplars of each identity, with ``place`` in the order chosen (from 1).

    An identity's exemplars are bounded by what the tracker keeps, so a group fits a task.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id").reset_index(drop=True)
        order = diverse_order(np.array(pdf["vec"].tolist(), dtype=np.float64), k)
        return pdf.iloc[order].assign(place=np.arange(1, len(order) + 1))

    rows = exemplars.where("vec is not null").select("item_id", "identity_id", F.col("vec").cast("array<double>").alias("vec"))
    return rows.groupBy("identity_id").applyInPandas(pick, "item_id long, identity_id long, vec array<double>, place long")


def prototypes(exemplars: DataFrame) -> DataFrame:
    """``identity_id, n, v``: the normalised mean of the normalised observations."""
    unit = exemplars.withColumn("vec", normalise(F.col("vec")))
    return mean_vector(unit, "identity_id").withColumn("v", normalise(F.col("v")))


def _weighted(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    return normalise(F.zip_with(a, b, lambda x, y: x * wa + y * wb))


def remember(identities: DataFrame, exemplars: DataFrame, seen: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Fold new observations in. ``seen(identity_id, label, first_seen, last_seen, appearances, vecs)``, a row
    an identity, ``vecs`` being an array of vectors; ids that aren't known are created.

    The prototype is the normalised sum of the old one, weighted by its appearances, and the new
    observations' unit mean, weighted by theirs. The label is overwritten, the lifetime extended, and the
    exemplars are chosen again from old and new.
    """
    long = seen.select("identity_id", F.posexplode("vecs").alias("nth", "vec")).withColumn("vec", normalise(F.col("vec")))
    new = seen.select("identity_id", "label", "first_seen", "last_seen", "appearances").join(
        prototypes(long).select("identity_id", F.col("v").alias("prototype")), "identity_id"
    )
    both = identities.alias("o").join(new.alias("n"), "identity_id", "full")
    old_w, new_w = F.col("o.appearances").cast("double"), F.col("n.appearances").cast("double")
    folded = both.select(
        "identity_id", F.coalesce("n.label", "o.label").alias("label"),
        F.least("o.first_seen", "n.first_seen").alias("first_seen"), F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
        (F.coalesce("o.appearances", F.lit(0)) + F.coalesce("n.appearances", F.lit(0))).cast("long").alias("appearances"),
        F.when(F.col("o.prototype").isNull(), F.col("n.prototype")).when(F.col("n.prototype").isNull(), F.col("o.prototype"))
        .otherwise(_weighted(F.col("o.prototype"), old_w, F.col("n.prototype"), new_w)).alias("prototype"),
    )
    touched = new.select("identity_id")
    top = exemplars.agg(F.coalesce(F.max("item_id"), F.lit(0)).alias("top"))
    fresh = long.join(F.broadcast(top)).select(
        (F.col("top") + 1 + F.col("identity_id") * 100_000 + F.col("nth")).alias("item_id"), "identity_id", "vec"
    )
    pool = exemplars.join(touched, "identity_id", "left_semi").select("item_id", "identity_id", "vec").unionByName(fresh)
    kept = select_diverse(pool, keep).drop("place")
    rest = exemplars.join(touched, "identity_id", "left_anti").select("item_id", "identity_id", "vec")
    return folded, rest.unionByName(kept)


def touch(identities: DataFrame, sightings: DataFrame) -> DataFrame:
    """Extend ``last_seen`` to the latest of ``sightings(identity_id, when)``; never back."""
    latest = sightings.groupBy("identity_id").agg(F.max("when").alias("when"))
    joined = identities.join(latest, "identity_id", "left")
    return joined.withColumn("last_seen", F.greatest("last_seen", "when")).drop("when")


def merge(identities: DataFrame, exemplars: DataFrame, merges: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """``merges(keep_id, absorb_id)``: fold each absorbed record into the one kept and delete it.

    Prototypes are weighted by appearances. An unknown id is an error of the caller's and changes nothing.
    """
    known = identities.select("identity_id")
    valid = (
        merges.where("keep_id != absorb_id").join(known.withColumnRenamed("identity_id", "keep_id"), "keep_id", "left_semi")
        .join(known.withColumnRenamed("identity_id", "absorb_id"), "absorb_id", "left_semi")
    )
    rows = identities.join(valid.withColumnRenamed("absorb_id", "identity_id"), "identity_id", "left")
    rows = rows.withColumn("home", F.coalesce("keep_id", "identity_id"))
    weight = F.col("appearances").cast("double")
    sums = (
        rows.select("home", F.posexplode("prototype").alias("pos", "x"), weight.alias("w"))
        .groupBy("home", "pos").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
        .groupBy("home").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    )
    facts = rows.groupBy("home").agg(
        F.max(F.when(F.col("keep_id").isNull(), F.col("label"))).alias("label"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.sum("appearances").alias("appearances"),
    )
    merged = facts.join(sums, "home").select(
        F.col("home").alias("identity_id"), "label", "first_seen", "last_seen", "appearances", normalise(F.col("v")).alias("prototype")
    )
    moved = exemplars.join(valid.withColumnRenamed("absorb_id", "identity_id"), "identity_id", "left").select(
        "item_id", F.coalesce("keep_id", "identity_id").alias("identity_id"), "vec"
    )
    touched = valid.select(F.col("keep_id").alias("identity_id")).distinct()
    again = select_diverse(moved.join(touched, "identity_id", "left_semi"), keep).drop("place")
    return merged, moved.join(touched, "identity_id", "left_anti").select("item_id", "identity_id", "vec").unionByName(again)


def forget(identities: DataFrame, exemplars: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the records of ``ids(identity_id)``; unknown ids change nothing."""
    return identities.join(ids, "identity_id", "left_anti"), exemplars.join(ids, "identity_id", "left_anti")


def integrity(identities: DataFrame, exemplars: DataFrame) -> DataFrame:
    """``kind, id``: exemplars without a record (``orphan``) and records without exemplars (``bare``)."""
    orphans = exemplars.join(identities, "identity_id", "left_anti").select(F.lit("orphan").alias("kind"), F.col("item_id").alias("id"))
    bare = identities.join(exemplars, "identity_id", "left_anti").select(F.lit("bare").alias("kind"), F.col("identity_id").alias("id"))
    return orphans.unionByName(bare)


def reconcile(identities: DataFrame, exemplars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without what ``integrity`` finds."""
    return identities.join(exemplars, "identity_id", "left_semi"), exemplars.join(identities, "identity_id", "left_semi")


def upsert(index: DataFrame, rows: DataFrame, key: str = "identity_id") -> DataFrame:
    """``index`` with ``rows`` in place of those of the same key; one row a key is expected in ``rows``."""
    return index.join(rows, key, "left_anti").unionByName(rows.select(*index.columns))


def pending(identities: DataFrame, index: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Ids that are known, not described yet, and have a thumbnail to describe."""
    return identities.select("identity_id").join(index, "identity_id", "left_anti").join(thumbnails, "identity_id", "left_semi")


def largest(rows: DataFrame, key: str, area: str, order: str) -> DataFrame:
    """The row of largest ``area`` of each key, the earliest by ``order`` on ties."""
    best = F.max_by(F.struct(*[F.col(c) for c in rows.columns if c != key]), F.struct(F.col(area), -F.col(order)))
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def identity_counts(identities: DataFrame, exemplars: DataFrame) -> DataFrame:
    """One row: ``identities``, ``exemplars``, and ``widest``, the most exemplars that one identity has."""
    per = exemplars.groupBy("identity_id").agg(F.count("*").alias("n"))
    return identities.agg(F.count("*").alias("identities")).join(
        per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("exemplars"), F.coalesce(F.max("n"), F.lit(0)).alias("widest"))
    )


def describable(boxes: DataFrame, described: DataFrame, least_width: float = 16.0, least_height: float = 32.0) -> DataFrame:
    """``identity_id`` and its first box that can be described: of ``boxes(identity_id, frame, x1, y1, x2, y2,
    time_since_update)`` those in sight and large enough, of identities not in ``described`` yet. Each identity once."""
    good = boxes.where(
        (F.col("time_since_update") == 0) & (F.col("x2") - F.col("x1") >= least_width) & (F.col("y2") - F.col("y1") >= least_height)
    ).join(described.select("identity_id"), "identity_id", "left_anti")
    first = F.min_by(F.struct("frame", "x1", "y1", "x2", "y2"), F.struct("frame", "x1", "y1"))
    return good.groupBy("identity_id").agg(first.alias("b")).select("identity_id", "b.*")


def running_means(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``key, n, vec``: the running mean of each key's vectors in their order, half the past and half the present, of unit
    norm after each. Rows come sorted, in batches; only the mean goes from one to the next."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        now, n, mean = None, 0, None
        for pdf in batches:
            out = []
            for k, v in zip(pdf[key].tolist(), pdf["vec"]):
                v = np.asarray(v, dtype=np.float64)
                if n == 0 or k != now:
                    if n:
                        out.append((now, n, mean))
                    now, n, mean = k, 0, None
                mean = v if mean is None else (mean + v) / 2
                size = np.sqrt(mean @ mean)
                mean, n = mean / size if size else mean, n + 1
            yield pd.DataFrame(out, columns=[key, "n", "vec"])
        if n:
            yield pd.DataFrame([(now, n, mean)], columns=[key, "n", "vec"])

    slim = rows.where("vec is not null").select(key, "vec", *[c for c in order if c not in (key, "vec")])
    return slim.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{key} {kind}, n long, vec array<double>")
