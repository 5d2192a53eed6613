"""Pair mining for verifiers, and leak-free splits of the pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlaps
from .running import running
from .search import meet_blocks


def _hash_order(*cols: str, seed: int = 0) -> list[Column]:
    """A repeatable random order; the columns themselves break ties."""
    return [F.xxhash64(F.lit(seed), *cols), *[F.col(c) for c in cols]]


def positions(observations: DataFrame) -> DataFrame:
    """``observations(track, item_id, frame, ..)`` with ``pos``, the place in the track from 0."""
    w = Window.partitionBy("track").orderBy("frame", "item_id")
    return observations.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


ROUNDS = 40  # of walking on, for numbers that fall beyond the total


def pair_number(k: Column, total: Column, *seed: Column) -> Column:
    """The ``k``-th of a repeatable random order of the numbers under ``total``.

    A permutation of the next power of four, four rounds of a Feistel network over its two halves, walked on while
    the number is beyond ``total``; what is still beyond after ``ROUNDS`` (at most one in 90,000) stays ``k``'s own.
    Different ``k`` give different numbers but for those few.
    """
    half = F.greatest(F.ceil(F.log2(F.greatest(total, F.lit(2)).cast("double")) / 2), F.lit(1)).cast("int")
    shift = lambda way, x: F.call_function(f"shift{way}", x, half)
    mask = shift("left", F.lit(1).cast("long")) - 1

    def permuted(x: Column) -> Column:
        left, right = shift("right", x), x.bitwiseAND(mask)
        for turn in range(4):
            left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(turn), right, *seed).bitwiseAND(mask))
        return shift("left", left).bitwiseOR(right)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), permuted(k), lambda x, _: F.when(x < total, x).otherwise(permuted(x)))
    return F.when(walk < total, walk).otherwise(k)


def positive_pairs(observations: DataFrame, gap: int, per_track: int | None = None, seed: int = 0) -> DataFrame:
    """``track, a, b``: observations of one track at least ``gap`` places apart; at most ``per_track`` of each.

    The cap is the sampling that the mining asks for, the same on every run. It is taken before any pair is made:
    the pairs of a track are numbered, numbers are drawn, and only their pairs are joined.
    """
    p = positions(observations).select("track", "item_id", "pos")
    x, y = p.alias("x"), p.alias("y")
    if per_track is None:
        met = x.join(y, (F.col("x.track") == F.col("y.track")) & (F.col("y.pos") >= F.col("x.pos") + gap))
        return met.select(F.col("x.track").alias("track"), F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"))
    if gap < 1:
        raise ValueError("a capped sample needs a gap of 1 or more")
    sizes = p.groupBy("track").agg(F.count("*").alias("n"))
    m = F.greatest(F.col("n") - gap, F.lit(0))  # the first of a pair has place 0 to m - 1, and m - place partners
    total = (m * (m + 1) / 2).cast("long")
    # the i-th pair of a track, counted from its end: the row of i in a triangle
    nth = sizes.select("track", "n", m.alias("m"), total.alias("total")).where("total > 0")
    nth = nth.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("total"), F.lit(per_track)) - 1)))
    at = nth.withColumn("i", pair_number(F.col("k"), F.col("total"), F.lit(seed), F.col("track")))
    row = F.floor((F.sqrt(F.col("i") * 8.0 + 1) - 1) / 2).cast("long")
    at = at.withColumn("r", row)
    start = lambda r: r * (r + 1) / 2
    r, i = F.col("r"), F.col("i")  # the root may be off by one
    at = at.withColumn("r", F.when(start(r) > i, r - 1).when(start(r + 1) <= i, r + 1).otherwise(r))
    at = at.select("track", (F.col("m") - 1 - F.col("r")).alias("first"), (F.col("n") - 1 - (F.col("i") - (F.col("r") * (F.col("r") + 1) / 2).cast("long"))).alias("second"))
    at = at.distinct()
    return (
        at.join(p.select("track", F.col("pos").alias("first"), F.col("item_id").alias("a")), ["track", "first"])
        .join(p.select("track", F.col("pos").alias("second"), F.col("item_id").alias("b")), ["track", "second"])
        .select("track", "a", "b")
    )


def labelled_positives(observations: DataFrame, min_gap: int) -> DataFrame:
    """``sequence, person, a, b``: one person's observations at least ``min_gap`` frames (not places) apart."""
    o = observations.select("sequence", "person", "item_id", "frame")
    return o.alias("x").join(
        o.alias("y"),
        (F.col("x.sequence") == F.col("y.sequence")) & (F.col("x.person") == F.col("y.person")) & (F.col("y.frame") - F.col("x.frame") >= min_gap),
    ).select(F.col("x.sequence").alias("sequence"), F.col("x.person").alias("person"), F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"))


def spans(observations: DataFrame, *by: str) -> DataFrame:
    """``by, first, last, n``: when each track was alive."""
    return observations.groupBy(*by).agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))


def coalive_tracks(tracks: DataFrame, within: str | None = None, width: float | None = None) -> DataFrame:
    """``track_a < track_b`` whose closed lifetimes meet, and so are different objects.

    Plain theta join, fast where many overlap; with ``width``, lifetimes are cut in bins of that many frames
    and joined by bin, each pair kept in the first bin that both have, which suits long, sparse time lines.
    """
    t = tracks.select("track", "first", "last", *([within] if within else []))
    x, y = t.alias("x"), t.alias("y")
    meet = (F.col("x.track") < F.col("y.track")) & overlaps(F.col("x.first"), F.col("x.last"), F.col("y.first"), F.col("y.last"))
    if within:
        meet = meet & (F.col(f"x.{within}") == F.col(f"y.{within}"))
    if width:
        bins = lambda a: F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("bin")
        x, y = t.select("*", bins("x")).alias("x"), t.select("*", bins("y")).alias("y")
        first_bin = F.floor(F.greatest(F.col("x.first"), F.col("y.first")) / width)
        meet = (F.col("x.bin") == F.col("y.bin")) & (F.col("x.bin") == first_bin) & meet
    return x.join(y, meet).select(F.col("x.track").alias("track_a"), F.col("y.track").alias("track_b"))


def negative_pairs(observations: DataFrame, wanted: int | None = None, seed: int = 0) -> DataFrame:
    """``track_a, track_b, a, b``: observations of two tracks that were alive together.

    With ``wanted``, that many at random but repeatably, the mining's balance of classes: the pairs of all pairs of
    tracks are numbered, ``wanted`` numbers are drawn, and only their pairs are joined.
    """
    lives = spans(observations, "track")
    tracks = coalive_tracks(lives)
    if wanted is None:
        o = observations.select("track", "item_id")
        return (
            tracks.join(o.select(F.col("track").alias("track_a"), F.col("item_id").alias("a")), "track_a")
            .join(o.select(F.col("track").alias("track_b"), F.col("item_id").alias("b")), "track_b")
            .select("track_a", "track_b", "a", "b")
        )
    spark = observations.sparkSession
    size = lambda x: lives.select(F.col("track").alias(f"track_{x}"), F.col("n").alias(f"n_{x}"))
    sized = tracks.join(size("a"), "track_a").join(size("b"), "track_b").withColumn("pairs", F.col("n_a") * F.col("n_b"))
    total = sized.agg(F.sum("pairs")).first()[0] or 0
    numbers = spark.range(min(wanted, total)).select(pair_number(F.col("id"), F.lit(total), F.lit(seed)).alias("i")).distinct()
    order = sized.withColumn("key", F.xxhash64("track_a", "track_b"))
    upto = running(order, "key", {"after": "pairs"}, "track_a", "track_b").withColumn("before", F.col("after") - F.col("pairs"))
    bounds = upto.select("track_a", "track_b", "n_b", "before", "after")
    width = max(1, total // 4096)
    cut = lambda c: F.floor(F.col(c) / width)
    bounds = bounds.withColumn("bin", F.explode(F.sequence(cut("before"), F.floor((F.col("after") - 1) / width))))
    met = numbers.withColumn("bin", cut("i")).join(bounds, "bin").where("before <= i and i < after")
    met = met.withColumn("off", F.col("i") - F.col("before")).selectExpr("track_a", "track_b", "off div n_b as pos_a", "off % n_b as pos_b")
    p = positions(observations)
    place = lambda x: p.select(F.col("track").alias(f"track_{x}"), F.col("pos").alias(f"pos_{x}"), F.col("item_id").alias(x))
    return met.join(place("a"), ["track_a", "pos_a"]).join(place("b"), ["track_b", "pos_b"]).select("track_a", "track_b", "a", "b")


def hard_negatives(anchors: DataFrame, candidates: DataFrame, keep: int, digits: int = 6) -> DataFrame:
    """Of each anchor's candidates, the ``keep`` of another person that look most alike.

    ``anchors(sequence, person, a, vec)``, ``candidates(sequence, person, item_id, vec)`` of the same sequence, met in
    blocks, each of which gives its ``keep`` hardest.
    """

    def hardest(c: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        matrix = lambda v: np.array(v.tolist(), dtype=np.float64)
        c = c.sort_values("item_id", kind="stable")
        s = np.round(matrix(x["vec"]) @ matrix(c["vec"]).T, digits)
        s[x["person"].to_numpy()[:, None] == c["person"].to_numpy()[None, :]] = -np.inf
        pick = np.argsort(-s, axis=1, kind="stable")[:, :keep]
        found = pd.DataFrame({"a": np.repeat(x["a"].to_numpy(), pick.shape[1]), "b": c["item_id"].to_numpy()[pick].ravel(), "score": np.take_along_axis(s, pick, 1).ravel()})
        return found[np.isfinite(found["score"])]

    left, right = candidates.where("vec is not null").select("sequence", "person", "item_id", "vec"), anchors.where("vec is not null").select("sequence", "person", "a", "vec")
    pairs = meet_blocks(left, right, hardest, "a long, b long, score double", on=("sequence",), sent_key="a")
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= keep)


def mine_pairs(observations: DataFrame, gap: int, per_track: int, seed: int = 0) -> DataFrame:
    """``a, b, owner_a, owner_b, y``: the self-supervised mining as one operator, in equal classes.

    Positives are observations of one track at least ``gap`` places apart, at most ``per_track`` a track. Negatives are
    observations of two tracks alive together, as many as there are positives. The larger class is trimmed by hash.
    """
    positive = positive_pairs(observations, gap, per_track, seed).select("a", "b", F.col("track").alias("owner_a"), F.col("track").alias("owner_b"), F.lit(1).alias("y"))
    negative = negative_pairs(observations, positive.count(), seed).select("a", "b", F.col("track_a").alias("owner_a"), F.col("track_b").alias("owner_b"), F.lit(0).alias("y"))
    return balance(positive.unionByName(negative), "y", "a", "b", seed=seed)


def split_by_owner(pairs: DataFrame, is_test: Column, owner_a: str = "owner_a", owner_b: str = "owner_b") -> DataFrame:
    """``pairs`` with ``side`` train or test; pairs whose owners fall on both sides are dropped.

    ``is_test`` is a predicate on a column named ``owner``, so that an owner is on one side whole.
    """
    owners = pairs.select(F.col(owner_a).alias("owner")).union(pairs.select(F.col(owner_b).alias("owner"))).distinct()
    sides = owners.select("owner", is_test.alias("test"))
    out = pairs.join(sides.select(F.col("owner").alias(owner_a), F.col("test").alias("ta")), owner_a).join(
        sides.select(F.col("owner").alias(owner_b), F.col("test").alias("tb")), owner_b
    )
    return out.where("ta = tb").withColumn("side", F.when(F.col("ta"), "test").otherwise("train")).drop("ta", "tb")


def random_owners(pairs: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """``owner, test``: a hash permutation's first share of owners; at least one on each side."""
    owners = pairs.select(F.col("owner_a").alias("owner")).union(pairs.select(F.col("owner_b").alias("owner"))).distinct()
    n = owners.count()
    test = min(max(round(fraction * n), 1), max(n - 1, 1))
    return _numbered(owners, "owner", seed=seed).select("owner", (F.col("nth") <= test).alias("test"))


def _numbered(rows: DataFrame, *key: str, seed: int) -> DataFrame:
    """``rows`` with ``nth``, their place from 1 in the random order of ``key``, counted range by range."""
    hashed = rows.withColumns({"__one": F.lit(1), "__hash": F.xxhash64(F.lit(seed), *key)})
    return running(hashed, "__hash", {"nth": "__one"}, *key).drop("__one", "__hash")


def balance(rows: DataFrame, label: str = "y", *key: str, seed: int = 0) -> DataFrame:
    """Equal numbers of each class, chosen by hash of ``key``."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}  # a row a class
    least = min(sizes.values(), default=0)
    parts = [_numbered(rows.where(F.col(label).eqNullSafe(y)), *key, seed=seed).where(F.col("nth") <= least).drop("nth") for y in sorted(sizes, key=str)]
    return reduce(DataFrame.unionByName, parts) if parts else rows
