"""Scores against truth: AUROC, thresholds, rates, calibration of identities, retrieval."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .memory import select_diverse
from .running import running
from .search import QUERY_BOUND, meet_blocks


def by_score(scored: DataFrame) -> DataFrame:
    """``scored(score, y)`` -> ``score, pos, neg`` and what lies at or above: ``tp, fp``, and ``p, n`` in all.

    Scores are grouped first, and the running sums are taken range by range.
    """
    g = scored.groupBy("score").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("neg"))
    every = g.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return running(g, "score", {"tp": "pos", "fp": "neg"}, descending=True).join(F.broadcast(every))


def auroc(scored: DataFrame, empty: float | None = 0.5) -> DataFrame:
    """One row, ``auroc``: the chance that a positive scores above a negative, ties one half.

    ``empty`` is the value where a class is missing: 0.5, or null for "undefined".
    """
    g = by_score(scored)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return g.agg(wins.alias("w"), F.max("p").alias("p"), F.max("n").alias("n")).select(
        F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / F.col("p") / F.col("n")).otherwise(F.lit(empty).cast("double")).alias("auroc")
    )


def youden_threshold(scored: DataFrame) -> DataFrame:
    """One row, ``threshold``: midway between the score that maximises TPR - FPR (the lowest on ties) and the
    next lower one. No row where a class is missing."""
    g = by_score(scored).where("p > 0 and n > 0").select("score", (F.col("tp") / F.col("p") - F.col("fp") / F.col("n")).alias("gain"))
    best = g.orderBy(F.desc(F.round("gain", 12)), "score").limit(1).select(F.col("score").alias("best"))
    lower = scored.select("score").join(F.broadcast(best)).where("score < best").agg(F.max("score").alias("lower"))
    return best.join(lower).select(((F.col("best") + F.coalesce("lower", "best")) / 2).alias("threshold"))


def false_merge_cut(scored: DataFrame, rate: float) -> DataFrame:
    """One row, ``n, allowed, cut``: the negative score that at most ``rate`` of the negatives lie above.

    The boundary is the next number up from ``cut`` (see ``boundary_above``).
    """
    neg = scored.where("y = 0").groupBy("score").agg(F.count("*").alias("c"))
    ranked = running(neg, "score", {"upto": "c"}, descending=True).join(F.broadcast(neg.agg(F.sum("c").alias("n"))))
    ranked = ranked.withColumn("allowed", F.floor(F.lit(rate) * F.col("n")))
    return ranked.where("upto > allowed").orderBy(F.desc("score")).limit(1).select(
        F.col("n").cast("long"), F.col("allowed").cast("long"), F.col("score").alias("cut")
    )


def boundary_above(cut: float | None) -> float:
    """The smallest number above the cut; infinity where there was no negative."""
    return math.inf if cut is None else math.nextafter(cut, math.inf)


def confusion(scored: DataFrame, threshold: float | Column) -> DataFrame:
    """One row: ``tp, fp, tn, fn, accuracy, tpr, tnr``; rates of nothing are 0."""
    up, y = F.col("score") >= threshold, F.col("y") == 1
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    t = scored.agg(n(up & y).alias("tp"), n(up & ~y).alias("fp"), n(~up & ~y).alias("tn"), n(~up & y).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(F.expr(a).cast("double"), F.expr(b)), F.lit(0.0))
    return t.select(
        "*", share("tp + tn", "tp + fp + tn + fn").alias("accuracy"), share("tp", "tp + fn").alias("tpr"), share("tn", "tn + fp").alias("tnr")
    )


def quantiles(rows: DataFrame, value: str, shares: list[float], *by: str) -> DataFrame:
    """``by, q0, q25, ..``: exact, linearly interpolated."""
    out = [F.percentile(F.col(value), F.lit(s)).alias(f"q{round(s * 100)}") for s in shares]
    return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def _bounded(rows: DataFrame) -> pd.DataFrame | None:
    """The rows, if there are at most ``QUERY_BOUND``."""
    head = rows.where("vec is not null").limit(QUERY_BOUND + 1).toPandas()
    return head if 0 < len(head) <= QUERY_BOUND else None


def best_matches(observations: DataFrame, exemplars: DataFrame, digits: int, on: tuple[str, ...] = (), block: int = 4096) -> DataFrame:
    """``track, item_id, identity_id, best``: each observation's best cosine to each identity.

    Where both sides have lifetimes ``t0, t1``, only identities alive at the same time as the observation's track
    (closed), or the track itself, are compared: observations go in the order of their time, some at once, against
    the identities that their span meets.
    """
    alive = "t0" in observations.columns

    def score(o: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        o, e = o.sort_values("t0" if alive else "item_id", kind="stable"), e.sort_values("identity_id", kind="stable")
        matrix, owner = np.array(e["vec"].tolist(), dtype=np.float64), e["identity_id"].to_numpy()
        out = []
        for at in range(0, len(o), 256):
            part = o.iloc[at : at + 256]
            track, cols = part["track"].to_numpy(), np.arange(len(owner))
            if alive:
                a0, a1, b0, b1 = (c.to_numpy() for c in (part["t0"], part["t1"], e["t0"], e["t1"]))
                cols = np.flatnonzero((b0 <= a1.max()) & (b1 >= a0.min()) | np.isin(owner, track))
            if not len(cols):
                continue
            ids, first = np.unique(owner[cols], return_index=True)
            best = np.maximum.reduceat(np.round(np.array(part["vec"].tolist(), dtype=np.float64) @ matrix[cols].T, digits), first, axis=1)
            keep = np.ones(best.shape, dtype=bool)
            if alive:
                c0, c1 = b0[cols][first], b1[cols][first]
                keep = (a0[:, None] <= c1) & (c0 <= a1[:, None]) | (track[:, None] == ids)
            r, c = np.nonzero(keep)
            out.append(pd.DataFrame({"track": track[r], "item_id": part["item_id"].to_numpy()[r], "identity_id": ids[c], "best": best[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"track": [], "item_id": [], "identity_id": [], "best": []})

    life = ["t0", "t1"] if alive else []
    left = observations.where("vec is not null").select("track", "item_id", "vec", *life, *on)
    right = exemplars.where("vec is not null").select("identity_id", "vec", *life, *on)
    found = meet_blocks(left, right, score, "track long, item_id long, identity_id long, best double", block, on, "item_id", "vec")
    return found.groupBy("track", "item_id", "identity_id").agg(F.max("best").alias("best"))


def identity_scores(observations: DataFrame, exemplars: DataFrame, on: str | None, quantile: float, digits: int = 6) -> DataFrame:
    """``track, identity_id, score``: of a track's observations' best cosines to an identity, a high quantile.

    The best exemplar counts, as exemplars are chosen to differ; over observations a quantile, as a single
    frame proves little. ``on`` names a column that both must share (label, sequence). Compared in blocks
    (see ``search.meet_blocks``); lifetimes ``t0, t1`` on both sides leave out who never met, but for a track's own.
    """
    best = best_matches(observations, exemplars, digits, (on,) if on else ())
    return best.groupBy("track", "identity_id").agg(F.percentile("best", F.lit(quantile)).alias("score"))


def halves(observations: DataFrame, least: int = 4) -> DataFrame:
    """Tracks of at least ``least`` observations, with ``late`` false for the first half (rounded down)."""
    w = Window.partitionBy("track")
    place = F.row_number().over(w.orderBy("frame", "item_id"))
    n = F.count("*").over(w)
    rows = observations.select("*", place.alias("place"), n.alias("size")).where(F.col("size") >= least)
    return rows.withColumn("late", F.col("place") > F.floor(F.col("size") / 2)).drop("place", "size")


def calibration_scores(observations: DataFrame, quantile: float) -> DataFrame:
    """``track, identity_id, y, score``: late halves against early ones; the own one is the positive, those of
    other tracks alive at the same time are negatives, but for scores of exactly 0 (slices that can't meet)."""
    cut = halves(observations)
    life = cut.groupBy("track").agg(F.min("frame").alias("t0"), F.max("frame").alias("t1"))
    cut = cut.join(life, "track")
    early = cut.where(~F.col("late")).select(F.col("track").alias("identity_id"), "vec", "t0", "t1")
    late = cut.where("late").select("track", "item_id", "vec", "t0", "t1")
    out = identity_scores(late, early, None, quantile).withColumn("y", (F.col("track") == F.col("identity_id")).cast("int"))
    return out.where("y = 1 or score != 0").select("track", "identity_id", "y", "score")


def real_returns(observations: DataFrame, least: int = 2) -> DataFrame:
    """``person, first_track, last_track``: for people with two tracks or more of ``least`` observations, the
    first is stored and the last one comes back; those between don't count."""
    tracks = observations.groupBy("person", "track").agg(F.min("frame").alias("start"), F.count("*").alias("n")).where(F.col("n") >= least)
    key = F.struct("start", "track")
    return tracks.groupBy("person").agg(
        F.min_by("track", key).alias("first_track"), F.max_by("track", key).alias("last_track"), F.count("*").alias("tracks")
    ).where("tracks >= 2").drop("tracks")


class _Ranking:
    """The queries of one unit, their hits, and how many rows of the gallery rank before each hit.

    Queries come first, then the rows of their people, then the whole gallery, in blocks. Vectors of queries are kept, of
    hits only their scores; a rounded score and a place in the order of ids make one number, so ties need no second look.
    """

    def __init__(self, scale: float, block: int):
        self.scale, self.block, self.rows, self.got = scale, block, [], 0
        self.hits, self.gallery, self.held, self.ready = None, [], 0, False

    def _exact(self, v: np.ndarray, places: int) -> bool:
        """Whether score and place fit into a double's integers together; not so for what isn't finite either."""
        most = np.sqrt((v * v).sum(axis=1).max(initial=0.0)) * self.longest * self.scale
        return bool((most + 2) * (places + 1) < 2**53)

    def query(self, item, track, owner, vec) -> None:
        self.rows.append((item, track, owner, vec))

    def _start(self) -> None:
        item, track, owner, vec = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((item, track, owner))
        self.item, self.track, self.owner, self.vec = item[order], track[order], owner[order], vec[order]
        self.longest = np.sqrt((vec * vec).sum(axis=1).max())
        self.people, self.begin = np.unique(self.owner, return_index=True)
        self.end = np.append(self.begin[1:], len(self.owner))
        self.hits = [[] for _ in self.people]

    def person(self, item, track, owner, vec) -> None:
        if self.hits is None:
            self._start()
        for k in np.flatnonzero(np.isin(self.people, owner)):
            its = owner == self.people[k]
            self.hits[k].append((item[its], track[its], np.rint(self.vec[self.begin[k] : self.end[k]] @ vec[its].T * -self.scale)))

    def _order_hits(self) -> None:
        """Each query's hits in their order, as score and place among the person's rows; those on its own track last."""
        for k, parts in enumerate(self.hits):
            item, track = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            by = np.argsort(item, kind="stable")
            item, track, keys = item[by], track[by], np.concatenate([p[2] for p in parts], axis=1).take(by, axis=1)  # rows stay whole in memory
            parts.clear()
            size, at, place, n = len(item) + 1, np.arange(len(item), dtype=np.float64), np.zeros(keys.shape, dtype=np.int32), np.zeros(len(keys), dtype=np.int64)
            exact = (max(keys.max(initial=0.0), -keys.min(initial=0.0)) + 2) * size < 2**53
            for q, row in enumerate(keys):
                own = track == self.track[self.begin[k] + q]
                n[q] = h = len(item) - np.count_nonzero(own)
                if exact:
                    row *= size
                    row += at
                    row[own] = np.inf
                    row.sort()
                    score = np.floor(row[:h] / size)
                    place[q, :h] = row[:h] - score * size
                    row[:h] = score
                else:
                    place[q] = np.lexsort((row, own))
                    row[:] = row[place[q]]
            self.hits[k] = (item, keys, place, n, np.zeros(keys.shape, dtype=np.int64))
        self.ready = True

    def meet(self, item, track, owner, vec) -> None:
        self.gallery.append((item, track, vec))
        self.got += len(item)
        self.held += len(item)
        if self.held >= self.block or self.held * vec[0].nbytes >= TOGETHER:
            self._count()

    def _count(self) -> None:
        if not self.ready:
            self._order_hits()
        item, track, vec = (np.concatenate(c) for c in zip(*self.gallery))
        self.gallery, self.held = [], 0
        by = np.argsort(item, kind="stable")
        item, track, vec = item[by], track[by], vec[by]
        m, exact, steps = len(item) + 1, self._exact(vec, len(item)), np.arange(len(item), dtype=np.float64)
        places = [np.searchsorted(item, h[0]) for h in self.hits]
        who = np.searchsorted(self.people, self.owner)
        for at in range(0, len(self.item), 32):
            here = self.track[at : at + 32]
            same = np.flatnonzero(np.isin(track, here))
            for r, row in enumerate(self.vec[at : at + 32] @ vec.T):
                k, own = who[at + r], same[track[same] == here[r]]
                _, score, place, n, counts = self.hits[k]
                q = at + r - self.begin[k]
                sought, behind = score[q, : n[q]], places[k][place[q, : n[q]]]
                row *= -self.scale
                np.rint(row, out=row)
                if not exact:  # by the order of the scores that there are
                    both = np.unique(np.concatenate([row, sought]), return_inverse=True)[1].astype(np.float64)
                    row, sought = both[: len(row)], both[len(row) :]
                row *= m
                row += steps
                row[own] = np.inf
                row.sort()
                counts[q, : n[q]] += np.searchsorted(row, sought * m + behind)

    def ranks(self):
        """``item, ranks`` of each query, ranks ascending."""
        if self.gallery:
            self._count()
        for k, (_, _, _, n, counts) in enumerate(self.hits or []):
            for q, item in enumerate(self.item[self.begin[k] : self.end[k]]):
                yield item, counts[q, : n[q]] + 1


HELD = 6_000_000  # scores of hits that a unit holds, about
TOGETHER = 1 << 25  # bytes of the gallery's vectors that are met at once
UNIT = 4096  # queries of a unit at most, about
PACKED = 1 << 15  # bytes of vectors in a row of the packed gallery


def _precision(ranks: np.ndarray) -> float:
    return float((np.arange(1, len(ranks) + 1) / ranks).mean())


def _unit_rows(observations: DataFrame, held: int) -> tuple[DataFrame, int, int]:
    """The rows of the gallery with ``owner``, ``unit`` and the units ``first..last`` of their person; the number of units and of rows.

    A unit is a share of the queries of some people, or some of one's, that have about ``held`` hits in all. Rows that are no
    queries (no person, or no other track) have negative units.
    """
    spark, o = observations.sparkSession, observations.where("vec is not null and track is not null")
    people = o.groupBy("person").agg(F.count("*").alias("n"), (F.min("track") < F.max("track")).alias("usable"))
    cost = F.col("n") * (F.col("n") + max(1, held // UNIT))
    usable = F.col("usable") & F.col("person").isNotNull()
    head = people.limit(QUERY_BOUND + 1).collect()
    if len(head) <= QUERY_BOUND:  # the table isn't read anew for each sum
        people = spark.createDataFrame(head, people.schema)
    rows, total = people.agg(F.sum("n"), F.sum(F.when(usable, cost))).first()
    dealt = people.where(usable).select("person", cost.alias("cost"), F.xxhash64("person").alias("place"))
    starts = running(dealt, "place", {"owner": "cost"}, "person", inclusive=False).select(
        "person", "owner", F.expr(f"owner div {held}").alias("first"), F.expr(f"(owner + cost - 1) div {held}").alias("last")
    )
    h = F.xxhash64("item_id")
    unit = F.when(F.col("owner").isNull(), -1 - F.pmod(h, F.lit(1024))).otherwise(F.col("first") + F.pmod(h, F.col("last") - F.col("first") + 1))
    whole = isinstance(o.schema["track"].dataType, IntegralType)
    track = F.col("track").cast("long") if whole else F.xxhash64("track")
    none = lambda c: F.coalesce(c, F.lit(-1)).cast("long").alias(c)
    out = o.join(starts, "person", "left").select(F.col("item_id").cast("long"), track.alias("track"), none("owner"), unit.alias("unit"), none("first"), none("last"), "vec")
    return out, -(-(total or 0) // held), rows or 0


def _per_query(observations: DataFrame, digits: int, give, schema: str, block: int = 1 << 17, held: int = HELD) -> DataFrame:
    """``give(items, ranks)`` of each usable query, a gallery of any size; ``give`` makes columns of ``schema`` from lists of both.

    The gallery is packed, dealt once and read by the task of each unit of queries, block by block, three times: for the unit's
    queries, for their people's rows (both skip other blocks), and whole. So neither pairs nor hits are ever rows, nothing is
    sent to all tasks, and what a task holds depends on ``held`` and ``block`` only.
    """
    spark = observations.sparkSession
    rows, units, size = _unit_rows(observations, held)
    if not units:
        return spark.createDataFrame([], schema)
    names = ["item_id", "track", "owner", "unit", "vec"]

    def pack(batches):
        for b in batches:
            item, track, owner, unit, first, last = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            vec = np.ascontiguousarray(b.column(6).flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            if not len(item):
                continue
            vec = vec.reshape(len(item), -1)
            step, out = max(1, PACKED // max(8, 8 * vec.shape[1])), []
            for at in range(0, len(item), step):
                cut = slice(at, at + step)
                out.append([unit[cut].min(), unit[cut].max(), first[cut].min(), last[cut].max(), *[c[cut].tobytes() for c in (item, track, owner, unit, vec)]])
            kinds = [pa.int64()] * 4 + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["lo", "hi", "first", "last", *names])

    packed = rows.repartition("unit").sortWithinPartitions("first", "unit").mapInArrow(pack, "lo long, hi long, first long, last long, " + ", ".join(f"{c} binary" for c in names))
    reads = spark.range(0, 3 * units, 1, units).select(F.expr("id div 3").alias("u"), (F.col("id") % 3).alias("read"))
    wanted = F.when(F.col("read") == 0, F.col("u").between(F.col("lo"), F.col("hi"))).when(F.col("read") == 1, F.col("u").between(F.col("first"), F.col("last"))).otherwise(True)
    met = reads.join(packed.repartition(1).hint("shuffle_replicate_nl"), wanted).select("u", "read", *names)  # a task is a unit and the whole gallery

    def rank(batches):
        now, state = None, None

        def settled():
            if state.got != size:
                raise RuntimeError(f"unit {now} has met {state.got} rows of {size}")
            items, ranks = [], []
            for i, r in state.ranks():
                items.append(i)
                ranks.append(r)
                if len(items) == 256:
                    yield give(items, ranks)
                    items, ranks = [], []
            if items:
                yield give(items, ranks)

        for b in batches:
            for i in range(b.num_rows):
                u, read = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                item, track, owner, unit = (np.frombuffer(b.column(c)[i].as_buffer(), dtype=np.int64) for c in range(2, 6))
                vec = np.frombuffer(b.column(6)[i].as_buffer(), dtype=np.float64).reshape(len(item), -1)
                if u != now:
                    if state is not None and state.rows:
                        yield from settled()
                    now, state = u, _Ranking(10.0**digits, block)
                if read == 0:
                    its = unit == u
                    if its.any():
                        state.query(item[its], track[its], owner[its], vec[its])
                elif state.rows:
                    (state.person if read == 1 else state.meet)(item, track, owner, vec)
        if state is not None and state.rows:
            yield from settled()

    return met.mapInArrow(rank, schema)


def _summary(items: list, ranks: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in ranks], pa.int64()), pa.array([_precision(r) for r in ranks])], ["first", "ap"])


def _counted_ranks(observations: DataFrame, digits: int, block: int = 1 << 17, held: int = HELD) -> DataFrame:
    """``query, rank`` of the hits in each usable query's gallery, of any size."""

    def give(items: list, ranks: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(items, [len(r) for r in ranks])), pa.array(np.concatenate(ranks))], ["query", "rank"])

    return _per_query(observations, digits, give, "query long, rank long", block, held)


def _hit_ranks(queries: DataFrame, bank: pd.DataFrame, digits: int, summed: bool = False) -> DataFrame:
    """``query, rank`` of the hits in each usable query's gallery; or each query's ``first, ap``, if ``summed``."""
    bank = bank.sort_values("item_id", kind="stable")
    sent = queries.sparkSession.sparkContext.broadcast((bank["person"].to_numpy(), bank["track"].to_numpy(), np.array(bank["vec"].tolist(), dtype=np.float64)))

    def run(batches):
        person, track, e = sent.value
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                s = np.round(np.array(part["vec"].tolist(), dtype=np.float64) @ e.T, digits)
                own = part["track"].to_numpy()[:, None] == track[None, :]
                order = np.argsort(np.where(own, np.inf, -s), axis=1, kind="stable")
                hit = (part["person"].to_numpy()[:, None] == person[None, :]) & ~own
                row, place = np.nonzero(np.take_along_axis(hit, order, axis=1))
                if not summed:
                    yield pd.DataFrame({"query": part["item_id"].to_numpy()[row], "rank": place + 1})
                elif len(row):
                    ranks = np.split(place + 1, np.flatnonzero(np.diff(row)) + 1)
                    yield pd.DataFrame({"first": [r[0] for r in ranks], "ap": [_precision(r) for r in ranks]})

    return queries.where("vec is not null").mapInPandas(run, "first long, ap double" if summed else "query long, rank long")


def retrieval(observations: DataFrame, digits: int = 6) -> DataFrame:
    """One row: ``queries, rank1, rank5, rank10, map``.

    A query is usable if its person is on another track as well; its own track is no part of its gallery. A
    gallery of up to ``QUERY_BOUND`` observations goes to the queries' tasks as a matrix. Beyond, tasks read it block by
    block and count what ranks before each hit. Either way a query is summed up in one task, and hits are never rows.
    """
    o = observations.where("track is not null").select("item_id", "person", "track", "vec")
    bank = _bounded(o)
    per = _per_query(o, digits, _summary, "first long, ap double") if bank is None else _hit_ranks(o, bank, digits, True)
    within = lambda k: F.avg((F.col("first") <= k).cast("double"))
    return per.agg(
        F.count("*").alias("queries"), within(1).alias("rank1"), within(5).alias("rank5"), within(10).alias("rank10"), F.avg("ap").alias("map")
    )


def trapezoid_auroc(scored: DataFrame) -> DataFrame:
    """AUROC as the area under the curve over single rows: ties aren't averaged; rows tie by ``key``."""
    rows = running(scored, "score", {"tp": "y"}, "key", descending=True)
    return rows.agg((F.sum(F.when(F.col("y") == 0, F.col("tp"))) / F.sum("y") / F.sum(1 - F.col("y"))).alias("auroc"))


def pair_similarity(observations: DataFrame, digits: int = 6, block: int = 4096) -> DataFrame:
    """``person, mean, median, pairs`` of the cosines of all pairs of one person's observations.

    Blocks of pairs are counted by rounded cosine, at most 2 * 10 ** ``digits`` + 1 different values, and only the counts go on.
    """
    o = observations.where("vec is not null").select("person", "item_id", "vec")

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        matrix = lambda s: np.array(s.tolist(), dtype=np.float64)
        later = a["item_id"].to_numpy()[:, None] < b["query_id"].to_numpy()[None, :]
        values, n = np.unique(np.round(matrix(a["vec"]) @ matrix(b["vec"]).T, digits)[later], return_counts=True)
        return pd.DataFrame({"person": a["person"].iloc[0], "s": values + 0.0, "n": n})

    kind = o.schema["person"].dataType.simpleString()
    found = meet_blocks(o, o.withColumnRenamed("item_id", "query_id"), count, f"person {kind}, s double, n long", block, ("person",))
    g = found.groupBy("person", "s").agg(F.sum("n").alias("n"))
    return g.groupBy("person").agg(
        (F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("mean"), F.percentile("s", F.lit(0.5), F.col("n")).alias("median"), F.sum("n").alias("pairs")
    )


def class_means(scored: DataFrame, by: str = "y") -> DataFrame:
    """``by, mean, n``: the mean score of each class."""
    return scored.groupBy(by).agg(F.avg("score").alias("mean"), F.count("score").alias("n"))


def returned_scores(observations: DataFrame, quantile: float, keep: int = 5, least: int = 2, on: str | None = None, digits: int = 6) -> DataFrame:
    """``person, identity_id, y, score``: real returns. Each person's first track is stored, its ``keep`` most spread
    observations as exemplars; the last track of each is the query. The own identity is the positive, those of
    others are negatives, of the same ``on`` (sequence) if that is given.
    """
    ends = real_returns(observations, least)
    extra = [on] if on else []
    pick = lambda c: observations.join(ends.select("person", F.col(c).alias("track")), ["person", "track"]).select("person", "item_id", "vec", *extra)
    first = pick("first_track").withColumnRenamed("person", "identity_id")
    chosen = select_diverse(first.select("item_id", "identity_id", "vec"), keep).select("identity_id", "item_id")
    stored = first.join(chosen, ["identity_id", "item_id"]).drop("item_id")
    scores = identity_scores(pick("last_track").withColumnRenamed("person", "track"), stored, on, quantile, digits)
    return scores.select(F.col("track").alias("person"), "identity_id", (F.col("track") == F.col("identity_id")).cast("int").alias("y"), "score")
