"""Operators on detections and sightings: overlap joins, attribution, suppression, lifecycles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, centre_distance, continuity, iou
from .running import running


def frame_pairs(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("seq", "frame"), prefix: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Boxes of one frame side by side, with ``iou`` and ``distance``."""
    a = left.select(*by, *[F.col(c).alias(prefix[0] + c) for c in left.columns if c not in by])
    b = right.select(*by, *[F.col(c).alias(prefix[1] + c) for c in right.columns if c not in by])
    x, y = Box.of(prefix[0]), Box.of(prefix[1])
    return a.join(b, list(by)).withColumn("iou", iou(x, y)).withColumn("distance", centre_distance(x, y))


def contested(detections: DataFrame, tracks: DataFrame, threshold: float, by: tuple[str, ...] = ("seq", "frame")) -> DataFrame:
    """Detections that lie over ``threshold`` inside two tracks or more: ``by, det_idx, deep``."""
    deep = frame_pairs(detections, tracks, by).where(F.col("iou") > threshold)
    return deep.groupBy(*by, F.col("a_det_idx").alias("det_idx")).agg(F.count("*").alias("deep")).where("deep >= 2")


def uncontested(detections: DataFrame, tracks: DataFrame, threshold: float, by: tuple[str, ...] = ("seq", "frame")) -> DataFrame:
    return detections.join(contested(detections, tracks, threshold, by), [*by, "det_idx"], "left_anti")


def attribute(detections: DataFrame, truth: DataFrame, least: float = 0.5, by: tuple[str, ...] = ("seq", "frame"), digits: int = 9) -> DataFrame:
    """The truth box each detection overlaps best, if by ``least`` or more; ties go to the first truth id."""
    pairs = frame_pairs(detections, truth, by).withColumn("r", F.round("iou", digits)).where(F.col("r") >= least)
    best = F.min_by(F.struct("b_id", "r"), F.struct(-F.col("r"), F.col("b_id")))
    return pairs.groupBy(*by, F.col("a_det_idx").alias("det_idx")).agg(best.alias("m")).select(*by, "det_idx", F.col("m.b_id").alias("id"), F.col("m.r").alias("iou"))


def suppress(boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, threshold: float) -> list[int]:
    """Greedy suppression in the order of scores (first wins ties): what overlaps a kept box of its class by
    more than ``threshold`` goes. Indices kept, in that order."""
    order, kept = np.argsort(-scores, kind="stable"), []
    area = np.clip(boxes[:, 2] - boxes[:, 0], 0, None) * np.clip(boxes[:, 3] - boxes[:, 1], 0, None)
    alive = np.ones(len(boxes), dtype=bool)
    for i in order:
        if not alive[i]:
            continue
        kept.append(int(i))
        w = np.clip(np.minimum(boxes[i, 2], boxes[:, 2]) - np.maximum(boxes[i, 0], boxes[:, 0]), 0, None)
        h = np.clip(np.minimum(boxes[i, 3], boxes[:, 3]) - np.maximum(boxes[i, 1], boxes[:, 1]), 0, None)
        union = area[i] + area - w * h
        overlap = np.divide(w * h, union, out=np.zeros_like(union), where=union > 0)
        alive &= ~((overlap > threshold) & (classes == classes[i]))
    return kept


def nms(detections: DataFrame, threshold: float, by: tuple[str, ...] = ("seq", "frame")) -> DataFrame:
    """``by, det_idx``: detections that survive suppression within their frame and class.

    Frames are dealt out by hash and come to Python many at a time, sorted; one that a batch cuts in two is
    carried over to the next.
    """
    kinds = ", ".join(f"{c} {detections.schema[c].dataType.simpleString()}" for c in (*by, "det_idx"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[list(by)]
        start = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
        at = [pdf[c].to_numpy() for c in ("score", "class_id")]
        corners = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        keep = [i + a for a, z in zip(start, [*start[1:], len(pdf)]) for i in suppress(corners[a:z], at[0][a:z].astype(float), at[1][a:z], threshold)]
        return pdf.iloc[keep][[*by, "det_idx"]]

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            last = (pdf[list(by)] == pdf[list(by)].iloc[-1]).all(axis=1).to_numpy()
            head = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            rest = pdf.iloc[head:].reset_index(drop=True)
            if head:
                yield settle(pdf.iloc[:head].reset_index(drop=True))
        if rest is not None:
            yield settle(rest)

    columns = [*by, "det_idx", "x1", "y1", "x2", "y2", "score", "class_id"]
    return detections.select(*columns).repartition(*by).sortWithinPartitions(*by, "det_idx").mapInPandas(run, kinds)


def decode_predictions(predictions: DataFrame, least: float, classes: list[int] | None = None) -> DataFrame:
    """``predictions(.., cx, cy, w, h, scores array, scale, pad_x, pad_y)`` -> boxes in the frame's pixels.

    The best class (the first on ties) and its score; below ``least`` or outside ``classes`` rows go.
    """
    best = F.array_max("scores")
    out = predictions.withColumn("score", best).withColumn("class_id", (F.array_position("scores", best) - 1).cast("int")).where(F.col("score") >= least)
    if classes is not None:
        out = out.where(F.col("class_id").isin(classes))
    half = {"x": F.col("w") / 2, "y": F.col("h") / 2}
    sides = {f"{a}{i}": ((F.col(f"c{a}") + (half[a] if i == 2 else -half[a])) - F.col(f"pad_{a}")) / F.col("scale") for a in "xy" for i in (1, 2)}
    return out.withColumns(sides).drop("cx", "cy", "w", "h", "scores", "scale", "pad_x", "pad_y")


def islands(sightings: DataFrame, key: str, time: str, gap, tie: str) -> DataFrame:
    """``sightings`` with ``island``, counted from 1: a new one where more than ``gap`` lies since the last."""
    w = Window.partitionBy(key).orderBy(time, tie)
    new = F.when(F.lag(time).over(w).isNull() | (F.col(time) - F.lag(time).over(w) > gap), 1).otherwise(0)
    rows = sightings.withColumn("__new", new)
    return rows.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def lifecycle(sightings: DataFrame, key: str, time: str, gap, tie: str, min_hits: int) -> DataFrame:
    """``key, island, first, last, hits, state``: lost if it was confirmed by ``min_hits``, dead if not."""
    g = islands(sightings, key, time, gap, tie).groupBy(key, "island").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("hits"))
    return g.withColumn("state", F.when(F.col("hits") >= min_hits, "lost").otherwise("dead"))


def coalive_counts(tracks: DataFrame) -> DataFrame:
    """``track, closed, strict``: how many other tracks ``(track, first, last)`` overlap in time.

    A track misses those that end before it starts and those that start after it ends. Both are running
    sums over the frames at which anything starts or ends, so nothing is paired.
    """
    starts = tracks.groupBy(F.col("first").alias("frame")).agg(F.count("*").alias("s"))
    ends = tracks.groupBy(F.col("last").alias("frame")).agg(F.count("*").alias("e"))
    flash = tracks.where("first = last").groupBy(F.col("first").alias("frame")).agg(F.count("*").alias("z"))
    frames = starts.join(ends, "frame", "full").join(flash, "frame", "full").na.fill(0)
    sums = running(frames.select("frame", F.col("s").alias("s0"), F.col("e").alias("e0"), "z"), "frame", {"s": "s0", "e": "e0"})
    a = sums.select(F.col("frame").alias("first"), (F.col("e") - F.col("e0")).alias("ended"), F.col("e").alias("ended_at"), F.col("z").alias("z1"), F.col("s0").alias("begun_with"))
    b = sums.select(F.col("frame").alias("last"), F.col("s").alias("begun"), (F.col("s") - F.col("s0")).alias("begun_before"))
    t = tracks.join(a, "first").join(b, "last")
    closed = F.col("begun") - F.col("ended") - 1
    # strictly: starts before the end, ends after the start; for a moment's track the same two sums hold, but
    # it is then not counted among them itself, nor are others of the same moment
    strict = F.when(F.col("first") < F.col("last"), F.col("begun_before") - F.col("ended_at") - 1).otherwise(
        F.col("begun_before") - (F.col("ended_at") - F.col("z1"))
    )
    return t.select("track", closed.cast("long").alias("closed"), strict.cast("long").alias("strict"))


def continuity_scores(sightings: DataFrame, key: str, time: str, tie: str, temporal: float, spatial: float) -> DataFrame:
    """``sightings`` with ``score`` against the same object's last sighting; 0 for its first."""
    w = Window.partitionBy(key).orderBy(time, tie)
    prev = {f"p_{c}": F.lag(c).over(w) for c in ("x1", "y1", "x2", "y2", time)}
    rows = sightings.withColumns(prev)
    return rows.withColumn("score", continuity(F.col(time) - F.col(f"p_{time}"), Box.of(), Box.of("p_"), temporal, spatial)).drop(*prev)


def recent_views(observations: DataFrame, key: str, time: str, value: str, n: int) -> DataFrame:
    """``observations`` with ``recent``: the last ``n`` values in order, the present one included."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(-n + 1, 0)
    return observations.withColumn("recent", F.collect_list(value).over(w))


def newest(frames: DataFrame, key: str, frame: str) -> DataFrame:
    """The newest frame of each stream; what came before is dropped."""
    return frames.groupBy(key).agg(F.max(frame).alias(frame)).join(frames, [key, frame])


def scene_ranking(boxes: DataFrame, scene: str, wanted, k: int = 10) -> DataFrame:
    """Scenes by their share of wanted boxes, the first ``k``."""
    g = boxes.groupBy(scene).agg(F.avg(wanted.cast("double")).alias("share"), F.count("*").alias("n"))
    return g.orderBy(F.desc(F.round("share", 9)), scene).limit(k)


def build_box_detector(kind: str, *, least_score: float, classes: list[int], threshold: float, by: tuple[str, ...] = ("frame",)):
    """A function from a model's raw predictions to boxes, by name: ``decoded``, or ``suppressed`` as well. An unknown name is
    an error. ``predictions`` are those of ``decode_predictions``, with a number ``row`` within their frame."""
    if kind not in ("decoded", "suppressed"):
        raise ValueError(f"unknown detector {kind!r}")

    def detect(predictions: DataFrame) -> DataFrame:
        found = decode_predictions(predictions, least_score, classes).withColumnRenamed("row", "det_idx")
        return found if kind == "decoded" else found.join(nms(found, threshold, by), [*by, "det_idx"], "left_semi")

    return detect
