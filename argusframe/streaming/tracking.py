"""Tracking as a stream: frames of many sequences, each sequence one key with its tracker and binder as state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.binding import BinderConfig
from ..operators.tracking import TrackerConfig
from ..operators.tracks import TRACK_SCHEMA, SequenceRun, as_frame, as_result

STATE = "version int, arrays binary, last int"
VERSION = 1  # of the arrays' names and shapes


def one_row_a_frame(detections: DataFrame) -> DataFrame:
    """``detections`` as ``track_frames`` takes them -> a row a frame, with its detections in an array.

    Apply it to files or batches that hold whole frames.
    """
    det = F.struct("det_idx", "x1", "y1", "x2", "y2", "score", "class_id", "label", "vec")
    return detections.groupBy("seq", "frame").agg(
        F.max("detector_ran").alias("detector_ran"), F.array_sort(F.collect_list(F.when(F.col("det_idx").isNotNull(), det))).alias("detections")
    )


def track_stream(
    frames: DataFrame, tracker: TrackerConfig = TrackerConfig(), binder: BinderConfig | None = None, fps: float = 30.0,
    fold_on_death: bool = True, idle: str | None = None,
) -> DataFrame:
    """``frames(seq, frame, detector_ran, detections)`` of a stream -> what ``track_frames`` gives.

    Frames that a trigger brings are put in order; a frame at or before the last one processed is late and
    dropped. Frames in between that never came count as not looked at: motion is followed, nothing ages.
    State lives in the checkpoint, keyed by sequence, as an archive of the state's arrays by name and its version; with ``idle`` (milliseconds as text) a sequence
    without frames for that long is forgotten.
    """
    columns = ["det_idx", "x1", "y1", "x2", "y2", "score", "class_id", "label", "vec"]

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        version, packed, last = state.get if state.exists else (VERSION, None, -1)
        if version != VERSION:
            raise ValueError(f"state of version {version} can't be read")
        job = SequenceRun.load(bytes(packed), tracker, binder, fps, fold_on_death) if packed else SequenceRun(tracker, binder, fps, fold_on_death)
        rows = pd.concat(list(batches)).sort_values("frame")
        out: list[tuple] = []
        for r in rows.itertuples(index=False):
            if r.frame <= last:
                continue
            last = int(r.frame)
            found = [d if isinstance(d, dict) else d.asDict() for d in (r.detections if r.detections is not None else [])]
            frame = as_frame(pd.DataFrame(found, columns=columns)) if r.detector_ran else None
            out += [(key[0], *row) for row in job.feed(last, frame)]
        state.update((VERSION, job.dump(), last))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield as_result(out)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return frames.groupBy("seq").applyInPandasWithState(step, TRACK_SCHEMA, STATE, "append", timeout)


def session_tracks(sightings: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Lifecycle of a stream of sightings: a gap ends a track, as ``max_age`` does. Rows later than ``late``
    behind the newest are dropped."""
    return sightings.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("hits")).select(
        key, F.col("w.start").alias("first"), F.col("w.end").alias("ends"), "hits"
    )


def detected_frames(frames: DataFrame, every: int) -> DataFrame:
    """The detector's stride: whether it runs on a frame."""
    return frames.withColumn("detector_ran", F.col("frame") % every == 0)
