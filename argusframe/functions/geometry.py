"""Boxes, intervals, crops. Boxes are corners ``x1, y1, x2, y2``; all are JVM expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}").cast("double") for c in ("x1", "y1", "x2", "y2")))


def _positive(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; sides are clipped at zero, no union gives 0."""
    inter = _positive(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * _positive(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    area = lambda x: _positive(x.x2 - x.x1) * _positive(x.y2 - x.y1)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def centre_distance(a: Box, b: Box) -> Column:
    """Distance of the centres in mean widths, each width at least 1."""
    dx = (a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2
    dy = (a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2
    width = (F.greatest(a.x2 - a.x1, F.lit(1.0)) + F.greatest(b.x2 - b.x1, F.lit(1.0))) / 2
    return F.sqrt(dx * dx + dy * dy) / width


def to_centre(b: Box) -> dict[str, Column]:
    return {"cx": (b.x1 + b.x2) / 2, "cy": (b.y1 + b.y2) / 2, "w": b.x2 - b.x1, "h": b.y2 - b.y1}


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def overlaps_strictly(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Lifetimes that share more than a moment; one that starts as the other ends is its sequel."""
    return (a0 < b1) & (b0 < a1)


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Closed intervals; touching counts. Used for being alive together."""
    return (a0 <= b1) & (b0 <= a1)


def crop_region(b: Box, width: int, height: int, upper: float = 1.0, least: int = 0) -> dict[str, Column]:
    """Pixel region of a box for an encoder: rounded half to even, clamped to the frame, the upper part of
    its height; ``usable`` is false below ``least`` pixels a side."""
    clamp = lambda c, top: F.greatest(F.lit(0), F.least(F.bround(c, 0).cast("int"), F.lit(top)))
    x1, y1, x2, y2 = clamp(b.x1, width), clamp(b.y1, height), clamp(b.x2, width), clamp(b.y2, height)
    bottom = y1 + F.bround((y2 - y1) * F.lit(float(upper)), 0).cast("int")
    return {"px1": x1, "py1": y1, "px2": x2, "py2": bottom, "usable": (x2 - x1 >= least) & (bottom - y1 >= least) & (x2 > x1) & (bottom > y1)}


def detection_crop(b: Box, width: int, height: int, upper: float = 1.0) -> dict[str, Column]:
    """Pixel region of a detection: truncated, at least one pixel, clamped so that it lies in the frame."""
    x1 = F.greatest(F.lit(0), F.least(b.x1.cast("int"), F.lit(width - 1)))
    y1 = F.greatest(F.lit(0), F.least(b.y1.cast("int"), F.lit(height - 1)))
    x2 = F.greatest(x1 + 1, F.least(b.x2.cast("int"), F.lit(width)))
    y2 = F.greatest(y1 + 1, F.least(b.y2.cast("int"), F.lit(height)))
    return {"px1": x1, "py1": y1, "px2": x2, "py2": F.greatest(y1 + 1, y1 + ((y2 - y1) * F.lit(float(upper))).cast("int"))}


def undo_letterbox(b: Box, scale: Column, pad_x: Column, pad_y: Column) -> Box:
    return Box((b.x1 - pad_x) / scale, (b.y1 - pad_y) / scale, (b.x2 - pad_x) / scale, (b.y2 - pad_y) / scale)


def should_embed(hits: Column, every: int) -> Column:
    """The first association, then every ``every``-th; never for ``every`` or hits of 0 and less."""
    if every <= 0:
        return F.lit(False)
    return (hits > 0) & ((hits == 1) | (hits % every == 0))


def continuity(gap: Column, here: Box, there: Box, temporal: float, spatial: float) -> Column:
    """How strongly time and place say that what is ``here`` is what was seen ``there``: 0 to 1, 0 for the unseen."""
    dx = (here.x1 + here.x2) / 2 - (there.x1 + there.x2) / 2
    dy = (here.y1 + here.y2) / 2 - (there.y1 + there.y2) / 2
    far = F.sqrt(dx * dx + dy * dy) / F.greatest(there.x2 - there.x1, F.lit(1.0))
    value = F.exp(-_positive(gap) / max(temporal, 1e-6)) * F.exp(-far / max(spatial, 1e-6))
    return F.coalesce(value, F.lit(0.0))


def is_static(first: Box, now: Box, peak_score: Column, convincing: float, motion: float) -> Column:
    """Weakly detected and never moved ``motion`` of its own first width; weak alone if ``motion`` is off."""
    weak = peak_score < convincing
    if motion <= 0:
        return weak
    dx = (now.x1 + now.x2) / 2 - (first.x1 + first.x2) / 2
    dy = (now.y1 + now.y2) / 2 - (first.y1 + first.y2) / 2
    return weak & (F.sqrt(dx * dx + dy * dy) < motion * F.greatest(first.x2 - first.x1, F.lit(1.0)))


def id_colour(identity: Column) -> dict[str, Column]:
    """A steady colour for an id."""
    return {c: (F.pmod(identity * step, F.lit(206)) + 50).cast("int") for c, step in (("r", 37), ("g", 17), ("b", 29))}
