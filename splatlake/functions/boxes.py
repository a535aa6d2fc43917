"""Axis-aligned 2D boxes as structs ``{x1,y1,x2,y2}``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(x1, y1, x2, y2) -> Column:
    names = ("x1", "y1", "x2", "y2")
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(n) for v, n in zip((x1, y1, x2, y2), names)])


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def intersection_over_smaller(a: Column, b: Column) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(F.lit(0.0))


def center_distance(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Distance of the centres as a fraction of the image diagonal."""
    dx = (a["x1"] + a["x2"]) / 2 - (b["x1"] + b["x2"]) / 2
    dy = (a["y1"] + a["y2"]) / 2 - (b["y1"] + b["y2"]) / 2
    diagonal = F.greatest(F.lit(1.0), F.sqrt(width * width + height * height))
    return F.sqrt(dx * dx + dy * dy) / diagonal


def area_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger area; 0 when either is empty."""
    s, t = area(a), area(b)
    return F.when((s > 0) & (t > 0), F.least(s, t) / F.greatest(s, t)).otherwise(F.lit(0.0))


def clip(b: Column, width: Column, height: Column) -> Column:
    """Clamp the corners to ``[0, w-1] x [0, h-1]``."""
    def clamp(v, hi):
        return F.greatest(F.lit(0.0), F.least((hi - 1).cast("double"), v))

    return box(clamp(b["x1"], width), clamp(b["y1"], height), clamp(b["x2"], width), clamp(b["y2"], height))


def area_fraction(b: Column, width: Column, height: Column) -> Column:
    return area(b) / F.greatest(F.lit(1.0), (width * height).cast("double"))
