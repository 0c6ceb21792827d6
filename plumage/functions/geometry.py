"""Box geometry as column expressions. A box is four columns x1, y1, x2, y2, or a struct that has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> dict[str, Column]:
    return {s: F.col(prefix + s) for s in SIDES}


def area(b) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def intersection(a, b) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def union_area(a, b) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a, b) -> Column:
    """Intersection over union; 0 where the union is empty."""
    u = union_area(a, b)
    return F.when(u > 0, intersection(a, b) / u).otherwise(F.lit(0.0))


def iou_at_least(a, b, percent: int) -> Column:
    """iou >= percent / 100, in whole numbers where the sides are whole."""
    u = union_area(a, b)
    return (u > 0) & (intersection(a, b) * 100 >= u * percent)


def mostly_contained(outer, inner, percent: int) -> Column:
    """The outer box is no smaller, and percent of the inner one lies in it."""
    return (area(inner) > 0) & (area(outer) >= area(inner)) & (intersection(outer, inner) * 100 >= area(inner) * percent)


def contained_relation(a, b, percent: int) -> Column:
    """'first' or 'second' for the larger box if percent of the smaller lies in it ('first' if equal), else null."""
    small = F.least(area(a), area(b))
    return F.when((small > 0) & (intersection(a, b) * 100 >= small * percent), F.when(area(a) >= area(b), F.lit("first")).otherwise("second"))


def touching(a, b) -> Column:
    """Closed rectangles that share a point."""
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(c, high if isinstance(high, Column) else F.lit(high)))


def clamped(b, width: Column, height: Column) -> dict[str, Column]:
    return {s: clamp(b[s], 0, width if s[0] == "x" else height) for s in SIDES}


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Normalised centre and size to clamped corners of an image of that size."""
    half_w, half_h = w * width * 0.5, h * height * 0.5
    raw = {"x1": cx * width - half_w, "y1": cy * height - half_h, "x2": cx * width + half_w, "y2": cy * height + half_h}
    return clamped(raw, width.cast("double"), height.cast("double"))


def letterbox_inverse(v: Column, pad: Column, scale: Column, size: Column) -> Column:
    """A coordinate of the padded, scaled image in the original."""
    return clamp((v - pad) / scale, 0.0, size.cast("double"))


def enlarged(b, width: Column, height: Column, ratio: float, aspect: float = 1.0) -> dict[str, Column]:
    """A window grown about evenly to ``ratio`` times its area, as far as the image allows on both sides."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    half = w + h * aspect
    delta = F.round((-half + F.sqrt(F.greatest(half * half - 4 * aspect * (1 - ratio) * w * h, F.lit(0.0)))) / (4 * aspect))
    dw = F.least(F.round(delta * aspect), b["x1"], width - b["x2"]).cast("int")
    dh = F.least(delta, b["y1"], height - b["y2"]).cast("int")
    real = (w > 0) & (h > 0)
    sides = {"x1": b["x1"] - dw, "y1": b["y1"] - dh, "x2": F.least(b["x2"] + dw, width), "y2": F.least(b["y2"] + dh, height)}
    return {s: F.when(real, c).otherwise(F.lit(0)) for s, c in sides.items()}


def reflected(i: Column, n: Column) -> Column:
    """Index i mirrored into 0..n-1, without repeating the border."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    k = F.pmod(i, period)
    return F.when(n <= 1, F.lit(0)).otherwise(F.least(k, period - k))
