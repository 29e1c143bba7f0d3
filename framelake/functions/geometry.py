"""Boxes, distances, windows and court coordinates as column expressions."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> Column:
    """The struct of four box columns, null for a degenerate box."""
    x1, y1, x2, y2 = (F.col(prefix + c) for c in BOX)
    return F.when((x2 > x1) & (y2 > y1), F.struct(*[F.col(prefix + c).alias(c) for c in BOX]))


def require_box(b: Column) -> Column:
    """``b``, or a failure if it is degenerate."""
    return F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), b).otherwise(F.raise_error(F.lit("a box needs x2 > x1 and y2 > y1")).cast("struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>"))


def center_x(b: Column) -> Column:
    return F.floor((b["x1"] + b["x2"]) / 2)


def center_y(b: Column) -> Column:
    return F.floor((b["y1"] + b["y2"]) / 2)


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def overlap(a: Column, b: Column) -> Column:
    """Area common to two boxes."""
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    common = overlap(a, b)
    return common / (area(a) + area(b) - common)


def coverage(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that ``outer`` covers."""
    return overlap(inner, outer) / area(inner)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def distance_to_box(x: Column, y: Column, b: Column) -> Column:
    """Shortest distance from a point to a box, 0 inside."""
    dx, dy = F.greatest(b["x1"] - x, F.lit(0), x - b["x2"]), F.greatest(b["y1"] - y, F.lit(0), y - b["y2"])
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def inside(x: Column, y: Column, b: Column) -> Column:
    """Whether a point lies in a box, borders included."""
    return x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"])


def scaled(b: Column, factor: Column | float, width: Column | int, height: Column | int) -> Column:
    """The box times ``factor``, rounded half to even and kept within the image."""
    limit = lambda c, most: F.greatest(F.lit(0), F.least(F.bround(b[c] * F.lit(factor)).cast("long"), F.lit(most)))
    return F.struct(limit("x1", width).alias("x1"), limit("y1", height).alias("y1"), limit("x2", width).alias("x2"), limit("y2", height).alias("y2"))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """``x`` within the bounds; a null stays null, which least and greatest alone would drop."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def square_crop(cx: Column, cy: Column, side: Column, width: Column, height: Column) -> Column:
    """(crop_x, crop_y, side) of a square around a centre, moved into the image."""
    at = lambda c, most: F.least(F.greatest(c - F.floor(side / 2), F.lit(0)), most - side)
    return F.struct(at(cx, width).alias("crop_x"), at(cy, height).alias("crop_y"), side.alias("side"))


def adaptive_crop(points: Column, width: Column, height: Column, *, margin: int = 300, least: int = 1200) -> Column:
    """A square around all track points (half scale) with a margin, at most the short side of the image."""
    xs, ys = F.transform(points, lambda p: p["cx"].cast("long") * 2), F.transform(points, lambda p: p["cy"].cast("long") * 2)
    left, right, top, bottom = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    side = F.least(F.greatest(F.greatest(right - left, bottom - top) + 2 * margin, F.lit(least)), F.least(width, height))
    return square_crop(F.floor((left + right) / 2), F.floor((top + bottom) / 2), side, width, height)


def expanded(b: Column, ratio: float, width: Column | int, height: Column | int) -> Column:
    """The box grown by ``ratio`` of its size on every side, within the image."""
    dx, dy = F.floor((b["x2"] - b["x1"]) * ratio), F.floor((b["y2"] - b["y1"]) * ratio)
    return F.struct(
        F.greatest(b["x1"] - dx, F.lit(0)).alias("x1"), F.greatest(b["y1"] - dy, F.lit(0)).alias("y1"), F.least(b["x2"] + dx, F.lit(width)).alias("x2"), F.least(b["y2"] + dy, F.lit(height)).alias("y2")
    )


def ratio_reason(b: Column, *, low: float = 0.15, high: float = 1.2) -> Column:
    """Why a crop's width to height ratio fails, null if it passes; borders pass."""
    ratio = (b["x2"] - b["x1"]) / (b["y2"] - b["y1"])
    return F.when(b.isNull(), None).when(ratio < low, "narrow").when(ratio > high, "wide")


# --- windows of time, in whole deciseconds ------------------------------------------------------------------------


def clip_window(first: Column, last: Column, *, before: int = 20, after: int = 40) -> Column:
    return F.struct(F.greatest(F.lit(0), first - before).alias("start"), (last + after).alias("end"))


def preview_window(anchor: Column, *, before: int = 40, after: int = 20) -> Column:
    return F.struct(F.greatest(F.lit(0), anchor - before).alias("start"), (anchor + after).alias("end"))


def split_window(start: Column, end: Column, duration: Column, *, most: int = 40) -> Column:
    """(start, end, over): the part within a file and what continues, at most ``most``, in the next."""
    return F.struct(start.alias("start"), F.least(end, duration).alias("end"), F.least(F.greatest(end - duration, F.lit(0)), F.lit(most)).alias("over"))


# --- court --------------------------------------------------------------------------------------------------------

#: Fixed values of the court, in metres.
PERSON_HEIGHT, NEAR_RIM, PAINT_HALF, PAINT_DEPTH, ARC, CORNER_X, SIDE_DEGREES = 1.75, 1.25, 2.45, 4.225, 6.75, 6.6, 50.0
CORNER_Y = sqrt(ARC * ARC - CORNER_X * CORNER_X)


def to_court(x: Column, y: Column, hoop_x: Column, hoop_y: Column, box_height: Column, flipped: Column) -> Column:
    """Metres from the hoop by the height of the person's box; mirrored where ``flipped``."""
    scale = F.lit(PERSON_HEIGHT) / box_height
    dx = (x - hoop_x) * scale
    return F.struct(F.when(flipped, -dx).otherwise(dx).alias("x"), ((y - hoop_y) * scale).alias("y"))


def in_court(x: Column, y: Column) -> Column:
    return (F.abs(x) <= 8.0) & y.between(-2.075, 12.925)


def zone_of(x: Column, y: Column) -> Column:
    """One of ten zones; the first rule that fits counts."""
    radius = F.sqrt(x * x + y * y)
    degrees = F.atan2(F.abs(x), F.greatest(y, F.lit(1e-6))) * (180.0 / pi)
    side = lambda name: F.when(x < 0, f"{name}_l").otherwise(f"{name}_r")
    within = (F.abs(x) <= CORNER_X) & (radius <= ARC)
    return (
        F.when(radius <= NEAR_RIM, "ra")
        .when(within & (F.abs(x) <= PAINT_HALF) & (y <= PAINT_DEPTH), "paint")
        .when(within & (F.abs(x) <= PAINT_HALF), "mid_c")
        .when(within, side("mid"))
        .when((F.abs(x) > CORNER_X) & (y <= CORNER_Y), side("corner"))
        .when(degrees > SIDE_DEGREES, side("p45"))
        .otherwise("top")
    )
