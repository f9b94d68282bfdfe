"""Rectangles (struct<x, y, w, h>) and order statistics, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))))


def _shared(a: Column, b: Column) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    both = _shared(a, b)
    return _ratio(both, a["w"] * a["h"] + b["w"] * b["h"] - both)


def overlap_ratio(a: Column, b: Column) -> Column:
    """The shared area as a part of the smaller rectangle."""
    return _ratio(_shared(a, b), F.least(a["w"] * a["h"], b["w"] * b["h"]))


def same_line(a: Column, b: Column) -> Column:
    deep = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    apart = F.greatest(a["x"], b["x"]) - F.least(a["x"] + a["w"], b["x"] + b["w"])
    return (deep >= F.least(a["h"], b["h"]) * 0.5) & (apart < F.greatest(a["h"], b["h"]) * 4)


def gap_between(a: Column, b: Column) -> Column:
    across = F.greatest(F.lit(0.0), F.greatest(a["x"], b["x"]) - F.least(a["x"] + a["w"], b["x"] + b["w"]))
    down = F.greatest(F.lit(0.0), F.greatest(a["y"], b["y"]) - F.least(a["y"] + a["h"], b["y"] + b["h"]))
    return F.hypot(across, down)


def contains_point(r: Column, x: Column, y: Column) -> Column:
    return (x >= r["x"]) & (x <= r["x"] + r["w"]) & (y >= r["y"]) & (y <= r["y"] + r["h"])


def clamp(r: Column, width: Column, height: Column) -> Column:
    """A rectangle of whole pixels within a page, at least one wide and high."""
    x, y = F.greatest(F.lit(0.0), F.floor(r["x"])), F.greatest(F.lit(0.0), F.floor(r["y"]))
    x1, y1 = F.least(width, F.ceil(r["x"] + r["w"])), F.least(height, F.ceil(r["y"] + r["h"]))
    return rect(x, y, F.greatest(F.lit(1.0), x1 - x), F.greatest(F.lit(1.0), y1 - y))


def upper_median(x: Column) -> Column:
    """Aggregate: the element at half the count (from 0) of the sorted values."""
    values = F.array_sort(F.collect_list(x))
    return F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)


def bounding_box(r: Column) -> Column:
    """Aggregate: the least rectangle around all."""
    return rect(F.min(r["x"]), F.min(r["y"]), F.max(r["x"] + r["w"]) - F.min(r["x"]), F.max(r["y"] + r["h"]) - F.min(r["y"]))


def js_round(x: Column) -> Column:
    """Halves round up."""
    return F.floor(x + 0.5)
