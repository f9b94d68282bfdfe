"""Boxes of text: padding, filters and joins on rectangles, as columns and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry

KEYS = ("page", "box")


def unclip(w: Column, h: Column, ratio: float = 1.5) -> Column:
    """How far a detected box grows on each side: area times ratio over its outline."""
    return w * h * ratio / (2 * (w + h))


def fold_angle(a: Column) -> Column:
    """An angle in degrees as one above -45 and up to 45."""
    return a - 90 * F.ceil((a - 45) / 90)


def principal_axis(points: DataFrame, *keys: str) -> DataFrame:
    """angle (degrees) and elongation of each group of points (x, y)."""
    m = points.groupBy(*keys).agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"))
    mean, part = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.col("c") * F.col("c"))
    angle = F.degrees(F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))) / 2
    return m.select(*keys, angle.alias("angle"), F.sqrt((mean + part) / F.greatest(F.lit(1e-6), mean - part)).alias("elongation"))


def line_skew(lines: DataFrame) -> DataFrame:
    """The upper median of the folded angles of long lines (elongation above 4) of each page with three of them or more."""
    long = lines.where("elongation > 4 AND angle IS NOT NULL").withColumn("a", fold_angle(F.col("angle")))
    return long.groupBy("page").agg(geometry.upper_median(F.col("a")).alias("angle"), F.count("*").alias("n")).where("n >= 3").drop("n")


def padded(boxes: DataFrame, down: float, across: float) -> DataFrame:
    """Boxes (page, box, x, y, w, h, page_w, page_h) grown for reading, on no side by more than 45 percent of the gap to a neighbour or the edge."""
    r, o = boxes.alias("r"), boxes.select("page", *(F.col(c).alias(f"o{c}") for c in ("box", "x", "y", "w", "h"))).alias("o")
    right, bottom, oright, obottom = F.expr("x + w"), F.expr("y + h"), F.expr("ox + ow"), F.expr("oy + oh")
    level = F.least(bottom, obottom) - F.greatest("y", "oy") > 0.3 * F.least("h", "oh")
    above = F.least(right, oright) - F.greatest("x", "ox") > 0
    both = r.join(o, "page").where(F.col("box") != F.col("obox"))
    gaps = both.groupBy("page", "box").agg(
        F.min(F.when(above & (obottom <= F.col("y")), F.col("y") - obottom)).alias("g_up"), F.min(F.when(above & (obottom > F.col("y")) & (F.col("oy") >= bottom), F.col("oy") - bottom)).alias("g_down"),
        F.min(F.when(level & (oright <= F.col("x")), F.col("x") - oright)).alias("g_left"), F.min(F.when(level & (oright > F.col("x")) & (F.col("ox") >= right), F.col("ox") - right)).alias("g_right"),
    )
    out = boxes.join(gaps, ["page", "box"], "left")

    def pad(gap: str, edge: Column, size: str, share: float) -> Column:
        return F.least(F.col(size) * share, F.least(edge, F.coalesce(gap, edge)) * 0.45)

    up, dn = pad("g_up", F.col("y"), "h", down), pad("g_down", F.col("page_h") - bottom, "h", down)
    lf, rt = pad("g_left", F.col("x"), "h", across), pad("g_right", F.col("page_w") - right, "h", across)
    x0, y0 = F.greatest(F.lit(0.0), F.col("x") - lf), F.greatest(F.lit(0.0), F.col("y") - up)
    x1, y1 = F.least("page_w", right + rt), F.least("page_h", bottom + dn)
    return out.select("page", "box", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def clean_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes more than two wide and high."""
    return boxes.where("w > 2 AND h > 2")


def glyphs(components: DataFrame, least: float = 6, most: float = 200) -> DataFrame:
    """Components that may be a character: of its height, not too wide, of some area."""
    return components.where((F.col("h").between(least, most)) & (F.col("w") <= F.col("h") * 1.6) & (F.col("w") >= 1) & (F.col("area") >= 4))


def apart_from(lines: DataFrame, regions: DataFrame, share: float = 0.85) -> DataFrame:
    """Lines (page, rect) that no region of the page covers by more than `share`."""
    return lines.alias("l").join(regions.alias("r"), (F.col("l.page") == F.col("r.page")) & (geometry.overlap_ratio(F.col("l.rect"), F.col("r.rect")) > share), "left_anti")


def promising_lines(lines: DataFrame, regions: DataFrame, most: int = 12) -> DataFrame:
    """The best lines of each page: 11 glyphs or more, a score above 0.3, and not in a region already."""
    from .words import batch_top

    return batch_top(apart_from(lines.where("count >= 11 AND score > 0.3"), regions), ["page"], [F.desc("score"), "line"], most)


def biggest(boxes: DataFrame, k: int = 4) -> DataFrame:
    """The k boxes of each page with the largest area."""
    from .words import batch_top

    return batch_top(boxes, ["page"], [F.desc(F.col("w") * F.col("h")), "box"], k)


def rotation(boxes: DataFrame, readings: DataFrame) -> DataFrame:
    """degrees by which a page should be turned (null: none), by its boxes (page, box, w, h) and how surely turned crops of the biggest read.

    `readings`: page, degrees, text, conf of each crop; texts of fewer than two characters count nothing.
    """
    large = boxes.where("w * h > 60")
    shape = large.groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.expr("h > w * 1.5")).alias("tall"), F.count_if(F.expr("w > h * 2")).alias("wide"))
    counted = F.when(F.length(F.regexp_replace("text", r"\s", "")) >= 2, F.col("conf")).otherwise(0.0)
    sure = readings.groupBy("page").agg(*(F.avg(F.when(F.col("degrees") == d, counted)).alias(f"at{d}") for d in (0, 90, 180, 270)))
    lying = (F.col("tall") >= F.col("n") * 0.6) & (F.col("tall") >= 4)
    at = lambda d: F.coalesce(f"at{d}", F.lit(0.0))
    turned = F.when(F.col("n") < 4, None).when(lying, F.when(at(90) >= at(270), 90).otherwise(270)).when((F.col("wide") >= 3) & (at(180) > at(0) + 15), 180)
    return shape.join(sure, "page", "left").select("page", turned.cast("int").alias("degrees"))


def by_shape(boxes: DataFrame, size: int) -> DataFrame:
    """Boxes dealt to batches of `size` of like proportions (batch from 0) within each page."""
    from pyspark.sql import Window

    order = Window.partitionBy("page").orderBy(F.col("w") / F.greatest(F.col("h"), F.lit(1.0)), "box")
    return boxes.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
