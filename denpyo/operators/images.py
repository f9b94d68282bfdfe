"""Rasters as rows: histograms, thresholds, ink and connected components of page images, as plans.

Pixels are (image, x, y, v), v from 0 (black) to 255; an image may be spread over any number of tasks. Histograms are merged
sums, ink becomes runs of pixels, and runs that touch those of the next row are edges of `components`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .lineage import cut

#: Images whose mean is below this are light text on dark ground.
DARK = 110
#: Width in pixels of the cells in which runs of neighbouring rows meet.
CELL = 64
#: A run's number: row * ROW + column, so that numbers ascend from the upper left.
ROW = 1 << 20


def histograms(pixels: DataFrame) -> DataFrame:
    """image, v, n: how often each value occurs."""
    return pixels.groupBy("image", "v").agg(F.count("*").alias("n"))


def thresholds(counts: DataFrame) -> DataFrame:
    """image, threshold (the value that best divides the histogram, the lowest of equals; 128 where nothing divides it) and dark (mostly dark)."""
    whole, up = Window.partitionBy("image"), Window.partitionBy("image").orderBy("v")
    weight = F.col("v").cast("long") * F.col("n")
    c = counts.select("image", "v", F.sum("n").over(up).alias("below"), F.sum(weight).over(up).alias("part"), F.sum("n").over(whole).alias("all"), F.sum(weight).over(whole).alias("sum"))
    above, rest = F.col("all") - F.col("below"), F.col("sum") - F.col("part")
    gap = F.col("part").cast("double") / F.col("below") - F.when(above > 0, rest.cast("double") / above).otherwise(0.0)
    spread = F.when(above > 0, F.col("below").cast("double") * above * gap * gap).otherwise(0.0)
    best = c.withColumn("spread", spread).groupBy("image").agg(F.max_by("v", F.struct("spread", -F.col("v"))).alias("v"), F.max("spread").alias("spread"), (F.max("sum").cast("double") / F.max("all") < DARK).alias("dark"))
    return best.select("image", F.when(F.col("spread") > 0, F.col("v")).otherwise(128).cast("int").alias("threshold"), "dark")


def ink(pixels: DataFrame) -> DataFrame:
    """The pixels (image, x, y) that hold ink, also for light text on dark ground."""
    known = pixels.join(thresholds(histograms(pixels)), "image")
    return known.where(F.when(F.col("dark"), F.col("v") > F.col("threshold")).otherwise(F.col("v") <= F.col("threshold"))).select("image", "x", "y")


def runs(points: DataFrame) -> DataFrame:
    """image, run (number), y, x0, x1 (exclusive) of the runs of adjacent points of a row; points (image, x, y) are distinct."""
    row = Window.partitionBy("image", "y").orderBy("x")
    island = (F.col("x") - F.row_number().over(row)).alias("island")
    found = points.select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).select("image", "x", "y", island)
    found = found.groupBy("image", "y", "island").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    return found.select("image", (F.col("y") * ROW + F.col("x0")).alias("run"), "y", "x0", "x1")


def glyph_boxes(points: DataFrame) -> DataFrame:
    """image, x, y, w, h and area of each group of points that touch, corners too."""
    found = cut(runs(points))
    dealt = found.withColumn("cell", F.explode(F.sequence(F.floor(F.col("x0") / CELL), F.floor(F.col("x1") / CELL))))
    a, b = dealt.alias("a"), dealt.alias("b")
    touching = (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.cell") == F.floor(F.greatest("a.x0", "b.x0") / CELL))
    edges = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.y") + 1 == F.col("b.y")) & (F.col("a.cell") == F.col("b.cell"))).where(touching)
    labels = components(edges.select(F.col("a.image").alias("image"), F.col("a.run").alias("a"), F.col("b.run").alias("b")), "image")
    whole = found.join(labels.withColumnRenamed("node", "run"), ["image", "run"], "left").withColumn("label", F.coalesce("label", "run"))
    boxes = whole.groupBy("image", "label").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y") + 1 - F.min("y")).alias("h"), F.sum(F.col("x1") - F.col("x0")).alias("area"))
    return boxes.drop("label")
