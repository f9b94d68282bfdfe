"""Rasters as rows against the same on whole arrays."""

import numpy as np

from denpyo.functions import raster
from denpyo.operators import images


def test_thresholds_ink_and_glyphs(spark):
    rng = np.random.default_rng(4)
    pages = {1: rng.integers(0, 256, (30, 40)), 2: np.where(rng.random((25, 70)) < 0.3, rng.integers(10, 40, (25, 70)), 230), 3: np.full((5, 5), 200), 4: np.where(rng.random((20, 200)) < 0.25, 250, 20)}
    u = np.full((9, 150), 255)
    u[1:7, 2] = u[1:7, 140] = u[6, 2:141] = 0  # a shape wider than a cell
    u[0, 60] = u[1, 61] = 0  # corners touch
    pages[5] = u
    rows = [(k, int(x), int(y), int(v)) for k, page in pages.items() for (y, x), v in np.ndenumerate(page)]
    df = spark.createDataFrame(rows, "image long, x int, y int, v int").repartition(4)
    got = {r.image: (r.threshold, r.dark) for r in images.thresholds(images.histograms(df)).collect()}
    assert got == {k: (raster.otsu(p.astype(np.uint8)), raster.mostly_dark(p)) for k, p in pages.items()}
    boxes = {}
    for r in images.glyph_boxes(images.ink(df)).collect():
        boxes.setdefault(r.image, []).append((r.x, r.y, r.w, r.h, r.area))
    for k, p in pages.items():
        want = [tuple(c[n] for n in ("x", "y", "w", "h", "area")) for c in raster.connected_components(raster.ink(p.astype(np.uint8)))]
        assert sorted(boxes.get(k, [])) == sorted(want)
    assert images.glyph_boxes(images.ink(df.where("image < 0"))).count() == 0
