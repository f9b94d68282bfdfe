import numpy as np
import pytest
from pyspark.sql import functions as F

from denpyo.functions import raster
from denpyo.streaming import service


def test_login_limit_and_folds():
    failures, got = [], []
    for i in range(12):
        status, failures = service.admit(failures, float(i), False)
        got.append(status)
    assert got == [401] * 10 + [429] * 2 and service.admit(failures, 611.0, True) == (200, [])
    state = {}
    for e in [("progress", 0.5, None), ("progress", 0.2, None), *(("log", None, str(i)) for i in range(250)), ("engine", None, "x")]:
        state = service.fold(state, dict(type=e[0], value=e[1], payload=e[2]))
    assert state["progress"] == 0.5 and len(state["log"]) == 200 and state["log"][-1] == "249" and state["engine"] == "x"


def test_login_stream(spark, tmp_path):
    spark.createDataFrame([("a", float(i), i == 3) for i in range(8)], "ip string, at double, ok boolean").write.json(str(tmp_path / "in"))
    attempts = spark.readStream.schema("ip string, at double, ok boolean").json(str(tmp_path / "in"))
    q = service.limit_logins(attempts, limit=2).writeStream.format("memory").queryName("answers").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(90)
    assert [r.status for r in spark.table("answers").orderBy("at").collect()] == [401, 401, 429, 429, 429, 429, 429, 429]


def test_sessions(spark):
    logins = spark.createDataFrame([("s", "2026-01-01 00:00:00")], "sid string, at string").withColumn("at", F.to_timestamp("at"))
    asks = spark.createDataFrame([("s", "2026-01-01 11:59:59"), ("s", "2026-01-01 12:00:00"), ("t", "2026-01-01 01:00:00")], "sid string, at string").withColumn("at", F.to_timestamp("at"))
    assert service.live_sessions(asks, logins).count() == 1


@pytest.mark.parametrize("angle", [0, 3, -7.5, 12])
def test_skew(angle):
    h, w = 500, 700
    y, x = np.mgrid[0:h, 0:w]
    a = np.deg2rad(angle)
    across = (y - h / 2) * np.cos(a) - (x - w / 2) * np.sin(a)
    along = (y - h / 2) * np.sin(a) + (x - w / 2) * np.cos(a)
    bits = ((across % 30 < 12) & (along % 16 < 10) & (np.abs(along) < 250) & (np.abs(across) < 150)).astype(np.uint8)
    assert abs(raster.skew(bits)[0] - angle) <= 0.5


def test_raster_basics():
    page = np.full((40, 60, 4), 255, np.uint8)
    page[5:10, 5:10, :3] = 0
    page[20:24, 30:50, :3] = 10
    gray = raster.to_gray(page)
    parts = raster.connected_components(raster.ink(gray))
    assert sorted((p["x"], p["y"], p["w"], p["h"], p["area"]) for p in parts) == [(5, 5, 5, 5, 25), (30, 20, 20, 4, 80)]
    assert not raster.mostly_dark(gray) and raster.otsu(np.zeros((2, 2), np.uint8)) == 128
    assert raster.adaptive(gray, 8)[7, 7] == 0 and raster.stretch(gray).max() == 255
