import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from denpyo.functions import raster, scanners, text
from denpyo.operators import amounts, boxes, details, pages, segmentation, words
from denpyo.operators.candidates import vote_text
from denpyo.sources import csv_out, files, history

NUMBER = "7000012050002"


def row_of(y, *cells, h=20):
    return [{"text": t, "x": float(x), "y": float(y), "w": float(len(t) * 12), "h": float(h)} for x, t in cells]


def bill(x0, y0, digits, prices):
    rows = row_of(y0, (x0, "領収書")) + row_of(y0 + 40, (x0, "登録番号"), (x0 + 100, f"T{digits}"))
    for i, p in enumerate(prices):
        rows += row_of(y0 + 80 + 40 * i, (x0, f"商品{i}"), (x0 + 200, f"¥{p:,}"))
    return rows + row_of(y0 + 80 + 40 * len(prices), (x0, "合計"), (x0 + 200, f"¥{sum(prices):,}"))


def candidate(place, digits, rects, **more):
    base = {"valid": True, "kind": "read", "has_t": True, "context": True, "jan": False, "shadowed": False}
    return {"place": place, "digits": digits, **base, **more, "rects": [{k: float(v) for k, v in zip("xywh", r)} for r in rects]}


def test_whole_pages(spark):
    atoms = bill(50, 50, NUMBER, [1200, 300, 500]) + bill(700, 50, "8000020130001", [90, 10, 400])
    one = bill(0, 0, NUMBER, [100, 200])
    rows = [(1, i, *a.values(), 1400.0, 900.0) for i, a in enumerate(atoms)] + [(2, i, *a.values(), 700.0, 600.0) for i, a in enumerate(one)]
    df = spark.createDataFrame(rows, "page long, seq int, text string, x double, y double, w double, h double, page_w double, page_h double").repartition(3)
    kind = "page long, place int, digits string, valid boolean, kind string, has_t boolean, context boolean, jan boolean, shadowed boolean, rects array<struct<x:double,y:double,w:double,h:double>>"
    found = [{"page": 1, **candidate(0, NUMBER, [(150, 90, 168, 20)])}, {"page": 1, **candidate(1, "8000020130001", [(800, 90, 168, 20)])}]
    found += [{"page": 2, **candidate(0, NUMBER, [(100, 40, 168, 20)], has_t=False, kind="consensus")}, {"page": 3, **candidate(0, NUMBER, [(0, 0, 9, 9)], kind="corrected")}]
    got = {(r.page, r.document): r for r in pages.analyse_pages(df, spark.createDataFrame(found, kind), dt.date(2026, 10, 9)).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (3, 0)}
    assert (got[1, 0].digits, got[1, 0].amount, got[1, 0].match) == (NUMBER, 2000, "equal")
    assert (got[1, 1].digits, got[1, 1].amount) == ("8000020130001", 500)
    assert (got[2, 0].digits, got[2, 0].amount, got[2, 0].weak) == (NUMBER, 300, False) and dict(got[2, 0].statuses)["regno"] == "ok"
    assert got[3, 0].digits == NUMBER and got[3, 0].rows == []
    weak = [{"page": 2, **candidate(0, NUMBER, [(0, 0, 9, 9)], has_t=False, shadowed=True)}]
    kinds = spark.createDataFrame([(2, 0, "normal")], "page long, document int, kind string")
    (w,) = pages.analyse_pages(df.where("page = 2"), spark.createDataFrame(weak, kind), dt.date(2026, 10, 9), kinds).collect()
    assert w.weak and w.digits == NUMBER and w.kind_source == "manual" and not w.simplified and w.rows[0] == "領収書"


def test_suggestions_over_sure_ones_are_left_out(spark):
    found = [candidate(0, NUMBER, [(0, 0, 100, 20)]), candidate(1, "1" * 13, [(50, 10, 100, 20)], kind="corrected"), candidate(2, "2" * 13, [(50, 90, 100, 20)], kind="corrected")]
    kind = "page long, place int, digits string, valid boolean, kind string, has_t boolean, context boolean, jan boolean, shadowed boolean, rects array<struct<x:double,y:double,w:double,h:double>>"
    assert [b.digits for b in pages.located(spark.createDataFrame([{"page": 1, **f} for f in found], kind)).orderBy("place").collect()] == [NUMBER, "2" * 13]


def test_words_to_readings(spark):
    rows = [(1, 0, "tile", 0, "登録番号", 90.0, 0, 0, 80, 20), (1, 0, "tile", 1, "T7000", 80.0, 100, 2, 60, 20), (1, 0, "tile", 2, "012050002", 60.0, 170, 1, 120, 20), (1, 0, "tile", 3, "他", 10.0, 700, 0, 20, 20), (1, 0, "tile", 4, " ", 10.0, 1, 0, 20, 20)]
    df = spark.createDataFrame([(a, b, c, d, e, f, *map(float, r)) for a, b, c, d, e, f, *r in rows], "page long, crop long, stage string, seq int, text string, conf double, x double, y double, w double, h double")
    (r,) = words.readings(df).collect()
    assert (r.digits, r.has_t, r.valid, r.conf, r.x, r.y, r.w, r.h) == (NUMBER, True, True, 70.0, 100.0, 1.0, 190.0, 21.0)
    assert words.expected_numbers(df).first().expected == 1
    found = words.regions(df.withColumns({"page_w": F.lit(1000), "page_h": F.lit(500)})).collect()
    assert found and all(0 <= q.x and q.x + q.w <= 1000 for q in found) and found[0].x == 84.0
    many = spark.createDataFrame([(1, 0, "T 1234567890123"), (1, 1, "4901234567894"), (1, 2, "電話 0312345678901"), (1, 3, "12345")], "page long, seq int, text string")
    assert [(q.seq, q.score) for q in words.digit_lines(many).collect()] == [(0, 4)]


def test_reading_rows_again(spark):
    rows = spark.createDataFrame([(1, 0, "株式会社みどり"), (1, 1, "T7000012050002"), (1, 2, "合計 ¥1,200"), (1, 9, "雑談")], "doc long, row int, text string")
    numbers = spark.createDataFrame([(1, NUMBER)], "doc long, digits string")
    assert [(r.row, r.score) for r in details.chosen_rows(rows, numbers).orderBy("row").collect()] == [(0, 5), (1, 3), (2, 8)]
    parts = spark.createDataFrame([(1, 2, 0, "合計 1200", None, 0.0, 0.0, 100.0, 20.0), (1, 0, 0, "他", 50.0, 0.0, 0.0, 9.0, 9.0)], "doc long, row int, part int, text string, conf double, x double, y double, w double, h double")
    again = spark.createDataFrame([(1, 2, 0, 1, "合計 ¥1,200", 90.0), (1, 2, 0, 2, "合計 ¥1,200", 80.0), (1, 0, 0, 1, "", 90.0)], "doc long, row int, part int, seq int, text string, conf double")
    assert {(r.row, r.text) for r in details.refined(parts, again).collect()} == {(2, "合計 ¥1,200"), (0, "他")}
    assert details.crops(parts).count() == 6 and details.crops(parts, "tesseract").where("mode = 'adaptive'").count() == 2


def test_votes_and_titles(spark):
    assert vote_text([("| 合 計 ¥100 |", 50, 1), ("合計¥100", 60, 1), ("計¥700", 99, 1)]) == "合計¥100"
    assert vote_text([("|", 9, 1)]) == "|" and vote_text([]) == ""
    said = spark.createDataFrame([("領収害",), ("领 收 书",), ("領収書の控えを保管してください",), (None,)], "t string")
    assert [r[0] for r in said.select(segmentation.is_title(F.col("t"))).collect()] == [True, True, False, False]


def test_settlement_parts(spark):
    df = spark.createDataFrame([("1", 5), (None, 7), ("2", None)], "digits string, amount long")
    assert amounts.exceptions(df).count() == 2
    typed = spark.createDataFrame([("¥1,200",), ("",), ("x",)], "t string")
    assert [r[0] for r in typed.select(amounts.expected_difference(F.lit(1500).cast("long"), F.col("t"))).collect()] == [300, None, 1500]


def test_boxes(spark):
    df = spark.createDataFrame([(1, 0, 100.0, 100.0, 200.0, 20.0), (1, 1, 100.0, 124.0, 200.0, 20.0), (1, 2, 320.0, 100.0, 50.0, 20.0)], "page long, box int, x double, y double, w double, h double").withColumns({"page_w": F.lit(1000.0), "page_h": F.lit(1000.0)})
    got = {r.box: (r.x, r.y, r.w, r.h) for r in boxes.padded(df, 0.3, 0.6).collect()}
    assert got[0] == pytest.approx((88.0, 94.0, 221.0, 27.8))
    assert [r[0] for r in spark.createDataFrame([(46.0,), (45.0,), (-45.0,), (100.0,)], "a double").select(boxes.fold_angle(F.col("a"))).collect()] == [-44.0, 45.0, 45.0, 10.0]
    points = spark.createDataFrame([(1, float(x), float(x) / 2 + (x % 2) * 0.1) for x in range(50)], "page long, x double, y double")
    r = boxes.principal_axis(points, "page").first()
    assert abs(r.angle - np.degrees(np.arctan(0.5))) < 0.2 and r.elongation > 100
    tall = spark.createDataFrame([(1, i, 10.0, 50.0) for i in range(5)] + [(2, i, 90.0, 10.0) for i in range(5)], "page long, box int, w double, h double")
    read = spark.createDataFrame([(1, 90, "abc", 20.0), (1, 270, "abc", 60.0), (2, 0, "ab", 30.0), (2, 180, "ab", 50.0)], "page long, degrees int, text string, conf double")
    assert {r.page: r.degrees for r in boxes.rotation(tall, read).collect()} == {1: 270, 2: 180}
    assert {(r.box, r.batch) for r in boxes.by_shape(tall.where("page = 2"), 2).collect()} == {(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)}


def glyph_page(n=13, size=10, gap=4):
    bits = np.zeros((60, n * (size + gap) + 40), np.uint8)
    for i in range(n):
        bits[20 : 20 + size + 4, 20 + i * (size + gap) : 20 + i * (size + gap) + size - 2] = 1
    return bits


def test_raster():
    bits = glyph_page()
    found = raster.connected_components(bits)
    assert len(found) == 13 and found[0] == {"x": 20, "y": 20, "w": 8, "h": 14, "area": 112}
    u = np.zeros((5, 7), np.uint8)
    u[:4, 0] = u[:4, 3] = u[4, 1:3] = 1
    u[0, 5] = u[1, 6] = 1
    assert sorted((c["w"], c["h"], c["area"]) for c in raster.connected_components(u)) == [(2, 2, 2), (4, 5, 10)]
    (line,) = raster.glyph_lines(found)
    assert line["count"] == 13 and line["score"] == 1.0 and [s["count"] for s in line["segments"]] == [13]
    assert raster.glyph_lines(found[:5]) == []
    gray = np.where(bits > 0, 0, 255).astype(np.uint8)
    shaded = np.where((bits > 0) & (np.arange(bits.shape[1]) % 2 > 0), 50, gray).astype(np.uint8)
    assert raster.text_band(shaded, {"x": 0, "y": 0, "w": bits.shape[1], "h": 60}, 27) == (20.0, 14.0)
    assert raster.text_band(np.full((60, 60), 255, np.uint8), {"x": 0, "y": 0, "w": 60, "h": 60}, 30) is None
    assert (raster.turned(gray, 90)[:, ::-1].T == gray).all() and raster.turned(gray, 10).shape[0] > gray.shape[0]
    assert raster.scaled(gray, 100).shape[1] == 100 and raster.crop(gray, -5, -5, 30, 40, 2).shape == (39, 29)
    page = np.full((400, 600), 255, np.uint8)
    for y in range(40, 360, 40):
        for x in range(40, 560, 16):
            page[y : y + 14, x : x + 8] = 0
    assert abs(raster.straightening(raster.turned(page, 5)) - 5) <= 0.4 and raster.straightening(page) == 0.0
    steps = np.eye(4)[[0, 1, 1, 0, 1, 2, 3, 0]] * 0.9
    assert raster.ctc(steps, ["", "a", "b", "c"], 0.0, 80.0)[:2] == ("aabc", pytest.approx(90.0))
    chances = np.zeros((40, 100))
    chances[10:16, 10:80] = 0.9
    (b,) = raster.detected_boxes(chances, 200, 80)
    assert abs(b["angle"]) < 1 and b["elongation"] > 4 and b["x"] < 20 and b["w"] > 140


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([('a"b', i) for i in range(5)], "name string, n int").repartition(2)
    csv_out.write(df, f"{tmp_path}/out", ("名", "n"))
    import glob

    parts = [open(p, "rb").read().decode() for p in glob.glob(f"{tmp_path}/out/part-*")]
    assert len(parts) == 2 and all(p.startswith('﻿"名","n"\r\n') and p.endswith("\r\n") for p in parts)
    assert sum(p.count('"a""b"') for p in parts) == 5
    csv_out.write(df.limit(0), f"{tmp_path}/none")
    assert [open(p, "rb").read().decode() for p in glob.glob(f"{tmp_path}/none/part-*") if open(p, "rb").read()] == ['﻿"name","n"\r\n']
    e = spark.sql("SELECT 'f.pdf' file, 'p1' label, 0 document, '7000012050002' digits, 1200L amount, 'ok' summary, true simplified, TIMESTAMP '2026-10-09 08:05:03' at, 'x' name, array('1','2') others, 'paddle' engine, 1.25D seconds")
    assert [*history.batch_rows(e).first()][2:6] == ["1", "T" + NUMBER, "https://www." + csv_out.REGISTER_URL.split("www.")[1] + NUMBER, "1200"]
    assert [*history.history_rows(e).first()][0::5] == ["2026/10/9 8:05:03", "T1 T2"]
    h = spark.createDataFrame([("u", i, i) for i in range(60)], "user string, id long, at long")
    kept = history.appended(h, spark.createDataFrame([("u", 99, 99)], h.schema))
    assert kept.count() == 50 and kept.agg(F.min("id")).first()[0] == 11
    assert history.removed(h, spark.createDataFrame([("u", 5)], "user string, id long")).count() == 59
    assert history.removed(h, spark.createDataFrame([("u", None)], "user string, id long")).count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "in" / "b.jpeg").write_bytes(b"x")
    assert {r.kind for r in files.files(spark, f"{tmp_path}/in").collect()} == {"pdf", "image"}
    assert files.files(spark, f"{tmp_path}/in", stream=True).isStreaming and files.images(spark, f"{tmp_path}/in").count() == 0
    sizes = spark.createDataFrame([(1, 10, 10), (50 << 20, 10, 10), (1, 10000, 10000), (1, None, 5)], "n long, w int, h int")
    assert [r[0] for r in sizes.select(files.accepted(F.col("n"), F.col("w"), F.col("h"))).collect()] == [None, 413, 400, 400]
    assert tuple(sizes.where("w = 10000").select(files.fitted_size(F.col("w"), F.col("h"))).first()[0]) == (4000, 4000)
    s = files.settings(spark.createDataFrame([("a", '{"mode": "fast"}'), ("b", "no json")], "user string, json string")).collect()
    assert [(r.user, r.mode, r.maxTiles) for r in s] == [("a", "fast", 9), ("b", "standard", 9)]
    assert files.sample_bills(spark, 3).where("row = 2").count() == 3


@pytest.mark.parametrize("raw", ["T7OOO0120S0002", "登録番号 7000-0120-50002", "77000012050002", "T17000012050002", "No.70000l2050002", "T7000012050002 様", "abc 7000012050002x", "T7000O1205ab"])
def test_numbers_in_one_spelling(spark, raw):
    s = scanners.normal(raw)
    assert spark.createDataFrame([(raw,)], "s string").select(text.normalize_row(F.col("s"))).first()[0] == s
    for d, has_t, valid, start, end, n, was in scanners.registration_numbers(raw):
        assert len(d) == 13 and was == scanners.half(raw)[start:end] and n <= 3


def run_stream(spark, tmp_path, rows, schema, make, mode, name):
    """The output of a stream over files, one file a batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}-in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}-in")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    from denpyo.streaming import service

    tries = [("a", float(i), False) for i in range(11)] + [("b", 1.0, True)]
    got = run_stream(spark, tmp_path, [tries, [("a", 400.0, True), ("a", 606.0, True), ("a", 607.0, False)]], "ip string, at double, ok boolean", service.limit_logins, "append", "logins")
    assert {(r.ip, r.at): r.status for r in got} == {("a", float(i)): 401 for i in range(10)} | {("a", 10.0): 429, ("b", 1.0): 200, ("a", 400.0): 429, ("a", 606.0): 200, ("a", 607.0): 401}
    events = [[(1, i, "log", None, f"l{i}") for i in range(250)] + [(1, 300, "progress", 0.5, None)], [(1, 301, "progress", 0.2, None), (1, 302, "image", None, "x")]]
    schema = "scan long, seq long, type string, value double, payload string"
    got = run_stream(spark, tmp_path, events, schema, service.scan_states, "update", "scans")
    import json

    last = json.loads(max((r.state for r in got), key=len))
    assert last["progress"] == 0.5 and len(last["log"]) == 200 and last["image"] == "x"
    got = run_stream(spark, tmp_path, events, schema, service.progress, "complete", "progress")
    assert [(r.scan, r.progress) for r in got] == [(1, 0.5)]


def test_candidates_are_ranked_anew(spark, tmp_path):
    from denpyo.streaming import service

    schema = "doc long, seq long, digits string, has_t boolean, conf double, stage string, substitutions int, context boolean, x double, y double, w double, h double"
    row = lambda doc, seq: (doc, seq, NUMBER, True, 95.0, "anchor", 0, True, 0.0, 0.0, 100.0, 20.0)
    for i, part in enumerate([[row(1, 0), row(2, 0)], [row(1, 1), row(1, 2)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = service.keep_candidates(stream, f"{tmp_path}/store", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = service.latest_candidates(spark, f"{tmp_path}/out")
    assert {(r.doc, r.votes) for r in found.collect()} == {(1, 3), (2, 1)}
    work = spark.createDataFrame([(1,), (2,)], "doc long")
    assert [r.doc for r in service.unfinished(work, found).collect()] == [2]
