"""Registered queries of scans: pages, words, boxes, results and files, made of keys like those of the catalogue."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, geometry, numbers
from ..operators import amounts, boxes, details, pages, requirements, tables, words
from ..sources import files, history
from .catalogue import BOXES, query, table
from .catalogue import boxes as line_boxes

TODAY = datetime.date(2026, 10, 9)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with two valid numbers (digits, other) and a price p."""
    key = F.col("c_custkey")

    def number(factor: int) -> Column:
        base = F.lpad((key * factor + 11).cast("string"), 12, "0")
        return F.concat(numbers.check_digit(base).cast("string"), base)

    return table(spark, sf_dir, "customer").select(key.alias("page"), number(7919).alias("digits"), number(104729).alias("other"), (key * 37 % 9000 + 100).alias("p"))


def number_sql(factor: int) -> str:
    base = f"lpad(CAST(c_custkey * {factor} + 11 AS VARCHAR), 12, '0')"
    return f"(CAST(9 - list_sum([CAST({base}[i] AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END) for i in range(1, 13)]) % 9 AS INTEGER)::VARCHAR || {base})"


CUSTOMERS = f"c AS (SELECT c_custkey AS page, {number_sql(7919)} AS digits, {number_sql(104729)} AS other, c_custkey * 37 % 9000 + 100 AS p FROM customer)"


def atom(x: int, y: int, what: Column, width: int) -> Column:
    return F.struct(what.alias("text"), *(F.lit(float(v)).alias(c) for v, c in ((x, "x"), (y, "y"), (width, "w"), (20, "h"))))


def yen(x: Column) -> Column:
    return F.concat(F.lit("¥"), F.format_number(x, 0))


def bill_atoms(x: int, digits: Column, price: Column) -> list[Column]:
    """A bill of two items and their total, from x on."""
    lit = F.lit
    rows = [(50, [(x, lit("領収書"), 60)]), (90, [(x, lit("登録番号"), 80), (x + 100, F.concat(lit("T"), digits), 168)])]
    rows += [(130 + 40 * i, [(x, lit(f"商品{'AB'[i]}"), 60), (x + 200, yen(price * (i + 1)), 60)]) for i in range(2)]
    rows.append((210, [(x, lit("合計"), 40), (x + 200, yen(price * 3), 60)]))
    return [atom(ax, y, what, w) for y, cells in rows for ax, what, w in cells]


def page_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one bill, or with two side by side where the key is even."""
    c = customers(spark, sf_dir)
    two = F.array(*bill_atoms(50, F.col("digits"), F.col("p")), *bill_atoms(700, F.col("other"), F.col("p") + 7))
    one = F.array(*bill_atoms(50, F.col("digits"), F.col("p")))
    listed = c.select("page", F.posexplode(F.when(F.col("page") % 2 == 0, two).otherwise(one)).alias("seq", "a"))
    return listed.select("page", "seq", "a.*", F.lit(1400.0).alias("page_w"), F.lit(900.0).alias("page_h"))


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of those pages; the single ones are near cue words only, shadowed where the key is a multiple of three."""
    c = customers(spark, sf_dir)

    def found(place: int, digits: str, x: int) -> DataFrame:
        rects = F.array(F.struct(*(F.lit(float(v)).alias(n) for v, n in ((x, "x"), (90, "y"), (168, "w"), (20, "h")))))
        even = F.col("page") % 2 == 0
        return c.select(
            "page", F.lit(place).alias("place"), F.col(digits).alias("digits"), F.lit(True).alias("valid"), F.lit("read").alias("kind"), even.alias("has_t"), F.lit(True).alias("context"),
            F.lit(False).alias("jan"), (~even & (F.col("page") % 3 == 0)).alias("shadowed"), rects.alias("rects"),
        )

    return found(0, "digits", 150).union(found(1, "other", 800).where("page % 2 = 0"))


@query(f"""WITH {CUSTOMERS}, d AS (SELECT page, 0 AS document, digits, p, false AS second FROM c UNION ALL SELECT page, 1, other, p + 7, true FROM c WHERE page % 2 = 0)
SELECT page, document, digits, page % 2 = 1 AND page % 3 = 0 AS weak, 3 * p AS amount, 'total' AS source, 3 * p AS items_sum, 'equal' AS match,
CASE WHEN page % 2 = 1 AND page % 3 = 0 THEN 'warn' ELSE 'ok' END AS regno FROM d""")
def page_analysis(spark, sf_dir):
    r = pages.analyse_pages(page_atoms(spark, sf_dir), page_candidates(spark, sf_dir), TODAY)
    return r.select("page", "document", "digits", "weak", "amount", "source", "items_sum", "match", F.col("statuses")["regno"].alias("regno"))


@query(f"""WITH {CUSTOMERS} SELECT page, '領収書' AS first, CASE WHEN page % 2 = 0 THEN 5 ELSE 5 END::BIGINT AS rows, CASE WHEN page % 2 = 0 THEN 18 ELSE 9 END::BIGINT AS parts FROM c""")
def row_assembly(spark, sf_dir):
    rows = tables.assemble_rows(page_atoms(spark, sf_dir).withColumnRenamed("page", "doc"))
    return rows.groupBy(F.col("doc").alias("page")).agg(F.min_by(F.get(F.split("text", " "), F.lit(0)), "row").alias("first"), F.count("*").alias("rows"), F.sum(F.size("parts")).alias("parts"))


@query(f"""WITH {CUSTOMERS} SELECT page, CASE WHEN page % 2 = 0 THEN 16 ELSE 8 END::BIGINT AS phrases FROM c""")
def phrase_assembly(spark, sf_dir):
    return tables.assemble_phrases(page_atoms(spark, sf_dir).withColumnRenamed("page", "doc")).groupBy(F.col("doc").alias("page")).agg(F.count("*").alias("phrases"))


@query(f"""WITH {CUSTOMERS} SELECT page, unnest(range(0, 4))::INTEGER AS row, unnest([NULL, p * 100, p * 10, p])::BIGINT AS amount FROM c""")
def table_amounts(spark, sf_dir):
    c = customers(spark, sf_dir)
    cells = [atom(0, 0, F.lit("品 名"), 60), atom(200, 0, F.lit("数 量"), 60), atom(400, 0, F.lit("金 額"), 60)]
    for i, factor in enumerate((100, 10, 1)):
        cells += [atom(0, 30 + 30 * i, F.lit("商品"), 40), atom(230, 30 + 30 * i, F.lit(str(i + 1)), 30), atom(380, 30 + 30 * i, F.format_number(F.col("p") * factor, 0), 80)]
    atoms = c.select(F.col("page").alias("doc"), F.posexplode(F.array(*cells)).alias("seq", "a")).select("doc", "seq", "a.*")
    return tables.table_amounts(atoms).select(F.col("doc").alias("page"), "row", "amount")


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    conf = (F.col("page") % 40 + 50).cast("double")
    word = lambda x, what, w, sure: F.struct(what.alias("text"), sure.alias("conf"), *(F.lit(float(v)).alias(n) for v, n in ((x, "x"), (2, "y"), (w, "w"), (20, "h"))))
    row = F.array(word(0, F.lit("登録番号"), 80, F.lit(90.0)), word(100, F.concat(F.lit("T"), F.left("digits", F.lit(5))), 60, conf), word(170, F.substring("digits", 6, 8), 120, conf + 10), word(900, F.lit("御中"), 40, F.lit(10.0)))
    return c.select("page", F.lit(0).alias("crop"), F.lit("tile").alias("stage"), F.posexplode(row).alias("seq", "w")).select("page", "crop", "stage", "seq", "w.*")


@query(f"WITH {CUSTOMERS} SELECT page, digits, true AS has_t, true AS valid, (page % 40 + 55)::DOUBLE AS conf, 100.0::DOUBLE AS x, 190.0::DOUBLE AS w FROM c")
def ocr_readings(spark, sf_dir):
    return words.readings(number_words(spark, sf_dir)).select("page", "digits", "has_t", "valid", "conf", "x", "w")


@query("SELECT c_custkey AS page, 1 AS expected FROM customer")
def expected_numbers(spark, sf_dir):
    return words.expected_numbers(number_words(spark, sf_dir))


@query(f"""WITH {CUSTOMERS}, w AS (SELECT page, unnest([0, 1, 2])::INTEGER AS seq, unnest(['T ' || digits, '電話 ' || digits, substr(digits, 1, 4)]) AS s FROM c),
s AS (SELECT page, seq, (CASE WHEN seq = 0 THEN 3 ELSE 0 END) + 1 - (CASE WHEN seq = 1 THEN 3 ELSE 0 END) AS score FROM w WHERE seq < 2) SELECT page, seq, score::INTEGER AS score FROM s WHERE score >= 0""")
def digit_lines(spark, sf_dir):
    d = F.col("digits")
    spoken = F.array(F.concat(F.lit("T "), d), F.concat(F.lit("電話 "), d), F.left(d, F.lit(4)))
    w = customers(spark, sf_dir).select("page", F.posexplode(spoken).alias("seq", "text"))
    return words.digit_lines(w).select("page", "seq", "score")


def anchor_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words with keywords, numbers in one or two words and long numbers, moved and left out by key; and rows of glyphs on every second page."""
    c = customers(spark, sf_dir)
    k = F.col("page")
    dx, dy = k % 7 * 30, k % 5 * 40
    word = lambda x, y, what, w: F.struct(what.alias("text"), F.lit(90.0).alias("conf"), *(v.cast("double").alias(n) for n, v in (("x", dx + x), ("y", dy + y), ("w", F.lit(w)), ("h", F.lit(20)))))
    d = F.col("digits")
    listed = F.array(
        F.when(k % 3 != 0, word(10, 40, F.lit("登録 番号:"), 100)), word(130, 42, F.concat(F.lit("Ｔ"), F.left(d, F.lit(5))), 72), word(206, 41, F.substring(d, 6, 8), 96),
        F.when(k % 4 == 0, word(20, 240, F.lit("T"), 12)), F.when(k % 4 == 0, word(36, 240, F.substring(d, 1, 9), 108)), F.when(k % 5 == 0, word(60, 440, F.col("other"), 156)),
    )
    words_ = c.select("page", F.posexplode(listed).alias("seq", "v")).where("v IS NOT NULL").select("page", "seq", "v.*", F.lit(700.0).alias("page_w"), F.lit(640.0).alias("page_h"))
    run = F.array(F.struct((dx + 128).cast("double").alias("x"), F.lit(170.0).alias("w"), F.lit(14).cast("long").alias("count")))
    lines = c.where("page % 2 = 0").select("page", F.lit(0).alias("line"), (dx + 120).cast("double").alias("x"), (dy + 38).cast("double").alias("y"), F.lit(200.0).alias("w"), F.lit(24.0).alias("h"), F.lit(18.0).alias("char_height"), F.when(k % 3 == 1, run).otherwise(F.slice(run, 1, 0)).alias("segments"))
    return words_, lines


def _clamped(x: str, y: str, w: str, h: str) -> str:
    a, b = f"greatest(0, floor({x}))", f"greatest(0, floor({y}))"
    return f"'x': {a}::DOUBLE, 'y': {b}::DOUBLE, 'w': greatest(1, least(700, ceil(({x}) + ({w}))) - {a})::DOUBLE, 'h': greatest(1, least(640, ceil(({y}) + ({h}))) - {b})::DOUBLE"


#: Places by hand: rows of words begin at dy + 40, + 240 and + 440, words are 20 high; rows are in the order of their first words.
PLACES = """places AS (
  SELECT page, 1 AS turn, dx + 130 - 16 AS x, dy + 42 + 10 - 22 AS y, 380 AS w, 44 AS h FROM k
  UNION ALL SELECT page, 2, dx + 10 + 100 * 4.0::DOUBLE / 5, lv - 22, 440, 44 FROM k WHERE page % 3 <> 0
  UNION ALL SELECT page, 3, dx + 10 - 40, lv + 10, 480, 48 FROM k WHERE page % 3 <> 0
  UNION ALL SELECT page, 4, dx + 10 + 100 * 4.0::DOUBLE / 5 - 60, lv - 22, 520, 44 FROM k WHERE page % 3 <> 0
  UNION ALL SELECT page, CASE WHEN page % 3 = 0 THEN 0 ELSE 5 END, dx + 20 - 16, dy + 250 - 22, 380, 44 FROM k WHERE page % 4 = 0
  UNION ALL SELECT page, 7, dx + 60 - 10, dy + 450 - 22, 176, 44 FROM k WHERE page % 5 = 0)"""


@query(f"""WITH RECURSIVE k AS (SELECT c_custkey AS page, c_custkey % 7 * 30 AS dx, c_custkey % 5 * 40 AS dy, c_custkey % 5 * 40 + 51 AS lv FROM customer), {PLACES},
r AS (SELECT p.page, turn, dx, dy, {{{_clamped("p.x", "p.y", "p.w", "p.h")}}} AS r FROM places p JOIN k ON k.page = p.page),
g AS (SELECT *, page % 2 = 0 AND abs(dy + 50 - (r.y + r.h / 2)) < 18 AND dx + 320 > r.x AND dx + 120 < r.x + r.w AND (CASE WHEN dx + 120 <= r.x AND dx + 320 >= r.x THEN 0 ELSE abs(dx + 120 - r.x) END) < 120 AS near FROM r WHERE r.w >= 4 AND r.h >= 4),
gives AS (SELECT page, turn, r, CASE WHEN near THEN list_concat(
  CASE WHEN page % 3 = 1 THEN [{{{_clamped("dx + 128 - 18 * 1.2::DOUBLE", "dy + 38 - 24 * 0.4::DOUBLE", "170 + 18 * 2.4::DOUBLE", "24 * 1.8::DOUBLE")}, 'text_height': 18::DOUBLE, 'kind': 'number'}}] ELSE [] END,
  [{{{_clamped("least(r.x, dx + 120) - 18", "dy + 38 - 24 * 0.4::DOUBLE", "dx + 320 + 27 - least(r.x, dx + 120) + 18", "24 * 1.8::DOUBLE")}, 'text_height': 18::DOUBLE, 'kind': 'line'}}])
  ELSE [{{'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h, 'text_height': 20::DOUBLE, 'kind': 'place'}}] END || [{{{_clamped("r.x", "r.y - 16", "r.w", "r.h + 32")}, 'text_height': 20::DOUBLE, 'kind': 'rows'}}] AS out FROM g),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY turn) AS i, count(*) OVER (PARTITION BY page) AS n FROM gives),
walk AS (SELECT page, i, n, out AS kept FROM numbered WHERE i = 1
  UNION ALL SELECT w.page, m.i, w.n, CASE WHEN len([1 for q in kept if (greatest(0, least(q.x + q.w, m.r.x + m.r.w) - greatest(q.x, m.r.x)) * greatest(0, least(q.y + q.h, m.r.y + m.r.h) - greatest(q.y, m.r.y)))
    > 0.75::DOUBLE * (q.w * q.h + m.r.w * m.r.h - greatest(0, least(q.x + q.w, m.r.x + m.r.w) - greatest(q.x, m.r.x)) * greatest(0, least(q.y + q.h, m.r.y + m.r.h) - greatest(q.y, m.r.y)))]) > 0 THEN kept ELSE kept || m.out END
  FROM walk w JOIN numbered m ON m.page = w.page AND m.i = w.i + 1),
ended AS (SELECT page, kept FROM walk WHERE i = n)
SELECT page, unnest(range(0, len(kept)))::INTEGER AS place, unnest(kept, recursive := true) FROM ended""")
def regions(spark, sf_dir):
    return words.regions(*anchor_words(spark, sf_dir))


# Fixed rows of text with their scores, the first three rows and those near the number's row count more.
SCORED = (("株式会社みどり", 2), ("T{}", 0), ("2026年10月1日", 3), ("10%対象 ¥1,100", 7), ("品名 数量", 2), ("様", 3), ("ありがとう", 0), ("合計 1,200円", 5))


@query(f"""WITH {CUSTOMERS}, s AS (SELECT page, unnest(range(0, 8))::INTEGER AS row, unnest([{', '.join(str(s) for _, s in SCORED)}]) AS worth FROM c),
t AS (SELECT page, row, (worth + CASE WHEN abs(row - 1) <= 2 THEN 2 ELSE 0 END + CASE WHEN row < 3 THEN 1 ELSE 0 END)::INTEGER AS score FROM s) SELECT * FROM t WHERE score >= 2""")
def detail_rows(spark, sf_dir):
    c = customers(spark, sf_dir)
    spoken = F.array(*(F.concat(F.lit("T"), F.col("digits")) if "{}" in t else F.lit(t) for t, _ in SCORED))
    rows = c.select(F.col("page").alias("doc"), F.posexplode(spoken).alias("row", "text"))
    return details.chosen_rows(rows, c.select(F.col("page").alias("doc"), "digits")).select(F.col("doc").alias("page"), "row", "score")


@query(f"WITH {CUSTOMERS} SELECT page, '合計 ¥' || format('{{:,}}', p) AS text FROM c")
def row_voting(spark, sf_dir):
    c = customers(spark, sf_dir)
    total = F.concat(F.lit("合計 "), yen(F.col("p")))
    parts = c.select(F.col("page").alias("doc"), F.lit(0).alias("row"), F.lit(0).alias("part"), F.concat(F.lit("計"), yen(F.col("p"))).alias("text"), F.lit(55.0).alias("conf"))
    read = F.array(total, F.concat(F.lit("| "), total, F.lit(" |")), F.lit("合 ¥9"))
    again = c.select(F.col("page").alias("doc"), F.lit(0).alias("row"), F.lit(0).alias("part"), F.posexplode(read).alias("seq", "text")).withColumn("conf", F.lit(80.0))
    return details.refined(parts, again).select(F.col("doc").alias("page"), "text")


@query("""SELECT p_partkey, variant, round(20 + p_partkey % 30 - (10 + p_partkey % 5) * v[2], 6) AS x, round((10 + p_partkey % 5) * (1 + 2 * v[1]), 6) AS h, round(greatest(1, least(4, 32.0::DOUBLE / (10 + p_partkey % 5))), 6) AS scale
FROM (SELECT p_partkey, unnest([0, 1, 2])::INTEGER AS variant, unnest([[0.5::DOUBLE, 0.35], [0.15, 0.3], [0.35, 0.6]]) AS v FROM part)""")
def crop_variants(spark, sf_dir):
    h = (10 + F.col("p_partkey") % 5).cast("double")
    parts = table(spark, sf_dir, "part").select("p_partkey", (20 + F.col("p_partkey") % 30).cast("double").alias("x"), F.lit(5.0).alias("y"), F.lit(90.0).alias("w"), h.alias("h"))
    return details.crops(parts).select("p_partkey", "variant", F.round("x", 6).alias("x"), F.round("h", 6).alias("h"), F.round("scale", 6).alias("scale"))


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = line_boxes(spark, sf_dir)
    return b.select(F.col("doc").alias("page"), (F.col("seq").cast("long") * 1000000 + F.col("part")).alias("box"), "rect.*", F.lit(200.0).alias("page_w"), F.lit(100.0).alias("page_h"))


PAGE_BOXES = f"{BOXES}, q AS (SELECT doc AS page, seq * 1000000 + part AS box, x, y, w::DOUBLE AS w, h FROM b)"


@query(f"""WITH {PAGE_BOXES}, g AS (SELECT r.page, r.box,
min(CASE WHEN least(r.x + r.w, o.x + o.w) > greatest(r.x, o.x) AND o.y + o.h <= r.y THEN r.y - o.y - o.h END) AS u,
min(CASE WHEN least(r.x + r.w, o.x + o.w) > greatest(r.x, o.x) AND o.y + o.h > r.y AND o.y >= r.y + r.h THEN o.y - r.y - r.h END) AS d,
min(CASE WHEN least(r.y + r.h, o.y + o.h) - greatest(r.y, o.y) > 0.3::DOUBLE * least(r.h, o.h) AND o.x + o.w <= r.x THEN r.x - o.x - o.w END) AS l,
min(CASE WHEN least(r.y + r.h, o.y + o.h) - greatest(r.y, o.y) > 0.3::DOUBLE * least(r.h, o.h) AND o.x + o.w > r.x AND o.x >= r.x + r.w THEN o.x - r.x - r.w END) AS t
FROM q r JOIN q o ON r.page = o.page AND r.box <> o.box GROUP BY r.page, r.box),
p AS (SELECT q.*, least(h * 0.3::DOUBLE, least(y, coalesce(u, y)) * 0.45::DOUBLE) AS up, least(h * 0.3::DOUBLE, least(100 - y - h, coalesce(d, 100 - y - h)) * 0.45::DOUBLE) AS dn,
least(h * 0.6::DOUBLE, least(x, coalesce(l, x)) * 0.45::DOUBLE) AS lf, least(h * 0.6::DOUBLE, least(200 - x - w, coalesce(t, 200 - x - w)) * 0.45::DOUBLE) AS rt FROM q LEFT JOIN g USING (page, box))
SELECT page, box, round(greatest(0, x - lf), 6) AS x, round(greatest(0, y - up), 6) AS y, round(least(200, x + w + rt) - greatest(0, x - lf), 6) AS w, round(least(100, y + h + dn) - greatest(0, y - up), 6) AS h FROM p""")
def padded_boxes(spark, sf_dir):
    return boxes.padded(page_boxes(spark, sf_dir), 0.3, 0.6).select("page", "box", *(F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")))


@query(f"WITH {PAGE_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, box) AS k FROM q) SELECT page, box FROM r WHERE k <= 4")
def biggest_boxes(spark, sf_dir):
    return boxes.biggest(page_boxes(spark, sf_dir)).select("page", "box")


@query(f"WITH {PAGE_BOXES} SELECT page, box, ((row_number() OVER (PARTITION BY page ORDER BY w / greatest(h, 1), box) - 1) // 2)::INTEGER AS batch FROM q")
def shape_batches(spark, sf_dir):
    return boxes.by_shape(page_boxes(spark, sf_dir), 2).select("page", "box", "batch")


@query(f"""WITH {PAGE_BOXES}, s AS (SELECT page, count(*) AS n, count(*) FILTER (h > w * 1.5) AS tall, count(*) FILTER (w > h * 2) AS wide FROM q WHERE w * h > 60 GROUP BY page)
SELECT page, CASE WHEN n < 4 THEN NULL WHEN tall >= n * 0.6 AND tall >= 4 THEN CASE WHEN page % 3 = 0 THEN 270 ELSE 90 END WHEN wide >= 3 AND page % 2 = 0 THEN 180 END::INTEGER AS degrees FROM s""")
def page_rotation(spark, sf_dir):
    q = page_boxes(spark, sf_dir)
    at = lambda degrees, conf: F.struct(F.lit(degrees).alias("degrees"), F.coalesce(conf, F.lit(0.0)).alias("conf"))
    sure = F.array(at(0, F.lit(40.0)), at(180, F.when(F.col("page") % 2 == 0, 70.0).otherwise(50.0)), at(90, F.lit(60.0)), at(270, F.when(F.col("page") % 3 == 0, 80.0).otherwise(20.0)))
    read = q.select("page").distinct().select("page", F.inline(sure)).withColumn("text", F.lit("ab"))
    return boxes.rotation(q, read)


@query("SELECT l_orderkey AS doc, l_linenumber AS seq, l_partkey AS part, (CASE WHEN a % 90 > 45 THEN a % 90 - 90 ELSE a % 90 END)::DOUBLE AS angle, round(w * h * 1.5::DOUBLE / (2 * (w + h)), 6) AS grow FROM (SELECT *, l_partkey % 180 AS a, l_quantity::DOUBLE AS w, l_linenumber::DOUBLE AS h FROM lineitem)")
def angles(spark, sf_dir):
    w, h = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), boxes.fold_angle((F.col("l_partkey") % 180).cast("double")).alias("angle"), F.round(boxes.unclip(w, h), 6).alias("grow"))


@query("""WITH m AS (SELECT l_suppkey AS page, var_pop(l_partkey) AS a, var_pop(l_quantity::DOUBLE) AS b, covar_pop(l_partkey, l_quantity::DOUBLE) AS c FROM lineitem GROUP BY l_suppkey)
SELECT page, round(degrees(atan2(2 * c, a - b)) / 2, 4) AS angle, round(sqrt(((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c)) / greatest(1e-6, (a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c))), 3) AS elongation FROM m""")
def principal_axes(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    return boxes.principal_axis(points, "page").select("page", F.round("angle", 4).alias("angle"), F.round("elongation", 3).alias("elongation"))


@query("""WITH f AS (SELECT l_orderkey AS page, (CASE WHEN l_partkey % 90 > 45 THEN l_partkey % 90 - 90 ELSE l_partkey % 90 END)::DOUBLE AS a FROM lineitem WHERE l_quantity > 8)
SELECT page, list_sort(list(a))[(count(*) // 2)::INTEGER + 1] AS angle FROM f GROUP BY page HAVING count(*) >= 3""")
def line_skew(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 90).cast("double").alias("angle"), (F.col("l_quantity") / 2).alias("elongation"))
    return boxes.line_skew(lines)


@query(f"""WITH {BOXES}, s AS (SELECT p.doc, p.seq, p.part, greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) AS i, p.w * p.h AS a, q.w * q.h AS b,
least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y) >= least(p.h, q.h) * 0.5 AND greatest(p.x, q.x) - least(p.x + p.w, q.x + q.w) < greatest(p.h, q.h) * 4 AS level FROM b p JOIN b q ON p.doc = q.doc AND (p.seq, p.part) <> (q.seq, q.part))
SELECT doc, seq, part, round(max(i / (a + b - i)), 6) AS iou, bool_or(level) AS same_line FROM s GROUP BY doc, seq, part""")
def iou_and_lines(spark, sf_dir):
    b = line_boxes(spark, sf_dir)
    p, q = F.col("p.rect"), F.col("q.rect")
    both = b.alias("p").join(b.alias("q"), (F.col("p.doc") == F.col("q.doc")) & ((F.col("p.seq") != F.col("q.seq")) | (F.col("p.part") != F.col("q.part"))))
    return both.groupBy("p.doc", "p.seq", "p.part").agg(F.round(F.max(geometry.iou(p, q)), 6).alias("iou"), F.bool_or(geometry.same_line(p, q)).alias("same_line"))


@query("""WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS seq, l_partkey AS part, l_partkey % 90 / 4.0::DOUBLE - 3 AS x, l_suppkey % 40 / 8.0::DOUBLE AS y, l_quantity::DOUBLE / 3 AS w, l_linenumber / 2.0::DOUBLE AS h FROM lineitem)
SELECT doc, seq, part, greatest(0, floor(x))::DOUBLE AS x, greatest(1, least(20, ceil(x + w)) - greatest(0, floor(x)))::DOUBLE AS w, greatest(1, least(6, ceil(y + h)) - greatest(0, floor(y)))::DOUBLE AS h FROM r""")
def clamped(spark, sf_dir):
    r = geometry.rect(F.col("l_partkey") % 90 / 4.0 - 3, F.col("l_suppkey") % 40 / 8.0, F.col("l_quantity").cast("double") / 3, F.col("l_linenumber") / 2.0)
    c = geometry.clamp(r, F.lit(20.0), F.lit(6.0))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), c["x"].alias("x"), c["w"].alias("w"), c["h"].alias("h"))


@query(f"""WITH {BOXES}, l AS (SELECT doc AS page, seq * 1000000 + part AS line, x, y, w, h, seq + 8 AS n, (part % 10) / 10.0::DOUBLE AS score FROM b), g AS (SELECT * FROM b WHERE part % 7 = 0),
k AS (SELECT l.*, row_number() OVER (PARTITION BY page ORDER BY score DESC, line) AS place FROM l WHERE n >= 11 AND score > 0.3 AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc = l.page
AND greatest(0, least(l.x + l.w, g.x + g.w) - greatest(l.x, g.x)) * greatest(0, least(l.y + l.h, g.y + g.h) - greatest(l.y, g.y)) > 0.85 * least(l.w * l.h, g.w * g.h))) SELECT page, line FROM k WHERE place <= 2""")
def promising_lines(spark, sf_dir):
    b = line_boxes(spark, sf_dir)
    lines = b.select(F.col("doc").alias("page"), (F.col("seq").cast("long") * 1000000 + F.col("part")).alias("line"), "rect", (F.col("seq") + 8).alias("count"), (F.col("part") % 10 / 10.0).alias("score"))
    return boxes.promising_lines(lines, b.where("part % 7 = 0").select(F.col("doc").alias("page"), "rect"), 2).select("page", "line")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("scan"), F.concat(F.lit('s "'), F.col("o_custkey").cast("string"), F.lit('".pdf')).alias("file"), F.lit("p1").alias("label"), (key % 3).cast("int").alias("document"), key.alias("order"),
        F.when(key % 5 != 0, F.lpad(key.cast("string"), 13, "7")).alias("digits"), F.when(key % 7 != 0, key % 1000).alias("amount"), F.when(key % 2 == 0, "ok").otherwise("ng").alias("summary"), (key % 4 == 0).alias("simplified"),
        F.col("o_orderdate").cast("timestamp").alias("at"), F.when(key % 6 != 0, "done").otherwise("failed").alias("status"), F.array(F.lit("1"), key.cast("string")).alias("others"), F.lit("paddle").alias("engine"), (key % 100 / 8.0).alias("seconds"),
    )


RESULTS = f"""r AS (SELECT o_orderkey AS k, 's "' || o_custkey || '".pdf' AS file, CASE WHEN o_orderkey % 5 <> 0 THEN lpad(o_orderkey::VARCHAR, 13, '7') END AS digits, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 1000)::VARCHAR END AS amount,
CASE WHEN o_orderkey % 2 = 0 THEN 'ok' ELSE 'ng' END AS summary, CASE WHEN o_orderkey % 4 = 0 THEN 'はい' ELSE 'いいえ' END AS simplified, o_orderdate::TIMESTAMP AS moment, o_custkey FROM orders),
t AS (SELECT *, coalesce('T' || digits, '') AS number, coalesce('{fixed.REGISTER_URL}' || digits, '') AS link FROM r)"""


@query(f"WITH {RESULTS} SELECT k AS o_orderkey, file AS c0, 'p1' AS c1, (k % 3 + 1)::VARCHAR AS c2, number AS c3, link AS c4, coalesce(amount, '') AS c5, summary AS c6, simplified AS c7 FROM t")
def batch_file(spark, sf_dir):
    r = results(spark, sf_dir)
    return history.batch_rows(r.withColumn("label", F.concat_ws("|", "label", F.col("order").cast("string")))).select(F.get(F.split("c1", r"\|"), F.lit(1)).cast("long").alias("o_orderkey"), "c0", F.get(F.split("c1", r"\|"), F.lit(0)).alias("c1"), *(f"c{i}" for i in range(2, 8)))


@query(f"""WITH {RESULTS} SELECT year(moment) || '/' || month(moment) || '/' || day(moment) || ' 0:00:00' AS c0, file AS c1, number AS c2, link AS c3, coalesce(amount, '') AS c4, 'T1 T' || k AS c5, summary AS c6, simplified AS c7, 'paddle' AS c8,
printf('%.1f', round((k % 100 / 8.0)::DECIMAL(10, 4), 1)::DOUBLE) AS c9 FROM t""")
def history_file(spark, sf_dir):
    return history.history_rows(results(spark, sf_dir).withColumnRenamed("file", "name").withColumn("seconds", F.col("seconds").cast("decimal(10,4)").cast("double")))


@query(f"""WITH {RESULTS}, n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS c FROM t WHERE k % 6 <> 0) SELECT o_custkey || '-' || (k % 3) AS id, CASE WHEN c > 1 THEN file || ' #' || (k % 3 + 1) ELSE file END AS name, digits, amount::BIGINT AS amount FROM n""")
def history_entries(spark, sf_dir):
    return history.entries_of(results(spark, sf_dir)).select("id", "name", "digits", "amount")


@query("""WITH h AS (SELECT user_id AS u, event_id AS id, ts FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts DESC, id DESC) AS k FROM h) SELECT u AS "user", id FROM p WHERE k <= 50 AND id % 13 <> 0 AND u % 17 <> 0""")
def history_kept(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    kept = history.appended(e.where("id % 2 = 0"), e.where("id % 2 <> 0"))
    gone = e.where("id % 13 = 0").select("user", "id").union(e.where("user % 17 = 0").select("user", F.lit(None).cast("long")).distinct())
    return history.removed(kept, gone).select("user", "id")


@query("""WITH e AS (SELECT o_custkey, o_orderkey % 5 <> 0 AS d, o_orderkey % 7 <> 0 AS a, o_orderkey AS k FROM orders) SELECT k AS o_orderkey FROM e WHERE NOT d OR NOT a""")
def settlement_exceptions(spark, sf_dir):
    return amounts.exceptions(results(spark, sf_dir)).select(F.col("order").alias("o_orderkey"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 5000 - o_orderkey WHEN 1 THEN 5000 END::BIGINT AS difference FROM orders""")
def expected_amount(spark, sf_dir):
    key = F.col("o_orderkey")
    typed = F.when(key % 3 == 0, F.concat(F.lit("¥"), F.format_number(key, 0))).when(key % 3 == 1, "円").otherwise(" ")
    return table(spark, sf_dir, "orders").select("o_orderkey", amounts.expected_difference(F.lit(5000).cast("long"), typed).alias("difference"))


@query("SELECT l_orderkey AS doc, coalesce(sum(CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 2 = 0 THEN floor(l_extendedprice)::BIGINT END), 0)::BIGINT AS total FROM lineitem GROUP BY l_orderkey")
def selected_items(spark, sf_dir):
    kind = F.when(F.col("l_partkey") % 3 == 0, "item").otherwise("tax")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(amounts.selected_sum(kind, F.floor("l_extendedprice").cast("long"), F.col("l_suppkey") % 2 == 0).alias("total"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("place"), (F.col("o_orderkey") % 3 == 0).alias("primary"), F.when(F.col("o_orderkey") % 4 == 0, "corrected").otherwise("read").alias("kind"))


@query("""WITH c AS (SELECT o_custkey AS page, o_orderkey AS place, o_orderkey % 3 = 0 AS sure, o_custkey % 5 AS n FROM orders WHERE o_orderkey % 4 <> 0),
s AS (SELECT *, sure AND row_number() OVER (PARTITION BY page, sure ORDER BY place) <= greatest(3, n) AS shown FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY page, shown ORDER BY place) AS o FROM s)
SELECT page, place, shown FROM k WHERE shown OR o <= 6""")
def displayed_candidates(spark, sf_dir):
    c = ranked(spark, sf_dir)
    return pages.displayed(c, c.select("page", (F.col("page") % 5).alias("documents")).distinct()).select("page", "place", "shown")


@query("SELECT o_custkey AS page, o_orderkey::VARCHAR AS digits FROM orders WHERE o_orderkey % 3 = 0 AND NOT o_orderkey % 2 = 0")
def newly_found(spark, sf_dir):
    c = ranked(spark, sf_dir).withColumn("digits", F.col("place").cast("string")).withColumn("valid", F.col("place") % 2 == 0)
    return pages.newly_found(c, c).select("page", "digits")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS pdf, CASE WHEN p_partkey % 9 = 0 THEN 413 WHEN p_partkey % 10 = 0 OR (p_partkey % 100 * 100)::BIGINT * 9000 > 60000000 THEN 400 END::INTEGER AS refused FROM part""")
def uploads(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, "a.PDF").when(key % 4 == 2, "b.pdf.png").otherwise("c.jpg")
    kind = F.when(key % 4 == 1, "application/pdf")
    length = F.when(key % 9 == 0, 41 * 1024 * 1024).otherwise(1000)
    refused = files.accepted(length, F.when(key % 10 != 0, key % 100 * 100), F.lit(9000))
    return table(spark, sf_dir, "part").select("p_partkey", files.is_pdf(name, kind).alias("pdf"), refused.cast("int").alias("refused"))


@query("""SELECT user_id, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS fast, count(*) AS n, sum(CASE WHEN event_id % 3 = 1 THEN 4 ELSE 9 END)::BIGINT AS tiles FROM events GROUP BY user_id""")
def stored_settings(spark, sf_dir):
    key = F.col("event_id")
    stored = F.when(key % 3 == 0, '{"mode": "fast"}').when(key % 3 == 1, '{"maxTiles": 4, "other": 1}').otherwise("no json")
    s = files.settings(table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), stored.alias("json")))
    return s.groupBy(F.col("user").alias("user_id")).agg(F.count_if(F.col("mode") == "fast").alias("fast"), F.count("*").alias("n"), F.sum("maxTiles").cast("long").alias("tiles"))


@query("""SELECT l_orderkey AS page, sum(length(l_returnflag || l_linestatus))::BIGINT AS characters, count(DISTINCT l_returnflag) AS fonts, count(*) FILTER (l_linestatus = 'O') AS embedded,
round(count(*) FILTER (l_quantity < 20) / count(*), 6) AS ink, count(*) FILTER (l_quantity < 20) = 0 AS blank FROM lineitem GROUP BY l_orderkey""")
def page_facts(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("page", F.col("l_orderkey"))
    fonts = line.select("page", F.col("l_returnflag").alias("name"), (F.col("l_linestatus") == "O").alias("embedded"))
    shade = (F.col("l_quantity") * 10).cast("int")
    found = files.page_facts(line.select("page", F.concat("l_returnflag", "l_linestatus").alias("text")), fonts, line.select("page", shade.alias("r"), F.lit(255).alias("g"), F.lit(250).alias("b")))
    return found.select("page", "characters", "fonts", "embedded", F.round("ink", 6).alias("ink"), "blank")


@query("""SELECT o_custkey AS page, '{"lines":[' || string_agg('{"y":' || (o_orderkey % 50) || '.0,"x":' || (o_orderkey % 1000) || '.0,"text":"' || o_orderkey || '","conf":1.0,"w":2.0,"h":3.0}', ',' ORDER BY o_orderkey % 50, o_orderkey % 1000, o_orderkey::VARCHAR) || ']}' AS json
FROM orders GROUP BY o_custkey""")
def responses(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    number = lambda x: F.lit(float(x))
    return history.response(o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").cast("string").alias("text"), number(1).alias("conf"), (F.col("o_orderkey") % 1000).cast("double").alias("x"), (F.col("o_orderkey") % 50).cast("double").alias("y"), number(2).alias("w"), number(3).alias("h")))


@query("""SELECT o_orderkey, 'ok' AS regno, 'ok' AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'ok' ELSE 'ng' END AS recipient, 'ok' AS consistency, (o_orderkey % 1000 * 10 + 100)::BIGINT AS base, (o_orderkey % 1000 + 10)::BIGINT AS tax FROM orders""")
def required_fields(spark, sf_dir):
    """Statuses of bills with one rate; the addressee is missing where the key is odd."""
    key = F.col("o_orderkey")
    base = key % 1000 * 10 + 100
    rows = F.array(
        F.lit("請求書"), F.when(key % 2 == 0, "山田商事 御中").otherwise("控え"), F.lit("株式会社みどり"), F.lit("登録番号 T7000012050002"), F.lit("2026年9月1日"), F.concat(F.lit("商品代 "), yen(base)),
        F.concat(F.lit("10%対象 "), yen(base)), F.concat(F.lit("消費税(10%) "), yen(base / 10)), F.concat(F.lit("合計 "), yen(base * 11 / 10)),
    )
    listed = table(spark, sf_dir, "orders").select(key.alias("doc"), F.posexplode(rows).alias("row", "text"))
    documents = table(spark, sf_dir, "orders").select(key.alias("doc"), F.lit("7000012050002").alias("digits"), *(F.lit(None).cast(t).alias(c) for c, t in (("weak", "boolean"), ("corrected", "boolean"), ("kind", "string"))))
    s = requirements.analyse(listed, documents, TODAY)
    rate = F.get("tax_lines", F.lit(0))
    return s.select(F.col("doc").alias("o_orderkey"), *(F.col("statuses")[k].alias(k) for k in ("regno", "date", "recipient", "consistency")), rate["base"].alias("base"), rate["tax"].alias("tax"))
