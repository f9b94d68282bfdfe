"""The registered queries and their SQL.

The tables hold no billing documents, so texts, readings and rectangles are made
of order and line keys by expressions that both engines have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, geometry, numbers, text
from ..operators import amounts, voting

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import bills, pagescans, scans, votes  # noqa: F401 (register their queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    known = queries()
    return {k: v for k, v in SQL.items() if k in known}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a 12-digit base and the valid number made from it."""
    base = F.lpad((F.col("o_orderkey") * 1000003 + F.col("o_custkey")).cast("string"), 12, "0")
    o = table(spark, sf_dir, "orders").withColumn("base", base)
    return o.withColumn("digits", F.concat(numbers.check_digit(F.col("base")).cast("string"), "base"))


CHECK = "(9 - list_sum([CAST(base[i] AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END) for i in range(1, 13)]) % 9)"
NUMBERED = f"""b AS (SELECT *, lpad(CAST(o_orderkey * 1000003 + o_custkey AS VARCHAR), 12, '0') AS base FROM orders),
n AS (SELECT *, {CHECK}::INTEGER AS cd, CAST({CHECK} AS VARCHAR) || base AS digits FROM b)"""
DAMAGED = "substr(digits, 1, 5) || CAST((CAST(substr(digits, 6, 1) AS INTEGER) + 3) % 10 AS VARCHAR) || substr(digits, 7)"


def valid_sql(d: str) -> str:
    return f"(CAST(substr({d}, 1, 1) AS INTEGER) = 9 - list_sum([CAST(substr({d}, i + 1, 1) AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END) for i in range(1, 13)]) % 9)"


def damaged(d):
    return F.concat(F.substring(d, 1, 5), ((F.substring(d, 6, 1).cast("int") + 3) % 10).cast("string"), F.substring(d, 7, 7))


@query(f"WITH {NUMBERED} SELECT o_orderkey, base, cd AS check_digit FROM n")
def check_digit(spark, sf_dir):
    return numbered_orders(spark, sf_dir).select("o_orderkey", "base", numbers.check_digit(F.col("base")).alias("check_digit"))


@query(f"WITH {NUMBERED}, d AS (SELECT o_orderkey, digits, {DAMAGED} AS other FROM n) SELECT o_orderkey, {valid_sql('digits')} AS valid, {valid_sql('other')} AS other_valid FROM d")
def valid_digits(spark, sf_dir):
    d = numbered_orders(spark, sf_dir)
    return d.select("o_orderkey", numbers.is_valid(F.col("digits")).alias("valid"), numbers.is_valid(damaged(F.col("digits"))).alias("other_valid"))


@query(f"""WITH {NUMBERED} SELECT o_orderkey, (10 - list_sum([CAST(digits[i] AS INTEGER) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) for i in range(1, 13)]) % 10) % 10 = CAST(digits[13] AS INTEGER) AS jan FROM n""")
def ean13(spark, sf_dir):
    return numbered_orders(spark, sf_dir).select("o_orderkey", numbers.is_ean13(F.col("digits")).alias("jan"))


@query(f"""WITH {NUMBERED}, d AS (SELECT o_orderkey, {DAMAGED} AS digits FROM n), m(was, nows) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in numbers.CONFUSABLE_DIGITS.items())}),
w AS (SELECT * FROM d WHERE NOT {valid_sql('digits')}), p AS (SELECT *, unnest(range(0, 13)) AS position FROM w),
q AS (SELECT p.*, m.was, unnest(string_split(m.nows, '')) AS now FROM p JOIN m ON substr(digits, position + 1, 1) = m.was),
f AS (SELECT *, substr(digits, 1, position) || now || substr(digits, position + 2) AS corrected FROM q)
SELECT o_orderkey, position, was, now, corrected FROM f WHERE {valid_sql('corrected')}""")
def suggest_corrections(spark, sf_dir):
    d = numbered_orders(spark, sf_dir).select("o_orderkey", damaged(F.col("digits")).alias("digits"))
    return numbers.corrections(d).select("o_orderkey", "position", "was", "now", "corrected")


@query(f"WITH {NUMBERED} SELECT o_orderkey, 'T' || substr(digits, 1, 1) || ' ' || substr(digits, 2, 4) || ' ' || substr(digits, 6, 4) || ' ' || substr(digits, 10, 4) AS shown FROM n")
def format_t(spark, sf_dir):
    return numbered_orders(spark, sf_dir).select("o_orderkey", numbers.display(F.col("digits")).alias("shown"))


@query(f"WITH {NUMBERED} SELECT o_orderkey, 'T' || digits || '- ' || o_orderstatus AS half FROM n")
def half_width(spark, sf_dir):
    wide = F.concat(F.translate(F.concat(F.lit("T"), F.col("digits")), "T0123456789", "Ｔ０１２３４５６７８９"), F.lit("ー　"), F.col("o_orderstatus"))
    return numbered_orders(spark, sf_dir).select("o_orderkey", text.half_width(wide).alias("half"))


@query(f"""WITH {NUMBERED}, t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN digits WHEN 1 THEN {DAMAGED} WHEN 2 THEN '123' ELSE 'x' END AS s FROM n), v AS (SELECT *, CASE WHEN len(s) = 13 THEN {valid_sql("lpad(s, 13, '0')").replace("CAST(substr", "TRY_CAST(substr")} ELSE false END AS fits FROM t)
SELECT o_orderkey, CASE WHEN len(s) = 13 THEN s END AS digits, fits AS valid,
CASE WHEN s = 'x' THEN '数字以外の文字が含まれています' WHEN len(s) <> 13 THEN '13桁必要です(現在 ' || len(s) || ' 桁)' WHEN fits THEN 'チェックディジット一致'
ELSE 'チェックディジット不一致(先頭は ' || (9 - list_sum([CAST(substr(s, i + 1, 1) AS INTEGER) * (CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END) for i in range(1, 13)]) % 9)::INTEGER || ' のはず)' END AS message FROM v""")
def manual_input(spark, sf_dir):
    d = F.col("digits")
    k = F.col("o_orderkey") % 4
    typed = F.when(k == 0, F.concat(F.lit("Ｔ"), F.substring(d, 1, 1), F.lit(" "), F.substring(d, 2, 12))).when(k == 1, F.concat(F.lit("t"), damaged(d))).when(k == 2, "T-123").otherwise("Tx")
    m = numbers.manual(typed)
    return numbered_orders(spark, sf_dir).select("o_orderkey", m["digits"].alias("digits"), m["valid"].alias("valid"), m["message"].alias("message"))


STAGES = list(voting.STAGE_WEIGHTS)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as readings of their order's part number: two variants a supplier parity, stage by line number."""
    line = table(spark, sf_dir, "lineitem")
    damaged_here = (F.col("l_suppkey") % 3 == 0).cast("int")
    base = F.lpad((F.col("l_orderkey") * 1000003 + damaged_here * 7).cast("string"), 12, "0")
    return line.select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).cast("long").alias("seq"), F.concat(F.lit("7"), base).alias("digits"),
        (F.col("l_quantity") * 2).alias("conf"), (F.col("l_suppkey") % 2 == 0).alias("has_t"), (F.col("l_partkey") % 5 == 0).alias("context"), (F.col("l_partkey") % 3).cast("int").alias("substitutions"),
        F.element_at(F.array(*(F.lit(s) for s in STAGES)), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("stage"),
    )


READINGS = f"""r AS (SELECT l_orderkey AS doc, l_linenumber * 1000000 + l_partkey AS seq, '7' || lpad(CAST(l_orderkey * 1000003 + (CASE WHEN l_suppkey % 3 = 0 THEN 7 ELSE 0 END) AS VARCHAR), 12, '0') AS digits,
l_quantity * 2 AS conf, l_suppkey % 2 = 0 AS has_t, l_partkey % 5 = 0 AS context, l_partkey % 3 AS substitutions, [{', '.join(f"'{s}'" for s in STAGES)}][l_linenumber % 6 + 1] AS stage,
[{', '.join(str(v) for v in voting.STAGE_WEIGHTS.values())}][l_linenumber % 6 + 1]::DOUBLE AS sw FROM lineitem),
w AS (SELECT *, (0.35::DOUBLE + 0.65::DOUBLE * greatest(0, least(1, conf / 100))) * (CASE WHEN has_t THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END) * pow(0.7::DOUBLE, substitutions) * sw AS weight FROM r)"""


@query(f"WITH {READINGS} SELECT doc, seq, stage, round(weight, 6) AS weight FROM w")
def reading_weight(spark, sf_dir):
    r = readings(spark, sf_dir)
    return r.select("doc", "seq", "stage", F.round(voting.reading_weight(F.col("conf"), F.col("has_t"), F.col("substitutions"), F.col("stage")), 6).alias("weight"))


@query(f"WITH {READINGS}, t AS (SELECT doc, digits, round(sum(weight), 10) AS score, count(*) AS votes, bool_or(has_t) AS has_t, bool_or(context) AS context FROM w GROUP BY ALL) SELECT *, {valid_sql('digits')} AS valid FROM t")
def vote_tally(spark, sf_dir):
    t = voting.tally(readings(spark, sf_dir), "doc")
    return t.select("doc", "digits", F.round("score", 10).alias("score"), "votes", "has_t", "context", "valid")


@query(f"""WITH {READINGS}, p AS (SELECT doc, seq, weight, unnest(range(1, 14)) AS place, digits FROM w WHERE doc IN (SELECT doc FROM w GROUP BY doc HAVING count(*) >= 3)),
s AS (SELECT doc, place, substr(digits, place, 1) AS digit, round(sum(weight), 9) AS weight, min(seq) AS seq FROM p GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc, place ORDER BY weight DESC, seq) AS rn FROM s)
SELECT doc, string_agg(digit, '' ORDER BY place) AS digits FROM b WHERE rn = 1 GROUP BY doc""")
def consensus_digit(spark, sf_dir):
    return voting.consensus(readings(spark, sf_dir), "doc").select("doc", "digits")


@query(f"WITH {READINGS}, t AS (SELECT doc, digits, sum(weight) AS score, count(*) AS votes, bool_or(has_t) AS has_t, bool_or(stage = 'pdf') AS pdf, bool_or(context) AS context FROM w GROUP BY doc, digits),"
       f" c AS (SELECT doc, {valid_sql('digits')} AS valid, has_t, pdf, votes, floor(greatest(1, least(99, (1 - exp(-score / 1.5)) * 100 * (CASE WHEN {valid_sql('digits')} THEN 1 ELSE 0.35::DOUBLE END) * (CASE WHEN NOT has_t AND NOT context THEN 0.4::DOUBLE WHEN NOT has_t THEN 0.85::DOUBLE ELSE 1 END))) + 0.5)::INTEGER AS confidence FROM t)"
       " SELECT doc, bool_or(valid AND has_t AND (pdf OR (votes >= 3 AND confidence >= 80))) AS confident, max(confidence) AS best FROM c GROUP BY doc")
def confident(spark, sf_dir):
    t = voting.tally(readings(spark, sf_dir), "doc")
    no = F.lit(False)
    c = t.withColumn("confidence", voting.confidence(F.col("score"), F.col("valid"), F.lit("read"), F.col("has_t"), F.col("context"), no, no))
    sure = F.col("valid") & F.col("has_t") & (F.array_contains("stages", "pdf") | ((F.col("votes") >= 3) & (F.col("confidence") >= 80)))
    return c.groupBy("doc").agg(F.bool_or(sure).alias("confident"), F.max("confidence").alias("best"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"),
        geometry.rect(F.col("l_partkey") % 90, F.col("l_suppkey") % 40, F.col("l_quantity") + 1, F.col("l_linenumber") * 3).alias("rect"),
    )


BOXES = "b AS (SELECT l_orderkey AS doc, l_linenumber AS seq, l_partkey AS part, (l_partkey % 90)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y, l_quantity + 1 AS w, (l_linenumber * 3)::DOUBLE AS h FROM lineitem)"
SHARED = "greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y))"
PAIR = "p.doc = q.doc AND (p.seq, p.part) <> (q.seq, q.part)"


def paired(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.alias("p"), b.alias("q"), (F.col("p.doc") == F.col("q.doc")) & ((F.col("p.seq") != F.col("q.seq")) | (F.col("p.part") != F.col("q.part")))


@query(f"WITH {BOXES} SELECT p.doc, p.seq, p.part FROM b p WHERE EXISTS (SELECT 1 FROM b q WHERE {PAIR} AND {SHARED} > 0.5 * least(p.w * p.h, q.w * q.h))")
def overlap_semi(spark, sf_dir):
    p, q, same = paired(spark, sf_dir)
    return p.join(q, same & (geometry.overlap_ratio(F.col("p.rect"), F.col("q.rect")) > 0.5), "left_semi").select("doc", "seq", "part")


@query(f"WITH {BOXES} SELECT p.doc, p.seq, p.part FROM b p WHERE NOT EXISTS (SELECT 1 FROM b q WHERE {PAIR} AND {SHARED} > 0.3 * least(p.w * p.h, q.w * q.h))")
def overlap_anti(spark, sf_dir):
    p, q, same = paired(spark, sf_dir)
    return p.join(q, same & (geometry.overlap_ratio(F.col("p.rect"), F.col("q.rect")) > 0.3), "left_anti").select("doc", "seq", "part")


@query(f"WITH {BOXES}, m AS (SELECT p.doc, p.seq, p.part, q.seq AS qseq, q.part AS qpart FROM b p JOIN b q ON {PAIR} AND p.x + p.w / 2 BETWEEN q.x AND q.x + q.w AND p.y + p.h / 2 BETWEEN q.y AND q.y + q.h) SELECT doc, seq, part, min(qseq) AS first_block FROM m GROUP BY doc, seq, part")
def point_in_rect(spark, sf_dir):
    p, q, same = paired(spark, sf_dir)
    r = F.col("p.rect")
    hit = p.join(q, same & geometry.contains_point(F.col("q.rect"), r["x"] + r["w"] / 2, r["y"] + r["h"] / 2))
    return hit.groupBy("p.doc", "p.seq", "p.part").agg(F.min("q.seq").alias("first_block"))


@query(f"WITH {BOXES}, m AS (SELECT p.doc, p.seq, p.part, q.seq AS other, q.part AS opart, round(sqrt(pow(greatest(0, greatest(p.x, q.x) - least(p.x + p.w, q.x + q.w)), 2) + pow(greatest(0, greatest(p.y, q.y) - least(p.y + p.h, q.y + q.h)), 2)), 6) AS gap FROM b p JOIN b q ON {PAIR}), r AS (SELECT *, row_number() OVER (PARTITION BY doc, seq, part ORDER BY gap, other, opart) AS rn FROM m) SELECT doc, seq, part, other, gap FROM r WHERE rn = 1")
def nearest_seed(spark, sf_dir):
    p, q, same = paired(spark, sf_dir)
    gap = F.round(geometry.gap_between(F.col("p.rect"), F.col("q.rect")), 6)
    near = p.join(q, same).groupBy("p.doc", "p.seq", "p.part").agg(F.min(F.struct(gap.alias("gap"), F.col("q.seq").alias("other"), F.col("q.part"))).alias("m"))
    return near.select("doc", "seq", "part", "m.other", "m.gap")


@query(f"WITH {BOXES} SELECT doc, list_sort(list(h))[(count(*) // 2)::INTEGER + 1] AS middle, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM b GROUP BY doc")
def median_and_bounds(spark, sf_dir):
    g = boxes(spark, sf_dir).groupBy("doc").agg(geometry.upper_median(F.col("rect.h")).alias("middle"), geometry.bounding_box(F.col("rect")).alias("r"))
    return g.select("doc", "middle", "r.x", "r.y", "r.w", "r.h")


@query(f"""WITH {BOXES}, l AS (SELECT *, lag(x + w) OVER o AS prev_end, lag(h) OVER o AS prev_h FROM b WINDOW o AS (PARTITION BY doc ORDER BY x, seq, part)),
f AS (SELECT *, sum(CASE WHEN x - prev_end > 2 * greatest(prev_h, h) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY x, seq, part ROWS UNBOUNDED PRECEDING) AS phrase FROM l)
SELECT doc, phrase::BIGINT AS phrase, count(*) AS parts, min(x) AS x, max(x + w) AS right_edge FROM f GROUP BY doc, phrase""")
def phrase_islands(spark, sf_dir):
    r = F.col("rect")
    o = Window.partitionBy("doc").orderBy(r["x"], "seq", "part")
    apart = r["x"] - F.lag(r["x"] + r["w"]).over(o) > F.greatest(F.lag(r["h"]).over(o), r["h"]) * 2
    f = boxes(spark, sf_dir).withColumn("new", F.when(apart, 1).otherwise(0))
    f = f.withColumn("phrase", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return f.groupBy("doc", "phrase").agg(F.count("*").alias("parts"), F.min(r["x"]).alias("x"), F.max(r["x"] + r["w"]).alias("right_edge"))


@query(f"""WITH {BOXES}, g AS (SELECT doc, x, x - max(x + w) OVER (PARTITION BY doc ORDER BY x, seq, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM b)
SELECT doc, max(gap) AS gap FROM g WHERE gap > 0 GROUP BY doc""")
def largest_gap(spark, sf_dir):
    r = F.col("rect")
    before = Window.partitionBy("doc").orderBy(r["x"], "seq", "part").rowsBetween(Window.unboundedPreceding, -1)
    g = boxes(spark, sf_dir).select("doc", (r["x"] - F.max(r["x"] + r["w"]).over(before)).alias("gap"))
    return g.where("gap > 0").groupBy("doc").agg(F.max("gap").alias("gap"))


WORDS = ["コヒ豆", "合計", "消費税", "10%対象", "現金", "釣銭", "お預り 現金", "10%対象(税込)"]


def bill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    label = F.element_at(F.array(*(F.lit(w) for w in WORDS)), (F.when(F.col("l_partkey") % 4 == 0, F.col("l_suppkey") % 8).otherwise(0) + 1).cast("int"))
    return line.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).cast("long").alias("seq"), label.alias("label"), F.floor("l_extendedprice").cast("long").alias("amount"))


BILL = f"""l AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS seq, [{', '.join(f"'{w}'" for w in WORDS)}][(CASE WHEN l_partkey % 4 = 0 THEN l_suppkey % 8 ELSE 0 END) + 1] AS label, floor(l_extendedprice)::BIGINT AS amount FROM lineitem),
k AS (SELECT *, CASE label WHEN '合計' THEN 'total' WHEN '消費税' THEN 'tax' WHEN '10%対象' THEN 'other' WHEN '10%対象(税込)' THEN 'other' WHEN '現金' THEN 'payment' WHEN 'お預り 現金' THEN 'payment' WHEN '釣銭' THEN 'other' ELSE 'item' END AS kind FROM l)"""


def kinds(spark, sf_dir):
    return bill_lines(spark, sf_dir).withColumn("kind", text.classify(F.col("label")))


@query(f"WITH {BILL} SELECT doc, kind, count(*) AS n, sum(amount)::BIGINT AS total FROM k GROUP BY doc, kind")
def classify_kind(spark, sf_dir):
    return kinds(spark, sf_dir).groupBy("doc", "kind").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query(f"""WITH {BILL}, z AS (SELECT *, CASE WHEN kind = 'item' AND seq % 7 = 0 THEN 100 ELSE 50 END AS amt FROM k),
w AS (SELECT *, coalesce(sum(CASE WHEN kind = 'item' THEN amt END) OVER o, 0) AS run, coalesce(sum(CASE WHEN kind = 'tax' THEN amt END) OVER o, 0) AS tax,
coalesce(sum(CASE WHEN kind = 'other' AND contains(label, '対象') THEN amt END) OVER o, 0) AS sub, count(CASE WHEN kind = 'item' THEN 1 END) OVER o AS cnt,
max(CASE WHEN kind = 'item' THEN seq END) OVER (PARTITION BY doc) AS last_item, bool_or(kind = 'total') OVER (PARTITION BY doc) AS written
FROM z WINDOW o AS (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc, seq, amt::BIGINT AS amount FROM w WHERE kind = 'item' AND NOT written AND seq = last_item AND cnt >= 2 AND ((tax > 0 AND abs(amt - run - tax) <= 1) OR (sub > 0 AND tax > 0 AND abs(amt - sub - tax) <= 1) OR (amt = run AND seq % 3 <> 0))""")
def running_total_infer(spark, sf_dir):
    k = kinds(spark, sf_dir).withColumn("amount", F.when((F.col("kind") == "item") & (F.col("seq") % 7 == 0), 100).otherwise(50).cast("long"))
    k = k.withColumn("subject", F.col("label").contains("対象")).withColumn("bare", F.col("seq") % 3 != 0)
    return amounts.inferred_totals(k).where("inferred").select("doc", "seq", "amount")


@query(f"""WITH {BILL}, s AS (SELECT doc, coalesce(sum(CASE WHEN kind = 'item' THEN amount END), 0)::BIGINT AS items_sum, count(CASE WHEN kind = 'item' THEN 1 END) AS items, coalesce(sum(CASE WHEN kind = 'tax' THEN amount END), 0)::BIGINT AS tax_total,
coalesce(max(CASE WHEN kind = 'total' THEN amount END), max(CASE WHEN label = '現金' THEN amount END), nullif(coalesce(sum(CASE WHEN label = '10%対象(税込)' THEN amount END), 0), 0))::BIGINT AS doc_total FROM k GROUP BY doc)
SELECT *, CASE WHEN doc_total IS NULL OR items = 0 THEN NULL WHEN items_sum = doc_total THEN 'equal' WHEN tax_total > 0 AND abs(items_sum + tax_total - doc_total) <= 1 THEN 'equalWithTax' ELSE 'diff' END AS match FROM s""")
def items_vs_total(spark, sf_dir):
    return amounts.summary(kinds(spark, sf_dir).withColumns(amounts.row_marks(F.col("label"))))


@query(f"""WITH {BILL}, s AS (SELECT doc, sum(CASE WHEN kind = 'item' THEN amount END)::BIGINT AS items_sum, coalesce(max(CASE WHEN kind = 'total' THEN amount END), max(CASE WHEN label = '現金' THEN amount END), nullif(coalesce(sum(CASE WHEN label = '10%対象(税込)' THEN amount END), 0), 0))::BIGINT AS t FROM k GROUP BY doc)
SELECT doc, coalesce(t, items_sum) AS value, CASE WHEN t IS NOT NULL THEN 'total' WHEN items_sum IS NOT NULL THEN 'items' END AS source FROM s""")
def doc_amount(spark, sf_dir):
    s = amounts.summary(kinds(spark, sf_dir).withColumns(amounts.row_marks(F.col("label"))))
    a = amounts.document_amount(F.col("doc_total"), F.lit(None).cast("long"), F.col("items_sum"), F.col("items"))
    return s.select("doc", a["value"].alias("value"), a["source"].alias("source"))


@query("""WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS seq, l_partkey AS part, floor(l_extendedprice)::BIGINT AS base, CASE WHEN l_suppkey % 2 = 0 THEN 10 ELSE 8 END AS rate, CASE l_partkey % 3 WHEN 0 THEN floor(floor(l_extendedprice) * 0.1) WHEN 1 THEN floor(floor(l_extendedprice) * 0.08) ELSE floor(floor(l_extendedprice) / 11) END::BIGINT AS tax FROM lineitem),
f AS (SELECT *, abs(tax - base * rate::DOUBLE / (100 + rate)) < 1 AS inside, abs(tax - base * rate::DOUBLE / 100) < 1 AS outside FROM t)
SELECT doc, seq, part, rate, base, tax, CASE WHEN inside THEN '内税' WHEN outside THEN '外税' END AS mode, inside OR outside AS ok FROM f""")
def tax_breakdown(spark, sf_dir):
    base = F.floor("l_extendedprice").cast("long")
    b = F.col("base")
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), base.alias("base"), F.when(F.col("l_suppkey") % 2 == 0, 10).otherwise(8).alias("rate"))
    t = t.withColumn("tax", F.when(F.col("part") % 3 == 0, F.floor(b * F.lit("0.1").cast("decimal(2,1)"))).when(F.col("part") % 3 == 1, F.floor(b * F.lit("0.08").cast("decimal(3,2)"))).otherwise(F.floor(b / 11)).cast("long"))
    m = amounts.tax_mode(b, F.col("tax"), F.col("rate"), F.lit(None).cast("string"))
    return t.select("doc", "seq", "part", "rate", "base", "tax", m["mode"].alias("mode"), m["ok"].alias("ok"))


@query("""SELECT l_orderkey AS doc, CASE max(CASE WHEN l_quantity > 48 THEN 2 WHEN l_quantity > 40 THEN 1 ELSE 0 END) WHEN 2 THEN 'ng' WHEN 1 THEN 'warn' ELSE 'ok' END AS status FROM lineitem GROUP BY l_orderkey""")
def rules_rollup(spark, sf_dir):
    s = F.when(F.col("l_quantity") > 48, "ng").when(F.col("l_quantity") > 40, "warn").otherwise("ok")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(amounts.worst_status(s).alias("status"))


@query(f"""WITH {NUMBERED}, i AS (SELECT l_orderkey, sum(floor(l_extendedprice))::BIGINT AS amount FROM lineitem GROUP BY l_orderkey),
e AS (SELECT o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN digits END AS digits, CASE WHEN o_orderkey % 7 <> 0 THEN amount END AS amount FROM n LEFT JOIN i ON l_orderkey = o_orderkey)
SELECT o_custkey, count(*) AS documents, sum(coalesce(amount, 0))::BIGINT AS total, coalesce(sum(CASE WHEN digits IS NOT NULL THEN coalesce(amount, 0) END), 0)::BIGINT AS registered, count(*) - count(digits) AS no_number, count(*) - count(amount) AS no_amount FROM e GROUP BY o_custkey""")
def settlement(spark, sf_dir):
    """Per customer: documents, their amounts, those with a registration number, and what is missing."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.floor("l_extendedprice")).cast("long").alias("sum"))
    d = numbered_orders(spark, sf_dir).join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    d = d.select("o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("digits")).alias("digits"), F.when(F.col("o_orderkey") % 7 != 0, F.col("sum")).alias("amount"))
    return amounts.settlement(d, "o_custkey")


@query("""SELECT o_custkey, count(*) AS documents, count(CASE WHEN o_orderkey % 5 <> 0 THEN 1 END) AS with_number FROM orders GROUP BY o_custkey""")
def batch_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("documents"), F.count_if(F.col("o_orderkey") % 5 != 0).alias("with_number"))


@query("""WITH d AS (SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, o_orderkey % 4 AS k FROM orders),
e AS (SELECT o_orderkey, CASE WHEN k = 3 THEN 2018 + (o_orderkey % 9 + 1) ELSE y END::INTEGER AS year, m AS month, CASE WHEN k = 2 THEN 31 ELSE d END::INTEGER AS day FROM d),
v AS (SELECT *, TRY_CAST(lpad(year::VARCHAR, 4, '0') || '-' || lpad(month::VARCHAR, 2, '0') || '-' || lpad(day::VARCHAR, 2, '0') AS DATE) AS dt FROM e)
SELECT o_orderkey, year, month, day, dt IS NOT NULL AS valid, coalesce(dt < DATE '2023-10-01', false) AS before, coalesce(dt > DATE '2026-10-09', false) AS future FROM v""")
def date_parse(spark, sf_dir):
    y, m, d = (f("o_orderdate").cast("string") for f in (F.year, F.month, F.day))
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日"))).when(k == 1, F.concat_ws("/", y, m, d)).when(k == 2, F.concat(y, F.lit("-"), m, F.lit("-31"))).otherwise(F.concat(F.lit("発行 令和"), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("年 "), m, F.lit("月"), d, F.lit("日")))
    p = text.parse_date(written, F.lit("2026-10-09").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.*")


@query("""SELECT l_orderkey AS doc, l_linenumber AS seq, l_partkey AS part, (CASE l_suppkey % 3 WHEN 0 THEN -1 ELSE 1 END * floor(l_extendedprice))::BIGINT AS value FROM lineitem""")
def numeric_cell(spark, sf_dir):
    v = F.floor("l_extendedprice").cast("long")
    cell = F.concat(F.when(F.col("l_suppkey") % 3 == 0, "△").otherwise(""), F.lit("￥"), F.format_number(v, 0), F.when(F.col("l_suppkey") % 2 == 0, "円").otherwise(""))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), text.numeric_value(cell).alias("value"))


@query("""SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) // 1000 RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) >= 2 AS limited FROM events WHERE event_type = 'error'""")
def rate_limit(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.unix_timestamp("ts")).rangeBetween(-600, 0)
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts", (F.count("*").over(w) >= 2).alias("limited"))


@query("""WITH s AS (SELECT event_id, user_id, ts, max(CASE WHEN event_type = 'click' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS login FROM events)
SELECT event_id, user_id, login IS NOT NULL AND ts < login + INTERVAL 12 HOUR AS live FROM s""")
def session_ttl(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    login = F.max(F.when(F.col("event_type") == "click", F.col("ts"))).over(w)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", login.alias("login")).select("event_id", "user_id", F.coalesce(F.col("ts") < F.col("login") + F.expr("INTERVAL 12 HOURS"), F.lit(False)).alias("live"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT user_id, event_id, place FROM r WHERE place <= 50""")
def history_cap(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("place")).where("place <= 50")


@query("""SELECT o_orderkey, '"' || o_orderkey || '","' || replace('a "' || o_orderpriority || '".jpg', '"', '""') || '","' || o_orderstatus || '"' AS line FROM orders""")
def csv_lines(spark, sf_dir):
    from ..sources import csv_out

    name = F.concat(F.lit('a "'), F.col("o_orderpriority"), F.lit('".jpg'))
    return table(spark, sf_dir, "orders").select("o_orderkey", csv_out.line(F.col("o_orderkey").cast("string"), name, F.col("o_orderstatus")).alias("line"))


@query("""WITH p AS (SELECT p_partkey, 200 + p_partkey % 800 AS side, 2 + p_partkey % 3 AS n FROM part), g AS (SELECT *, unnest(range(0, n)) AS i FROM p), h AS (SELECT *, unnest(range(0, n)) AS j FROM g)
SELECT p_partkey, i::INTEGER AS i, j::INTEGER AS j, round(i * 0.75::DOUBLE * side / (n - 0.25::DOUBLE * (n - 1)), 6) AS x, round(j * 0.75::DOUBLE * side / (n - 0.25::DOUBLE * (n - 1)), 6) AS y FROM h""")
def tiles(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (200 + F.col("p_partkey") % 800).alias("side"), (2 + F.col("p_partkey") % 3).cast("int").alias("n"))
    g = p.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    at = lambda k: F.round(F.col(k) * 0.75 * F.col("side") / (F.col("n") - 0.25 * (F.col("n") - 1)), 6)
    return g.select("p_partkey", "i", "j", at("i").alias("x"), at("j").alias("y"))


@query("SELECT p_partkey, unnest(range(1, least(p_partkey % 80, 50) + 1))::INTEGER AS page FROM part WHERE p_partkey % 80 > 0")
def page_range(spark, sf_dir):
    pages = (F.col("p_partkey") % 80).cast("int")
    return table(spark, sf_dir, "part").where(pages > 0).select("p_partkey", F.explode(F.sequence(F.lit(1), F.least(pages, F.lit(50)))).alias("page"))


@query(f"WITH {NUMBERED} SELECT o_orderkey, '{fixed.REGISTER_URL}' || digits AS url, '{fixed.CORPORATE_URL}' || digits AS corporate FROM n")
def lookup_url(spark, sf_dir):
    from ..sources import csv_out

    return numbered_orders(spark, sf_dir).select("o_orderkey", csv_out.lookup_url(F.col("digits")).alias("url"), csv_out.corporate_url(F.col("digits")).alias("corporate"))


@query(f"WITH {NUMBERED} SELECT o_orderkey, digits, true AS has_t, true AS valid, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 6 END::INTEGER AS start FROM n")
def extract_t_numbers(spark, sf_dir):
    from ..functions import scanners

    o = numbered_orders(spark, sf_dir)
    written = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Ｔ"), F.col("digits"), F.lit(" 様"))).otherwise(F.concat(F.lit("登録番号: T"), F.substring("digits", 1, 1), F.lit("-"), F.substring("digits", 2, 12)))
    return o.select("o_orderkey", F.explode(scanners.numbers_in(written)).alias("n")).select("o_orderkey", "n.digits", "n.has_t", "n.valid", "n.start")


@query("""SELECT l_orderkey AS doc, l_linenumber AS seq, l_partkey AS part, floor(l_extendedprice)::BIGINT AS value, '10%対象' AS label, 10 AS rate FROM lineitem WHERE l_suppkey % 2 = 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, -floor(l_extendedprice)::BIGINT, '値引', NULL FROM lineitem WHERE l_suppkey % 2 = 1""")
def money_tokens(spark, sf_dir):
    from ..functions import scanners

    price = F.format_number(F.floor("l_extendedprice"), 0)
    row = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("10%対象 ¥"), price)).otherwise(F.concat(F.lit("値引 ▲"), price, F.lit("円")))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), F.explode(scanners.segments_in(row)).alias("m"))
    return line.select("doc", "seq", "part", "m.value", "m.label", "m.rate")


def written_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as rows of text: its lines, and their sum as the total."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("row"), F.floor("l_extendedprice").cast("long").alias("v"))
    total = line.groupBy("doc").agg(F.sum("v").alias("v")).select("doc", F.lit(1000).alias("row"), F.concat(F.lit("合 計 ￥"), F.format_number("v", 0)).alias("text"))
    rows = line.select("doc", "row", F.concat(F.lit("商品 ￥"), F.format_number("v", 0)).alias("text")).union(total)
    return rows.select("doc", "row", "text")


@query("""SELECT l_orderkey AS doc, sum(floor(l_extendedprice))::BIGINT AS items_sum, sum(floor(l_extendedprice))::BIGINT AS doc_total, sum(floor(l_extendedprice))::BIGINT AS amount, 'equal' AS match, 'total' AS source FROM lineitem GROUP BY l_orderkey""")
def document_analysis(spark, sf_dir):
    import datetime

    from ..operators import requirements

    documents = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc")).distinct().select("doc", *(F.lit(None).cast(t).alias(c) for c, t in (("digits", "string"), ("weak", "boolean"), ("corrected", "boolean"), ("kind", "string"))))
    found = requirements.analyse(written_bills(spark, sf_dir), documents, datetime.date(2026, 10, 8))
    return found.select("doc", "items_sum", "doc_total", "amount", "match", "source")
