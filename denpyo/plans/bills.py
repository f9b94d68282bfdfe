"""Registered queries of bills: rows of text put together by keys, and what follows from them.

Which rows a bill has depends on its key. The SQL knows of each row what it says (a table of facts), and works out what the engine must find in the text.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import requirements
from .catalogue import query, table

TODAY = datetime.date(2026, 10, 9)
NUMBER = "7000012050002"
#: Rows of a bill: text ({name}: an amount), how often of seven, facts, and of its amount: value, rate, role (base, tax, total, item).
ROWS = (
    ("請求書", 2, "bill", None, None, None),
    ("領収書", 3, "receipt_title", None, None, None),
    ("山田商事 御中", 2, "firm_addressed recipient", None, None, None),
    ("株式会社みどり", 3, "issuer", None, None, None),
    ("みどり食堂", 2, "issuer retailer", None, None, None),
    ("登録番号 T" + NUMBER, 5, "", None, None, None),
    ("2026年9月1日", 3, "date good", None, None, None),
    ("2023/05/01", 2, "date good before", None, None, None),
    ("2024/02/30", 2, "date invalid", None, None, None),
    ("2029年1月1日", 2, "date future", None, None, None),
    ("商品代 {price}", 5, "content priced", "price", None, "item"),
    ("お茶 {tea} ※", 2, "priced starred", "tea", None, "item"),
    ("10%対象 {base10}", 4, "rated rate_row", "base10", 10, "base"),
    ("消費税(10%) {tax10}", 4, "taxed tax_word", "tax10", 10, "tax"),
    ("8%対象 {base8}", 3, "rated rate_row eight", "base8", 8, "base"),
    ("消費税(8%) {tax8}", 3, "taxed tax_word eight", "tax8", 8, "tax"),
    ("合計 {total}", 4, "total_row", "total", None, "total"),
    ("田中 様", 2, "recipient", None, None, None),
)
VALUES = {
    "price": "k % 900 + 10", "tea": "k % 90 + 100", "base10": "k % 1000 * 10 + 100", "tax10": "k % 1000 + 10 + CASE WHEN k % 6 = 0 THEN 7 ELSE 0 END",
    "base8": "k % 500 * 25 + 125", "tax8": "k % 500 * 2 + 10", "total": "k % 1000 * 11 + 110 + CASE WHEN k % 5 = 0 THEN k % 500 * 27 + 135 ELSE 0 END",
}


def _has(t: int) -> str:
    return f"(k * {2 * t + 3} + {t * t}) % 7 < {ROWS[t][1]}"


def bill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))

    def said(t: int) -> Column:
        before, _, rest = ROWS[t][0].partition("{")
        name, _, after = rest.partition("}")
        shown = F.concat(F.lit(before + "¥"), F.format_number(F.expr(VALUES[name]), 0), F.lit(after)) if name else F.lit(before)
        return F.when(F.expr(_has(t)), shown)

    listed = o.select(F.col("k").alias("doc"), F.posexplode(F.array(*(said(t) for t in range(len(ROWS))))).alias("row", "text"))
    return listed.where("text IS NOT NULL")


def bill_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 19 == 0, "normal").when(k % 23 == 0, "simplified")
    return table(spark, sf_dir, "orders").select(k.alias("doc"), F.when(k % 11 != 0, NUMBER).alias("digits"), (k % 13 == 0).alias("weak"), (k % 17 == 0).alias("corrected"), kind.alias("kind"))


def _any(fact: str) -> str:
    return "(" + " OR ".join(_has(t) for t, r in enumerate(ROWS) if fact in r[2].split()) + ")"


def _value(role: str, rate: int | None) -> str:
    t = next(t for t, r in enumerate(ROWS) if r[5] == role and r[4] == rate)
    return f"CASE WHEN {_has(t)} THEN {VALUES[ROWS[t][3]]} END"


_FACTS = ("bill", "receipt_title", "firm_addressed", "recipient", "issuer", "retailer", "date", "good", "invalid", "content", "priced", "starred", "eight", "taxed", "total_row")
_PERCENT = "array_to_string(list_filter([CASE WHEN has10 AND {0}10 IS NULL THEN '10%' END, CASE WHEN has8 AND {0}8 IS NULL THEN '8%' END], lambda x: x IS NOT NULL), '・')"
_OK = "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN abs({1} - {0} * {2}::DOUBLE / 100) < 1 OR abs({1} - {0} * {2}::DOUBLE / (100 + {2})) < 1 END"
_MODE = "CASE WHEN abs({1} - {0} * {2}::DOUBLE / (100 + {2})) < 1 THEN '内税' WHEN abs({1} - {0} * {2}::DOUBLE / 100) < 1 THEN '外税' END"
_WORST = "CASE WHEN 'ng' IN ({0}) THEN 'ng' WHEN 'warn' IN ({0}) THEN 'warn' ELSE 'ok' END"
_SAID = """'%: 対象 ¥' || format('{{:,}}', {0}::BIGINT) || ' → 税 ¥' || format('{{:,}}', {1}::BIGINT) || CASE WHEN {2} THEN ' (' || {3} || 'で一致)' ELSE ' (不一致?)' END"""

BILLS = f"""a AS (SELECT o_orderkey AS k FROM orders),
b AS (SELECT k, {', '.join(f"{_any(f)} AS {f}" for f in _FACTS)}, {' OR '.join(f'({_has(t)})' for t in (6,))} AS recent,
  {_value("base", 10)} AS base10, {_value("tax", 10)} AS tax10, {_value("base", 8)} AS base8, {_value("tax", 8)} AS tax8, {_value("total", None)} AS total,
  CASE WHEN {_has(10)} THEN {VALUES["price"]} END AS price, CASE WHEN {_has(11)} THEN {VALUES["tea"]} END AS tea FROM a),
c AS (SELECT *, base10 IS NOT NULL OR tax10 IS NOT NULL AS has10, base8 IS NOT NULL OR tax8 IS NOT NULL AS has8,
  CASE WHEN k % 19 = 0 THEN 'normal' WHEN k % 23 = 0 THEN 'simplified' ELSE 'auto' END AS kind FROM b),
d AS (SELECT *, has10::INTEGER + has8::INTEGER AS n, {_PERCENT.format("base")} AS no_base, {_PERCENT.format("tax")} AS no_tax,
  kind = 'auto' AND NOT (firm_addressed OR bill) AND NOT retailer AND receipt_title AS unsure,
  kind = 'simplified' OR kind = 'auto' AND NOT (firm_addressed OR bill) AND (retailer OR receipt_title) AS simplified,
  {_OK.format("base10", "tax10", 10)} AS ok10, {_OK.format("base8", "tax8", 8)} AS ok8, {_MODE.format("base10", "tax10", 10)} AS mode10, {_MODE.format("base8", "tax8", 8)} AS mode8 FROM c),
e AS (SELECT *, (base10 IS NOT NULL)::INTEGER + (base8 IS NOT NULL)::INTEGER AS known, coalesce(base10, 0) + coalesce(base8, 0) AS inside,
  CASE WHEN base10 IS NOT NULL AND mode10 IS DISTINCT FROM '内税' THEN coalesce(tax10, 0) ELSE 0 END + CASE WHEN base8 IS NOT NULL AND mode8 IS DISTINCT FROM '内税' THEN coalesce(tax8, 0) ELSE 0 END AS more FROM d),
f AS (SELECT *,
  CASE WHEN k % 11 = 0 THEN 'ng' WHEN k % 17 = 0 OR k % 13 = 0 THEN 'warn' ELSE 'ok' END AS s_regno, CASE WHEN issuer THEN 'ok' ELSE 'warn' END AS s_issuer,
  CASE WHEN NOT date THEN 'ng' WHEN NOT good OR NOT recent THEN 'warn' ELSE 'ok' END AS s_date,
  CASE WHEN NOT (content OR priced) THEN 'warn' WHEN eight AND NOT starred THEN 'warn' ELSE 'ok' END AS s_content,
  CASE WHEN n = 0 THEN CASE WHEN simplified THEN 'warn' ELSE 'ng' END WHEN no_base = '' OR n = 1 AND total_row THEN 'ok' ELSE 'warn' END AS s_rate,
  CASE WHEN n > 0 AND no_tax = '' THEN 'ok' WHEN simplified AND n > 0 THEN CASE WHEN unsure THEN 'warn' ELSE 'na' END WHEN (has10 AND tax10 IS NULL)::INTEGER + (has8 AND tax8 IS NULL)::INTEGER < n THEN 'warn' ELSE 'ng' END AS s_tax,
  CASE WHEN recipient THEN 'ok' WHEN simplified THEN CASE WHEN unsure THEN 'warn' ELSE 'na' END ELSE 'ng' END AS s_recipient,
  CASE WHEN ok10 IS NULL AND ok8 IS NULL THEN NULL WHEN coalesce(ok10, true) AND coalesce(ok8, true) THEN 'ok' ELSE 'warn' END AS s_consistency,
  CASE WHEN total IS NULL OR known = 0 THEN NULL WHEN least(abs(inside - total), abs(inside + more - total)) <= known THEN 'ok' ELSE 'warn' END AS s_total FROM e)"""


@query(f"""WITH {BILLS} SELECT k AS doc, s_regno AS regno, s_issuer AS issuer, s_date AS date, s_content AS content, s_rate AS "rateTotal", s_tax AS tax, s_recipient AS recipient, s_consistency AS consistency, s_total AS total,
  simplified, CASE WHEN kind <> 'auto' THEN 'manual' WHEN unsure THEN 'auto-weak' ELSE 'auto' END AS kind_source, {_WORST.format("s_regno, s_issuer, s_date, s_content, s_rate, s_tax, s_recipient")} AS summary,
  CASE WHEN total IS NOT NULL THEN total ELSE price + coalesce(tea, 0) END AS amount_if_price,
  coalesce(price, 0) + coalesce(tea, 0) AS items_sum, coalesce(tax10, 0) + coalesce(tax8, 0) AS tax_total,
  CASE WHEN total IS NULL OR price IS NULL AND tea IS NULL THEN NULL WHEN coalesce(price, 0) + coalesce(tea, 0) = total THEN 'equal'
    WHEN coalesce(tax10, 0) + coalesce(tax8, 0) > 0 AND abs(coalesce(price, 0) + coalesce(tea, 0) + coalesce(tax10, 0) + coalesce(tax8, 0) - total) <= 1 THEN 'equalWithTax' ELSE 'diff' END AS match FROM f""")
def bill_report(spark, sf_dir):
    r = requirements.analyse(bill_rows(spark, sf_dir), bill_documents(spark, sf_dir), TODAY)
    priced = F.when((F.col("source") == "total") | F.expr(_has(10).replace("k *", "doc *")), F.col("amount"))
    return r.select("doc", *(F.col("statuses")[s].alias(s) for s in requirements.FIELDS), "simplified", "kind_source", "summary", priced.alias("amount_if_price"), "items_sum", "tax_total", "match")


@query(f"""WITH {BILLS}, m AS (SELECT k AS doc,
  CASE WHEN n = 0 THEN '適用税率(10%・8%)を確認できません' WHEN no_base = '' THEN '税率ごとの対象額があります' WHEN n = 1 AND total_row THEN CASE WHEN has10 THEN '10' ELSE '8' END || '%のみの書類で、合計額の記載があります' ELSE no_base || 'の対象額(金額)を特定できません' END AS rate_message,
  CASE WHEN NOT date THEN '日付を確認できません' WHEN NOT good AND invalid THEN '日付らしき記載がありますが、実在しない日付です(誤読の可能性)' WHEN NOT good THEN '未来の日付になっています(誤読の可能性)'
    WHEN NOT recent THEN 'インボイス制度の開始(2023年10月1日)より前の日付です' ELSE '日付があります(2026/09/01)' END AS date_message,
  CASE s_consistency WHEN 'ok' THEN '対象額と税額が端数処理の範囲で一致しています' WHEN 'warn' THEN '対象額と税額が一致しないようです(OCRの誤読の可能性もあります)' END AS consistency_message,
  CASE WHEN s_consistency IS NOT NULL THEN array_to_string(list_filter([CASE WHEN ok10 IS NOT NULL THEN '10' || {_SAID.format("base10", "tax10", "ok10", "mode10")} END, CASE WHEN ok8 IS NOT NULL THEN '8' || {_SAID.format("base8", "tax8", "ok8", "mode8")} END], lambda x: x IS NOT NULL), ' / ') END AS consistency_lines,
  CASE WHEN s_total IS NOT NULL THEN '合計 ¥' || format('{{:,}}', total::BIGINT) || CASE WHEN base10 IS NOT NULL THEN ' / 10%対象 ¥' || format('{{:,}}', base10::BIGINT) ELSE '' END || CASE WHEN base8 IS NOT NULL THEN ' / 8%対象 ¥' || format('{{:,}}', base8::BIGINT) ELSE '' END END AS total_lines FROM f)
SELECT * FROM m""")
def bill_messages(spark, sf_dir):
    r = requirements.analyse(bill_rows(spark, sf_dir), bill_documents(spark, sf_dir), TODAY)
    item = lambda f: F.get(F.filter("items", lambda x: x["id"] == f), F.lit(0))
    lines = lambda f: F.when(item(f).isNotNull(), F.array_join(item(f)["evidence"], " / "))
    return r.select(
        "doc", item("rateTotal")["message"].alias("rate_message"), item("date")["message"].alias("date_message"), item("consistency")["message"].alias("consistency_message"),
        lines("consistency").alias("consistency_lines"), lines("total").alias("total_lines"),
    )


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 900 + 100 AS n FROM orders)
SELECT k AS o_orderkey, CASE k % 6 WHEN 0 THEN (2000 + n % 1000)::VARCHAR WHEN 1 THEN n::VARCHAR WHEN 2 THEN (-n)::VARCHAR WHEN 3 THEN '0' WHEN 4 THEN '' ELSE '1100,' || n END AS amounts,
CASE k % 6 WHEN 0 THEN '8' WHEN 5 THEN '10,10' ELSE '' END AS rates FROM a""")
def odd_amounts(spark, sf_dir):
    """Amounts with a point for the comma, after a date, below zero, of nothing, none in a telephone number, and two without a sign."""
    from ..functions import scanners

    k = F.col("o_orderkey")
    n = k % 900 + 100
    row = (
        F.when(k % 6 == 0, F.concat(F.lit("8%対象 ¥2."), F.lpad((n % 1000).cast("string"), 3, "0"))).when(k % 6 == 1, F.concat(F.lit("小計 2026/09/01 "), n.cast("string"))).when(k % 6 == 2, F.concat(F.lit("値引 -"), n.cast("string"), F.lit("円")))
        .when(k % 6 == 3, "合計 ¥0").when(k % 6 == 4, "電話 03-1234-5678").otherwise(F.concat(F.lit("10%対象 1,100 消費税 "), n.cast("string")))
    )
    found = table(spark, sf_dir, "orders").select(k, scanners.segments_in(row).alias("s"))
    joined = lambda field: F.array_join(F.transform(F.col(f"s.{field}"), lambda x: x.cast("string")), ",")
    return found.select("o_orderkey", joined("value").alias("amounts"), joined("rate").alias("rates"))


#: Rows as they are read, and put right; the last three stay.
GARBLED = (("内消貿税等10%¥3", "内消費税等10%¥3"), ("領収害", "領収書"), ("事業者登録督号T1", "事業者登録番号T1"), ("請求晝", "請求書"), ("東京都千代田区", "東京都千代田区"), ("10%対象小計¥80,000", "10%対象小計¥80,000"), ("但しプリント代として", "但しプリント代として"))


@query(f"""SELECT o_orderkey, [{', '.join(f"'{good}'" for _, good in GARBLED)}][o_orderkey % {len(GARBLED)} + 1] || ' ' || o_orderkey AS repaired FROM orders""")
def keyword_repair(spark, sf_dir):
    from ..operators.details import repaired

    k = F.col("o_orderkey")
    read = F.element_at(F.array(*(F.lit(bad) for bad, _ in GARBLED)), (k % len(GARBLED) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k, repaired(F.concat(read, F.lit(" "), k.cast("string"))).alias("repaired"))


@query("SELECT c_custkey AS page, least(8, greatest(1, c_custkey % 11))::INTEGER AS expected FROM customer")
def expected_by_keywords(spark, sf_dir):
    """Pages with none to ten words that announce a number."""
    from ..operators import words

    k = F.col("c_custkey")
    said = F.transform(F.sequence(F.lit(0), (k % 11).cast("int")), lambda i: F.when(i == 0, "請求書").when(i % 2 == 0, "登録No.12").otherwise("登録番号T1"))
    return words.expected_numbers(table(spark, sf_dir, "customer").select(k.alias("page"), F.explode(said).alias("text")))
