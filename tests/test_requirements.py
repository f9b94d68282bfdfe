"""Amounts, tax and required fields, against cases worked out by hand; all documents of a test in one frame."""

import datetime as dt

import pytest

from denpyo.operators import requirements as R

TODAY = dt.date(2026, 10, 9)
NTA = "7000012050002"
HEAD = ("請求書", "株式会社サンプル 御中", "発行: 株式会社テスト", "登録番号 T" + NTA, "2026年10月1日", "Web制作費 一式")
#: name: rows, number, kind, more of the document
CASES = {
    "seven": (("セブン-イレブン足立弘道1丁目店", "事業者登録番号 T7810648631842", "2024年12月23日(月) 19:06", "領収書", "¥40", "(税率10%対象 ¥40)", "(内消費税等 10% ¥3)", "但しプリント代として", "nanaco支払 ¥40"), "7810648631842"),
    "taxi": (("領 収 書", "株式会社サンプル商事 様", "金額 ¥3,120", "(うち消費税等10% ¥283)", "但し タクシー運賃として", "2026年9月8日", "みどり自動車株式会社", "登録番号 T9803456789123"), "9803456789123"),
    "missing": (("請求書", "株式会社テスト", "2026/10/01", "Web制作 ¥100,000"), None),
    "unmarked": (("株式会社A 御中", "令和6年4月1日", "お茶 ¥108", "8%対象 ¥108", "消費税 8% ¥8"), "7123456789012"),
    "headings": ((*HEAD, "10%対象", "消費税10%"), NTA),
    "one of two": ((*HEAD, "10%対象 ¥110", "8%対象 ¥108 ※軽減税率", "消費税(10%) ¥10", "合計 ¥218"), NTA),
    "both": ((*HEAD, "10%対象 ¥110", "8%対象 ¥108 ※軽減税率", "消費税(10%) ¥10", "消費税(8%) ¥8", "合計 ¥218"), NTA),
    "cash": (("株式会社テスト", "登録番号 T" + NTA, "2026年10月1日", "Web制作費 ¥110,000", "10%対象 ¥110,000", "支払方法 現金"), NTA),
    "title": (("領収書", "株式会社テスト", "登録番号 T" + NTA, "2026年10月1日", "Web制作費として", "金額 ¥110,000", "10%対象 ¥110,000"), NTA),
    "forced": (("領収書", "株式会社テスト", "金額 ¥110,000", "10%対象 ¥110,000"), None, "normal"),
    "store": (("領収書", "足立弘道1丁目店東京都足立区弘道1丁目1番15号", "登録番号 T" + NTA, "2026年10月1日", "但しプリント代として", "¥40", "(税率10%対象 ¥40)", "(内消費税等10% ¥3)"), NTA),
    "tax only": (("〇〇食堂", "登録番号 T" + NTA, "2026年10月1日", "ランチ代として", "合計 ¥330", "対象 ¥330(内消費税 ¥30)"), NTA),
    "tomorrow": (("2026/10/10",), None), "today": (("2026/10/09",), None), "no rows": ((), NTA), "blank": (("", None, " "), None),
    "outer": (("10%対象 ¥1,000", "消費税(10%) ¥100", "8%対象 ¥500", "消費税(8%) ¥40", "合計 ¥1,640"), None), "wrong total": (("10%対象 ¥1,000", "消費税(10%) ¥100", "合計 ¥1,500"), None),
    "wrong tax": (("10%対象 ¥1,000", "消費税(10%) ¥150"), None), "same line": (("10%対象 ¥1,100(内消費税 ¥100)",), None), "included": (("10%対象 税込 ¥1,000", "消費税(10%) ¥100", "合計 ¥1,000"), None),
    "excluded": (("10%対象(税抜) ¥1,000", "消費税(10%) ¥100"), None),
}


def frames(spark, cases):
    rows = [(name, i, t) for name, c in cases.items() for i, t in enumerate(c[0])]
    documents = [(name, c[1], False, name == "corrected", c[2] if len(c) > 2 else None) for name, c in cases.items()]
    return spark.createDataFrame(rows, "doc string, row int, text string").repartition(3), spark.createDataFrame(documents, "doc string, digits string, weak boolean, corrected boolean, kind string")


@pytest.fixture(scope="module")
def got(spark):
    rows, documents = frames(spark, CASES)
    return {r.doc: r for r in R.analyse(rows, documents, TODAY).collect()}


def test_whole_reports(got):
    assert set(got) == set(CASES)
    s = got["seven"]
    assert s.simplified and s.summary == "ok" and s.statuses == dict(regno="ok", issuer="ok", date="ok", content="ok", rateTotal="ok", tax="ok", recipient="na", consistency="ok")
    assert got["taxi"].simplified and got["taxi"].summary == "ok" and got["taxi"].amount == 3120
    m = got["missing"]
    assert (m.statuses["regno"], m.statuses["recipient"], m.statuses["tax"], m.summary) == ("ng", "ng", "ng", "ng") and m.summary_text == "確認できない記載事項があります"
    assert got["unmarked"].statuses["content"] == "warn"
    assert got["headings"].statuses["rateTotal"] != "ok" and got["headings"].statuses["tax"] != "ok" and got["headings"].summary != "ok"
    assert (got["one of two"].statuses["rateTotal"], got["one of two"].statuses["tax"]) == ("ok", "warn")
    assert all(got["both"].statuses[k] == "ok" for k in R.FIELDS)
    assert not got["cash"].simplified and got["cash"].statuses["recipient"] == got["cash"].statuses["tax"] == "ng"
    assert got["title"].simplified and got["title"].kind_source == "auto-weak" and got["title"].statuses["recipient"] == "warn"
    assert not got["forced"].simplified and got["forced"].statuses["recipient"] == "ng" and got["forced"].kind_source == "manual"
    assert got["store"].kind_source == "auto" and got["store"].summary == "ok"
    assert got["tax only"].simplified and got["tax only"].statuses["rateTotal"] == got["tax only"].statuses["tax"] == "ok"
    assert got["tomorrow"].statuses["date"] == "warn" and got["today"].statuses["date"] == "ok"
    assert got["no rows"].statuses["regno"] == "ok" and got["no rows"].amount is None and got["blank"].statuses["date"] == "ng"


def test_tax_by_rate(got):
    lines = lambda k: [(x.rate, x.base, x.tax, x.mode, x.ok) for x in got[k].tax_lines]
    assert lines("outer") == [(10, 1000, 100, "外税", True), (8, 500, 40, "外税", True)] and got["outer"].total_ok
    assert got["wrong total"].total_ok is False and lines("same line") == [(10, 1100, 100, "内税", True)]
    assert lines("included")[0][4] is False and lines("excluded")[0][4] is True
    item = {x.id: x for x in got["wrong tax"]["items"]}["consistency"]
    assert item.status == "warn" and item.evidence == ["10%: 対象 ¥1,000 → 税 ¥150 (不一致?)"] and "一致しない" in item.message
    assert {x.id: x for x in got["wrong total"]["items"]}["total"].evidence == ["合計 ¥1,500", "10%対象 ¥1,000"]


def test_consistency(spark):
    rows, _ = frames(spark, {k: CASES[k] for k in ("outer", "wrong tax", "missing")})
    got = {r.doc: r for r in R.consistency(rows).collect()}
    assert set(got) == {"outer", "wrong tax"} and got["outer"].ok and not got["wrong tax"].ok and got["outer"].lines[1] == "8%: 対象 ¥500 → 税 ¥40 (外税で一致)"


AMOUNTS = {
    "taxed": (("商品A ¥500", "商品B ¥700", "消費税 ¥116", "合計 ¥1,316"), 1316, 1200, "equalWithTax"), "only": (("金額 ¥3,120",), 3120, 0, None), "diff": (("A ¥100", "B ¥200", "合計 ¥500"), 500, 300, "diff"),
    "named": (("商品A ¥100", "商品B ¥200", "商品C ¥300"), None, 600, None), "equal": (("商品A ¥100", "商品B ¥200", "商品C ¥300", "合計 ¥600"), 600, 600, "equal"), "off": (("A ¥1,000", "値引 ¥100", "合計 ¥900"), 900, 900, "equal"),
    "zero": (("合計 ¥0",), 0, 0, None), "two kinds": (("品 ¥1,100", "合計 ¥1,100(内消費税 ¥100)"), 1100, 1100, "equal"), "last": (("商品 ¥250 ¥500",), None, 500, None), "nothing": (("2026年10月1日", "12:30", "03-1234-5678"), None, 0, None),
    "inferred": (("A ¥600", "B ¥616", "消費税 ¥116", "¥1,332"), 1332, 1216, "equalWithTax"), "paid": (("A ¥300", "現金 ¥300", "お預り ¥1,000"), 300, 300, "equal"), "bare": (("利用料金(円)", "三郷 東京 1,320", "12 34"), None, 1354, None),
}


def test_amounts(spark):
    rows, documents = frames(spark, {k: (v[0], None) for k, v in AMOUNTS.items()})
    got = {r.doc: (r.doc_total, r.items_sum, r.match) for r in R.analyse(rows, documents, TODAY).collect()}
    assert got == {k: v[1:] for k, v in AMOUNTS.items()}
    listed = R.items(R.marked(rows)).where("doc = 'inferred'").orderBy("seq").collect()
    assert [(r.kind, r.inferred) for r in listed] == [("item", False), ("item", False), ("tax", False), ("total", True)]


def test_amounts_from_a_table(spark):
    rows, documents = frames(spark, {"t": (("品名 金額", "A 3 1,000", "B 9 2,000", "合計 3,000"), None)})
    table = spark.createDataFrame([("t", 1, 1000, True), ("t", 2, 2000, True), ("t", 3, 3000, True)], "doc string, row int, amount long, tabled boolean")
    r = R.analyse(rows, documents, TODAY, table).first()
    assert (r.items_sum, r.doc_total, r.match) == (3000, 3000, "equal")


def test_one_shuffle_of_rows_and_nothing_sent_to_the_driver(spark):
    rows, documents = frames(spark, {k: CASES[k] for k in ("outer", "missing")})
    plan = R.analyse(rows, documents, TODAY)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 2, plan  # of rows and of documents


@pytest.mark.parametrize("text", ("内消貿税等10%¥3", "清求書 12", "領收書99", "10%対像 1,234", "合計 ¥5", "99 登録督号 T1 8"))
def test_repair_does_not_depend_on_digits(text):
    from denpyo.operators import keywords

    other = text.translate(str.maketrans("0123456789", "9081726354"))
    assert keywords.repair(text).translate(str.maketrans("0123456789", "9081726354")) == keywords.repair(other)
    keywords._repaired.cache_clear()
    keywords.repair(text), keywords.repair(other)
    assert keywords._repaired.cache_info().misses == 1
