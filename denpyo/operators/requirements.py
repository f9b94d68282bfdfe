"""Amounts, tax and required fields of documents, as columns: lines to facts, facts to statuses by a table of rules.

`gathered` puts row texts in one spelling and the rows of a document into one array, `scanned` finds their amounts (the only work outside the engine, a function of each line's text).
From then on items, tax by rate, and facts of lines and documents are columns over that array, which what a bill holds bounds. RULES is the table by which a document's facts
become statuses and messages: of each field the first rule that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import amounts
from .details import read_rows

# Fixed patterns of the words that fields, kinds of document and amounts are known by.
ISSUER = r"株式会社|有限会社|合同会社|合資会社|合名会社|一般社団法人|一般財団法人|公益社団法人|公益財団法人|NPO法人|医療法人|社会福祉法人|学校法人|\(株\)|\(有\)|㈱|㈲|事務所|商店|商事|店$|店(?=[A-Za-z0-9_])|本店|支店|[^\s]店|食堂|[^\s]堂$|[^\s]屋$|亭|カフェ|クリニック|医院|病院|薬局|ホテル|旅館|工業|工房|製作所"
RECIPIENT = "(?:御中|様|殿)(?!式)"
RECEIPT = "(?i)レシート|お買上|お買い上げ|ご来店|お預り|お預かり|お釣|釣銭|POS|レジ|タクシー|運賃|乗車|迎車|駐車|入庫|出庫"
RETAILER = r"[^\s支本]店(?!舗|員|長|頭|内)|店舗|食堂|カフェ|喫茶|[^\s]屋$|亭|薬局|ドラッグ|ホテル|旅館|コンビニ|スーパー|ストア|マート|ショップ|ベーカリー|レストラン|ダイニング|居酒屋|交通|ハイヤー|パーキング"
RECEIPT_TITLE = "領収書|領収証"
CONTENT = "品名|品目|内容|摘要|明細|但し|但|商品|項目|として|代|料|費"
TAX_WORD = r"消費税|内税|外税|税額|税等|内消費税|うち税|税\s?¥"
TOTAL_WORD = "対象|合計|小計|総計|税込|税抜|お買上"
TAX_LABEL, BASE_LABEL = "消費税|税額|内税|外税|税等|うち税", "対象|合計|計|税込|税抜|小計"
OTHER_WORD = r"[^\s()（）%0-9:]"
TOTAL_ONLY, NOT_TOTAL = "合計|総額|請求金額|お買上|税込金額|ご利用額|領収金額", "小計|対象|消費税|税額|内税|外税|お預|釣|残高|ポイント"
RATE_NOTE, RATE_ROW = "※|印|商品|品目|表示|を示|です|ます", "対象|消費税|税額|税等|内税|外税|税込|税抜"
RATE, RATE_ANYWHERE = r"(?<![0-9.])(10|8)\s?%", r"(10|8)\s?%"
TOTAL_ROW, LEADING_AMOUNT = "合計|総額|請求金額|領収金額|お買上", r"^(金額|運賃|料金)\s?[:：]?\s?[¥0-9]"
INSIDE, OUTSIDE = r"税込|内税|内消費税|うち消費税|うち税|\(内", "税抜|外税|税別"
MONEY_HEADER = r"料金|金額|\(円\)|円\)|運賃|通行料"
LAST_NUMBER = r"(?s)^(.*)(?<![0-9,./:\-])([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{2,7})(?![0-9,./:\-%年月日時分])"
WORDS = "[぀-ヿ一-鿿A-Za-z]"


def gathered(rows: DataFrame) -> DataFrame:
    """doc, lines (structs of row, n: the row in one spelling, amount: what a table gives it) in the order of rows, without blank ones, and tabled (whether the document has a table).

    `rows` has doc, row and text, and may have amount and tabled.
    """
    amount, tabled = (F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t) for c, t in (("amount", "bigint"), ("tabled", "boolean")))
    # The shuffle that gathers a document comes first, so that the work on texts is spread however few files hold them.
    spelled = rows.select("doc", "row", "text", amount.alias("amount"), tabled.alias("tabled")).repartition("doc").withColumn("n", text.normalize_row(F.coalesce("text", F.lit(""))))
    # Blank rows are left out here, as a filter would go below the shuffle and have the spelling done twice.
    return spelled.groupBy("doc").agg(F.array_sort(F.collect_list(F.when(F.col("n") != "", F.struct("row", "n", "amount")))).alias("lines"), F.coalesce(F.bool_or("tabled"), F.lit(False)).alias("tabled"))


def scanned(found: DataFrame) -> DataFrame:
    """`found` with keywords of its lines put right, and their amounts (segs: value, start, end, marked, label, rate)."""
    known = found.withColumn("_read", read_rows(F.col("lines")["n"]))
    line = lambda l, i: F.struct(l["row"].alias("row"), F.get("_read", i)["n"].alias("n"), F.get("_read", i)["segs"].alias("segs"), l["amount"].alias("amount"))  # noqa: E731, E741
    return known.withColumn("lines", F.transform("lines", line)).drop("_read")


def marked(rows: DataFrame) -> DataFrame:
    """A row per document: doc, lines (structs of row, n, segs, amount) and tabled. `rows` as `gathered` takes it."""
    return scanned(gathered(rows))


def segments() -> Column:
    """The amounts of a document's lines, in order: value, label, rate, n and whether the label is one of tax or of a taxable sum."""

    def of_line(line: Column) -> Column:
        def told(s: Column) -> Column:
            tax = s["label"].rlike(TAX_LABEL)
            base = ~tax & (s["label"].rlike(BASE_LABEL) | ~s["label"].rlike(OTHER_WORD))
            return F.struct(s["value"].alias("value"), s["label"].alias("label"), s["rate"].alias("rate"), line["n"].alias("n"), tax.alias("is_tax"), base.alias("is_base"))

        return F.transform(line["segs"], told)

    return F.flatten(F.transform("lines", of_line))


# Line items


def _several(line: Column, kind: Column) -> Column:
    """Entries (pos, kind, value) of a row of several amounts: each counts by its label, one without words as the one before it, the last of a kind for all."""

    def of_kinds(kinds: Column) -> Column:
        def entry(k: Column) -> Column:
            of = F.filter(F.transform(line["segs"], lambda s, i: F.struct(F.get(kinds, i).alias("kind"), s["value"].alias("value"))), lambda x: x["kind"] == k)
            return F.struct((F.array_position(kinds, k) - 1).cast("int").alias("pos"), k.alias("kind"), F.element_at(of, -1)["value"].alias("value"))

        return F.transform(F.array_distinct(kinds), entry)

    own = F.transform(line["segs"], lambda s: F.when(s["label"].rlike(WORDS), text.classify(s["label"])))
    filled = text.bound(own, lambda o: F.transform(o, lambda x, i: F.coalesce(F.try_element_at(F.filter(F.slice(o, 1, i + 1), lambda y: y.isNotNull()), F.lit(-1)), kind)))
    return text.bound(filled, of_kinds)


def with_items(found: DataFrame) -> DataFrame:
    """`found` (as `marked` gives it) with its (structs of seq, text, amount, kind, bare, subject, inclusive, deposit, inferred): the line items, the last turned into a total where the sums say so.

    A row's amount is that of the document's table. Else each amount of the row counts by its label, an amount without
    words as the one before it, the last of a kind for all; and a row without a marked amount, in a document that speaks of money but has no table, by its last number.
    """
    priced = F.exists("lines", lambda l: l["n"].rlike(MONEY_HEADER))  # noqa: E741

    def entries(line: Column, kind: Column, priced: Column) -> Column:
        n, count = line["n"], F.size(line["segs"])
        head = n.rlike(MONEY_HEADER) & ~F.replace(n, F.lit("(円)"), F.lit("")).rlike("[0-9]{2,}")
        bare = F.nullif(F.replace(F.regexp_extract(n, LAST_NUMBER, 2), F.lit(","), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))
        late = (F.length(F.regexp_extract(n, LAST_NUMBER, 1)) >= 0.4 * F.length(n)) | (F.length(n) <= 12)
        whole = F.when(line["amount"].isNotNull(), line["amount"]).when(count == 1, F.get(line["segs"], F.lit(0))["value"])
        whole = whole.when((count == 0) & priced & ~F.col("tabled") & ~head & late, bare)
        one = F.filter(F.transform(F.array(whole), lambda v: F.struct(F.lit(0).alias("pos"), kind.alias("kind"), v.alias("value"))), lambda e: e["value"].isNotNull())
        return F.when(line["amount"].isNull() & (count > 1), _several(line, kind)).otherwise(one)

    def items_of(line: Column, priced: Column) -> Column:
        n = line["n"]
        label = F.length(F.regexp_replace(n, r"[¥0-9,.\-\s円()]", "")) <= 1
        marks = [c.alias(k) for k, c in amounts.row_marks(n).items()]

        def item(e: Column) -> Column:
            return F.struct((line["row"].cast("long") * 1000 + e["pos"]).alias("seq"), n.alias("text"), text.signed_amount(n, e["kind"], e["value"]).alias("amount"), e["kind"].alias("kind"), label.alias("bare"), *marks)

        return F.transform(text.bound(text.classify(n), lambda k: entries(line, k, priced)), item)

    listed = found.withColumn("its", text.bound(priced, lambda p: F.flatten(F.transform("lines", lambda line: items_of(line, p)))))
    return listed.withColumn("its", amounts.with_inferred_total(F.col("its")))


def items(found: DataFrame) -> DataFrame:
    """doc, row, seq, text, amount, kind, inferred and the marks of each line item of `found`, as `with_items` makes them."""
    return with_items(found).select("doc", F.inline_outer("its")).where(F.col("seq").isNotNull()).withColumn("row", F.floor(F.col("seq") / 1000))


# Tax by rate


def _first(segs: str, test) -> Column:
    return F.get(F.filter(segs, test), F.lit(0))


def with_rates(found: DataFrame) -> DataFrame:
    """`found` with segs, tax_lines (rate, base, tax, mode and ok of each tax rate of amounts and of rows that speak of tax, but for notes, the higher rate first), total (the stated one) and total_ok (null where nothing can be compared)."""
    spoken = F.filter("lines", lambda l: l["n"].rlike(RATE_ROW) & ~l["n"].rlike(RATE_NOTE))  # noqa: E741
    spoken = F.flatten(F.transform(spoken, lambda l: F.transform(F.regexp_extract_all(l["n"], F.lit(RATE), F.lit(1)), lambda r: r.cast("int"))))  # noqa: E741
    known = found.withColumn("segs", segments())
    rates = F.array_distinct(F.concat(F.filter(F.col("segs")["rate"], lambda r: r.isNotNull()), spoken))
    known = known.withColumns({"_rates": F.sort_array(rates, asc=False), "_unrated": _first("segs", lambda s: s["rate"].isNull() & s["is_tax"])})

    def line(rate: Column) -> Column:
        base = _first("segs", lambda s: (s["rate"] == rate) & s["is_base"])
        tax = F.coalesce(_first("segs", lambda s: (s["rate"] == rate) & s["is_tax"]), F.when(F.size("_rates") == 1, F.col("_unrated")))
        return text.bound(F.struct(rate.alias("rate"), base.alias("b"), tax.alias("t")), checked)

    def checked(x: Column) -> Column:
        b, t = x["b"], x["t"]
        words = F.concat_ws(" ", F.coalesce(b["label"], F.lit("")), F.coalesce(b["n"], F.lit("")), F.coalesce(t["label"], F.lit("")))
        forced = F.when(words.rlike(INSIDE), "内税").when(words.rlike(OUTSIDE), "外税")
        mode = text.bound(forced, lambda f: amounts.tax_mode(b["value"], t["value"], x["rate"], f))
        return text.bound(mode, lambda m: F.struct(x["rate"].alias("rate"), b["value"].alias("base"), t["value"].alias("tax"), m["mode"].alias("mode"), m["ok"].alias("ok")))

    known = known.withColumn("tax_lines", F.transform("_rates", line)).drop("_rates", "_unrated")
    add = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)
    stated = F.filter("segs", lambda s: s["label"].rlike(TOTAL_ONLY) & ~s["label"].rlike(NOT_TOTAL))
    based = F.filter("tax_lines", lambda x: x["base"].isNotNull())
    outside = F.filter("_based", lambda x: ~F.coalesce(x["mode"] == "内税", F.lit(False)))
    known = known.withColumns({"total": F.array_max(stated["value"]), "_based": based})
    known = known.withColumns({"_inside": add(F.col("_based")["base"]), "_more": add(F.transform(outside, lambda x: F.coalesce(x["tax"], F.lit(0).cast("bigint"))))})
    near = lambda x: F.abs(x - F.col("total")) <= F.size("_based")
    fits = near(F.col("_inside")) | near(F.col("_inside") + F.col("_more"))
    return known.withColumn("total_ok", F.when(F.col("total").isNotNull() & (F.size("_based") > 0), fits)).drop("_based", "_inside", "_more")


# Facts

SOME_TAX = f"exists(l.segs, s -> s.label RLIKE '{TAX_LABEL}')"
#: Facts of a line l, by SQL conditions over its n and segs; a document has a fact if one of its lines has it.
ROW_FACTS = {
    "firm_addressed": "contains(l.n, '御中')", "bill": f"l.n RLIKE '{fixed.BILL_TITLE}'", "receipt": f"l.n RLIKE '{RECEIPT}'", "retailer": rf"l.n RLIKE r'{RETAILER}' AND NOT l.n RLIKE '{RECIPIENT}'", "receipt_title": f"l.n RLIKE '{RECEIPT_TITLE}'",
    "issuer": rf"l.n RLIKE r'{ISSUER}' AND NOT l.n RLIKE '{RECIPIENT}'", "recipient": f"l.n RLIKE '{RECIPIENT}'", "content": rf"l.n RLIKE '{CONTENT}' AND NOT l.n RLIKE r'{TAX_WORD}'",
    "priced": rf"exists(l.segs, s -> s.marked) AND NOT l.n RLIKE r'{TAX_WORD}' AND NOT l.n RLIKE '{TOTAL_WORD}'", "eight": r"l.n RLIKE r'8\s?%'",
    "reduced": r"contains(l.n, '軽減') OR l.n RLIKE r'8\s?%' AND l.n RLIKE '軽減|※|[*]|★|☆|#'", "starred": "l.n RLIKE '^[*]|[※★☆]' AND exists(l.segs, s -> s.marked)",
    "total_row": rf"(l.n RLIKE '{TOTAL_ROW}' OR l.n RLIKE r'{LEADING_AMOUNT}') AND NOT l.n RLIKE '小計|対象' AND size(l.segs) > 0",
    "taxed": SOME_TAX, "tax_word": rf"l.n RLIKE r'{TAX_WORD}'", "rated": f"exists(l.segs, s -> s.rate IS NOT NULL AND NOT s.label RLIKE '{TAX_LABEL}')", "rate_row": rf"l.n RLIKE r'{RATE_ANYWHERE}' AND (NOT l.n RLIKE '{RATE_NOTE}' OR size(l.segs) > 0)",
}
#: Facts whose rows are shown as evidence.
SHOWN = ("issuer", "recipient", "content", "priced", "total_row", "taxed", "tax_word", "rated", "rate_row")


def with_facts(found: DataFrame, today) -> DataFrame:
    """`found` (digits, lines) with ROW_FACTS, the rows that show them (_issuer and so on: three at most), its dates (structs of text, parsed) and its rows (texts)."""
    tail = F.right("digits", F.lit(8))
    held = F.transform("lines", lambda l: F.contains(F.regexp_replace(l["n"], "[^0-9]", ""), tail))  # noqa: E741
    home = F.greatest(F.coalesce(F.array_position(held, F.lit(True)), F.lit(0)) - 1, F.lit(0))

    def shown(k: str) -> Column:
        # Bound, as the engine would look for the number's line anew for each line.
        return text.bound(home, lambda at: nearest(k, at)) if k == "issuer" else nearest(k, F.lit(0))

    def nearest(k: str, at: Column) -> Column:
        listed = F.expr(f"filter(transform(lines, (l, i) -> struct(l.n AS n, i AS at, {ROW_FACTS[k]} AS told)), x -> x.told)")
        order = lambda x: F.struct(F.abs(x["at"] - at).alias("rank"), x["at"].alias("place"), F.left(x["n"], F.lit(40)).alias("n"))
        return F.slice(F.array_sort(F.transform(listed, order))["n"], 1, 3)

    dated = F.transform("lines", lambda l: F.struct(F.left(F.regexp_extract(l["n"], text.DATE, 0), F.lit(30)).alias("text"), text.parse_date(l["n"], F.lit(today).cast("date")).alias("d")))  # noqa: E741
    known = found.withColumns({f"_{k}": shown(k) for k in SHOWN} | {"dates": F.filter(dated, lambda x: x["d"].isNotNull()), "rows": F.when(F.size("lines") > 0, F.col("lines")["n"])})
    return known.withColumns({k: F.size(f"_{k}") > 0 if k in SHOWN else F.expr(f"exists(lines, l -> coalesce({c}, false))") for k, c in ROW_FACTS.items()})


# Rules

_EXEMPT = "(領収書の表題から簡易インボイスと推定。小売・飲食・タクシー等以外の事業者の書類なら必要です)"
#: field, condition over a document's facts, status, message ({name}: a fact), evidence (names of facts; the first that shows anything). Statuses and messages.
RULES = (
    ("regno", "digits IS NULL", "ng", "登録番号を確認できません", "number"),
    ("regno", "corrected", "warn", "読み取った番号を1桁補正した推定値です。原本の番号と照合してください", "number"),
    ("regno", "weak", "warn", "番号は読めましたが「T」が確認できません", "number"),
    ("regno", "true", "ok", "検算OKの登録番号があります", "number"),
    ("issuer", "issuer", "ok", "会社名・店名らしき記載があります", "issuer"),
    ("issuer", "true", "warn", "会社名・店名を自動で特定できません(ロゴ等の場合は目視で確認)", ""),
    ("date", "size(dates) = 0", "ng", "日付を確認できません", ""),
    ("date", "size(good) = 0 AND exists(dates, x -> NOT x.d.valid)", "warn", "日付らしき記載がありますが、実在しない日付です(誤読の可能性)", "any_date"),
    ("date", "size(good) = 0", "warn", "未来の日付になっています(誤読の可能性)", "any_date"),
    ("date", "forall(good, x -> x.d.before)", "warn", "インボイス制度の開始(2023年10月1日)より前の日付です", "good_date"),
    ("date", "true", "ok", "日付があります({first_date})", "good_date"),
    ("content", "NOT (content OR priced)", "warn", "品名・内容らしき記載を確認できません", ""),
    ("content", "eight AND NOT light", "warn", "8%の記載がありますが、軽減税率対象である旨(※印など)を確認できません", "content priced"),
    ("content", "eight", "ok", "取引内容と軽減税率対象の旨があります", "content priced"),
    ("content", "true", "ok", "取引内容らしき記載があります", "content priced"),
    ("rateTotal", "n_rates = 0 AND simplified AND taxed AND total_row", "ok", "税率の記載はありませんが、合計額と税額の記載があります(簡易インボイスは税額の表示でも可)", "total_row"),
    ("rateTotal", "n_rates = 0 AND simplified", "warn", "適用税率(10%・8%)を確認できません", "rate_row"),
    ("rateTotal", "n_rates = 0", "ng", "適用税率(10%・8%)を確認できません", "rate_row"),
    ("rateTotal", "no_base = ''", "ok", "税率ごとの対象額があります", "rated rate_row"),
    ("rateTotal", "n_rates = 1 AND total_row", "ok", "{only_rate}%のみの書類で、合計額の記載があります", "total_row"),
    ("rateTotal", "true", "warn", "{no_base}の対象額(金額)を特定できません", "rate_row"),
    ("tax", "n_rates > 0 AND no_tax = ''", "ok", "税率ごとの消費税額があります", "taxed tax_word"),
    ("tax", "n_rates = 0 AND taxed", "ok", "消費税額の記載があります", "taxed tax_word"),
    ("tax", "simplified AND n_rates > 0 AND unsure", "warn", "簡易インボイスは適用税率か税額のどちらかでよいため省略可" + _EXEMPT, "taxed tax_word"),
    ("tax", "simplified AND n_rates > 0", "na", "簡易インボイスは適用税率か税額のどちらかでよいため省略可", "taxed tax_word"),
    ("tax", "n_no_tax < n_rates", "warn", "{no_tax}の消費税額を確認できません(税率ごとに必要です)", "taxed tax_word"),
    ("tax", "true", "ng", "消費税額(金額)を確認できません", "taxed tax_word"),
    ("recipient", "recipient", "ok", "宛名があります", "recipient"),
    ("recipient", "simplified AND unsure", "warn", "簡易インボイスなら省略可" + _EXEMPT, ""),
    ("recipient", "simplified", "na", "簡易インボイスなら省略可", ""),
    ("recipient", "true", "ng", "宛名(〇〇御中・様)を確認できません", ""),
    ("consistency", "n_checked = 0", None, "", ""),
    ("consistency", "all_fit", "ok", "対象額と税額が端数処理の範囲で一致しています", "checks"),
    ("consistency", "true", "warn", "対象額と税額が一致しないようです(OCRの誤読の可能性もあります)", "checks"),
    ("total", "total_ok IS NULL", None, "", ""),
    ("total", "total_ok", "ok", "税率ごとの金額の合計が総額と一致しています", "sums"),
    ("total", "true", "warn", "税率ごとの金額の合計が総額と一致しないようです(誤読の可能性もあります)", "sums"),
)
FIELDS = tuple(dict.fromkeys(r[0] for r in RULES))
#: Fields that do not count for a document's summary.
CHECKS = ("consistency", "total")
#: Evidence rows of a field at most.
MOST = {"issuer": 2, "date": 2, "content": 2, "recipient": 2}


def _message(template: str) -> Column:
    pieces = []
    for k, piece in enumerate(template.replace("}", "{").split("{")):
        pieces.append(F.coalesce(F.col(piece).cast("string"), F.lit("")) if k % 2 else F.lit(piece))
    return F.concat(*pieces)


def _judged(field: str) -> Column:
    """struct<id, status, message, evidence> by the field's rules; status null where the field does not apply."""
    out = F.lit(None)
    none = F.expr("cast(array() AS array<string>)")
    for _, condition, status, message, evidence in [r for r in RULES if r[0] == field][::-1]:
        shown = none
        for name in evidence.split()[::-1]:
            shown = F.when(F.size(f"_{name}") > 0, F.col(f"_{name}")).otherwise(shown)
        shown = F.slice(shown, 1, MOST[field]) if field in MOST else shown
        verdict = F.struct(F.lit(field).alias("id"), F.lit(status).cast("string").alias("status"), _message(message).alias("message"), shown.alias("evidence"))
        out = verdict if condition == "true" else F.when(F.expr(condition), verdict).otherwise(out)
    return out


def yen(x: Column) -> Column:
    return F.concat(F.lit("¥"), F.format_number(x, 0))


def check(found: DataFrame, today) -> DataFrame:
    """`found` (documents with lines, segs, tax_lines, total and total_ok) with items (structs of id, status, message, evidence), statuses (map), simplified, kind_source, summary, summary_text and rows (texts).

    documents: doc, digits, weak, corrected, kind (auto, normal or simplified; null: auto); one without lines has no facts.
    """
    found = with_facts(found.withColumns({"weak": F.coalesce("weak", F.lit(False)), "corrected": F.coalesce("corrected", F.lit(False)), "kind": F.coalesce("kind", F.lit("auto"))}), today)
    percent = lambda kept: F.array_join(F.transform(F.filter("tax_lines", kept), lambda x: F.concat(x["rate"].cast("string"), F.lit("%"))), "・")
    normal = F.col("firm_addressed") | F.col("bill")
    strong = ~normal & (F.col("receipt") | F.col("retailer"))
    vague = ~normal & ~strong & F.col("receipt_title")
    auto = F.col("kind") == "auto"
    found = found.withColumns({
        "simplified": (F.col("kind") == "simplified") | (auto & (strong | vague)), "unsure": auto & vague, "good": F.filter("dates", lambda x: x["d"]["valid"] & ~x["d"]["future"]),
        "light": F.col("reduced") | (F.col("eight") & F.col("starred")), "n_rates": F.size("tax_lines"), "no_base": percent(lambda x: x["base"].isNull()), "no_tax": percent(lambda x: x["tax"].isNull()),
        "n_no_tax": F.size(F.filter("tax_lines", lambda x: x["tax"].isNull())), "only_rate": F.get("tax_lines", F.lit(0))["rate"], "_checked": F.filter("tax_lines", lambda x: x["ok"].isNotNull()),
        "_number": F.when(F.col("digits").isNotNull(), F.array(F.concat(F.lit("T"), "digits"))).otherwise(F.expr("cast(array() AS array<string>)")),
    })
    day = F.get("good", F.lit(0))["d"]
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    shown = lambda x: F.concat(x["rate"].cast("string"), F.lit("%: 対象 "), yen(x["base"]), F.lit(" → 税 "), yen(x["tax"]), F.when(x["ok"], F.concat(F.lit(" ("), x["mode"], F.lit("で一致)"))).otherwise(" (不一致?)"))
    sums = F.transform(F.filter("tax_lines", lambda x: x["base"].isNotNull()), lambda x: F.concat(x["rate"].cast("string"), F.lit("%対象 "), yen(x["base"])))
    found = found.withColumns({
        "n_checked": F.size("_checked"), "all_fit": F.forall("_checked", lambda x: x["ok"]), "first_date": F.concat(day["year"].cast("string"), F.lit("/"), two(day["month"]), F.lit("/"), two(day["day"])),
        "_any_date": F.col("dates.text"), "_good_date": F.col("good.text"), "_checks": F.transform("_checked", shown), "_sums": F.concat(F.array(F.concat(F.lit("合計 "), yen(F.col("total")))), sums),
    })
    found = found.withColumn("items", F.filter(F.array(*(_judged(f) for f in FIELDS)), lambda x: x["status"].isNotNull()))
    core = F.filter("items", lambda x: ~x["id"].isin(*CHECKS))
    has = lambda s: F.exists(core, lambda x: x["status"] == s)
    summary = F.when(has("ng"), "ng").when(has("warn"), "warn").otherwise("ok")
    # What a summary says.
    said = F.when(summary == "ok", "記載事項がそろっている可能性が高いです").when(summary == "warn", "一部、自動では確認できない項目があります").otherwise("確認できない記載事項があります")
    source = F.when(~auto, "manual").when(F.col("unsure"), "auto-weak").otherwise("auto")
    statuses = F.map_from_entries(F.transform("items", lambda x: F.struct(x["id"], x["status"])))
    return found.withColumns({"statuses": statuses, "kind_source": source, "summary": summary, "summary_text": said})


REPORT = ("digits", "items", "statuses", "simplified", "kind_source", "summary", "summary_text", "tax_lines", "total", "total_ok", "rows")


def analyse(rows: DataFrame, documents: DataFrame, today, from_table: DataFrame | None = None) -> DataFrame:
    """A row per document: amount, source, items_sum, doc_total, tax_total, match and REPORT's columns (see `check`).

    rows: doc, row, text. documents: doc, digits, weak, corrected, kind. from_table: doc, row, amount, tabled (whether the document has a table).

    A document's rows are gathered into one by a single shuffle; all that follows is columns of that row. The one join, with `documents`, is by sorting:
    both sides grow with the documents, and sizes estimated from files of keys would have one of them sent to the driver whole.
    """
    if from_table is not None:
        tabled = from_table.groupBy("doc").agg(F.bool_or("tabled").alias("tabled"))
        rows = rows.select("doc", "row", "text").join(from_table.select("doc", "row", "amount").hint("merge"), ["doc", "row"], "left").join(tabled.hint("merge"), "doc", "left")
    lines = gathered(rows)
    none = F.expr(f"cast(array() AS {lines.schema['lines'].dataType.simpleString()})")
    found = documents.select("doc", "digits", "weak", "corrected", "kind").join(lines.hint("merge"), "doc", "left").withColumns({"lines": F.coalesce("lines", none), "tabled": F.coalesce("tabled", F.lit(False))})
    report = amounts.summed(with_items(check(with_rates(scanned(found)), today)), F.col("its"))
    value = amounts.document_amount(F.col("doc_total"), F.col("total"), F.col("items_sum"), F.col("n_items"))
    return report.select("doc", value["value"].alias("amount"), value["source"].alias("source"), "items_sum", "doc_total", "tax_total", "match", *REPORT)


def consistency(rows: DataFrame) -> DataFrame:
    """doc, ok, message and lines of documents where a rate's base and tax can be compared: rows of doc, row, text."""
    nobody = {c: F.lit(None).cast(t) for c, t in (("digits", "string"), ("weak", "boolean"), ("corrected", "boolean"), ("kind", "string"))}
    found = check(with_rates(marked(rows).withColumns(nobody)), "2000-01-01")
    item = F.get(F.filter("items", lambda x: x["id"] == "consistency"), F.lit(0))
    return found.select("doc", item.alias("i")).where("i IS NOT NULL").select("doc", (F.col("i.status") == "ok").alias("ok"), F.col("i.message").alias("message"), F.col("i.evidence").alias("lines"))
