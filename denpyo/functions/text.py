"""Text normalisation and classification, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HYPHENS = "‐‑‒–—―−ーｰ－﹣"


_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WIDE, _HALF = "".join(chr(ord(c) + 0xFEE0) for c in _LETTERS) + HYPHENS + "　", _LETTERS + "-" * len(HYPHENS) + " "


def half_width(s: Column) -> Column:
    """Full-width letters and digits, hyphens (the long vowel mark too) and the wide space to their ASCII forms."""
    return F.translate(s, _WIDE, _HALF)


# Simplified characters and the Japanese forms they stand for, place by place.
SIMPLIFIED = "对费领收识侧计额单价发书业务货买卖贩销数总钱现应预还种类证请记录册盖东会员银达测认页积实际时间电话场车乐气饮头"
JAPANESE = "対費領収識側計額単価発書業務貨買売販販数総銭現応預還種類証請記録冊蓋東会員銀込測認頁積実際時間電話場車楽気飲頭"


# Signs and the ASCII forms they count as, place by place.
SIGNS, PLAIN_SIGNS = "|｜（）：￥％", "  ():¥%"
#: Blanks of any script; the engine's own \\s knows those of ASCII only.
BLANK = r"[ \t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
# Fixed patterns of one spelling, in order: no spaces next to Japanese words, a misread per cent, letters read for 0 and 1, single spaces. \s: any BLANK.
SPELLING = (
    (r"(?<=[^\x00-\x7f])\s+(?=[^\x00-\x7f]|[0-9%])|(?<=[0-9%])\s+(?=[^\x00-\x7f])|(?<=[0-9])\s+(?=%)", ""),
    (r"(?<![0-9,.])(10|8)\s?(?:96|%6|0/0)(?=\s?(?:対象|小計|消費税|税込|税抜|\)|軽減))", "$1%"),
    (r"(?<=[0-9])[Oo](?=[0-9]|年|月|日|%)|(?<=[年月/.\-])[Oo](?=[0-9])", "0"),
    (r"(?<=[0-9])[lI|](?=[0-9]|年|月|日|%)|(?<=[年月/.\-])[lI|](?=[0-9])", "1"),
    (r"\s{2,}", " "),
    (r"^\s+|\s+$", ""),
)


def blanks(pattern: str) -> str:
    """The pattern with BLANK for \\s."""
    return pattern.replace(r"\s", BLANK)


def stripped(s: Column) -> Column:
    """Without blanks on either side."""
    return F.regexp_replace(s, blanks(r"^\s+|\s+$"), "")


def plain_signs(s: Column) -> Column:
    """Half width, Japanese forms and plain signs, by one table (no form of one step is changed by another)."""
    return F.translate(s, _WIDE + SIMPLIFIED + SIGNS, _HALF + JAPANESE + PLAIN_SIGNS)


#: What a text has if any pattern of SPELLING changes it.
MISSPELT = rf"{BLANK}|[OolI|]|96|%6|0/0"


def spelled(t: Column) -> Column:
    def put_right(n: Column) -> Column:
        for pattern, to in SPELLING:
            n = F.regexp_replace(n, blanks(pattern), to)
        return n

    return bound(t, lambda n: F.when(n.rlike(MISSPELT), put_right(n)).otherwise(n))


def normalize_row(s: Column) -> Column:
    """A recognised row of text in one spelling: half width, Japanese forms, no spaces within words, digits where digits belong."""
    return spelled(plain_signs(s))


def bound(x: Column, use) -> Column:
    """use(x) with x evaluated once, however often `use` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


# Fixed patterns of row kinds.
TAX = "(消費税|税額|内税|外税|税等)"
OTHER = r"(?i)(釣|残高|ポイント|電話|TEL|FAX|〒|No\.|番号|口座|会員)"
TOTAL = "(合計|総額|総計|請求金額|ご請求|御請求|お支払|支払金額|領収金額|ご利用額|ご利用金額|利用金額合計|税込金額|料金合計|お買上)"
LEADING_TOTAL = r"^(金額|運賃|料金|領収額|ご料金)\s?[:：]?\s?[¥0-9]"
SUBTOTAL = "(小計|対象|内訳)"
PAYMENT = r"(?i)(支払|お預|預り|現金|クレジット|カード|nanaco|Suica|PASMO|ICOCA|PayPay|楽天|電子マネー|WAON|Edy|QUICPay|d払い|au\s?PAY)"
DISCOUNT = r"(?i)(値引|割引|値割|返品|返金|クーポン|ディスカウント|OFF\b)"


def classify(n: Column) -> Column:
    """tax, other, total, payment or item, from the words of a normalised row."""
    total = (n.rlike(TOTAL) | n.rlike(LEADING_TOTAL)) & ~n.rlike(SUBTOTAL) & ~n.rlike("お預|預り")
    return F.when(n.rlike(TAX), "tax").when(n.rlike(OTHER), "other").when(total, "total").when(n.rlike(PAYMENT), "payment").when(n.rlike(SUBTOTAL), "other").otherwise("item")


def signed_amount(n: Column, kind: Column, amount: Column) -> Column:
    """Discounts and returns among items count negative, even without a sign."""
    return F.when((kind == "item") & (amount > 0) & n.rlike(DISCOUNT), -amount).otherwise(amount)


def numeric_value(s: Column) -> Column:
    """The amount of a table cell that is nothing but an amount, as bigint; else null."""
    form = r"^[-△▲]?¥?-?([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,8})(?:円|-)?$"

    def amount(t: Column) -> Column:
        value = F.replace(F.regexp_extract(t, form, 1), F.lit(","), F.lit("")).try_cast("bigint")
        return F.when(t.rlike(form), F.when(t.rlike("^[^0-9]*[-△▲]"), -value).otherwise(value))

    # Only letters that may stand for digits make the spelling matter to an amount.
    whole = bound(plain_signs(s), lambda t: F.regexp_replace(F.when(t.rlike("[OolI]"), spelled(t)).otherwise(t), BLANK, ""))
    return bound(whole, amount)


DATE = r"((?:19|20)[0-9]{2}|令和\s?[0-9]{1,2}|R\s?[0-9]{1,2}|令和元)\s?[年/.\-]\s?([0-9]{1,2})\s?[月/.\-]\s?([0-9]{1,2})\s?日?"


def parse_date(s: Column, today: Column) -> Column:
    """struct<year, month, day, valid, before, future> of the first date in a row; null without one."""


    def parts(m: Column) -> Column:
        """Year, month and day of the text of a date; its numbers, from the left, are these three."""
        n = F.regexp_extract_all(m, F.lit("[0-9]+|元"), F.lit(0))
        year = F.when(F.get(n, F.lit(0)) == "元", 2019).when(F.length(F.get(n, F.lit(0))) == 4, F.get(n, F.lit(0)).try_cast("int")).otherwise(2018 + F.get(n, F.lit(0)).try_cast("int"))
        return F.struct(year.alias("year"), F.get(n, F.lit(1)).try_cast("int").alias("month"), F.get(n, F.lit(2)).try_cast("int").alias("day"))

    def judged(p: Column) -> Column:
        name = F.concat_ws("-", F.lpad(p["year"].cast("string"), 4, "0"), F.lpad(p["month"].cast("string"), 2, "0"), F.lpad(p["day"].cast("string"), 2, "0"))
        return F.struct(p["year"].alias("year"), p["month"].alias("month"), p["day"].alias("day"), F.try_to_date(name, "yyyy-MM-dd").alias("date"))

    def told(p: Column) -> Column:
        before, future = (F.coalesce(x, F.lit(False)) for x in (p["date"] < F.lit("2023-10-01").cast("date"), p["date"] > today))
        return F.struct(p["year"].alias("year"), p["month"].alias("month"), p["day"].alias("day"), p["date"].isNotNull().alias("valid"), before.alias("before"), future.alias("future"))

    return bound(F.regexp_extract(s, DATE, 0), lambda m: F.when(m != "", bound(bound(parts(m), judged), told)))
