"""Registration numbers: check digits, corrections, display and manual entry, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import half_width

# Digits that are read for one another, by the digit that was read.
CONFUSABLE_DIGITS = {
    "0": "8693", "1": "74", "2": "73", "3": "8592", "4": "19", "5": "638", "6": "580", "7": "12", "8": "36095", "9": "8043",
}


def _sum(digits: Column, odd: int, even: int) -> Column:
    """Sum of the first twelve digits, with a weight for odd and one for even places from 1."""
    total = F.lit(0)
    for i in range(1, 13):
        total = total + F.substring(digits, i, 1).try_cast("int") * (odd if i % 2 else even)
    return total


def check_digit(base: Column) -> Column:
    """The digit (1 to 9) that goes before a 12-digit base; null for anything else."""
    # Counted from the right, odd places weigh 1 and even ones 2.
    return F.when(base.rlike("^[0-9]{12}$"), 9 - _sum(base, 2, 1) % 9)


def is_valid(digits: Column) -> Column:
    """Whether 13 digits carry their check digit."""
    return F.coalesce(check_digit(F.substring(digits, 2, 12)) == F.substring(digits, 1, 1).try_cast("int"), F.lit(False)) & F.coalesce(digits.rlike("^[0-9]{13}$"), F.lit(False))


def is_ean13(digits: Column) -> Column:
    good = (10 - _sum(digits, 1, 3) % 10) % 10 == F.substring(digits, 13, 1).cast("int")
    return F.when(digits.rlike("^[0-9]{13}$"), good).otherwise(F.lit(False))


def display(digits: Column) -> Column:
    """T1 2345 6789 0123; anything that isn't 13 digits only gets the T."""
    parts = F.concat_ws(" ", F.substring(digits, 1, 1), F.substring(digits, 2, 4), F.substring(digits, 6, 4), F.substring(digits, 10, 4))
    return F.concat(F.lit("T"), F.when(digits.rlike("^[0-9]{13}$"), parts).otherwise(digits))


def manual(entry: Column) -> Column:
    """struct<digits, valid, expected, message> of a number typed by hand."""
    s = F.regexp_replace(F.regexp_replace(half_width(entry), r"[\s　 \-.:：]", ""), "^[Tt]", "")
    expected = check_digit(F.substring(s, 2, 12))
    full = s.rlike("^[0-9]{13}$")
    fits = full & (expected == F.substring(s, 1, 1).try_cast("int"))
    message = (
        F.when(s == "", "").when(~s.rlike("^[0-9]+$"), "数字以外の文字が含まれています")
        .when(F.length(s) != 13, F.concat(F.lit("13桁必要です(現在 "), F.length(s).cast("string"), F.lit(" 桁)")))
        .when(fits, "チェックディジット一致").otherwise(F.concat(F.lit("チェックディジット不一致(先頭は "), expected.cast("string"), F.lit(" のはず)")))
    )
    return F.struct(F.when(full, s).alias("digits"), F.coalesce(fits, F.lit(False)).alias("valid"), F.when(full, expected).alias("expected"), message.alias("message"))


def corrections(numbers: DataFrame, digits: str = "digits", positions: str | None = None) -> DataFrame:
    """Rows of `numbers` with each one-digit change (position from 0, was, now, corrected) that makes an invalid number valid.

    positions: a column with the places of doubtful digits; where it names any, only these are changed.
    """
    d = F.col(digits)
    # A number is valid if its first digit is not 0 and the weighted sum of all is a multiple of 9; a change moves the sum by weight * (now - was).
    weight = [1 if i == 0 or i % 2 == 0 else 2 for i in range(13)]
    rest = F.lit(0)
    for i, w in enumerate(weight):
        rest = rest + w * (F.ascii(F.substring(d, i + 1, 1)) - 48)
    known = numbers.withColumn("_rest", F.when(d.rlike("^[0-9]{13}$"), (rest % 9).cast("int")))
    # Wrong numbers are told apart within the generator: a filter of its own would be pushed down and repeat how the digits came about thirteen times.
    places = F.when((F.col("_rest") != 0) | d.startswith("0"), F.split(d, ""))
    # By weight, digit and rest: the digits that make the sum fit.
    fits = [[[now for now in CONFUSABLE_DIGITS[str(was)] if (r + w * (int(now) - was)) % 9 == 0] for r in range(9)] for w in (1, 2) for was in range(10)]
    table = F.array(*(F.array(*(F.lit(x) for x in now)) if now else F.expr("cast(array() AS array<string>)") for row in fits for now in row))
    heavy = (F.col("position") > 0) & (F.col("position") % 2 == 1)
    each = known.select("*", F.posexplode(F.when(F.col("_rest").isNotNull(), places)).alias("position", "was")).where("position < 13")
    if positions:
        each = each.where(F.coalesce(F.size(positions), F.lit(0)).isin(0, -1) | F.array_contains(positions, F.col("position")))
    place = (F.when(heavy, 10).otherwise(0) + F.col("was").cast("int")) * 9 + F.col("_rest")
    found = each.select("*", F.explode(F.get(table, place)).alias("now")).drop("_rest")
    corrected = F.concat(d.substr(F.lit(1), F.col("position")), "now", d.substr(F.col("position") + 2, F.lit(13)))
    return found.withColumn("corrected", corrected).where(~F.startswith("corrected", F.lit("0")))
