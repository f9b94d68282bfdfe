"""Totals, inferred totals, tax checks and roll-ups over line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound


def inferred_totals(lines: DataFrame, key: str = "doc", seq: str = "seq") -> DataFrame:
    """`kind` with the last item turned into a total where no total is written and the sums say so.

    `lines` has kind, amount, subject (a taxable subtotal) and bare (a label of at most one character).
    Only the last item can change, so running sums over the rows before it are exact.
    """
    before = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    item = F.col("kind") == "item"
    zero = F.lit(0).cast("bigint")
    run = F.coalesce(F.sum(F.when(item, F.col("amount"))).over(before), zero)
    tax = F.coalesce(F.sum(F.when(F.col("kind") == "tax", F.col("amount"))).over(before), zero)
    sub = F.coalesce(F.sum(F.when((F.col("kind") == "other") & F.col("subject"), F.col("amount"))).over(before), zero)
    count = F.coalesce(F.count(F.when(item, 1)).over(before), zero)
    last = F.max(F.when(item, F.col(seq))).over(whole)
    written = F.max((F.col("kind") == "total").cast("int")).over(whole) == 1
    amount = F.col("amount")
    fits = ((tax > 0) & (F.abs(amount - run - tax) <= 1)) | ((sub > 0) & (tax > 0) & (F.abs(amount - sub - tax) <= 1)) | ((amount == run) & F.col("bare"))
    turned = item & ~written & (F.col(seq) == last) & (count >= 2) & fits
    return lines.withColumn("inferred", turned).withColumn("kind", F.when(turned, "total").otherwise(F.col("kind")))


def row_marks(label: Column) -> dict[str, Column]:
    """What a normalised row's words say besides its kind: a taxable subtotal, one that includes tax, money handed over."""
    return {"subject": label.contains("対象"), "inclusive": label.rlike(r"税込|内税|\("), "deposit": label.rlike("お預|預り")}


def summary(lines: DataFrame, key: str = "doc") -> DataFrame:
    """items_sum, tax_total, doc_total (written, else paid, else taxable with tax) and match of each document.

    `lines` has kind, amount and the marks of `row_marks`: money handed over is no payment, and only
    subtotals that include tax make a total.
    """
    of = lambda kind: F.col("kind") == kind
    sums = lines.groupBy(key).agg(
        F.coalesce(F.sum(F.when(of("item"), F.col("amount"))), F.lit(0)).alias("items_sum"), F.count(F.when(of("item"), 1)).alias("items"),
        F.coalesce(F.sum(F.when(of("tax"), F.col("amount"))), F.lit(0)).alias("tax_total"), F.max(F.when(of("total"), F.col("amount"))).alias("written"),
        F.max(F.when(of("payment") & ~F.col("deposit"), F.col("amount"))).alias("paid"), F.coalesce(F.sum(F.when(of("other") & F.col("subject") & F.col("inclusive"), F.col("amount"))), F.lit(0)).alias("taxable"),
    )
    total = F.coalesce("written", "paid", F.when(F.col("taxable") > 0, F.col("taxable")))
    return sums.select(key, "items_sum", "tax_total", total.alias("doc_total"), _match(total, F.col("items")).alias("match"), "items")


def _match(total: Column, items: Column) -> Column:
    return (
        F.when(total.isNull() | (items == 0), F.lit(None)).when(F.col("items_sum") == total, "equal")
        .when((F.col("tax_total") > 0) & (F.abs(F.col("items_sum") + F.col("tax_total") - total) <= 1), "equalWithTax").otherwise("diff")
    )


def _sum_of(lines: Column, kept) -> Column:
    return F.aggregate(F.filter(lines, kept)["amount"], F.lit(0).cast("bigint"), lambda a, x: a + x)


def with_inferred_total(lines: Column) -> Column:
    """An array of a document's lines in order (structs with kind, amount, subject and bare) with inferred, as `inferred_totals` does it for a frame."""
    item = lambda x: x["kind"] == "item"

    def judged(last: Column) -> Column:
        x, before = F.get(lines, last), F.slice(lines, 1, F.greatest(last, F.lit(0)))
        run, count = _sum_of(before, item), F.size(F.filter(before, item))
        tax, sub = _sum_of(before, lambda y: y["kind"] == "tax"), _sum_of(before, lambda y: (y["kind"] == "other") & y["subject"])
        amount = x["amount"]

        def fits(s: Column) -> Column:
            taxed = (s["tax"] > 0) & ((F.abs(amount - s["run"] - s["tax"]) <= 1) | ((s["sub"] > 0) & (F.abs(amount - s["sub"] - s["tax"]) <= 1)))
            return (s["count"] >= 2) & (taxed | ((amount == s["run"]) & x["bare"]))

        sums = F.struct(run.alias("run"), tax.alias("tax"), sub.alias("sub"), count.alias("count"))
        return F.when((last >= 0) & bound(sums, fits), last).otherwise(-1)

    last = F.aggregate(F.transform(lines, lambda x, i: F.when(item(x), i).otherwise(-1)), F.lit(-1), lambda a, i: F.greatest(a, i))
    turned = F.when(F.exists(lines, lambda x: x["kind"] == "total"), F.lit(-1)).otherwise(bound(last, judged))
    return bound(turned, lambda at: F.transform(lines, lambda x, i: x.withField("inferred", i == at).withField("kind", F.when(i == at, "total").otherwise(x["kind"]))))


def summed(found: DataFrame, lines: Column) -> DataFrame:
    """`found` with items_sum, n_items, tax_total, doc_total and match of an array of lines, as `summary` gives them of a frame."""
    of = lambda kind, more=lambda x: F.lit(True): lambda x: (x["kind"] == kind) & more(x)
    most = lambda kept: F.array_max(F.filter(lines, kept)["amount"])
    sums = found.withColumns({
        "items_sum": _sum_of(lines, of("item")), "n_items": F.size(F.filter(lines, of("item"))), "tax_total": _sum_of(lines, of("tax")), "_taxable": _sum_of(lines, of("other", lambda x: x["subject"] & x["inclusive"])),
        "_stated": F.coalesce(most(of("total")), most(of("payment", lambda x: ~x["deposit"]))),
    })
    sums = sums.withColumn("doc_total", F.coalesce("_stated", F.when(F.col("_taxable") > 0, F.col("_taxable")))).drop("_stated", "_taxable")
    return sums.withColumn("match", _match(F.col("doc_total"), F.col("n_items")))


def document_amount(doc_total: Column, breakdown_total: Column, items_sum: Column, items: Column) -> Column:
    """struct<value, source>: the written total, else that of the tax breakdown, else the items' sum."""
    return F.struct(F.coalesce(doc_total, breakdown_total, F.when(items > 0, items_sum)).alias("value"), F.when(doc_total.isNotNull() | breakdown_total.isNotNull(), "total").when(items > 0, "items").alias("source"))


def tax_mode(base: Column, tax: Column, rate: Column, forced: Column) -> Column:
    """struct<mode, ok> of a rate's base and tax; a difference of one yen or more fails."""
    base, tax = base.cast("double"), tax.cast("double")
    inner = F.abs(tax - base * rate / (100 + rate)) < 1
    outer = F.abs(tax - base * rate / 100) < 1
    found = F.when(forced == "内税", F.when(inner, "内税")).when(forced == "外税", F.when(outer, "外税")).otherwise(F.when(inner, "内税").when(outer, "外税"))
    both = base.isNotNull() & tax.isNotNull()
    return F.struct(F.when(both, F.coalesce(found, forced)).otherwise(forced).alias("mode"), F.when(both, found.isNotNull()).alias("ok"))


def worst_status(status: Column) -> Column:
    """Aggregate: ng if any is, else warn if any is, else ok."""
    worst = F.max(F.when(status == "ng", 2).when(status == "warn", 1).otherwise(0))
    return F.when(worst == 2, "ng").when(worst == 1, "warn").otherwise("ok")


def exceptions(entries: DataFrame) -> DataFrame:
    """Documents without a registration number or without an amount."""
    return entries.where(F.col("digits").isNull() | F.col("amount").isNull())


def expected_difference(total: Column, typed: Column) -> Column:
    """How far a total is from the amount that was typed as expected, signs other than digits left out; null without digits typed."""
    return total - F.when(F.trim(typed) != "", F.coalesce(F.regexp_replace(typed, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint")))


def selected_sum(kind: Column, amount: Column, selected: Column) -> Column:
    """Aggregate: the sum of the items that are ticked."""
    return F.coalesce(F.sum(F.when((kind == "item") & selected, amount)), F.lit(0).cast("bigint"))


def settlement(entries: DataFrame, *keys: str) -> DataFrame:
    """Sums and counts over settled documents; an amount that is missing counts as nothing."""
    amount = F.coalesce("amount", F.lit(0).cast("bigint"))
    return entries.groupBy(*keys).agg(
        F.count("*").alias("documents"), F.sum(amount).alias("total"), F.coalesce(F.sum(F.when(F.col("digits").isNotNull(), amount)), F.lit(0)).alias("registered"),
        F.count_if(F.col("digits").isNull()).alias("no_number"), F.count_if(F.col("amount").isNull()).alias("no_amount"),
    )
