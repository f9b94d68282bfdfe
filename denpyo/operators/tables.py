"""Rows, phrases and tables from positioned text, as plans.

Atoms are (doc, seq, text, x, y, w, h). All steps group by document, so one shuffle on it serves them all; order-dependent
steps are folds over a document's sorted atoms in the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.runs import cut_at, middle_of, runs

ATOM = ("text", "x", "y", "w", "h")
# Words of table headers.
HEADER = "品名|品目|商品名?|内容|摘要|数量|単価|金額|税率|利用日|利用年月日|入口|出口|料金|車種|日付|項目|小計"
#: What those words begin with.
HEADER_LETTER = "[" + "".join(dict.fromkeys(w[0] for w in HEADER.split("|"))) + "]"
AMOUNT_HEADER = "金額|料金|通行料|税込|合計|価格"
#: How near in heights of text the right edges of a column's figures are.
EDGE = 1.2


def _parts(atoms: DataFrame) -> DataFrame:
    """doc, lines: the rows of each document from top to bottom, each an array of atoms from left to right.

    Rows are runs of atoms, by their centres, whose centre is within 0.45 of a height of the row's upper median.
    """
    kept = atoms.where((F.col("h") > 0) & t.stripped(F.coalesce("text", F.lit(""))).cast("string").rlike("."))
    item = F.struct((F.col("y") + F.col("h") / 2).alias("centre"), F.col("seq").cast("long").alias("seq"), *(F.col(c) if c == "text" else F.col(c).cast("double").alias(c) for c in ATOM))
    listed = kept.groupBy("doc").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def joins(run: Column, a: Column) -> Column:
        centre = F.get(run, F.floor(F.size(run) / 2).cast("int"))["centre"]
        tall = F.greatest(middle_of(F.transform(run, lambda p: p["h"])), a["h"])
        return F.abs(a["centre"] - centre) < 0.45 * tall

    across = lambda row: F.array_sort(F.transform(row, lambda p: F.struct(p["x"].alias("x"), p["centre"].alias("centre"), p["seq"].alias("seq"), *(p[c].alias(c) for c in ("text", "y", "w", "h")))))
    return listed.select("doc", F.transform(runs(F.col("items"), joins), across).alias("lines"))


def _told(lines: DataFrame) -> DataFrame:
    """doc, row, text, rectangle and parts of each of the arrays of `lines`."""
    each = lines.select("doc", F.posexplode_outer("lines").alias("row", "p")).where(F.col("p").isNotNull())
    x, y = F.array_min("p.x"), F.array_min("p.y")
    right, bottom = F.array_max(F.transform("p", lambda a: a["x"] + a["w"])), F.array_max(F.transform("p", lambda a: a["y"] + a["h"]))
    parts = F.transform("p", lambda a: F.struct(*(a[c].alias(c) for c in ATOM)))
    return each.select("doc", "row", F.concat_ws(" ", "p.text").alias("text"), x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"), parts.alias("parts"))


def assemble_rows(atoms: DataFrame) -> DataFrame:
    """doc, row (from 0), text, x, y, w, h and parts of each row."""
    return _told(_parts(atoms))


def _phrases(row: Column) -> Column:
    """A row cut wherever a gap is more than twice the taller neighbour's height."""
    wide = lambda a, b: b["x"] - a["x"] - a["w"] > 2 * F.greatest(a["h"], b["h"])
    starts = F.filter(F.sequence(F.lit(1), F.size(row)), lambda i: (i == 1) | wide(F.get(row, i - 2), F.get(row, i - 1)))
    return cut_at(row, starts)


def assemble_phrases(atoms: DataFrame) -> DataFrame:
    """The same of each phrase."""
    return _told(_parts(atoms).withColumn("lines", F.flatten(F.transform("lines", _phrases))))


def _gathered(rows: DataFrame) -> DataFrame:
    """doc, rows: the rows (doc, row, parts) of each document as structs of row and parts, in order."""
    return rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("row", "parts"))).alias("rows"))


def _headed(row: Column) -> Column:
    """Whether a row has two words of table headers; its spelling is looked at only if it may have them."""
    spoken = F.concat_ws(" ", row["parts"]["text"])
    return F.when(t.plain_signs(spoken).rlike(f"(?s){HEADER_LETTER}.*{HEADER_LETTER}"), F.regexp_count(t.normalize_row(spoken), F.lit(HEADER)) >= 2).otherwise(False)


def with_columns(found: DataFrame) -> DataFrame:
    """`found` (doc, rows: structs of row and parts) with cells (structs of row, place, text, x, h, right and value: null unless an amount), tall and columns (structs of column, right, left, count, header, is_amount).

    A column is a run of amounts, by their right edges, that are less than EDGE heights right of its upper median; it needs three rows. Its header is
    the first part of the first row with two header words that overlaps it. The amounts are in the first column under an amount header, else in the last one with half as
    many rows as the fullest. All are folds over one document's cells, so nothing is joined.
    """

    def cells_of(r: Column) -> Column:
        return F.transform(r["parts"], lambda p, place: F.struct(r["row"].alias("row"), place.alias("place"), *(p[c].alias(c) for c in ("text", "x", "h")), (p["x"] + p["w"]).alias("right"), t.numeric_value(p["text"]).alias("value")))

    known = found.withColumn("cells", F.flatten(F.transform("rows", cells_of)))
    figures = F.array_sort(F.transform(F.filter("cells", lambda c: c["value"].isNotNull()), lambda c: F.struct(*(c[n].alias(n) for n in ("right", "row", "place", "x")))))
    known = known.withColumns({"tall": F.coalesce(F.nullif(middle_of(F.col("cells")["h"]), F.lit(0.0)), F.lit(10.0)), "figures": figures})
    near = lambda run, f: f["right"] - F.get(run, F.floor(F.size(run) / 2).cast("int"))["right"] < EDGE * F.col("tall")
    stacks = F.when(F.size("figures") >= 3, runs(F.col("figures"), near))
    known = known.withColumn("stacks", F.filter(stacks, lambda s: F.size(F.array_distinct(s["row"])) >= 3)).drop("figures")
    head = F.get(F.filter("rows", _headed), F.lit(0))["row"]
    known = known.withColumn("names", F.when(F.size("stacks") > 0, t.bound(head, lambda at: F.filter("cells", lambda c: c["row"] == at))))

    def column(s: Column, k: Column) -> Column:
        return F.struct(k.alias("column"), F.get(s, F.floor(F.size(s) / 2).cast("int"))["right"].alias("right"), F.array_min(s["x"]).alias("left"), F.size(F.array_distinct(s["row"])).alias("count"))

    def named(c: Column) -> Column:
        over = F.get(F.filter("names", lambda p: (p["x"] <= c["right"] + F.col("tall")) & (p["right"] >= c["left"] - F.col("tall"))), F.lit(0))
        return c.withField("header", t.normalize_row(over["text"]))

    def judged(columns: Column) -> Column:
        most = F.array_max(columns["count"])
        under = F.array_min(F.filter(columns, lambda c: c["header"].rlike(AMOUNT_HEADER))["column"])
        filled = t.bound(most, lambda m: F.array_max(F.filter(columns, lambda c: c["count"] >= F.greatest(F.lit(3.0), 0.5 * m))["column"]))
        return t.bound(F.coalesce(under, filled), lambda pick: F.transform(columns, lambda c: c.withField("is_amount", c["column"] == pick)))

    listed = F.transform(F.transform("stacks", column), named)
    return known.withColumn("columns", t.bound(listed, judged)).drop("stacks", "names")


def _amounts(found: DataFrame) -> DataFrame:
    """`found` (as `with_columns` gives it) with amounts: structs of row and value, the figures in the amounts' column, from left to right."""
    inside = lambda c, right: c["value"].isNotNull() & (F.abs(c["right"] - right) < EDGE * F.col("tall"))
    figures = lambda right: F.transform(F.filter("cells", lambda c: inside(c, right)), lambda c: F.struct(c["row"].alias("row"), c["value"].alias("value")))
    # Bound, as the engine would work out the column anew for each cell.
    return found.withColumn("amounts", t.bound(F.get(F.filter("columns", lambda c: c["is_amount"]), F.lit(0))["right"], figures))


def _of_row(row: Column) -> Column:
    return F.try_element_at(F.filter("amounts", lambda a: a["row"] == row), F.lit(-1))["value"]


def _columns(found: DataFrame) -> DataFrame:
    # An outer generator, here and below: with others the engine tests the size of the array first, for which it makes the whole array once more.
    return with_columns(found).select("doc", "tall", F.inline_outer("columns")).where(F.col("column").isNotNull()).select("doc", "column", "right", "left", "count", "tall", "header", "is_amount")


def columns(rows: DataFrame) -> DataFrame:
    """doc, column (from 0), right, left, count, tall, header and is_amount of the figures' columns of each document with three amounts or more, of `rows` (doc, row, parts)."""
    return _columns(_gathered(rows))


def row_amounts(rows: DataFrame) -> DataFrame:
    """doc, row, amount: the last figure of the row in the amounts' column, for rows (doc, row, parts) that have one."""
    found = _amounts(with_columns(_gathered(rows)))
    return found.select("doc", F.explode_outer(F.array_distinct(F.col("amounts")["row"])).alias("row"), "amounts").where(F.col("row").isNotNull()).select("doc", "row", _of_row(F.col("row")).alias("amount"))


def _listed(atoms: DataFrame) -> DataFrame:
    """doc, rows: the same of atoms, without taking the rows apart."""
    return _parts(atoms).select("doc", F.transform("lines", lambda p, k: F.struct(k.alias("row"), p.alias("parts"))).alias("rows"))


def table_columns(atoms: DataFrame) -> DataFrame:
    """`columns` of the rows of atoms."""
    return _columns(_listed(atoms))


def table_amounts(atoms: DataFrame) -> DataFrame:
    """doc, row, text and the amount that the inferred table gives the row (null: none)."""
    each = _amounts(with_columns(_listed(atoms))).select("doc", F.explode_outer("rows").alias("r"), "amounts").where(F.col("r").isNotNull())
    return each.select("doc", "r.row", F.concat_ws(" ", F.col("r.parts")["text"]).alias("text"), _of_row(F.col("r.row")).alias("amount"))
