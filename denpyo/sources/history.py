"""Results as files and as the stored history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import BATCH_HEADER, HISTORY_HEADER
from . import csv_out

MOST = 50


def _number(digits: Column) -> Column:
    return F.coalesce(F.concat(F.lit("T"), digits), F.lit(""))


def _simplified(x: Column) -> Column:
    return F.when(x, "はい").when(~x, "いいえ").otherwise("")


def batch_rows(results: DataFrame) -> DataFrame:
    """The eight columns of a batch file; `results` has file, label, document (from 0), digits, amount, summary and simplified."""
    link = F.coalesce(csv_out.lookup_url(F.col("digits")), F.lit(""))
    fields = (F.col("file"), F.col("label"), (F.col("document") + 1).cast("string"), _number(F.col("digits")), link, F.col("amount").cast("string"), F.col("summary"), _simplified(F.col("simplified")))
    return results.select(*(F.coalesce(f, F.lit("")).alias(f"c{i}") for i, f in enumerate(fields)))


def history_rows(entries: DataFrame) -> DataFrame:
    """The ten columns of a history file; `entries` has at, name, digits, amount, others, summary, simplified, engine and seconds."""
    link = F.coalesce(csv_out.lookup_url(F.col("digits")), F.lit(""))
    others = F.array_join(F.transform("others", lambda d: F.concat(F.lit("T"), d)), " ")
    fields = (
        F.date_format("at", "yyyy/M/d H:mm:ss"), F.col("name"), _number(F.col("digits")), link, F.col("amount").cast("string"), others, F.col("summary"),
        _simplified(F.col("simplified")), F.col("engine"), F.format_string("%.1f", F.round("seconds", 1)),
    )
    return entries.select(*(F.coalesce(f, F.lit("")).alias(f"c{i}") for i, f in enumerate(fields)))


def write_batch(results: DataFrame, path: str) -> None:
    csv_out.write(batch_rows(results), path, BATCH_HEADER)


def write_history(entries: DataFrame, path: str) -> None:
    csv_out.write(history_rows(entries), path, HISTORY_HEADER)


def entries_of(results: DataFrame) -> DataFrame:
    """An entry for each finished document: id, at, name (with its number where the scan has several), digits, amount, summary, simplified."""
    several = F.count("*").over(Window.partitionBy("scan")) > 1
    name = F.when(several, F.concat("file", F.lit(" #"), (F.col("document") + 1).cast("string"))).otherwise(F.col("file"))
    return results.where("status = 'done'").select(F.concat_ws("-", "scan", "document").alias("id"), "at", name.alias("name"), "digits", "amount", "summary", "simplified")


def appended(history: DataFrame, new: DataFrame, most: int = MOST) -> DataFrame:
    """The newest entries of each user of both frames (user, id, at, ...)."""
    both = history.unionByName(new, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("at"), F.desc("id")))
    return both.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def removed(history: DataFrame, gone: DataFrame) -> DataFrame:
    """The history without the entries (user, id) of `gone`; a null id clears a user's."""
    all_ = gone.where("id IS NULL").select("user").distinct()
    return history.join(gone, ["user", "id"], "left_anti").join(all_, "user", "left_anti")


def response(results: DataFrame) -> DataFrame:
    """page and a JSON text of its lines (text, conf, x, y, w, h) in order of y, then x."""
    line = F.struct("y", "x", "text", "conf", "w", "h")
    return results.groupBy("page").agg(F.to_json(F.struct(F.array_sort(F.collect_list(line)).alias("lines"))).alias("json"))
