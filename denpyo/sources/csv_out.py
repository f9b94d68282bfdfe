"""CSV sinks: every field quoted, CRLF line ends, a byte order mark first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CORPORATE_URL, REGISTER_URL

BOM = "﻿"


def quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def line(*fields: Column) -> Column:
    return F.concat_ws(",", *(quoted(f) for f in fields))


def lookup_url(digits: Column) -> Column:
    """Where the public register shows a registration number."""
    return F.concat(F.lit(REGISTER_URL), F.url_encode(digits))


def corporate_url(digits: Column) -> Column:
    """Where the public register shows a corporate number."""
    return F.concat(F.lit(CORPORATE_URL), F.url_encode(digits))


def write(df: DataFrame, path: str, header: tuple[str, ...] | None = None) -> None:
    """Part files that each begin with the mark and the header (the columns' names if None), one row a line.

    A part without rows has no file, except that an empty frame leaves one file with the header.
    """
    head = BOM + ",".join('"' + c.replace('"', '""') + '"' for c in header or df.columns)
    body = df.select(line(*(F.col(f"`{c}`") for c in df.columns)).alias("value"))
    # The header goes before the first row of a part, which is where its running number is 0.
    part = F.spark_partition_id()
    numbered = body.select("value", F.monotonically_increasing_id().alias("at"), part.alias("part"))
    first = numbered.select(F.when(F.col("at") == F.shiftleft(F.col("part").cast("long"), 33), F.concat(F.lit(head + "\r\n"), "value")).otherwise(F.col("value")).alias("value"))
    first.write.option("lineSep", "\r\n").mode("overwrite").text(path)
    if df.isEmpty():
        df.sparkSession.range(1).coalesce(1).select(F.lit(head).alias("value")).write.option("lineSep", "\r\n").mode("overwrite").text(path)
