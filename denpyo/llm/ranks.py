"""Places of rows within groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Workspace


def joined(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """`left` with the other columns of `right` where the named columns are equal; nulls equal nulls."""
    other = right.withColumnsRenamed({n: f"_of_{n}" for n in names})
    on = reduce(and_, (F.col(f"`{n}`").eqNullSafe(F.col(f"`_of_{n}`")) for n in names))
    return left.join(other, on, how).drop(*(f"_of_{n}" for n in names))


def ranked(ws: Workspace, df: DataFrame, group: list[str], order: list[str], index: str = "index", total: str = "total") -> DataFrame:
    """`df` with each row's place among its group's rows by `order` (long, from 0, nulls first) and the group's size.

    Rows are dealt out by ranges of (group, order), so a group of any size takes as many tasks as its rows need, equal
    rows included; only counts by task and group meet. `df` should come from a table, so that a task which runs again
    numbers its rows as before. No column of `df` may be called _salt, _part or _pos.
    """
    names = df.columns
    keys = [*group, *order, "_salt"]
    placed = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    part = F.spark_partition_id()
    placed = ws.keep(placed.select(*names, part.alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos")), "placed")
    runs = placed.groupBy("_part", *group).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", *group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias(total))
    runs = ws.keep(runs, "runs")
    return joined(placed, runs, ["_part", *group]).select(*names, (F.col("_pos") + F.col("_shift")).alias(index), total)
