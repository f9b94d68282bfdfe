"""Cutting a sorted array into runs, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def middle_of(values: Column) -> Column:
    """The upper median of an array, null of none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def run_starts(items: Column, joins: Callable[[Column, Column], Column]) -> Column:
    """Where runs begin (from 1): an element goes on with the run before it if joins(run so far, element).

    The fold carries the last start and the starts found, so its state is small however long the array.
    """

    def step(done: Column, i: Column) -> Column:
        fresh = F.struct(i.alias("last"), F.concat(done["starts"], F.array(i)).alias("starts"))
        going_on = bound(F.slice(items, done["last"], i - done["last"]), lambda run: bound(F.element_at(items, i), lambda item: joins(run, item)))
        return F.when(going_on, done).otherwise(fresh)

    begun = F.struct(F.lit(1).alias("last"), F.array(F.lit(1)).alias("starts"))
    rest = F.when(F.size(items) > 1, F.sequence(F.lit(2), F.size(items))).otherwise(F.expr("cast(array() AS array<int>)"))
    return F.when(F.size(items) > 0, F.aggregate(rest, begun, step, lambda done: done["starts"]))


def runs(items: Column, joins: Callable[[Column, Column], Column]) -> Column:
    """The runs themselves, as an array of arrays."""
    return cut_at(items, run_starts(items, joins))


def cut_at(items: Column, starts: Column) -> Column:
    def pieces(s: Column) -> Column:
        return F.transform(s, lambda at, k: F.slice(items, at, F.coalesce(F.get(s, k + 1), F.size(items) + 1) - at))

    return bound(starts, pieces)
