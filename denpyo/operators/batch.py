"""Order-dependent steps over small groups (a page, a document), many groups of a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def listed(rows: DataFrame, keys: list[str], order: str, name: str = "rows") -> DataFrame:
    """One row a group: its rows as an array of structs, by `order` and then by all other columns."""
    first = [order, *(c for c in rows.columns if c not in (order, *keys))]
    # As many partitions as the session asks for: what follows is work in Python, which few full partitions would do one after the other.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))


def each(groups: DataFrame, one: Callable[..., list[dict]], schema: str) -> DataFrame:
    """The rows that `one` makes of each row of `groups`, given its columns by name."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([x for row in batch.to_pylist() for x in one(**row)], schema=arrow)

    return groups.mapInArrow(run, schema)


def box(*names: str) -> list[Column]:
    return [F.col(n).cast("double").alias(n) for n in names or ("x", "y", "w", "h")]
