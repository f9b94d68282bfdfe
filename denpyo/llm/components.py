"""Connected components of an edge table, without collecting neighbours.

Alternates two steps until nothing changes: every edge's larger end is tied to
the least neighbour of its smaller end, then every node's smaller neighbours
are tied to the least of them. Minima are aggregated before the shuffle and
joined back, so a node with very many edges is split like any skewed join key.
Each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace


#: Edges that a file of a step's table holds; small graphs are not spread over many tasks.
EDGES_PER_FILE = 250_000


def components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """node, root for each node whose root (the least id reachable) is another node.

    `edges` has columns a and b (long); loops, nulls and repeated edges do no harm.
    """
    start = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a is not null and b is not null")
    now = workspace.keep(_ordered(start), "edges")
    mark = _mark(now)
    while mark[0]:
        files = 1 + mark[0] // EDGES_PER_FILE
        both = now.select(F.col("hi").alias("node"), F.col("lo").alias("m")).union(now.select(F.col("lo"), F.col("hi")))
        least = workspace.keep(both.groupBy("node").agg(F.least("node", F.min("m")).alias("m")).coalesce(2 * files), "least")
        tied = now.join(least, F.col("lo") == F.col("node")).select("hi", F.col("m").alias("lo"))
        wide = workspace.keep(_ordered(tied).coalesce(files), "wide")
        own = workspace.keep(wide.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "node").coalesce(files), "own")
        tied = wide.join(own, F.col("hi") == F.col("node")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(own.select("node", "m"))
        then = workspace.keep(_ordered(tied).coalesce(files), "edges")
        after = _mark(then)
        for old in (now, least, wide, own):
            workspace.drop(old)
        now = then
        if after == mark:
            break
        workspace.release()
        mark = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("hi > lo").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
