"""Exact top-k search by distributed histogram selection.

A block of queries at a time (a bounded number, broadcast) is scored against
all candidates. One pass finds, per query, the range that must hold the kth
score; further passes count scores in global histograms over an ever smaller
range until the kth value itself is known. The last pass keeps what scores
above it and, of the ties, the smallest ids. Every pass recomputes the scores
from the input; nothing of the order of queries times candidates is stored.

Vectors of unlike length are not compared. Vectors that are null or hold null
or non-finite components, and rows without an id, take no part. Rows repeating
an id are candidates each, and as a query count once (the smallest vector); no
row with the query's own id is its candidate. With fewer than k candidates all are
returned. Integer scores are exact; one beyond 2**61 in size raises an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Workspace, read
from .vectors import matrices

BINS = 512
LIMIT = 1 << 61
TILE = 1024


def to_integers(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -1e300, 1e300)


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """int64 products of integer-valued float64 matrices."""
    largest = (np.abs(q).max(initial=0)) * (np.abs(c).max(initial=0)) * q.shape[1]
    if largest < 2**53:
        return (q @ c.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (q, c))
    out = a @ b.T if q.shape[1] else np.zeros((len(q), len(c)), object)
    if any(abs(x) > LIMIT for x in out.ravel()):
        raise OverflowError("a score is beyond 2**61 in size")
    return out.astype(np.int64)


class Block:
    """A block of queries, by dimension."""

    def __init__(self, ids: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.parts = ids, parts

    def scores(self, batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Query positions, candidate ids, their scores and which of them count, a tile of candidates at a time."""
        known = {m.shape[1]: (at, m) for at, m in self.parts}
        ids = batch.column(0)
        for rows, matrix in matrices(ids, batch.column(1)):
            if matrix.shape[1] in known:
                at, q = known[matrix.shape[1]]
                own = ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)
                for i in range(0, len(rows), TILE):
                    c = own[i : i + TILE]
                    yield at, c, inner_products(q, to_integers(matrix[i : i + TILE], scale)), self.ids[at][:, None] != c[None, :]


def _blocks(queries: DataFrame, scale: float, size: int) -> Iterator[Block]:
    """Queries by ascending id, `size` at a time."""
    finite = "v IS NOT NULL AND id IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    last = None
    while True:
        rest = queries.where(finite)
        table = (rest if last is None else rest.where(F.col("id") > F.lit(last))).orderBy("id", "v").limit(size).toArrow().combine_chunks()
        if not table.num_rows:
            return
        ids = table.column(0).to_numpy()
        last = int(ids[-1])
        once = np.concatenate(([True], ids[1:] != ids[:-1]))
        table = table.filter(pa.array(once)).combine_chunks()
        ids = ids[once]
        vectors = table.column(1)
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        yield Block(ids, [(rows, to_integers(m, scale)) for rows, m in matrices(pa.array(ids), vectors)])
        if table.num_rows < size and not len(once) == size:
            return


def _mapped(candidates: DataFrame, shared, fold, emit, schema: str) -> DataFrame:
    """One state a partition: fold(state, block, batch) for each batch, then emit(state, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state = shared.value, None
        for batch in batches:
            state = fold(state, block, batch)
        if state is not None:
            columns = emit(state, block)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])

    return candidates.mapInArrow(run, schema)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: float = 1.0, block: int = 2048, workspace: Workspace | None = None) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score.

    Both frames have columns id and v; each component x counts as floor(scale * x).
    """
    spark = candidates.sparkSession
    workspace = workspace or Workspace(spark, "topk")
    queries, candidates = (d.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")) for d in (queries, candidates))
    found = []
    for part in _blocks(queries, scale, block):
        shared = spark.sparkContext.broadcast(part)
        kth = _kth_scores(candidates, shared, part, k, scale)
        picked = _picked(candidates, shared, kth, k, scale)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = picked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.append(workspace.keep(ranked, "block"))
        shared.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(found[0].schema).parquet(*(f"{workspace.root}/{i + 1:03d}-block" for i in range(len(found)))) if len(found) > 1 else found[0]


def _kth_scores(candidates: DataFrame, shared, part: Block, k: int, scale: float) -> np.ndarray:
    """The kth highest score of each query; -LIMIT - 1 where there are fewer than k."""
    n = len(part.ids)

    def best(state, block, batch):
        state = state if state is not None else np.full((n, k), -LIMIT - 1, np.int64)
        for at, _, s, counts in block.scores(batch, scale):
            s = np.where(counts, s, -LIMIT - 1)
            both = np.concatenate((state[at], s), axis=1)
            state[at] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        return state

    def range_of(state, block):
        return np.arange(n), state.min(axis=1), state.max(axis=1)

    rows = _mapped(candidates, shared, best, range_of, "q long, low long, high long").groupBy("q").agg(F.max("low"), F.max("high")).collect()
    low, high = np.full(n, -LIMIT - 1, np.int64), np.full(n, -LIMIT - 1, np.int64)
    for q, a, b in rows:
        low[q], high[q] = a, b
    # Where no partition has k candidates the kth score is anywhere below the best.
    above = np.zeros(n, np.int64)
    high = high + 1
    done = high == -LIMIT
    while not (done | (high - low <= 1)).all():
        width = np.maximum(1, -((low - high) // BINS))

        def count(state, block, batch, low=low, high=high, width=width):
            state = state if state is not None else np.zeros((n, BINS), np.int64)
            for at, _, s, counts in block.scores(batch, scale):
                inside = counts & (s >= low[at][:, None]) & (s < high[at][:, None])
                i, j = np.nonzero(inside)
                np.add.at(state, (at[i], (s[i, j] - low[at[i]]) // width[at[i]]), 1)
            return state

        def upper(state, block):
            # A bin below a partition's own kth can't hold the global kth.
            over = np.cumsum(state[:, ::-1], axis=1)[:, ::-1] - state
            i, j = np.nonzero((state > 0) & (over < k))
            return i, j, state[i, j]

        counted = _mapped(candidates, shared, count, upper, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        bins: dict[int, list] = {}
        for q, b, c in counted.collect():  # at most BINS a query of the block
            bins.setdefault(q, []).append((b, c))
        for q in range(n):
            if done[q] or high[q] - low[q] <= 1:
                continue
            for b, c in sorted(bins.get(q, []), reverse=True):
                if above[q] + c >= k:
                    low[q], high[q] = low[q] + b * width[q], min(high[q], low[q] + (b + 1) * width[q])
                    break
                above[q] += c
            else:
                low[q], done[q] = -LIMIT - 1, True  # fewer than k
    return low


def _picked(candidates: DataFrame, shared, kth: np.ndarray, k: int, scale: float) -> DataFrame:
    def keep(state, block, batch):
        state = state or []
        for at, c, s, counts in block.scores(batch, scale):
            i, j = np.nonzero(counts & (s >= kth[at][:, None]))
            state.append((at[i], c[j], s[i, j]))
        if len(state) > 64:
            state = [_best(state, k)]
        return state

    def emit(state, block):
        q, c, s = _best(state, k)
        return block.ids[q], c, s

    return _mapped(candidates, shared, keep, emit, "query_id long, vec_id long, score long")


def _best(found: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query by score, then id."""
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e
    q, c, s = (np.concatenate([x[i] for x in found]) for i in range(3))
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    begin = np.searchsorted(q, q)
    few = np.arange(len(q)) - begin < k
    return q[few], c[few], s[few]


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all, by the integer inner product of floor(1024 x)."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return top_k(vectors.where("id % 100 = 0"), vectors, k=10, scale=1024.0)


OP4_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
