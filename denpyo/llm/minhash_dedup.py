"""Near-duplicate documents by min-max hashing.

Each permutation gives two signature values, its minimum and its maximum over a
document's shingles. Bands of values put documents into buckets; the number
of bands follows from the threshold and `miss`, the chance of losing one pair at the
threshold. Documents with equal shingle sets are one representative before that.
A bucket ties its members to its least one, never to each other, and the components of
those ties are the groups in which links are confirmed: a group's texts travel, which are
shorter than their shingle sets, and the full sets
are compared in blocks of bounded size, by matrix products of their incidence,
which return a spanning forest of the links. The components of these are the result.

Words are runs of bytes other than space and \\t..\\r, with A-Z lower-cased; a set is
the distinct runs of `size` words, or the whole sequence where there are fewer. A text
that is null or without words has an empty set and links with nothing. Repeated rows get
equal results; rows of one doc_id with other texts link by their own texts. Rows with a
null doc_id link with nothing, have a null component and are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .tables import Workspace, bitmap, maybe_in, read
from .text import U, Powers, chunks, mix, shingles, words

#: Documents of a block; a comparison holds two blocks.
BLOCK = 512
#: Bits of the map of large buckets for each of them: every document has dozens of keys that are in none, of which one in KEY_BITS / 2 or fewer passes.
KEY_BITS = 256
#: Documents that small groups are dealt to one task by.
DEAL = 2000


def banding(percent: int, miss: float = 1e-6, rows: int = 6) -> tuple[int, int]:
    """Permutations a band (two values each) and the number of bands, so that a pair of any size at the threshold is lost with a chance of `miss` at most.

    A permutation's minimum and maximum both agree if the first and the last of the union's u elements are shared ones:
    c (c - 1) / (u (u - 1)) for c shared ones, a little less than the square of c / u. The least such
    chance over the sizes at the threshold counts; a union of one element agrees with itself.
    """
    chance = 1.0
    for union in range(2, 4000):
        shared = -(-percent * union // 100)
        chance = min(chance, (shared * (shared - 1) / (union * (union - 1))) if shared > 1 else chance)
    return rows // 2, math.ceil(math.log(miss) / math.log1p(-(chance ** (rows // 2))))


def signature_bands(h: np.ndarray, begin: np.ndarray, per_band: int, bands: int, seed: int = 11) -> np.ndarray:
    """A key for each row and band from the minima and maxima of h under per_band * bands multipliers; rows must not be empty."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, per_band * bands, dtype=np.int64).astype(U) * U(2) + U(1)
    out = np.empty((len(begin) - 1, bands), U)
    y = np.empty_like(h)
    for band in range(bands):
        key = np.full(len(begin) - 1, band + 1, U)
        for p in factors[band * per_band : (band + 1) * per_band]:
            np.multiply(h, p, out=y)
            for ends in (np.minimum, np.maximum):
                key = mix(key * U(0x9E3779B97F4A7C15) + ends.reduceat(y, begin[:-1]))
        out[:, band] = key
    return out


def _described(docs: DataFrame, size: int, per_band: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (two hashes of the set), bands."""
    factors = np.random.default_rng(5).integers(0, 1 << 63, 2, dtype=np.int64).astype(U) * U(2) + U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for c in chunks(batch.column("text")):
                h, begin = shingles(words(c, powers), c.last - c.first, size)
                n = np.diff(begin)
                full = np.flatnonzero(n)
                keys = np.zeros((len(n), bands), U)
                s = np.zeros((2, len(n)), U)
                if len(full):
                    starts = np.concatenate((begin[full], [begin[-1]]))
                    keys[full] = signature_bands(h, starts, per_band, bands)
                    for k in range(2):
                        s[k, full] = np.add.reduceat(mix(h * factors[k]), starts[:-1])
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.first, c.last - c.first), pa.array(n.astype(np.int64)), pa.array(s[0].view(np.int64)), pa.array(s[1].view(np.int64)), lists], names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _large_keys(buckets: DataFrame) -> tuple:
    return bitmap(buckets, "key", hashed=True, per=KEY_BITS)


def _in_buckets(alike: DataFrame, wanted: tuple) -> DataFrame:
    """doc_id and key of the bands whose keys a bitmap holds, so that only these travel."""
    shared = alike.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column("bands")
            key, row = bands.flatten(), bands.value_parent_indices()
            held = pa.array(maybe_in(key.to_numpy(), *shared.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row.filter(held)), key.filter(held)], names=["doc_id", "key"])

    return alike.select(F.col("rep").alias("doc_id"), "bands").mapInArrow(run, "doc_id long, key long")


def _texts(docs: DataFrame, wanted: tuple) -> DataFrame:
    """doc_id and text of the documents that a bitmap of ids holds, placed by doc_id; repeated rows once."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(maybe_in(batch.column("hash").to_numpy(), *shared.value)))
            yield from pa.Table.from_batches([kept]).group_by(["doc_id", "text"]).aggregate([]).to_batches()

    found = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("hash")).mapInArrow(run, "doc_id long, text string")
    return found.repartition("doc_id").dropDuplicates(["doc_id", "text"])


def sets_of(texts: pa.Array, size: int, powers: Powers) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    out = []
    for c in chunks(texts):
        h, begin = shingles(words(c, powers), c.last - c.first, size)
        out += np.split(h, begin[1:-1])
    return out


def overlaps(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections of sorted arrays without repeats."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    sizes = np.array([len(s) for s in sets])
    if m <= 8:
        for i in range(m):
            out[i, i] = sizes[i]
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    which = np.cumsum(new) - 1
    often = np.bincount(which)[which] > 1 if len(which) else new
    _, column = np.unique(which[often], return_inverse=True)
    owner = owner[often]
    for first in range(0, int(column.max(initial=-1)) + 1, columns):
        a, b = np.searchsorted(column, [first, first + columns])
        at = np.zeros((m, columns), np.float32)
        at[owner[a:b], column[a:b] - first] = 1
        out += (at @ at.T).astype(np.int64)
    out[np.arange(m), np.arange(m)] = sizes
    return out


def first_of_component(adjacent: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix the first node of its component."""
    root = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while len(front):
                front = np.flatnonzero(adjacent[front].any(axis=0) & (root < 0))
                root[front] = i
    return root


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, miss: float = 1e-6, block: int = BLOCK, workspace: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; linked is 100 * intersection >= percent * union."""
    ws = workspace or Workspace(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = ws.keep(_described(docs, size, *banding(percent, miss)), "described")
    full = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    ws.release()
    alike = ws.keep(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "alike")
    banded = alike.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("key"))
    buckets = ws.keep(banded.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi"), "buckets")
    large = buckets.where("n > 2").select("key", "lo")
    more = _in_buckets(alike, _large_keys(large)).join(large, "key").select("lo", F.col("doc_id").alias("hi"))
    ties = buckets.where("n = 2").select("lo", "hi").union(more)
    grouped = components(ties.select(F.col("lo").alias("a"), F.col("hi").alias("b")), ws)
    ws.release()
    members = ws.keep(grouped.union(grouped.select("root", "root").distinct()), "members")
    links = ws.keep(_confirmed(docs, members, percent, size, block, ws), "links")
    ws.release()
    roots = components(links, ws)
    placed = ws.keep(alike.join(roots, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("root", "rep").alias("component")), "placed")
    ws.release()
    out = described.join(placed, ["s1", "s2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _confirmed(docs: DataFrame, members: DataFrame, percent: int, size: int, block: int, ws: Workspace) -> DataFrame:
    """A spanning forest (a, b) of the links within each group of `members` (node, root)."""
    groups = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    deals = max(1, members.count() // DEAL)
    sized = ws.keep(members.join(groups, "root"), "sized")
    with_texts = sized.join(_texts(docs, bitmap(members, "node", per=32)), F.col("node") == F.col("doc_id"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = with_texts.withColumn("own", own).withColumn("other", F.explode(F.expr("IF(blocks = 1, array(0), sequence(0, blocks - 1))")))
    # Groups of one block share tasks; a pair of blocks of a larger group is a task's group of its own.
    placed = placed.select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(deals))).otherwise(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))).alias("task"),
        (F.col("blocks") > 1).alias("large"), "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "text",
    )

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, powers = [], [], Powers()
        for _, group in pdf.groupby(["root", "i", "j"], sort=False):
            if len(group) < 2 or (group["i"].iloc[0] != group["j"].iloc[0] and group["own"].nunique() < 2):
                continue
            group = group.sort_values("node", kind="stable")
            node = group["node"].to_numpy()
            sets = sets_of(pa.array(group["text"], pa.string()), size, powers)
            n = np.array([len(s) for s in sets])
            common = overlaps(sets)
            joined = (100 + percent) * common >= percent * (n[:, None] + n[None, :])
            joined |= node[:, None] == node[None, :]
            root = first_of_component(joined)
            tied = np.flatnonzero(root != np.arange(len(root)))
            a += node[root[tied]].tolist()
            b += node[tied].tolist()
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return placed.groupBy("large", "task").applyInPandas(confirm, "a long, b long")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)
