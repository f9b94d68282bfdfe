"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors of a label are one representative with a count. Representatives
are dealt to tiles of bounded size within their label. What travels to every pair of tiles of a
label is int8 codes only: a vector's code differs from it by a remainder of known length, which bounds
the error of each product, and tells which rows of two tiles may have a partner in the other. A tile
then hands these rows in full precision to its pairs, where the links are computed exactly. A pair of
tiles returns for each linked vector the number of its links and the least member of its component
there, never the pairs.

Vectors that are null, zero or hold null or non-finite components, rows without label
or id, and vectors of unlike length link with nothing; each such row is its own
component (a null id has a null component, and is kept). Every row counts as a
vector, also rows that repeat an id, with the same vector or another.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .tables import Workspace, read

TILE = 2048
#: Rows of a tile that are multiplied at a time.
STRIP = 512
#: Room for rounding in the double-precision bound itself.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, lengths of the coded vectors and of the remainders."""
    scale = np.abs(unit).max(axis=1) / 127.0
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = code * scale[:, None]
    return code, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(unit - coded, axis=1)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 codes; float32 sums of up to 1024 terms below 2**14 are exact."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    return out


class Coded:
    """Codes of a tile's unit vectors and what bounds their errors."""

    def __init__(self, code: np.ndarray, scale: np.ndarray, size: np.ndarray, rest: np.ndarray):
        self.parts = code, scale, size, rest

    def rows(self, at) -> Coded:
        return Coded(*(x[at] for x in self.parts))

    def may_link(self, other: Coded, threshold: float) -> np.ndarray:
        """Which pairs may have a cosine of `threshold` or more."""
        (ca, sa, la, ea), (cb, sb, lb, eb) = self.parts, other.parts
        bound = la[:, None] * eb[None, :] + ea[:, None] * lb[None, :] + ea[:, None] * eb[None, :] + SLACK
        return code_products(ca, cb) * sa[:, None] * sb[None, :] + bound >= threshold


def partners(a: Coded, b: Coded, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two tiles may have a partner in the other, in `same` one in itself besides the row."""
    n, m = len(a.parts[0]), len(b.parts[0])
    left, right = np.zeros(n, bool), np.zeros(m, bool)
    for i in range(0, n, STRIP):
        may = a.rows(slice(i, i + STRIP)).may_link(b, threshold)
        if same:
            k = np.arange(len(may))
            may[k, k + i] = False
        left[i : i + STRIP] = may.any(axis=1)
        right |= may.any(axis=0)
    return np.flatnonzero(left), np.flatnonzero(right)


def linked(unit_a: np.ndarray, unit_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a cosine of `threshold` or more, exactly as in double precision."""
    coded = Coded(*quantise(unit_b)) if len(unit_b) else None
    out = np.zeros((len(unit_a), len(unit_b)), bool)
    for at in range(0, len(unit_a) if coded else 0, STRIP):
        strip = unit_a[at : at + STRIP]
        i, j = np.nonzero(Coded(*quantise(strip)).may_link(coded, threshold))
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            out[p + at, q] = np.einsum("ij,ij->i", strip[p], unit_b[q]) >= threshold
    return out


def _roots(adjacent: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix the first node of its component."""
    root = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while len(front):
                reached = adjacent[front].any(axis=0) & (root < 0)
                front = np.flatnonzero(reached)
                root[front] = i
    return root


def _pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _unpack(body: bytes) -> list[np.ndarray]:
    found = np.load(io.BytesIO(body))
    return [found[f"arr_{k}"] for k in range(len(found.files))]


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    m = np.array(pdf["v"].tolist(), dtype=np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow in the norm
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    head = pdf.iloc[:1][["label", "dim", "tiles", "tile"]]
    return head.assign(codes=[_pack(*quantise(m))], whole=[_pack(m, pdf["key"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64))])


def _handed(asked: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
    """The rows of a tile that its pairs asked for."""
    if not len(asked):
        return pd.DataFrame({"label": [], "dim": [], "i": [], "j": [], "tile": [], "body": []})
    whole = _unpack(tile["whole"].iloc[0])
    return asked[["label", "dim", "i", "j", "tile"]].assign(body=[_pack(*(x[np.frombuffer(r, np.int32)] for x in whole)) for r in asked["rows"]])


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, workspace: Workspace | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `vectors` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ws = workspace or Workspace(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    usable = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("v", F.when(usable, F.col("v"))).withColumn("key", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    alike = ws.keep(rows.where("v IS NOT NULL").groupBy("key", "label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "alike")
    tiles = alike.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = (
        alike.withColumn("dim", F.size("v")).join(tiles, ["label", "dim"])
        .select("label", "dim", "tiles", F.pmod("key", F.col("tiles")).cast("int").alias("tile"), "key", "copies", "v")
    )
    label = rows.schema["label"].dataType.simpleString()
    tiled = ws.keep(dealt.groupBy("label", "dim", "tile").applyInPandas(_tile, f"label {label}, dim int, tiles int, tile int, codes binary, whole binary"), "tiles")
    ws.release()
    pairs = tiled.select("label", "dim", "tile", "codes", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    pairs = pairs.select("label", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "codes")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        """A row for each side of a pair of tiles: the numbers of its rows that may have a partner."""
        sides = [Coded(*_unpack(b)) for b in pdf["codes"]]
        same = bool(pdf["i"].iloc[0] == pdf["j"].iloc[0])
        none = pdf.iloc[:0].drop(columns="codes").assign(rows=[])
        if len(sides) == 1 and not same:  # the other tile is empty
            return none
        found = partners(sides[0], sides[-1], threshold, same)
        if not len(found[0]):
            return none
        return pdf.drop(columns="codes").assign(rows=[r.astype(np.int32).tobytes() for r in found[: len(sides)]])

    where = f"label {label}, dim int, i int, j int, tile int"
    asked = ws.keep(pairs.groupBy("label", "dim", "i", "j").applyInPandas(ask, f"{where}, rows binary"), "asked")
    ws.release()
    handed = asked.groupBy("label", "dim", "tile").cogroup(tiled.select("label", "dim", "tile", "whole").groupBy("label", "dim", "tile")).applyInPandas(_handed, f"{where}, body binary")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [_unpack(b) for b in pdf["body"]]
        unit, keys, counts = sides[0]
        if len(sides) == 1:
            whole = linked(unit, unit, threshold)
            np.fill_diagonal(whole, False)
        else:
            hit = linked(unit, sides[1][0], threshold)
            keys, counts, n = np.concatenate((keys, sides[1][1])), np.concatenate((counts, sides[1][2])), len(keys)
            whole = np.zeros((len(keys), len(keys)), bool)
            whole[:n, n:], whole[n:, :n] = hit, hit.T
        links = whole @ counts
        some = np.flatnonzero(links)
        if not len(some):
            return pd.DataFrame({"key": [], "links": [], "root": []}, dtype="int64")
        return pd.DataFrame({"key": keys[some], "links": links[some], "root": keys[some][_roots(whole[np.ix_(some, some)])]})

    found = ws.keep(handed.groupBy("label", "dim", "i", "j").applyInPandas(pair, "key long, links long, root long"), "found")
    ws.release()
    links = found.groupBy(F.col("key").alias("linked")).agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), ws)
    placed = alike.join(links, F.col("key") == F.col("linked"), "left").join(roots, F.col("key") == F.col("node"), "left")
    placed = ws.keep(placed.select("key", "label", "v", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    reps = ws.keep(placed.join(least, "root").select("key", F.col("label").alias("rep_label"), F.col("v").alias("rep_v"), "n_links", "component_id"), "reps")
    same = [F.col("r.key") == F.col("s.key"), F.col("r.label") == F.col("s.rep_label"), F.col("r.v") == F.col("s.rep_v")]
    out = rows.alias("r").join(reps.alias("s"), same, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
m AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT t.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least(t.vec_id, coalesce(m.least, t.vec_id)) AS component_id,
       t.vec_id = least(t.vec_id, coalesce(m.least, t.vec_id)) AS kept
FROM embeddings t LEFT JOIN n ON n.a = t.vec_id LEFT JOIN m ON m.a = t.vec_id
"""
