"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from
measures of its bytes and words, a gated attention weighs the passages, and the
weighted mean of their codes is scored; labels are known of documents only, so the
attention learns which passages decide. The model is fitted in the driver on a
sample of at most `per_class` labelled documents of each class, picked by a hash
of their ids, with every passage of each; scoring takes
every passage of every text and needs no shuffle.

A null or empty text is a bag of one blank passage and gets a score like any
other. Repeated rows get equal scores. Labels other than 0 and 1 are ignored; a
document labelled more than once counts with the mean. With no label of one class
every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import fresh, read, small_batches
from .text import Chunk, Powers, U, chunks, words

PASSAGE = 64
REJECT_BELOW = 0.3

#: Byte classes, in this order; the rest of ASCII, then control and non-ASCII bytes follow.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?", "|", "*#$%&", "@+=~^`<>\\", "'\"", "()[]{}", "-_/")
_class = np.full(256, len(CLASSES), np.int64)
for _i, _chars in enumerate(CLASSES):
    _class[list(_chars.encode())] = _i
_class[:9] = _class[14:32] = _class[127] = len(CLASSES) + 1
_class[128:] = len(CLASSES) + 2
N_CLASSES = len(CLASSES) + 3
N_FEATURES = N_CLASSES + 7


def passages(chunk: Chunk, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Measures of each passage of the chunk's texts, and where each text's passages begin (rows + 1)."""
    rows = len(chunk.ends)
    w = words(chunk, powers)
    per_row = np.bincount(w.row, minlength=rows) if len(w.row) else np.zeros(rows, np.int64)
    count = np.maximum(1, -(-per_row // PASSAGE))
    begin = np.concatenate(([0], np.cumsum(count)))
    n = int(begin[-1])
    x = np.zeros((n, N_FEATURES), np.float32)
    first_word = np.concatenate(([0], np.cumsum(per_row)))[:-1]
    of_word = begin[w.row] + (np.arange(len(w.row)) - first_word[w.row]) // PASSAGE if len(w.row) else w.row
    # Bytes from a passage's first word to the next passage's belong to it, and a text's lead to its first passage.
    starts_of_rows = np.concatenate(([0], chunk.ends[:-1]))
    edge = np.zeros(n, np.int64)
    edge[begin[:-1]] = starts_of_rows
    if len(of_word):
        new = np.flatnonzero(np.concatenate(([True], of_word[1:] != of_word[:-1])))
        inner = new[(w.row[new] >= 0) & (of_word[new] != begin[w.row[new]])]
        edge[of_word[inner]] = w.start[inner]
    sizes = np.diff(np.concatenate((edge, [len(chunk.data)])))
    if len(chunk.data):
        of_byte = np.repeat(np.arange(n) * N_CLASSES, sizes)
        of_byte += _class[chunk.data]
        x[:, :N_CLASSES] = np.bincount(of_byte, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(sizes, 1)[:, None]
    if len(of_word):
        k = np.bincount(of_word, minlength=n)
        some = np.maximum(k, 1)
        size = (w.end - w.start).astype(np.float64)
        mean = np.bincount(of_word, size, n) / some
        again = np.zeros(len(w.hash))
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
        key = (w.row.astype(U) << U(40)) | (w.hash >> U(24))
        order = np.argsort(key, kind="stable")
        seen = np.zeros(len(key))
        seen[order[1:]] = key[order[1:]] == key[order[:-1]]
        here = np.sort((of_word.astype(U) << U(40)) | (w.hash >> U(24)))
        different = np.bincount((here[np.concatenate(([True], here[1:] != here[:-1]))] >> U(40)).astype(np.int64), minlength=n)
        capital = _class[chunk.data[w.start]] == 1
        x[:, N_CLASSES:] = np.stack([
            mean / 10, np.sqrt(np.maximum(0, np.bincount(of_word, size * size, n) / some - mean * mean)) / 10, np.log1p(k) / 4,
            np.bincount(of_word, again, n) / some, np.bincount(of_word, seen, n) / some, different / some, np.bincount(of_word, capital, n) / some,
        ], axis=1)
    return x, begin


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    weights: dict[str, np.ndarray]
    shift: float

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """A score from 0 to 1 for each bag."""
        if not self.weights:
            return np.full(len(begin) - 1, 1 / (1 + np.exp(-self.shift)))
        logit = _forward(self.weights, (x - self.mean) / self.deviation, begin)[-1] + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _forward(p: dict, x: np.ndarray, begin: np.ndarray) -> tuple:
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    bag = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    a = np.exp(e - np.maximum.reduceat(e, begin[:-1])[bag])
    a /= np.add.reduceat(a, begin[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, begin[:-1], axis=0)
    return h, t, g, a, bag, z, z @ p["c"] + p["d"]


def train(x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 16, attention: int = 8, epochs: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fits the bag model by Adam on all bags at once; `weight` is each bag's share in the loss."""
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / deviation).astype(np.float64)
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = {"W": rng.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, attention)), "U": rng.normal(0, hidden**-0.5, (hidden, attention)), "w": rng.normal(0, 0.5, attention), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(())}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    weight = weight / weight.sum()
    for step in range(1, epochs + 1):
        h, t, g, a, bag, z, logit = _forward(p, x, begin)
        dl = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * weight
        dz = dl[:, None] * p["c"]
        toward = dz[bag]
        da = (h * toward).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, begin[:-1])[bag])
        dt = de[:, None] * p["w"] * g * (1 - t * t)
        dg = de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * toward + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        grads = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dl, "d": dl.sum()}
        for k in p:
            q = grads[k] + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.999 * v[k] + 0.001 * q * q
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, deviation, p, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, **options) -> Model:
    """A model of `labels.label` (0 or 1) from the texts of `docs`; both have doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select("doc_id", F.col(f"`{label}`").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.avg("y").alias("y"))
    known = known.withColumn("kind", (F.col("y") >= 0.5).cast("int"))
    have = {r.kind: r.n for r in known.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if len(have) < 2:
        n0, n1 = have.get(0, 0), have.get(1, 0)
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0), np.zeros(0), {}, float(np.log(share / (1 - share))))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = [known.where(f"kind = {k}").orderBy(*order).limit(per_class) for k in (0, 1)]
    chosen = spark.createDataFrame(sample[0].union(sample[1]).toPandas()[["doc_id", "y"]])  # 2 * per_class rows at most
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for c in chunks(batch.column("text")):
                x, begin = passages(c, powers)
                kept = [x[b:e] for b, e in zip(begin[:-1], begin[1:])]
                part = batch.slice(c.first, c.last - c.first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([k.tobytes() for k in kept], pa.binary())], names=["doc_id", "y", "x"])

    bags = texts.select("doc_id", "y", "text").mapInArrow(measured, "doc_id long, y double, x binary").toPandas()
    bags = bags.sort_values(["doc_id", "x"]).drop_duplicates(["doc_id", "x"])
    y = bags["y"].to_numpy()
    if not ((y >= 0.5).any() and (y < 0.5).any()):
        return fit(docs, labels.limit(0), label)
    x = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in bags["x"]]
    begin = np.concatenate(([0], np.cumsum([len(a) for a in x])))
    # Weights undo the sample's class shares, so that scores stay probabilities.
    share = {k: have[k] / max(1, ((y >= 0.5) == k).sum()) for k in (0, 1)}
    return train(np.concatenate(x), begin, y, np.where(y >= 0.5, share[1], share[0]), **options)


def score(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of docs (all if None) and a double column `name`, which replaces one of that name."""
    small_batches(docs.sparkSession)
    carried = [c for c in (docs.columns if keep is None else keep) if c != name]
    text = fresh([*carried, name], "t")
    source = docs.select(*(F.col(f"`{c}`") for c in carried), F.col("text").cast("string").alias(text))
    schema = source.drop(text).withColumn(name, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for c in chunks(batch.column(text)):
                x, begin = passages(c, powers)
                part = batch.slice(c.first, c.last - c.first)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(carried))), pa.array(shared.value.score(x, begin))], names=[*carried, name])

    return source.mapInArrow(run, schema)


def held_out(doc_id):
    """Whether the row is kept from learning: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that the queries use: labels of the rows that are not held out."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fitted(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))
