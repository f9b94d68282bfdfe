"""Cross-entropy difference: how much better a target model predicts a text than a background model.

Both are bigram models backed by unigrams, counted over all words of all their texts, and share one
vocabulary: all distinct words of both, and at least LEAST_WORDS, which leaves mass to unseen ones. Words,
contexts and pairs are told apart by 64-bit hashes. Nothing is cut: what is counted grows
with the texts and is spread over parts by hash, whose number grows as well. A document's score is the mean over its words of
target loss minus background loss; the lower, the more it is like the target.

Texts are read in groups of some GROUP_BYTES. A group asks each part once for the counts of its distinct
n-grams, telling its own; a part adds up what it was told and answers in the order asked, so a frequent
n-gram is one entry a group.

A text without words (null, empty, blank) has no losses to compare: its score and losses are 0.
Repeated rows count each, and get equal scores. An empty target or background model is uniform.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Workspace, read
from .text import U, Powers, chunks, mix, words

WORD_BITS = 18
LEAST_WORDS = 1 << WORD_BITS
GROUP_BYTES = 8 << 20
#: Weight of the bigram estimate, and the pseudo-count of each word.
MIX, PSEUDO = 0.6, 0.1
START = 0x2545F4914F6CDD1D
TARGET, BACKGROUND, SCORED = 1, 2, 4


def ngrams(column: pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of each word, and the hashes of the word, its context and the pair; a text's first word follows a start mark."""
    powers, rows, hashes = Powers(), [np.zeros(0, np.int64)], [np.zeros(0, U)]
    starts = [np.zeros(0, bool)]
    for c in chunks(column):
        w = words(c, powers)
        first = np.ones(len(w.hash), bool)
        first[1:] = w.row[1:] != w.row[:-1]
        rows.append(w.row + c.first)
        hashes.append(w.hash)
        starts.append(first)
    word = np.concatenate(hashes)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.concatenate(starts)] = U(START)
    return np.concatenate(rows), [word, before, mix(mix(before) * U(0x9E3779B97F4A7C15) + word)]


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; it never falls as hashes grow."""
    return ((h >> U(40)) * U(parts) >> U(24)).astype(np.int64)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers, byte by byte of all, without the high bytes that all lack: counts are small, so one to three bytes of eight are left. How many are left comes first."""
    n = np.ascontiguousarray(numbers, dtype=np.int64).view(U)
    width = max(1, -(-int(n.max(initial=U(0))).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(n.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(parts: list[bytes]) -> np.ndarray:
    """The numbers of all parts, one after the other."""
    out = [np.zeros(0, np.int64)]
    for p in parts:
        if p:
            read = np.frombuffer(p, np.uint8)[1:].reshape(p[0], -1)
            n = np.zeros((read.shape[1], 8), np.uint8)
            n[:, : p[0]] = read.T
            out.append(n.view(np.int64).ravel())
    return np.concatenate(out)


def packed(keys: np.ndarray) -> bytes:
    """Rising numbers: the first one, and the steps from each to the next."""
    return keys[:1].tobytes() + planes(np.diff(keys).view(np.int64))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate((np.frombuffer(data[:8], U), unplaned([data[8:]]).view(U))), dtype=U)


@dataclass
class Model:
    """The texts whose n-grams a model counts; they are counted together with those of the texts to score."""

    docs: DataFrame


def count(docs: DataFrame) -> Model:
    return Model(docs)


def _grouped(texts: DataFrame, *carried: str) -> DataFrame:
    """`carried` and __text with the number __g of a group of about GROUP_BYTES, by a hash of the whole row."""
    size = texts.agg(F.sum(F.octet_length("__text").cast("long") + 1)).first()[0] or 0
    return texts.withColumn("__g", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in (*carried, "__text"))), F.lit(size // GROUP_BYTES + 1)).cast("int"))


def _asked(grouped: DataFrame, role: int, parts: int) -> DataFrame:
    """Of each group, part and kind of n-gram (word, context, pair): its distinct hashes in order, and how often each occurs."""

    def run(table: pa.Table) -> pa.Table:
        g = table.column("__g")[0].as_py()
        out = []
        hashes = ngrams(table.column("__text"))[1]
        for kind in range(len(hashes)):
            keys, n = np.unique(hashes.pop(0), return_counts=True)
            cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
            out += [(i, g, role, kind, packed(keys[a:b]), planes(n[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "g", "role", "kind", "keys", "n"])

    return grouped.select("__g", "__text").groupBy("__g").applyInArrow(run, "part int, g int, role int, kind int, keys binary, n binary")


def _answer(table: pa.Table) -> pa.Table:
    """A part's answers to the groups to score, and as group -1 its distinct words and its words in the target and the background."""
    part = table.column("part")[0].as_py()
    names = ["part", "g", "kind", "target", "background", "n_words", "n_target", "n_background"]
    out = []
    for kind in range(3):
        rows = table.filter(pc.equal(table.column("kind"), kind)).to_pylist()
        if not rows:
            continue
        of = [unpacked(r.pop("keys")) for r in rows]
        keys, sizes = np.concatenate(of), [len(k) for k in of]
        del of
        n = unplaned([r.pop("n") for r in rows])
        at = np.unique(keys, return_inverse=True)[1]
        role = np.repeat([r["role"] for r in rows], sizes)
        totals = [np.bincount(at, np.where(role & m, n, 0)).astype(np.int64) for m in (TARGET, BACKGROUND)]
        if kind == 0:
            out.append((part, -1, kind, b"", b"", int(((totals[0] + totals[1]) > 0).sum()), int(totals[0].sum()), int(totals[1].sum())))
        end = np.cumsum(sizes)
        out += [(part, r["g"], kind, *(planes(t[at[e - s : e]]) for t in totals), 0, 0, 0) for r, s, e in zip(rows, sizes, end) if r["role"] & SCORED]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)


def losses(counts: list[np.ndarray], total: int, size: int) -> np.ndarray:
    """Of each word, from how often it, its context and the pair occur in the model's `total` words; `size` is the vocabulary's."""
    word, context, pair = counts
    alone = (word + PSEUDO) / (total + PSEUDO * size)
    after = (pair + PSEUDO * alone) / (context + PSEUDO)
    return -np.log(MIX * np.minimum(after, 1.0) + (1 - MIX) * alone)


def score(docs: DataFrame, target: Model, background: Model, keep: tuple[str, ...] = ("doc_id",), workspace: Workspace | None = None) -> DataFrame:
    """`keep` (without columns named like those made), n_words, target_loss, background_loss (means per word) and score, their difference. `docs` is read twice and must be the same."""
    ws = workspace or Workspace(docs.sparkSession, "lm")
    text = F.col("text").cast("string").alias("__text")
    keep = tuple(c for c in keep if c not in ("n_words", "target_loss", "background_loss", "score"))
    made = ["n_words", "target_loss", "background_loss", "score"]
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), text)
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).withColumns({"n_words": F.lit(0).cast("long")} | {m: F.lit(0.0) for m in made[1:]}).schema
    roles = [(_grouped(source, *names), SCORED | TARGET * (target.docs is docs) | BACKGROUND * (background.docs is docs))]
    if target.docs is background.docs and target.docs is not docs:
        roles.append((_grouped(target.docs.select(text)), TARGET | BACKGROUND))
    else:
        roles += [(_grouped(m.docs.select(text)), role) for m, role in ((target, TARGET), (background, BACKGROUND)) if m.docs is not docs]
    size = sum(d.docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0 for d in (Model(docs), target, background))
    parts = size // GROUP_BYTES + 1
    asked = None
    for grouped, role in roles:
        one = _asked(grouped, role, parts)
        asked = one if asked is None else asked.unionByName(one)
    answers = ws.keep(asked.groupBy("part").applyInArrow(_answer, "part int, g int, kind int, target binary, background binary, n_words long, n_target long, n_background long"), "answers")
    ws.release()
    whole = answers.where("g = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_target", "n_background"))).first()
    vocabulary, totals = max(whole[0], LEAST_WORDS), (whole[1], whole[2])

    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        rows = table.num_rows
        row, hashes = ngrams(table.column("__text"))
        n = np.bincount(row, minlength=rows)
        # A pair has one word and one context, so losses are those of distinct pairs.
        first, pair = np.unique(hashes.pop(), return_index=True, return_inverse=True)[1:]
        distinct, where = [], []
        for _ in range(2):
            keys, at = np.unique(hashes.pop(0), return_inverse=True)
            distinct.append(len(keys))
            where.append(at[first])
        distinct.append(len(first))
        del at, keys, first
        order = pc.sort_indices(answered, sort_keys=[("kind", "ascending"), ("part", "ascending")])
        kinds = answered.column("kind").to_numpy()[order.to_numpy()]

        def mean(name: str, total: int) -> np.ndarray:
            counts = []
            for kind, size in enumerate(distinct):
                told = answered.column(name).take(order.filter(pa.array(kinds == kind)))
                of = unplaned([x.as_py() for x in told])
                if len(of) != size:
                    raise ValueError("the documents changed between two readings")
                counts.append(of[where[kind]] if kind < 2 else of)
            return np.bincount(row, losses(counts, total, vocabulary)[pair], rows) / np.maximum(n, 1)

        means = [mean(name, total) for name, total in zip(("target", "background"), totals)]
        return pa.Table.from_arrays([*(table.column(c) for c in names), pa.array(n.astype(np.int64)), *(pa.array(x) for x in (*means, means[0] - means[1]))], names=[*keep, *made])

    replies = answers.where("g >= 0").select(F.col("g").alias("__g"), "part", "kind", "target", "background")
    return roles[0][0].groupBy("__g").cogroup(replies.groupBy("__g")).applyInArrow(run, schema)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the benchmark's passages as the target and all documents as the background."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, count(read(spark, sf_dir, "benchmark")), count(docs))
