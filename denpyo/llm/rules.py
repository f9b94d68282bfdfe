"""Quality rules whose cutoffs carry a guarantee.

A rule compares a ratio of two measures of a text with a cutoff. Cutoffs are learnt for each stratum (a language) from labelled
documents that the base rules leave. Of these, a part picked by a hash of the id is for tuning: a rule's candidate is the cutoff, from lax to strict, that
rejects the most label-0 documents less PRICE for each label-1 document (the laxest such; none if that gains nothing). The other labelled documents are the
holdout: from the laxest cutoff on, each is tested with the exact binomial tail P(X <= rejected label-1 documents), X ~ Bin(label-1 documents, share);
cutoffs of a rule are nested and tested in that order until one fails, so a rule of a stratum is one test, and Bonferroni's correction divides RISK by
the number of strata times rules. The last certified cutoff up to the candidate holds; without one the rule rejects nothing in that stratum. The share is
LIMIT over the number of rules. So with confidence 1 - RISK, for all strata at once, all rules together reject at most LIMIT of the stratum's
label-1 documents, as far as the labelled rows are a fair draw.

A null or empty text has no words and fails the base rules. A null stratum is one of its own; a stratum without labels has no cutoffs, and its
documents are judged by the base rules alone. A document labelled more than once counts with its mean, from 0.5 on as 1; labels other than 0 and 1
and labels of unknown documents are ignored; repeated documents count each. An empty table gives none. Words are told apart by 64 bits of hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import joined
from .tables import Workspace, column, fresh, read, small_batches
from .text import MUL, Chunk, Powers, U, _space, chunks, mix, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Rules: numerator, denominator, whether too much (or too little) of it is bad, cutoffs in thousandths from lax to strict.
RULES = {
    "symbols": ("n_symbols", "n_words", True, (2000, 1500, 1000, 700, 500, 350, 250, 200, 150, 100, 70, 50)),
    "duplicate_lines": ("n_dup_lines", "n_lines", True, (950, 900, 850, 800, 750, 700, 650, 600, 550, 500, 450, 400, 350, 300)),
    "repeats": ("n_repeat_words", "n_words", True, (275, 250, 225, 200, 175, 150, 125, 100)),
    "long_words": ("word_chars", "n_words", True, (12000, 11000, 10000, 9500, 9000, 8500, 8000, 7500, 7250, 7000, 6750, 6500)),
    "short_words": ("word_chars", "n_words", False, (2000, 2250, 2500, 2750, 3000, 3250, 3500, 3750, 4000)),
}
LIMIT, RISK, PRICE = 0.05, 0.05, 10
#: Tenths of the labelled documents that are for tuning.
TUNING = 3
#: Strata whose cutoffs may be broadcast: 100 bytes each.
FEW_STRATA = 20_000

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS.encode())] = True


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])


def _twice(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by owner and key, and in that order which entries equal the one before, and which any neighbour."""
    order = np.lexsort((key, owner))
    again = np.zeros(len(key), bool)
    again[1:] = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    shared = again.copy()
    shared[:-1] |= again[1:]
    return order, again, shared


def measured_chunk(c: Chunk, powers: Powers) -> np.ndarray:
    """MEASURES (rows) of each text (columns)."""
    rows, data = len(c.ends), c.data
    bounds = np.concatenate(([0], c.ends)).astype(np.int64)
    w = words(c, powers, lower=False)
    n_words = np.bincount(w.row, minlength=rows) if len(w.row) else np.zeros(rows, np.int64)
    ink = ~_space[data]
    chars, symbols = _per_row(ink & ((data & 0xC0) != 0x80), bounds), _per_row(_symbol[data], bounds)

    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((bounds[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((bounds[1:], breaks)), kind="stable")
    inked = np.concatenate(([0], np.cumsum(ink)))
    start, end = (x[inked[end] > inked[start]] for x in (start, end))
    owner = np.searchsorted(c.ends, start, side="right")
    up, down = powers.upto(len(data) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)])))
    order, again, _ = _twice(owner, mix((total[end] - total[start]) * down[start] + (end - start).astype(U)))
    lines, dup_lines = np.bincount(owner, minlength=rows), np.bincount(owner[order[again]], minlength=rows)

    repeated = np.zeros(rows, np.int64)
    windows = len(w.hash) - WINDOW + 1
    if windows > 0:
        h = np.zeros(windows, U)
        for j in range(WINDOW):
            h = h * U(MUL) + w.hash[j : j + windows]
        inside = np.flatnonzero(w.row[:windows] == w.row[WINDOW - 1 :])
        order, _, shared = _twice(w.row[inside], mix(h[inside]))
        first = inside[order[shared]]
        covered = np.bincount(first, minlength=len(w.hash) + 1)
        covered[: len(w.hash) + 1] -= np.bincount(first + WINDOW, minlength=len(w.hash) + 1)
        repeated = np.bincount(w.row[np.cumsum(covered)[:-1] > 0], minlength=rows)
    return np.stack([n_words, chars, symbols, lines, dup_lines, repeated])


def measures(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of docs (all if None), MEASURES (long, in place of columns of those names) and base_failed."""
    small_batches(docs.sparkSession)
    out = [*MEASURES, "base_failed"]
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in out]
    text = fresh([*carried, *out], "t")
    source = docs.select(*(F.col(f"`{c}`") for c in carried), column(docs, "text", "string").alias(text))
    schema = source.drop(text).withColumns({m: F.lit(0).cast("long") for m in MEASURES}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for c in chunks(batch.column(text)):
                own = batch.slice(c.first, c.last - c.first)
                found = measured_chunk(c, powers)
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(len(carried))), *(pa.array(x, pa.int64()) for x in found)], names=[*carried, *MEASURES])

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return source.mapInArrow(run, schema).withColumn("base_failed", failed)


def _beyond(rule: str, cut: Column) -> Column:
    """Whether a row's ratio is beyond a cutoff; exact."""
    above, below, much, _ = RULES[rule]
    left, right = 1000 * F.col(above), cut * F.col(below)
    return left > right if much else left < right


def tail(k: int, n: int, share: float) -> float:
    """P(X <= k), X ~ Bin(n, share), for k below the mean; 1 from there on."""
    if k >= n * share:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
    whole = term = 1.0
    for i in range(k, 0, -1):
        term *= i * (1 - share) / ((n - i + 1) * share)
        whole += term
        if term < 1e-17 * whole:
            break
    return min(1.0, math.exp(log) * whole)


def chosen(counts: np.ndarray, share: float, level: float) -> tuple[int | None, int, int, float]:
    """A rule's cutoff in one stratum: its number or None, the label-1 documents of the holdout, those it rejects, and the tail.

    counts[tuning, label, place]: documents that the cutoffs before `place` (of lax to strict) keep and all from there on reject.
    """
    rejected = np.cumsum(counts, axis=2)[:, :, :-1]
    gain = rejected[1, 0] - PRICE * rejected[1, 1]
    candidate = int(np.argmax(gain)) if len(gain) and gain.max() > 0 else -1
    n, best = int(counts[0, 1].sum()), (None, int(counts[0, 1].sum()), 0, 1.0)
    for j in range(candidate + 1):
        k = int(rejected[0, 1, j])
        p = tail(k, n, share)
        if p > level:
            break
        best = j, n, k, p
    return best


def calibrate(ws: Workspace, measured: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """stratum, rule, cut (thousandths, null if none is certified), n_good, n_rejected, tail: a row for each stratum with labels and rule.

    measured: doc_id, the stratum, MEASURES, base_failed. labels: doc_id, quality.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("label"))
    tuning = (F.crc32(F.col("id").cast("string").cast("binary")) % 10 < TUNING).cast("int")
    placed = []
    for rule, (*_, cuts) in RULES.items():
        place = sum((~_beyond(rule, F.lit(c))).cast("int") for c in cuts)
        placed.append(F.struct(F.lit(rule).alias("rule"), place.alias("place")))
    rows = measured.where("NOT base_failed").join(known, measured["doc_id"] == known["id"]).select(measured[stratum].alias("stratum"), "label", tuning.alias("tuning"), F.inline(F.array(*placed)))
    counts = ws.keep(rows.groupBy("stratum", "rule", "label", "tuning", "place").count(), "counts")
    tests = len(RULES) * max(1, counts.select("stratum").distinct().count())
    share, level = limit / len(RULES), risk / tests

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        rule = group["rule"].iloc[0]
        cuts = RULES[rule][3]
        table = np.zeros((2, 2, len(cuts) + 1), np.int64)
        np.add.at(table, (group["tuning"].to_numpy(), group["label"].to_numpy(), group["place"].to_numpy()), group["count"].to_numpy())
        j, n, k, p = chosen(table, share, level)
        return pd.DataFrame({"stratum": [group["stratum"].iloc[0]], "rule": [rule], "cut": pd.array([None if j is None else cuts[j]], "Int64"), "n_good": [n], "n_rejected": [k], "tail": [p]})

    kind = measured.schema[stratum].dataType.simpleString()
    return counts.groupBy("stratum", "rule").applyInPandas(decide, f"stratum {kind}, rule string, cut long, n_good long, n_rejected long, tail double")


def judge(measured: DataFrame, cutoffs: DataFrame, strata: int, stratum: str = "lang") -> DataFrame:
    """`measured` with rejected_by (names of the rules beyond whose cutoff the row is) and kept; strata: about how many `cutoffs` has."""
    wide = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))  # a row per stratum, of a few rules
    wide = wide.withColumnsRenamed({"stratum": stratum, "cuts": (cuts := fresh(measured.columns, "cuts"))})
    wide = F.broadcast(wide) if strata <= FEW_STRATA else wide
    rows = joined(measured, wide, [stratum], "left")
    found = F.array(*(F.when(_beyond(r, F.col(cuts)[r]), F.lit(r)) for r in RULES))
    found = F.filter(found, lambda x: x.isNotNull())
    return rows.select(*(F.col(f"`{c}`") for c in measured.columns), found.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "rules")
    measured = ws.keep(measures(read(spark, sf_dir, "documents"), keep=["doc_id", "lang"]), "measured")
    cutoffs = ws.keep(calibrate(ws, measured, read(spark, sf_dir, "labels")), "cutoffs")
    out = judge(measured, cutoffs, cutoffs.count() // len(RULES))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
