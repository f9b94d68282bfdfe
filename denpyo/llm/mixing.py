"""Mixing to target weights by soft membership, in DataFrame operations only.

A naive Bayes classifier learnt from a labelled table gives each document a
posterior over domains. Its features are which markers occur, whole words and runs of symbols that the
labelled documents of the domains tell apart best, and the document's source. Each document
then gets a rate of zero or more such that the expected tokens of each domain, the
sum of rate * tokens * posterior, come as near as possible to the targets: least squares
with a small pull towards rate 1, by Newton steps until the targets are met; a warning tells where they cannot be. A step
needs one row of sums over all documents, and a document's rate follows from its own row and one number a domain,
so no state is kept per document.

Least squares count a change of a document's rate by its tokens in `mixed`, whose rates follow from p alone, and once in `sample`,
whose moves are p times the tokens: of all rates that meet the targets those that add and leave out the fewest rows, so
that a few tokens of a domain in many short documents and some long ones do not repeat the short ones as often as the long ones.
Where no rates meet the targets, those of `sample` are scaled so that its tokens are as many as the targets say of the input's.

Tokens are words (runs of other than white space), none in a null or empty text; such rows bear on no share,
so their rate is 1, however often others are repeated. Repeated rows count each. A null source is a source of its own. Without
labels every domain is equally likely. Markers are at most `words` words and `symbols` runs of symbols, of a sample of at most
PER_DOMAIN labelled documents a domain; every source of that sample has a likelihood.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Workspace, fresh, read

DOMAINS = ("good", "low", "toxic")
#: Shares of the tokens that the mixture shall have.
TARGETS = {"good": 0.95, "low": 0.02, "toxic": 0.03}
#: Runs of up to three symbols, and how many runs and words are markers.
SYMBOL = r"[^\p{L}\p{M}\p{N}\s]{1,3}"
SYMBOLS, WORDS = 12, 40
PER_DOMAIN = 1500


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("double")


def _lowered(text: Column) -> Column:
    """Lower case, with a space on either side of each word."""
    return F.concat(F.lit(" "), F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "\n\t\r", "   "), F.lit(" "))


def _counted(lowered: DataFrame, markers: list[str], *others: Column) -> DataFrame:
    """Columns m0, m1, ... (1 where the marker occurs in t) and tokens beside `others`."""
    return lowered.select(*others, *(F.contains("t", F.lit(m)).cast("double").alias(f"m{i}") for i, m in enumerate(markers)), token_count(F.col("t")).alias("tokens"))


class Classifier:
    """Log-odds of markers by domain, log-probabilities of none, and of sources."""

    def __init__(self, domains: tuple[str, ...], markers: list[str], weights: list[list[float]], priors: list[float], sources: dict[str | None, list[float]]):
        self.domains, self.markers, self.weights, self.priors, self.sources = domains, markers, weights, priors, sources

    def source_logs(self, spark: SparkSession) -> DataFrame:
        """A row a known source, as many at most as the sample has rows."""
        rows = json.dumps([{"known": s, "terms": list(map(float, v))} for s, v in self.sources.items()])
        return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<known:string,terms:array<double>>>")))

    def posteriors(self, docs: DataFrame, *carried: Column) -> DataFrame:
        """k (a struct of `carried`), tokens and the array p of posteriors, in the domains' order."""
        texts = docs.select(F.struct(*carried).alias("k"), _lowered(F.col("text")).alias("t"), F.col("source").cast("string").alias("s"))
        counted = _counted(texts, self.markers, F.col("k"), F.col("s"))
        known = F.broadcast(self.source_logs(docs.sparkSession))
        counted = counted.join(known, F.col("s").eqNullSafe(F.col("known")), "left")
        logs = [sum((F.col(f"m{i}") * w for i, w in enumerate(self.weights[k])), F.lit(prior) + F.coalesce(F.get("terms", F.lit(k)), F.lit(0.0))) for k, prior in enumerate(self.priors)]
        rated = counted.select("k", "tokens", F.array(*logs).alias("logs"))
        # Softmax; a term that overflows makes a posterior of zero.
        p = F.transform("logs", lambda x: 1 / F.aggregate("logs", F.lit(0.0), lambda total, y: total + F.exp(y - x)))
        return rated.select("k", "tokens", p.alias("p"))


def learn(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, words: int = WORDS, symbols: int = SYMBOLS, per_domain: int = PER_DOMAIN) -> Classifier:
    """From `labelled` (doc_id, domain): at most per_domain documents of each domain, picked by a hash of their ids."""
    spark = docs.sparkSession
    labelled = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    have = {r.domain: r.n for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = sum(have.get(d, 0) for d in domains)
    priors = [math.log((have.get(d, 0) + 1) / (n + len(domains))) for d in domains]
    sample = None
    for d in domains:
        part = labelled.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        sample = part if sample is None else sample.union(part)
    chosen = docs.select("doc_id", "text", "source").join(F.broadcast(sample), "doc_id")  # len(domains) * per_domain rows at most
    texts = chosen.select("domain", F.col("source").cast("string").alias("source"), _lowered(F.col("text")).alias("t")).persist()
    words_of, runs_of = F.split(F.trim("t"), r"\s+"), F.regexp_extract_all("t", F.lit(SYMBOL), F.lit(0))
    found = F.concat(
        F.transform(F.array_distinct(words_of), lambda w: F.struct(F.lit(False).alias("symbol"), w.alias("w"))),
        F.transform(F.array_distinct(runs_of), lambda w: F.struct(F.lit(True).alias("symbol"), w.alias("w"))),
    )
    tokens = texts.select("domain", F.explode(found).alias("f")).select("domain", "f.*").where("w <> ''")
    by_word = tokens.groupBy("symbol", "w").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"d{k}") for k, d in enumerate(domains)))
    sizes = {r.domain: r.n for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    # Chi-square of a word's documents by domain.
    total = sum(sizes.values()) or 1
    chi = sum(((F.col(f"d{k}") - F.col("n") * sizes.get(d, 0) / total) ** 2 / (F.col("n") * max(sizes.get(d, 0), 1) / total) for k, d in enumerate(domains)), F.lit(0.0))
    telling = by_word.where("n >= 5")
    runs = [r.w for r in telling.where("symbol").orderBy(F.desc(chi), "w").limit(symbols).collect()]
    markers = [*runs, *(f" {r.w} " for r in telling.where("NOT symbol").orderBy(F.desc(chi), "w").limit(words).collect())]
    sums = _counted(texts, markers, F.col("domain")).groupBy("domain").agg(F.count("*").alias("n"), *(F.sum(f"m{i}").alias(f"m{i}") for i in range(len(markers)))).collect()
    seen = {r.domain: r for r in sums}
    weights = []
    for k, d in enumerate(domains):
        share = [((seen[d][f"m{i}"] if d in seen else 0.0) + 0.5) / (sizes.get(d, 0) + 1) for i in range(len(markers))]
        weights.append([math.log(q / (1 - q)) for q in share])
        priors[k] += sum(math.log(1 - q) for q in share)  # of a document without any marker
    by_source: dict = {}
    counts = texts.groupBy("source").agg(*(F.count_if(F.col("domain") == d).alias(f"d{k}") for k, d in enumerate(domains))).collect()  # no more rows than the sample
    for r in counts:
        by_source[r.source] = [math.log((r[f"d{k}"] + 1) / (sizes.get(d, 0) + len(counts) + 1)) for k, d in enumerate(domains)]
    unknown = [math.log(1 / (sizes.get(d, 0) + len(counts) + 1)) for d in domains]
    texts.unpersist()
    # Relative to an unknown source, so that one without likelihood adds nothing.
    return Classifier(domains, markers, weights, priors, {s: [a - b for a, b in zip(v, unknown)] for s, v in by_source.items()})


def _rate(history: list[list[float]], domains: int, pull: float, lever: Column | None = None) -> Column:
    """A document's rate after the steps whose weighted residuals are in `history`; `lever` multiplies what they move it."""
    step = 1 / (1 + pull)
    if not history:
        return F.lit(1.0)
    past = F.expr(f"array({', '.join('array(' + ', '.join(f'{g!r}D' for g in row) + ')' for row in history)})")

    def move(rate: Column, g: Column) -> Column:
        slope = sum((g[k] * F.col("p")[k] for k in range(domains)), F.lit(0.0))
        slope = slope if lever is None else slope * lever
        return F.greatest(F.lit(0.0), rate - F.lit(step) * (slope + F.lit(pull) * (rate - 1)))

    return F.aggregate(past, F.lit(1.0), move)


def _rated(history: list[list[float]], domains: int, pull: float, lever: Column | None = None, scale: float = 1.0) -> Column:
    """The rate of a row with tokens; 1 of one without, whose copies would bring no domain nearer to its target."""
    return F.when(F.col("tokens") > 0, F.lit(scale) * _rate(history, domains, pull, lever)).otherwise(F.lit(1.0))


def fit_rates(rows: DataFrame, targets: list[float], steps: int = 100, pull: float = 1e-3, enough: float = 1e-4, by_row: bool = False) -> tuple[list[list[float]], list[float]]:
    """A history of one move for `_rate`, and the shares reached; `rows` has tokens and p.

    Minimises the sum over domains of (share - target)**2 / first share, plus a small part of the pull, over rates >= 0; shares
    are of the tokens at rate 1. The pull counts rows by their tokens, or all alike if `by_row`.
    A rate is then max(0, 1 - p * move), times the tokens in p * move if `by_row`, so damped Newton steps in the moves suffice. Stops
    when each share is within `enough` of its target, relative to it. Warns where that is not reached: after `steps`, or where no
    rates meet the targets.
    """
    domains = len(targets)
    total, n = rows.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    if not total:
        return [], []
    t, little, p = np.array(targets), pull * 1e-4, F.col("p")
    mean = total / n if by_row else 1.0
    lever = F.col("tokens") / F.lit(mean) if by_row else F.lit(1.0)
    step = 1 / (1 + pull)
    pairs = [(k, j) for k in range(domains) for j in range(k, domains)]

    def at(move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Shares, their slopes and half the sum of squared rates."""
        rate, w = _rate([[float(m / step) for m in move]], domains, pull, lever), F.col("tokens") / total
        row = rows.where("tokens > 0").select(w.alias("w"), lever.alias("l"), "p", rate.alias("r")).agg(
            *(F.sum(F.col("w") * p[k] * F.col("r")) for k in range(domains)),
            *(F.sum(F.when(F.col("r") > 0, F.col("w") * F.col("l") * p[k] * p[j]).otherwise(0.0)) for k, j in pairs),
            F.sum(F.col("w") / F.col("l") * F.col("r") * F.col("r")),
        ).first()
        slopes = np.zeros((domains, domains))
        for (k, j), x in zip(pairs, row[domains:-1]):
            slopes[k, j] = slopes[j, k] = x
        return np.array(row[:domains]), slopes, row[-1] / 2

    move = np.zeros(domains)
    share, slopes, squares = at(move)
    first = np.maximum(share, 1e-6)
    met = lambda s: bool((np.abs(s - t) <= enough * np.maximum(t, 1e-3)).all())
    left, size = steps, 1.0
    change = None
    while not met(share) and left > 0:
        if change is None:
            slope = t + little * first * move - share
            change = -np.linalg.solve(slopes + little * np.diag(first), slope)
            value, size = t @ move + little / 2 * first @ move**2 + squares, 1.0
            if -(slope @ change) < 1e-14 * max(1.0, abs(value)):
                break
        new = move + size * change
        found = at(new)
        left -= 1
        if t @ new + little / 2 * first @ new**2 + found[2] <= value + 1e-4 * size * (slope @ change):
            move, (share, slopes, squares), change = new, found, None
        else:
            size /= 2
    if not met(share):
        warnings.warn(f"mixing: shares {[round(float(s), 6) for s in share]} miss the targets {list(targets)}", stacklevel=2)
    return ([[float(m / step / mean) for m in move]] if move.any() else []), [float(s) for s in share]


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, key: tuple[str, ...] = ("doc_id",), workspace: Workspace | None = None, **options) -> DataFrame:
    """The `key` columns, tokens, p (posteriors in the targets' order) and rate of each row of docs (doc_id, text, source).

    A key column named like one of the others gets an underscore.
    """
    targets = targets or TARGETS
    ws = workspace or Workspace(docs.sparkSession, "mixing")
    classifier = learn(docs, labelled, tuple(targets))
    rows = ws.keep(classifier.posteriors(docs, *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(key))), "posteriors")
    history, _ = fit_rates(rows, list(targets.values()), **options)
    names = [fresh(("tokens", "p", "rate"), c) for c in key]
    return rows.select(*(F.col(f"k.c{i}").alias(c) for i, c in enumerate(names)), "tokens", "p", _rated(history, len(targets), options.get("pull", 1e-3)).alias("rate"))


def copies(rate: Column, *identity: str) -> Column:
    """How often a document enters: the rate, rounded up or down by a hash of its identity so that totals hold."""
    chance = F.pmod(F.xxhash64(F.lit(17), *(F.col(f"`{c}`") for c in identity)), F.lit(1 << 30)) / F.lit(1 << 30)
    return F.floor(rate + chance).cast("int")


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain from quality and toxic marks."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good").alias("domain"))


def sample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, workspace: Workspace | None = None, **options) -> DataFrame:
    """`docs` as the rates say: each row as often as its copies (never, once, or more), which change as few rows as the targets allow."""
    ws = workspace or Workspace(docs.sparkSession, "mixing")
    targets = targets or TARGETS
    classifier = learn(docs, labelled, tuple(targets))
    names = docs.columns
    rows = ws.keep(classifier.posteriors(docs, *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))), "posteriors")
    history, share = fit_rates(rows.select("tokens", "p"), list(targets.values()), by_row=True, **options)
    scale = sum(targets.values()) / sum(share) if sum(share) > 0 else 1.0
    rated = rows.select("k", copies(_rated(history, len(targets), options.get("pull", 1e-3), F.col("tokens"), scale), "k").alias("n"))
    return rated.where("n > 0").select("k", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*(F.col(f"k.c{i}").alias(c) for i, c in enumerate(names)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(read(spark, sf_dir, "documents"), labelled_domains(read(spark, sf_dir, "labels")), key=("doc_id", "source"))
    p = (F.round(F.col("p")[k], 6).alias(f"p_{d}") for k, d in enumerate(TARGETS))
    return out.select("doc_id", "source", F.col("tokens").cast("long").alias("tokens"), *p, F.round("rate", 6).alias("rate"), copies(F.col("rate"), "doc_id").alias("copies"))
