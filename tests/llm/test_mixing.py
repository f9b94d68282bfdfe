import re

import numpy as np
from pyspark.sql import functions as F

from denpyo.llm import mixing

SF = "/root/testdata/sf0.01"


def test_rates_meet_targets_and_match_numpy(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.3, 0.2], 300)
    tokens = rng.integers(0, 900, 300).astype(float)
    rows = spark.createDataFrame([(i, float(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens double, p array<double>")
    targets = [0.7, 0.25, 0.1]
    history, share = mixing.fit_rates(rows, targets, steps=40)
    assert np.abs(np.array(share) - targets).max() < 2e-3
    r, pull = np.ones(300), 1e-3
    for g in history:
        r = np.maximum(0, r - 1 / (1 + pull) * (p @ np.array(g) + pull * (r - 1)))
    got = np.array([x.r for x in rows.withColumn("r", mixing._rate(history, 3, pull)).orderBy("doc_id").collect()])
    assert np.allclose(got, r, atol=1e-9) and (got >= 0).all()


def test_query_and_posteriors(spark):
    pdf = mixing.op9_mixing(spark, SF).toPandas()
    assert len(pdf) == spark.read.parquet(f"{SF}/documents.parquet").count()
    shares = [(pdf[f"p_{d}"] * pdf.tokens * pdf.rate).sum() / pdf.tokens.sum() for d in mixing.TARGETS]
    assert np.abs(np.array(shares) - list(mixing.TARGETS.values())).max() < 0.01
    known = mixing.labelled_domains(spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    both = pdf.merge(known, on="doc_id")
    best = both[[f"p_{d}" for d in mixing.TARGETS]].to_numpy().argmax(axis=1)
    assert (np.array(list(mixing.TARGETS))[best] == both.domain).mean() > 0.85


def test_posteriors_match_plain_bayes(spark):
    import math
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = mixing.labelled_domains(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    model = mixing.learn(docs, labels, words=6, symbols=3)
    known = {r.doc_id: r.domain for r in labels.where("domain IS NOT NULL").collect()}
    text = {r.doc_id: " " + re.sub("[\n\t\r]", " ", (r.text or "").lower()) + " " for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    inside = {d: [i for i, k in known.items() if k == d and i in text] for d in mixing.DOMAINS}
    of = Counter(known.values())

    def log_terms(i, d):
        n = len(inside[d])
        out = math.log((of[d] + 1) / (len(known) + 3))
        for m in model.markers:
            share = (sum(m in text[j] for j in inside[d]) + 0.5) / (n + 1)
            out += math.log(share if m in text[i] else 1 - share)
        return out + math.log(sum(source[j] == source[i] for j in inside[d]) + 1)

    assert 0 < len(model.markers) <= 9
    got = {r.k.doc_id: (r.tokens, r.p) for r in model.posteriors(docs, F.col("doc_id")).collect()}
    for i in text:
        assert got[i][0] == len(text[i].split())
        logs = [log_terms(i, d) for d in mixing.DOMAINS]  # relative to an unseen source
        e = [math.exp(x - max(logs)) for x in logs]
        assert np.allclose(got[i][1], [x / sum(e) for x in e], atol=1e-9), i


def test_key_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, 8, 9)], "doc_id long, text string, source string, tokens int, p int, _text int")
    none = spark.createDataFrame([], "doc_id long, domain string")
    out = mixing.mixed(docs, none, key=("doc_id", "tokens", "p", "_text"))
    assert out.columns == ["doc_id", "tokens_", "p_", "_text", "tokens", "p", "rate"] and tuple(out.first())[:5] == (1, 7, 8, 9, 2.0)
    assert mixing.sample(docs.withColumn("_all", F.lit("own")), none, {"good": 1.0}).columns == [*docs.columns, "_all"]


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, None, 5), (2, "", "a", 5), (2, "", "a", 5), (None, "some words here", "b", 5), (4, "word " * 50_000, "a", 5)], "doc_id long, text string, source string, rate int")
    none = spark.createDataFrame([], "doc_id long, domain string")
    out = mixing.mixed(docs, none).collect()
    assert len(out) == 5 and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in out)
    assert mixing.mixed(docs.limit(0), none).count() == 0
    got = mixing.sample(docs, none, {"good": 0.5, "low": 0.25, "toxic": 0.25})
    assert got.columns == docs.columns


def test_no_python_on_executors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert not re.search("Python|Pandas|Arrow", mixing.sample(docs, none)._jdf.queryExecution().executedPlan().toString())


def test_residual_relative_to_each_target(spark):
    import warnings

    import pytest

    rng = np.random.default_rng(4)
    p = rng.dirichlet([9, 0.3, 0.3], 400) * 0.9 + np.array([0.08, 0.01, 0.01])
    rows = spark.createDataFrame([(float(t), [float(x) for x in q]) for t, q in zip(rng.integers(1, 900, 400), p)], "tokens double, p array<double>")
    targets = np.array([0.95, 0.02, 0.03])
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        history, share = mixing.fit_rates(rows, list(targets))
    assert (np.abs(np.array(share) - targets) <= 1e-3 * targets).all()
    rate = mixing._rate(history, 3, 1e-3)
    sums = rows.agg(*(F.sum(F.col("tokens") * F.col("p")[k] * rate) / F.lit(rows.agg(F.sum("tokens")).first()[0]) for k in range(3))).first()
    assert np.allclose(sums, share)
    same = spark.createDataFrame([(5.0, [1 / 3] * 3)] * 4, "tokens double, p array<double>")
    with pytest.warns(UserWarning, match="miss the targets"):
        mixing.fit_rates(same, [0.5, 0.25, 0.25])


def test_rows_without_tokens_are_not_repeated(spark):
    docs = spark.createDataFrame([(0, "some words here", "a"), *((i, [None, "", " \n"][i % 3], "a") for i in range(1, 31))], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    targets = {"good": 20.0, "low": 20.0, "toxic": 20.0}  # of one third each: the rate is 60
    rates = {r.doc_id: r.rate for r in mixing.mixed(docs, none, targets).collect()}
    assert abs(rates.pop(0) - 60) < 0.1 and set(rates.values()) == {1.0}
    got = {r.doc_id: r.n for r in mixing.sample(docs, none, targets).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got.pop(0) >= 59 and got == {i: 1 for i in range(1, 31)}


def test_short_documents_are_not_repeated_like_long_ones(spark):
    # Domain low has 1 in 100 tokens, most of them in a few long documents beside very many short ones.
    rows = [(i, 100.0, [0.98, 0.01, 0.01]) for i in range(1000)] + [(1000 + i, 1.0, [0.0, 1.0, 0.0]) for i in range(200)] + [(1200 + i, 200.0, [0.0, 1.0, 0.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, tokens double, p array<double>")
    targets = [0.8428, 0.1486, 0.0086]
    total = sum(t for _, t, _ in rows)
    after = {}
    for by_row in (False, True):
        history, share = mixing.fit_rates(df, targets, by_row=by_row)
        assert (np.abs(np.array(share) - targets) <= 1.1e-4 * np.array(targets)).all()
        lever = F.col("tokens") if by_row else None
        got = df.withColumn("r", mixing._rated(history, 3, 1e-3, lever)).agg(F.sum("r"), *(F.sum(F.col("tokens") * F.col("p")[k] * F.col("r")) for k in range(3))).first()
        assert np.allclose(np.array(got[1:]) / total, share, atol=1e-9)
        after[by_row] = got[0]
    assert after[False] > 2400 and after[True] < 1400


def test_tokens_stay_where_targets_cannot_be_met(spark):
    import pytest

    # The word x marks domain low, which one labelled document of each twenty with it is of: no mixture has a third of it.
    docs = spark.createDataFrame([(i, "x " * (1 + i % 7) + "word " * 90, "a") for i in range(200)] + [(200 + i, "word " * 100, "a") for i in range(200)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, "low" if i % 20 == 0 and i < 200 else "good") for i in range(400)], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="miss the targets"):
        got = mixing.sample(docs, labels, {"good": 0.6, "low": 0.4})
        tokens = got.agg(F.sum(mixing.token_count(F.col("text")))).first()[0]
    assert 0.9 < tokens / docs.agg(F.sum(mixing.token_count(F.col("text")))).first()[0] < 1.1
