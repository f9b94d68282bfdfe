import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from .test_line_dedup import brute as brute_lines
from .test_minhash import brute as brute_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(3)).union(docs.limit(1).select(F.lit(90001).cast("long"), F.lit(None).cast("string"), "lang", "source", "n_chars"))
    names = docs.columns
    results = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, results[-1], SF)
        if k < 4:
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/{k}")
        results.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [[tuple(r) for r in d.collect()] for d in results]
    texts = [[(r.doc_id, r.text) for r in d.collect()] for d in results[:5]]
    # Quality: a subset, and labelled good documents stay.
    assert set(rows[1]) <= set(rows[0])
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {i for i, _ in texts[1]}
    assert len(good & kept) >= 0.97 * len(good) and len(kept) < len({i for i, _ in texts[0]})
    # Lines and groups as by brute force.
    assert sorted(texts[2], key=str) == brute_lines(texts[1])
    want = {g[0] for g in brute_groups(texts[2], 80) if g[3]}
    assert {i for i, _ in texts[3]} == want and len(texts[3]) == len(set(texts[3]))
    # Mixing repeats or leaves out whole rows.
    assert set(rows[4]) <= set(rows[3])
    # Ids are those that the tiktoken library gives, row for row.
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want_ids = sorted((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in texts[4])
    assert sorted((r.doc_id, bytes(r.ids)) for r in results[5].collect()) == want_ids


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_clashing_names_and_ties(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    own = ["_text", "_score", "score", "__text", "_id", "_kept", "node", "keeps", "n", "tokens", "k", "c0", "gone", "ids"]
    docs = docs.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in own))
    first = docs.limit(1)
    docs = docs.union(first.withColumn("n", F.lit("zz"))).union(first.withColumn("n", F.lit("aa")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{c} {r.doc_id}" for c in own if c != "n"), name
            assert r.n in (f"n {r.doc_id}", "aa", "zz")
    again = corpus_pipeline.minhash_stage(spark, docs, SF).where(F.col("doc_id") == first.first().doc_id).collect()
    assert [r.n for r in again] in (["aa"], [])
