import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import types as T

from denpyo.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "Hello world", "It's  a\n\n\ttest  ", "ünïcödé ß 漢字 🙂🙂", "a" * 5000, "x y " * 3000, "\u0000▁▁ tab\t",
    "1234567890" * 50, "don't DON'T 've", " 　mixed​", "!!!###$$$ %%%", "\r\n\r\n", "Hello world",
]


def tiktoken_of():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_tiktoken_and_round_trips(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    docs = spark.createDataFrame([(i if i else None, t, "own") for i, t in enumerate(TEXTS)], schema)
    enc = tiktoken_of()
    got = {r.doc_id: r for r in byte_bpe.digest(docs, PATH, P.PATTERN).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        r = got[i if i else None]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and r.round_trip
    ids = byte_bpe.encode(docs, PATH, P.PATTERN)
    assert ids.columns == ["doc_id", "text", "ids"]
    assert {bytes(r.ids) for r in ids.filter("text = 'Hello world'").collect()} == {np.array(enc.encode_ordinary("Hello world"), "<u4").tobytes()}


def test_sample_documents_match_tiktoken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    enc = tiktoken_of()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in byte_bpe.op3_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digest(docs, PATH, P.PATTERN).count() == 0
