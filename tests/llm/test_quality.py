import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from denpyo.llm import quality
from denpyo.llm.text import Powers, chunks, shingles, words

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = quality.op1_quality(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    pdf = got.toPandas()
    assert len(pdf) == spark.read.parquet(f"{SF}/documents.parquet").count() and pdf.score.between(0, 1).all()
    both = pdf.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert len(both) > 50 and (both.predicted == both.quality).mean() > 0.93
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(pdf.doc_id, pdf.held_out))


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fitted(docs, labels)
    rows = [(1, None), (2, ""), (3, "   \n "), (None, "a b c"), (5, "word " * 200_000), (5, "word " * 200_000), (6, "漢字 🙂")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own"))
    got = quality.score(odd, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert quality.score(odd.limit(0), model).count() == 0


def test_clashing_names(spark):
    import public_tokenizers as P
    from denpyo.llm import byte_bpe, licences, line_dedup, lm_scoring, minhash_dedup

    own = ["_text", "_score", "__text", "_id", "_kept", "tokens", "t", "c0", "gone", "h", "line", "s1", "__g", "matches", "ids", "n_tokens", "score", "k"]
    docs = spark.createDataFrame([(1, "a b c d e\nReleased under the MIT License."), (2, None)], "doc_id long, text string")
    for c in own:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    keep = tuple(c for c in docs.columns if c != "text")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    file, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    made = {
        "score": quality.score(docs, model), "ids": byte_bpe.encode(docs, file, pattern), "n_tokens": byte_bpe.digest(docs, file, pattern, keep=keep),
        "matches": licences.scan(docs, keep), "score ": lm_scoring.score(docs, lm_scoring.count(docs), lm_scoring.count(docs), keep), "": line_dedup.dedup_lines(docs),
    }
    for name, out in made.items():
        rows = out.collect()
        assert len(rows) == 2, name
        for c in set(own) - {name.strip(), "n_words", "round_trip"}:
            assert {r[c] for r in rows} == {f"own {c}"}, (name, c)
    assert minhash_dedup.near_duplicates(docs).count() == 2


def test_long_texts_are_fitted_whole(spark):
    """The one telling passage of a long text decides its label, wherever it is."""
    rng = np.random.default_rng(1)
    plain = ["the", "of", "and", "word", "some", "more", "text"]
    rows, marks = [], []
    for i in range(60):
        words_ = [plain[k] for k in rng.integers(0, len(plain), 64 * 150)]
        if i % 2:
            at = 64 * int(rng.integers(0, 150))
            words_[at : at + 64] = ["$$##%%"] * 64
        rows.append((i, " ".join(words_)))
        marks.append((i, 1 - i % 2))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, q in marks]) > 0.95


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0), (2, 7)], "doc_id long, quality int")
    assert {round(r.score, 3) for r in quality.score(docs, quality.fit(docs, one)).collect()} == {1.0}
    apart = spark.createDataFrame([(8, 1), (9, 0)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, apart)).count() == 2


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    x, begin, y = rng.normal(size=(40, 5)), np.arange(0, 41, 4), rng.integers(0, 2, 10).astype(float)
    before = quality.train(x, begin, y, np.ones(10), epochs=1)
    after = quality.train(x, begin, y, np.ones(10), epochs=200)

    def loss(m):
        s = np.clip(m.score(x, begin), 1e-9, 1 - 1e-9)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    assert loss(after) < 0.3 < loss(before)


def test_words_and_shingles_match_plain_python():
    texts = [None, "", "one", "a b c d", "A b c d e f a b c d e", "tab\tnew\nline\x0bx\x0cy\rz  end ", " ünï ÜNÏ é ", "x" * 300 + " y"] * 3
    for limit in (1, 50, 1 << 20):
        at, sets = 0, []
        for c in chunks(pa.array(texts), limit):
            assert c.first == at
            at = c.last
            w = words(c, Powers())
            h, begin = shingles(w, c.last - c.first, 5)
            sets += [frozenset(h[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:])]
        assert at == len(texts)

        def plain(t):
            low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t or "")
            for sep in "\t\n\x0b\x0c\r":
                low = low.replace(sep, " ")
            ws = [x for x in low.split(" ") if x]
            return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])

        want = [plain(t) for t in texts]
        assert [len(s) for s in sets] == [len(s) for s in want]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(sets[i] & sets[j]) == len(want[i] & want[j])
