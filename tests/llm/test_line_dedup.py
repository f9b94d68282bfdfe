import random
import re

import pytest
from pyspark.sql import functions as F

from denpyo.llm import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def token_set(line, shortest=1):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in line))
    return frozenset(w) if len(w) >= shortest else None


def brute(rows, percent=80, shortest=1):
    """The text left of each row, comparing every line with all earlier ones."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, index, left = [], {}, {}
    for i, text in order:
        out, fresh = [], []
        for line in text.split("\n"):
            s = token_set(line, shortest)
            if s is not None:
                near = {k for x in s for k in index.get(x, ())}
                gone = any((100 + percent) * len(s & seen[k]) >= percent * (len(s) + len(seen[k])) for k in near)
                for x in s:
                    index.setdefault(x, []).append(len(seen))
                seen.append(s)
                if gone:
                    continue
            out.append(line)
        left[i, text] = "\n".join(out)
    return sorted(((i, left.get((i, t))) for i, t in rows), key=str)


def edited(rng, line, k):
    w = line.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**5)}"
    return " ".join(w)


@pytest.mark.parametrize("crowd", [64, 3])
def test_matches_brute_force(spark, crowd):
    rng = random.Random(crowd)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(4000)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bases = [line(rng.randrange(1, 40)) for _ in range(60)]
    hot = line(25)
    rows = []
    for i in range(150):
        parts = [rng.choice(["", "two words", line(rng.randrange(1, 60)), edited(rng, rng.choice(bases), rng.randrange(4)), rng.choice(bases), edited(rng, hot, rng.randrange(4))]) for _ in range(rng.randrange(0, 7))]
        rows.append((i, "\n".join(parts)))
    rows += [rows[5], (900, None), (901, ""), (None, bases[3] + "\n" + hot), (902, "\n\n"), (903, "\r\n".join([hot.upper(), "x y z a b", "b a z y x"])), (904, "\n".join(["long tail of words"] * 3 + ["q w e r t y " * 3000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("own")).withColumn("line", F.lit(1)).repartition(3)
    out = line_dedup.dedup_lines(df, crowd=crowd)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute(rows)


def test_empty_and_sample(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(none).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_least_length_is_an_option(spark):
    rows = [(1, "a b c\na b c\na b c d e"), (2, "a b c d e\na b c")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), shortest=5).collect()
    assert sorted((r.doc_id, r.text) for r in got) == brute(rows, shortest=5) == [(1, rows[0][1]), (2, "a b c")]


@pytest.mark.parametrize("crowd", [1024, 20])
def test_thousands_of_variants_of_one_line(spark, crowd, monkeypatch):
    """Variants near and far from the first one, in one crowd; with a small CROWD, and with tokens that stand out."""
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 64 if crowd > 20 else 1 << 40)
    monkeypatch.setattr(line_dedup, "SHARE", 7)
    rng = random.Random(7)
    base = " ".join(f"b{i}" for i in range(20))
    rows = [(i, edited(rng, base, rng.choice([0, 1, 2, 3, 3, 4])) + "\n" + edited(rng, base, rng.randrange(6))) for i in range(1200)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), crowd=crowd).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute(rows)


def test_short_lines_take_part(spark, tmp_path):
    """Query and stage against brute force without a least length; four tokens are similar to five that hold them."""
    import corpus_pipeline

    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 8)))
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(200)]
    rows += [(300, "a b c d\n\nAll rights reserved."), (301, "a b c d e\nall RIGHTS reserved.\n "), (302, "q r s\nq r s t\nz\nz z\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert dict(want)[301] == " " and dict(want)[302] == "q r s\nq r s t\nz"
    got = corpus_pipeline.line_stage(spark, df, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    removed = {r.doc_id: r.n_removed for r in line_dedup.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert removed[301] == 2 and removed[302] == 2


def test_words_of_odd_bytes():
    import numpy as np
    import pyarrow as pa

    from denpyo.llm import text

    texts = ["", "Ab aB\tx\x0by\x0c[z{ @A", " ", "\n\nÀé 日本 \x08\x0e end", None, "Z", "a" * 3 + " b", "", bytes(range(1, 128)).decode(), "\r"]
    (c,) = text.chunks(pa.array(texts))
    found, again = {}, {}
    w = text.words(c, text.Powers())
    got = [(int(r), bytes(c.data[a:b])) for r, a, b in zip(w.row, w.start, w.end)]
    assert got == [(i, x) for i, t in enumerate(texts) for x in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())]
    for (_, x), h in zip(got, w.hash.tolist()):
        assert found.setdefault(x.lower(), h) == h and again.setdefault(h, x.lower()) == x.lower()
    # The hash is that of earlier versions: a polynomial of bytes + 1, lower-cased.
    up = np.multiply.accumulate(np.array([1, text.MUL, text.MUL, text.MUL], np.uint64))
    assert w.hash[0] == text.mix((np.array([98, 99], np.uint64) * up[:2]).sum(keepdims=True) + np.uint64(2))[0]


def test_counts_of_tokens_travel_in_few_rows(spark):
    import numpy as np

    docs = spark.range(6000).selectExpr("concat_ws(' ', transform(sequence(1, 20), x -> concat('w', id * 20 + x % 19))) AS text").repartition(6)
    rows = line_dedup.token_counts(docs, 1).collect()
    assert len({r.first for r in rows}) == len(rows) <= (1 << line_dedup.TABLE_BITS) // line_dedup.COUNTS
    assert sum(np.frombuffer(r.n, np.int64).sum() for r in rows) == 120_000
