import random
import re

import pytest
from pyspark.sql import functions as F

from denpyo.llm import minhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    index, parent = {}, list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    by_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            if i in by_id:
                parent[root(k)] = root(by_id[i])
            by_id[i] = k
    for k, s in enumerate(sets):
        for other in {o for x in s for o in index[x] if o < k}:
            n = len(s & sets[other])
            if rows[k][0] is not None and rows[other][0] is not None and 100 * n >= percent * (len(s) + len(sets[other]) - n):
                parent[root(k)] = root(other)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = i if i is None or not sets[k] else least[root(k)]
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def varied(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("percent,block", [(85, 16), (80, 512)])
def test_matches_brute_force(spark, percent, block):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows, common = [], text(40)
    for i in range(120):
        base = text(rng.randrange(3, 120))
        rows += [(len(rows), varied(rng, base, rng.randrange(4) if k else 0)) for k in range(rng.choice([1, 1, 2, 4]))]
    hot = text(90)
    rows += [(len(rows), varied(rng, hot, rng.randrange(5))) for _ in range(70)]  # a large group of near copies
    rows += [(len(rows), hot) for _ in range(40)]
    rows += [(len(rows), text(20) + " " + common) for _ in range(50)]  # a common passage
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "only three words"), (5004, "ONLY three  words"), (None, hot), rows[3], (5005, "x"), (5006, "x y z a b " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("own")).repartition(3)
    got = sorted((tuple(r) for r in minhash_dedup.near_duplicates(df, percent, block=block).collect()), key=str)
    want = brute(rows, percent)
    assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]
    assert [g for g in got if g[0] is None] == [(None, len(shingle_set(hot)), None, True)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(df).count() == 0
    assert minhash_dedup.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].kept


def test_sample_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in minhash_dedup.op5_minhash_dedup(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()], 85)


def test_bands_follow_the_threshold():
    per_band, bands = minhash_dedup.banding(0.85)
    assert (1 - 0.85 ** (2 * per_band)) ** bands <= 1e-6


def test_texts_travel_instead_of_their_sets(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        base = " ".join(f"word{rng.randrange(10**5)}" for _ in range(300))
        rows += [(2 * i, base), (2 * i + 1, varied(rng, base, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).persist()
    df.count()
    written = lambda: sum(e.totalShuffleWrite() for e in [spark.sparkContext._jsc.sc().statusStore().executorList(True).head()])
    before = written()
    assert minhash_dedup.near_duplicates(df, 85).where("kept").count() == 400
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    share = (written() - before) / sum(len(t) for _, t in rows)
    df.unpersist()
    assert share < 1.5, share


def test_keys_of_small_buckets_hardly_travel(spark):
    rng = random.Random(8)
    key = lambda: rng.getrandbits(64) - (1 << 63)
    large = [key() for _ in range(3000)]
    docs = [(i, [large[i % 3000], *(key() for _ in range(30))]) for i in range(9000)]
    alike = spark.createDataFrame(docs, "rep long, bands array<long>")
    buckets = spark.createDataFrame([(k,) for k in large], "key long")
    sent = minhash_dedup._in_buckets(alike, minhash_dedup._large_keys(buckets)).count()
    assert 9000 <= sent < 11_200  # of 279000
