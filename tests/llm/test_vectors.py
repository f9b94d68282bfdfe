import numpy as np
import pytest
from pyspark.sql import functions as F

from denpyo.llm import embedding_dedup, topk_search
from denpyo.llm.components import components
from denpyo.llm.tables import Workspace

NAN, INF = float("nan"), float("inf")


def brute_topk(rows, k, scale):
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, q in sorted(good):
        if i % 100 == 0 and i not in seen:
            seen.add(i)
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 2048])
def test_topk_matches_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(350)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [rows[7], rows[100]]  # ties and repeats
    rows += [(400, None), (None, rows[0][1]), (500, [1.0, None]), (600, [NAN] * 6), (700, [INF] * 6), (800, [1.0] * 4), (801, [2.0] * 4), (900, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("rank", F.lit("own")).repartition(5)
    got = sorted(tuple(r) for r in topk_search.top_k(df.where("id % 100 = 0"), df, 10, 1024.0, block).collect())
    assert got == brute_topk(rows, 10, 1024.0)


def test_topk_large_scores_and_empty(spark):
    rows = [(0, [3e15, 1.0]), (1, [2e15, 7.0]), (2, [2e15, 7.0]), (3, [-3e15, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    with pytest.raises(Exception, match="OverflowError"):
        topk_search.top_k(df.where("id = 0"), df, 2).collect()
    df = spark.createDataFrame([(i, [float(round(x * 3e-7)) if abs(x) > 1e9 else x for x in v]) for i, v in rows], "id long, v array<double>")
    got = [tuple(r)[1:] for r in topk_search.top_k(df.where("id = 0"), df, 2).orderBy("rank").collect()]
    assert got == [(1, 1, 54 * 10**16 + 7), (2, 2, 54 * 10**16 + 7)]
    none = df.where("id < 0")
    assert topk_search.top_k(none, df).count() == 0 and topk_search.top_k(df, none).count() == 0


def brute_links(rows, t):
    ok = [(i, v, l) for i, v, l in rows]
    n = len(ok)
    good = [i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, l in ok]
    links, parent = [0] * n, list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            if good[a] and good[b] and ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]):
                u, v = np.array(ok[a][1], float), np.array(ok[b][1], float)
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= t:
                    links[a] += 1
                    links[b] += 1
                    parent[root(a)] = root(b)
    out = []
    for a in range(n):
        ids = [ok[b][0] for b in range(n) if root(b) == root(a)]
        c = min(ids) if good[a] else ok[a][0]
        out.append((ok[a][0], links[a], c, c is None or c == ok[a][0]))
    return sorted(out, key=str)


def test_embedding_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        base = rng.normal(size=8)
        for k in range(rng.integers(1, 4)):
            rows.append((len(rows), [float(x) for x in base + rng.normal(size=8) * 0.12 * k], int(i % 3)))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)] + [rows[5]]
    rows += [(rows[9][0], rows[40][1], rows[9][2]), (rows[60][0], rows[61][1], rows[60][2])]  # an id with another vector
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [NAN] * 8, 1), (2003, [None] * 8, 1), (2004, rows[5][1], None), (None, rows[5][1], rows[5][2]), (2005, [1.0], 1), (2006, [2.0], 1), (2007, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df, 0.98, tile=32).collect()), key=str)
    assert got == brute_links(rows, 0.98)
    assert embedding_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_repeated_ids_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_code_bounds_hold():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(200, 33))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    code, scale, size, rest = embedding_dedup.quantise(u)
    near = embedding_dedup.code_products(code, code) * scale[:, None] * scale[None, :]
    bound = size[:, None] * rest[None, :] + rest[:, None] * size[None, :] + rest[:, None] * rest[None, :]
    assert (np.abs(near - u @ u.T) <= bound + 1e-12).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7), (None, 4)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 201 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(tuple(r) for r in components(df, Workspace(spark, "t")).collect())
    want = {2: 1, 3: 1, 9: 1, 6: 5} | {100 + i: 100 for i in range(1, 50)} | {201 + i: 200 for i in range(40)}
    # 249 = 200 + 49 is not reached: the chain ends at 240
    assert got == want
    assert components(df.where("a < 0"), Workspace(spark, "t")).count() == 0
