import hashlib
import zlib

import numpy as np
import pytest

from denpyo.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i % 16, level[i - i % 16 : i - i % 16 + 16]))
        i //= 16
    return out


def plain(rows):
    """What the query should return, as a sorted list, by whole trees in memory."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], leaf_of(r, r[4]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in by[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources]) if sources else None
    out = []
    for k, s in enumerate(sources):
        for i, (key, own, r) in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, k)
            node = own
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0 and r[4] is not None:
                node = leaf_of(r, r[4].translate(lower))
            for place, run in steps:
                node = h("".join([*run[:place], node, *run[place + 1 :]]))
            proof = h("".join(x for place, run in steps for j, x in enumerate(run) if j != place))
            out.append((key, own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def rows_of(counts):
    rows, key = [], 0
    for source, n in counts:
        for _ in range(n):
            key += 1
            rows.append((key * 7 % 1009 + key, source, "de" if key % 3 else None, key % 50, None if key % 11 == 0 else "" if key % 13 == 0 else f"Tëxt {'A' if key % 2 else 'b'} {key}"))
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run(spark, rows, tmp_path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.op11_merkle_manifest(spark, str(tmp_path))


@pytest.mark.parametrize("counts", [[("a", 1)], [("a", 16), (None, 17), ("", 2)], [("s", 300), ("é", 257), ("z", 256)], [(f"s{i}", 1 + i % 3) for i in range(40)]])
def test_against_plain_trees(spark, tmp_path, counts):
    rows = rows_of(counts)
    got = run(spark, rows, tmp_path)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == plain(rows)


def test_tall_tree(spark, tmp_path):
    rows = rows_of([("hot", 4500), ("b", 40)])  # four steps: blocks of two, twice
    assert sorted((tuple(r)[:7] for r in run(spark, rows, tmp_path).collect()), key=str) == plain(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(5, "a", "x", 1, "T"), (5, "a", "x", 1, "T"), (5, "a", "x", 1, "U"), (None, "a", None, None, None), (None, None, None, None, "Q" * 300_000), (-3, "a", "x", 1, "")]
    got = run(spark, rows, tmp_path)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == plain(rows)
    assert run(spark, [], tmp_path / "none").count() == 0


def test_clashing_names_and_siblings(spark):
    rows = [(i, "a", "x", 1, f"t{i}", "g", "k", "h") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA + ", g string, key string, hash string")
    found = {r.key: r for r in merkle.checked(merkle.manifest(df), siblings=True).collect()}
    want = {r[0]: r for r in plain([r[:5] for r in rows])}
    for k, r in found.items():
        assert (r.leaf, r.root) == (want[k][1], want[k][3]) and r.verified
        assert h("".join(x for level in r.siblings for x in level)) == r.proof_sha256
    assert {len(r.siblings[0]) for r in found.values()} == {15, 7}


@pytest.mark.parametrize("items, steps", [(1, 0), (1, 2), (16, 1), (17, 2), (256, 2), (200, 2), (4096, 3), (4000, 3), (257, 3), (5000, 4), (1, 5)])
def test_addresses_fill_the_block(items, steps):
    sizes = merkle.widths(items, steps)
    places = [merkle.addresses(items, steps, d, np.arange(n)) for d, n in enumerate(sizes)]
    assert sorted(np.concatenate(places).tolist()) == list(range(sum(sizes))) and places[0][0] == 0
    if steps == 3 and items == 4096:  # halves: the upper two levels come first, then each lower subtree in one piece
        assert sorted(np.concatenate(places[:2]).tolist()) == list(range(17))
        assert places[3][0] - places[2][0] == 1 and places[2][1] - places[2][0] == 17


def test_build_and_paths():
    items = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(300)), np.uint8).reshape(-1, 32)
    nodes = merkle.build(items, 3)
    root = nodes[0].tobytes()
    for i, p in enumerate(merkle.paths(nodes, 300, 3)):
        assert merkle.folded(items[i].tobytes(), p) == root and merkle.unpacked(merkle.packed(p)) == p
