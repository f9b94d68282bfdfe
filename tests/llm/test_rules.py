import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from denpyo.llm import rules
from denpyo.llm.tables import Workspace
from denpyo.llm.text import Powers, chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def texts(seed=1, n=200):
    rng, out = random.Random(seed), [None, "", " \n\t", "\n\n", "a", "é漢🙂 # *\r\n\n x\n x\nx", "\n" + "w " * 9, "a b\n" * 40]
    for _ in range(n):
        vocabulary = rng.choice(["a b", "a b c d", "é # 漢 | <x> yy zz $"]).split()
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "\t", " \n", "\r\n", " "]) for _ in range(rng.randint(0, 60))))
    return out


def test_measures_against_plain():
    rows = texts()
    got = [x for c in chunks(pa.array(rows, pa.string()), limit=500) for x in rules.measured_chunk(c, Powers()).T.tolist()]
    assert [tuple(x) for x in got] == [plain(t) for t in rows]


def test_long_text(spark):
    text = "word one two # three\n" * 60_000
    row = rules.measures(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row[m] for m in rules.MEASURES) == plain(text) and row.base_failed


def exact_tail(k, n, share):
    p = Fraction(share).limit_denominator(1000)
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("k, n, share", [(0, 10, 0.2), (3, 50, 0.1), (9, 1000, 0.01), (40, 1000, 0.05), (0, 0, 0.1), (7, 60, 0.1)])
def test_tail_is_the_exact_binomial(k, n, share):
    assert rules.tail(k, n, share) == pytest.approx(float(exact_tail(k, n, share)) if k < n * share else 1.0, rel=1e-9)


def test_chosen_cutoff():
    counts = np.zeros((2, 2, 4), int)  # tuning, label, place: three cutoffs
    counts[1, 0] = [5, 5, 0, 40]
    counts[1, 1] = [0, 0, 3, 100]
    counts[0, 1] = [0, 0, 1, 999]
    assert rules.chosen(counts, 0.01, 0.01) == (1, 1000, 0, rules.tail(0, 1000, 0.01))
    assert rules.chosen(counts, 0.001, 0.01)[0] is None  # too few to tell
    counts[0, 1] = [300, 0, 0, 700]
    assert rules.chosen(counts, 0.01, 0.01)[0] is None
    counts[1, 0] = 0
    assert rules.chosen(counts, 0.5, 0.5)[0] is None  # nothing to gain


def labelled(spark, seed=2, n=6000):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = [rng.choice("the quick brown fox jumps over lazy dogs now and then".split()) + str(rng.randint(0, 999)) for _ in range(rng.randint(22, 40))]
        words = words if good and rng.random() > 0.002 else [w + rng.choice(["", " #", " $ %"]) for w in words]
        docs.append((i, " ".join(words), "en" if i % 10 else None, "x"))
        labels += [(i, int(good))] * (1 + (i % 7 == 0))
    docs += [(n + 1, "short", "xx", None), (n + 2, " ".join(f"w{i} # #" for i in range(30)), "xx", None), (None, None, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, rule string"), spark.createDataFrame(labels + [(1, None), (None, 1), (99999, 1), (2, 7)], "doc_id long, quality int")


def test_guarantee_holds_and_matches_a_plain_run(spark):
    docs, labels = labelled(spark)
    ws = Workspace(spark, "test")
    measured = ws.keep(rules.measures(docs))
    cutoffs = rules.calibrate(ws, measured, labels, limit=0.1)
    got = {(r.stratum, r.rule): (r.cut, r.n_good, r.n_rejected) for r in cutoffs.collect()}
    import zlib

    quality = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality in (0, 1):
            quality.setdefault(r.doc_id, []).append(r.quality)
    rows = [r for r in measured.collect() if r.doc_id in quality and not r.base_failed]
    for stratum in ("en", None):
        for rule, (above, below, much, cuts) in rules.RULES.items():
            counts = np.zeros((2, 2, len(cuts) + 1), int)
            for r in rows:
                if r.lang == stratum:
                    beyond = [1000 * r[above] > c * r[below] if much else 1000 * r[above] < c * r[below] for c in cuts]
                    counts[int(zlib.crc32(str(r.doc_id).encode()) % 10 < 3), int(np.mean(quality[r.doc_id]) >= 0.5), beyond.index(True) if any(beyond) else len(cuts)] += 1
            j, n, k, _ = rules.chosen(counts, 0.1 / len(rules.RULES), 0.05 / (2 * len(rules.RULES)))
            assert got[stratum, rule] == (None if j is None else cuts[j], n, k)
    assert got["en", "symbols"][0] is not None
    judged = rules.judge(measured, cutoffs, 2).collect()
    assert len(judged) == 6003
    good = [r for r in judged if r.doc_id in quality and np.mean(quality[r.doc_id]) >= 0.5 and not r.base_failed]
    assert sum(not r.kept for r in good) <= 0.1 * len(good)
    bad = [r for r in judged if r.doc_id in quality and np.mean(quality[r.doc_id]) < 0.5 and r.lang == "en"]
    assert sum(not r.kept for r in bad) > 0.9 * len(bad)
    by_id = {r.doc_id: r for r in judged}
    assert not by_id[6001].kept and by_id[6001].base_failed and by_id[6002].kept and not by_id[None].kept
    assert {r.rule for r in judged} == {"x", None}  # columns of clashing names stay


def test_no_labels_and_no_rows(spark):
    ws = Workspace(spark, "test")
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a b " * 3, "en"), (2, " ".join(f"w{i}" for i in range(30)), None), (2, " ".join(f"w{i}" for i in range(30)), None)], "doc_id long, text string, lang string")
    measured = rules.measures(docs)
    cutoffs = rules.calibrate(ws, measured, none)
    assert cutoffs.count() == 0 and [(r.doc_id, r.kept) for r in rules.judge(measured, cutoffs, 0).orderBy("doc_id").collect()] == [(1, False), (2, True), (2, True)]
    empty = rules.measures(docs.limit(0))
    assert rules.judge(empty, rules.calibrate(ws, empty, none), 0).count() == 0
