import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from denpyo.llm import licences, lm_scoring

SF = "/root/testdata/sf0.01"


def test_licences_in_documents(spark):
    got = {r.doc_id: r for r in licences.op2_licence_scan(spark, SF).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    hits = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = sorted({name for line, name in lines.items() if line in r.text.split("\n")})
        hits += bool(want)
        assert got[r.doc_id].licences == ",".join(want), r.doc_id
        for s in filter(None, got[r.doc_id].spans.split(",")):
            name, a, b = s.rsplit(":", 2)
            assert lines[r.text[int(a) : int(b)]] == name
    assert hits > 10


def test_rules_need_order_and_nearness():
    s = licences.Scanner()
    t = {k: v + "." for k, v in licences.SENTENCES.items()}
    bsd = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]
    assert [m[0] for m in s.scan("\n".join(t[k] for k in bsd))] == ["BSD-3-Clause"]
    assert [m[0] for m in s.scan("\n".join([t["bsd-grant"], "x y.", t["bsd-source"], t["bsd-binary"]]))] == ["BSD-2-Clause"]
    assert s.scan("\n".join([t["bsd-source"], t["bsd-grant"], t["bsd-binary"]])) == []
    assert s.scan("\n".join([t["bsd-grant"], "x.", "y.", t["bsd-source"], t["bsd-binary"]])) == []
    assert [m[0] for m in s.scan("  RELEASED under  the mit license!\nreleased under the MIT License")] == ["MIT", "MIT"]
    assert s.scan(None) == s.scan("") == s.scan("The license is unknown.") == []


def test_licence_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (4, "word " * 100_000), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit("own"))
    got = [(r.doc_id, [m.licence for m in r.matches]) for r in licences.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (2, []), (4, []), (None, ["MIT"])], key=str) and licences.scan(df.limit(0)).count() == 0


def plain_model(texts):
    words, contexts, pairs = Counter(), Counter(), Counter()
    for t in texts:
        ws = ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", t.lower())]
        words.update(ws[1:])
        contexts.update(ws[:-1])
        pairs.update(zip(ws, ws[1:]))
    total, size = sum(words.values()), 1 << lm_scoring.WORD_BITS

    def loss(a, b):
        alone = (words[b] + lm_scoring.PSEUDO) / (total + lm_scoring.PSEUDO * size)
        after = (pairs[a, b] + lm_scoring.PSEUDO * alone) / (contexts[a] + lm_scoring.PSEUDO)
        return -math.log(lm_scoring.MIX * min(after, 1) + (1 - lm_scoring.MIX) * alone)

    return loss


def test_scores_match_plain_python(spark):
    target, other = ["a b c d a b", "a b"], ["x y z", "a x b y", ""]
    df = lambda ts: spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id long, text string")
    docs = [*target, *other, "A b\nq", None, " ", "w " * 200_000]
    rows = lm_scoring.score(df(docs).withColumn("score", F.lit(1)), lm_scoring.count(df(target)), lm_scoring.count(df(other))).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (docs[r.doc_id] or "").lower())]
        assert r.n_words == len(ws) - 1
        for loss, got in ((plain_model(target), r.target_loss), (plain_model(other), r.background_loss)):
            assert got == pytest.approx(np.mean([loss(a, b) for a, b in zip(ws, ws[1:])]) if len(ws) > 1 else 0.0, abs=1e-9)
    none = df([])
    assert lm_scoring.score(none, lm_scoring.count(none), lm_scoring.count(none)).count() == 0


def test_benchmark_passages_score_low(spark):
    pdf = lm_scoring.op7_lm_scoring(spark, SF).toPandas().set_index("doc_id")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    holding = [i for i, t in docs.items() if any(x in t for x in items)]
    assert holding and pdf.score[holding].median() < pdf.score.quantile(0.2)


def test_more_pairs_than_any_fixed_table(spark, monkeypatch):
    """2**20 pairs and 2**18 words once shared buckets; the plain model tells all apart."""
    monkeypatch.setattr(lm_scoring, "GROUP_BYTES", 1 << 20, raising=False)
    rng = np.random.default_rng(7)
    docs = [" ".join(f"w{x}" for x in rng.integers(0, 500_000, 1000)) for _ in range(1300)]
    target = docs[:20] + ["w1 w2 w3"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4).cache()
    split = [["<s>", *d.split()] for d in docs]
    pairs = Counter(p for ws in split for p in zip(ws, ws[1:]))
    assert len(pairs) > 1 << 20
    goal = [["<s>", *d.split()] for d in target]
    size = len({w for ws in split + goal for w in ws[1:]})
    assert size > 1 << lm_scoring.WORD_BITS

    def model(texts, pairs):
        words, contexts = Counter(w for ws in texts for w in ws[1:]), Counter(w for ws in texts for w in ws[:-1])
        total = sum(words.values())

        def loss(a, b):
            alone = (words[b] + lm_scoring.PSEUDO) / (total + lm_scoring.PSEUDO * size)
            after = (pairs[a, b] + lm_scoring.PSEUDO * alone) / (contexts[a] + lm_scoring.PSEUDO)
            return -math.log(lm_scoring.MIX * min(after, 1) + (1 - lm_scoring.MIX) * alone)

        return loss

    models = (model(goal, Counter(p for ws in goal for p in zip(ws, ws[1:]))), model(split, pairs))
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = {r.doc_id: r for r in lm_scoring.score(df, lm_scoring.count(aims), lm_scoring.count(df)).collect()}
    assert len(got) == len(docs)
    for i in range(0, len(docs), 13):
        for loss, have in zip(models, (got[i].target_loss, got[i].background_loss)):
            assert have == pytest.approx(np.mean([loss(a, b) for a, b in zip(split[i], split[i][1:])]), abs=1e-9)


def test_wrapped_licence_texts():
    import textwrap

    t = {k: v if v.endswith(":") else v + "." for k, v in licences.SENTENCES.items()}
    wrap = lambda x, first="", rest="": textwrap.fill(x, 72, initial_indent=first, subsequent_indent=rest)
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n\n" + wrap(t["mit-grant"]) + "\n\n" + wrap(t["mit-notice"])
    bsd2 = "\n".join([wrap(t["bsd-grant"]), "", wrap(t["bsd-source"], "1. ", "   "), wrap(t["bsd-binary"], "2. ", "   ")])
    bsd3 = bsd2 + "\n" + wrap(t["bsd-endorse"], "3. ", "   ")
    gpl3 = wrap(t["gpl-grant"], "# ", "# ") + "\n#\n" + wrap(t["gpl-warranty"][:-1] + "; without even the implied warranty.", "# ", "# ")
    old = lambda *k: wrap("; ".join(licences.SENTENCES[x] for x in k) + ".", " * ", " * ")
    texts = {
        "MIT": mit, "BSD-2-Clause": bsd2, "BSD-3-Clause": bsd3, "GPL-3.0-or-later": gpl3,
        "GPL-2.0-or-later": old("gpl-free", "gpl-terms", "version-2-later"), "LGPL-2.1-or-later": old("lgpl-free", "lgpl-terms", "version-21-later"),
        "AGPL-3.0-or-later": wrap(t["agpl3-grant"]), "MPL-2.0": wrap(t["mpl-form"] + " 2.0."), "ISC": wrap(t["isc-grant"]), "Unlicense": wrap(t["unlicense"]),
    }
    for name, text in texts.items():
        for ending in ("\n", "\r\n"):
            whole = f"Some words before\n\n{text}\n\nand after".replace("\n", ending)
            found = licences.Scanner().scan(whole)
            assert [m[0] for m in found] == [name], (name, found)
            assert whole[found[0][1] :].split()[0] in text and whole[found[0][2] :].strip()


def test_numbers_travel_in_few_bytes():
    import numpy as np

    from denpyo.llm import lm_scoring

    for numbers in ([], [0], [0, 1, 255], [3, 70_000, 0], [2**62, 5]):
        assert lm_scoring.unplaned([lm_scoring.planes(np.array(numbers, np.int64)), b""]).tolist() == numbers
    assert len(lm_scoring.planes(np.arange(200))) < 220 and len(lm_scoring.planes(np.arange(0, 60_000, 300))) < 420
    for keys in ([0], [2**64 - 1], [5, 6, 2**40, 2**64 - 1]):
        assert lm_scoring.unpacked(lm_scoring.packed(np.array(keys, np.uint64))).tolist() == keys
    near = (np.arange(1000, dtype=np.uint64) << np.uint64(30)) + np.uint64(2**63)
    assert len(lm_scoring.packed(near)) < 4100 and (lm_scoring.unpacked(lm_scoring.packed(near)) == near).all()
