import hashlib
import re

from pyspark.sql import functions as F

from denpyo.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (name, e) in enumerate(PLAIN.items()):
        for m in re.finditer(e, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[name]()
            if ok:
                out.append((k, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "a@b.com_c@d.org x.y+z@mail.example.co.uk, a@b @c.d a@b@c.com", "é漢🙂 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0255 1.2.3",
    "4465758382889437 4465758382889437", "card 4465-7583-8288-9437! 4465758382889436 5500 0000 0000 0004", "+1 (743) 555-3824 éeux +12 3 +1555. +123456789012345678 +1-2",
    "1" * 3000 + "@" + "a" * 3000 + " " + "1 " * 3000 + "x@y." * 500, "a" * 200_000, "1.2.3.4" * 500, "++1 555 123 4567+1 555 123 4567", "x@y.z\nq@w.e 10.0.0.1\t10.0.0.2",
]


def test_base_spans_match_plain_expressions(spark):
    df = spark.createDataFrame([(i if i else None, t, "own") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = plain_spans(t)
        assert [tuple(x) for x in got[i if i else None].base] == want, i
        assert set(want) <= {tuple(x) for x in got[i if i else None].spans}
    assert pii.personal_data(df.limit(0)).count() == 0


def test_query_on_sample(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    names = list(PLAIN)
    rows = pii.op8_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{names[k]}:{s}:{e}" for k, s, e in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"please call telephone +1 555 010 {1000 + i} today") for i in range(12)]
    rows += [(100, "please call telephone 5550109999 today"), (101, "there were 5550109998 of them"), (102, "version 2 is out"), (103, "please call telephone 5550109999 today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.personal_data(df).collect()}
    assert got[100] == got[103] == [(3, 22, 32)] and got[101] == got[102] == [] and len(got[3]) == 1


def plain_graph(rows, rounds=3, support=5, confidence=0.8, accept=0.9):
    """The method on whole texts, with plain dictionaries: (row, kind, start, end) of the spans beyond the base ones."""
    secret = re.compile(pii.EXPRESSIONS["secret"])
    mentions = []
    for i, (_, text) in enumerate(rows):
        text = text or ""
        base = plain_spans(text)
        seeds = base + [(4, m.start(), m.end()) for m in secret.finditer(text) if not any(m.start() < e and m.end() > s for _, s, e in base)]
        found = {k: [x[1:] for x in base if x[0] == k] for k in range(4)}
        for k in found:  # contexts reach to matches of the kind's expression, valid or not
            found[k] = [m.span() for m in re.finditer(list(PLAIN.values())[k], text)]
        found[4] = [m.span() for m in secret.finditer(text)]
        found[-1] = [m.span() for m in re.finditer(pii.CANDIDATE, text)]
        tokens = [(-1, s, e) for s, e in found[-1] if not any(s < y and e > x for _, x, y in seeds)]
        for k, s, e in seeds + tokens:
            near = found[k]
            j = near.index((s, e))
            left = " ".join(text[near[j - 1][0] if j else 0 : s].lower().split()).split(" ")
            right = " ".join(text[e : near[j + 1][1] if j + 1 < len(near) else len(text)].lower().split()).split(" ")
            marks = [f"L{n} " + " ".join(left[-n:]) for n in (1, 2, 3) if left != [""] and left[-1]]
            marks += [f"R {right[0]}"] if right[0] else []
            marks += [f"B {left[-1]} _ {right[0]}"] if right[0] and left[-1] else []
            mentions.append((i, k, s, e, re.sub(r"[\s().-]+", "", text[s:e]).lower(), marks))
    seeds = {}
    for _, k, _, _, v, _ in mentions:
        if k >= 0:
            seeds[v] = min(k, seeds.get(v, k))
    edges = {(p, m[4]) for m in mentions for p in m[5]}
    known = {(v, k): 1.0 for v, k in seeds.items()}
    scores = dict(known)
    for _ in range(rounds):
        rated = {}
        for p in {p for p, _ in edges}:
            values = [v for q, v in edges if q == p]
            for kind in range(5):
                total = sum(scores.get((v, kind), 0.0) for v in values)
                if sum(seeds.get(v) == kind for v in values) >= support and total / len(values) >= confidence:
                    rated[p, kind] = total / len(values)
        miss = {}
        for p, v in edges:
            for kind in range(5):
                if v not in seeds and (p, kind) in rated:
                    miss[v, kind] = miss.get((v, kind), 1.0) * max(1 - rated[p, kind], 1e-6)
        scores = known | {k: 1 - x for k, x in miss.items()}
    best = {}
    for (v, k), x in scores.items():
        if v not in seeds and x >= accept:
            best[v] = max(best.get(v, (0, -9)), (x, -k))
    return sorted([(i, -best[v][1], s, e) for i, k, s, e, v, _ in mentions if k == -1 and v in best] + [(i, 4, s, e) for i, k, s, e, _, _ in mentions if k == 4])


def test_matches_plain_graph_on_planted_contexts(spark):
    rng = __import__("random").Random(3)
    words = [f"w{'abcdefghij'[i % 10]}{'xyz'[i % 3]}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(30)) + "a1"
    rows = [(i, f"{say(4)} reach me at phone +1 555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} or mail u{i}@x.example.com {say(3)}") for i in range(15)]
    rows += [(100 + i, f"{say(2)} token = \"{hexa()}\" {say(2)}") for i in range(9)]
    rows += [(200, f'{say(2)} token = "short99" {say(1)}'), (201, "please reach me at phone (555) 010-9999 or so"), (202, "or mail name@intranet and more"), (203, "in 2020 5 of 99 were 1.2.3.4 and 10.0.0.1")]
    rows += [(300 + i, f"{say(2)} {rng.randrange(100)} {say(2)} host {rng.randrange(255)}.1.2.{i}{rng.choice(['', '.'])} {say(1)}") for i in range(12)] + [rows[3], (400, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in pii.personal_data(df).collect():
        got[r.doc_id] = {tuple(x) for x in r.spans} - {tuple(x) for x in r.base}
    want = {r[0]: set() for r in rows}
    for i, *span in plain_graph(rows):
        want[rows[i][0]].add(tuple(span))
    assert got == want
    assert {k for k, _, _ in got[200]} == {4} and got[201] == {(3, 25, 39)} and {k for k, _, _ in got[202]} == {0} and len(got[100]) == 1


def test_long_texts_of_many_matches_take_linear_time(spark):
    import time

    texts = ["x" + " 1.2.3.4 ab12 cd@ef" * 50_000, " ".join(f"w{i}" for i in range(150_000)), "12 " * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    began = time.time()
    got = {r.doc_id: len(r.base) for r in pii.personal_data(df).collect()}
    assert got == {0: 50_000, 1: 0, 2: 0} and time.time() - began < 90


def test_no_python_on_executors(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string")
    plan = pii.personal_data(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
