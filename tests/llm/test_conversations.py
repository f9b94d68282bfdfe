import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from denpyo.llm import conversations as cv


def least_edits(codes):
    """Cost and edits by plain backward distances and memoised strings."""
    n, ways = len(codes), [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]

    def arcs(i, q):
        out = [(3, i, t, "I") for c, t in ways[q].items() if c]
        if i < n:
            initial, fault = divmod(codes[i], 4)
            out.append((4, i + 1, q, "D"))
            if fault in (0, 3):
                more = 3 if fault == 3 else 0
                out += [(more, i + 1, ways[q][initial], "K")] if initial in ways[q] else []
                out += [(3 + more, i + 1, t, "R") for c, t in ways[q].items() if c]
        return out

    left = [[10**9] * 4 for _ in range(n)] + [[0, 6, 3, 0]]
    for i in range(n - 1, -1, -1):
        for _ in range(5):
            for q in range(4):
                left[i][q] = min(left[i][q], *(c + left[j][t] for c, j, t, _ in arcs(i, q)))
    known = {}

    def best(i, q):
        if (i, q) not in known:
            known[i, q] = "" if i == n and q in (0, 3) else min(letter + best(j, t) for c, j, t, letter in arcs(i, q) if left[i][q] == c + left[j][t])
        return known[i, q]

    return left[0][0], best(0, 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=30))
def test_auction_finds_the_least_edits(codes):
    assert cv.repair(bytes(codes)) == least_edits(codes)


def test_prices_are_distances_and_arcs_tight():
    codes = bytes(random.Random(1).choice([0, 4, 8, 4, 8, 12, 1, 6, 7, 11]) for _ in range(100))
    arcs, price = cv.priced(cv.edit_arcs(codes), cv.ENDS)
    assert all(price[i] <= c + price[j] for i, own in enumerate(arcs) for c, j, _ in own)
    assert price[0] == least_edits(codes)[0]
    whole = cv.through(codes[:50])
    assert min(c + price[200 + r] for r, c in enumerate(whole[:4])) == price[0]


def test_long_run_takes_little():
    assert cv.repair(bytes([8] * 20_000))[0] == 3 * 20_000 / 2


SP = lambda x: " " if x is None else str(x)


def plain(rows, damage=True):
    by, out = {}, {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        k = zlib.crc32(f"{SP(conv)}:{SP(turn)}".encode()) % 20 if damage else 9
        role, text = SP(role), SP(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, codes = set(), []
        for _, role, text in own:
            ink = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append(4 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + fault)
        turns = [x[0] for x in own if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = least_edits(codes)
        lines, it = [], iter(own)
        for letter in audit:
            other = "assistant" if lines and lines[-1][0][0] == "u" else "user"
            row = ("", other, "") if letter == "I" else next(it)
            if letter != "D":
                lines.append((row[1] if letter == "K" else other, row[2]))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0][0] for x in lines))
        illegal = sum((a // 4, b // 4) not in {(0, 1), (1, 2), (2, 1)} for a, b in zip(codes, codes[1:]))
        out[conv] = (gaps, *(sum(c % 4 == f for c in codes) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def some_rows(seed, convs=60, long=0):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(long if c == 0 and long else rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No", "", None, " \t", "Well!\n", f"{t}. é漢?", "Same."])
            rows.append((None if c == 5 else c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 1, 2]), role, text))
    return rows


def as_dict(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_query_against_plain(spark, tmp_path):
    rows = some_rows(3)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = as_dict(cv.op12_conversation_repair(spark, str(tmp_path)))
    assert got == plain(rows) and len(got) == 60


@pytest.mark.parametrize("block", [1, 7, 16])
def test_blocks_of_long_conversations(spark, block):
    """Several blocks a conversation give the same as one."""
    rows = some_rows(8, convs=12, long=150)
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(cv.report(df, block=block)) == plain(rows, damage=False)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More?"), (1, 2, "assistant", "Yes."), (2, 0, "system", "S."), (2, 1, "assistant", "A."), (3, 0, "user", "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", conv string, code string")
    got = [tuple(r) for r in cv.repaired(df).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "", "I"), (1, 2, "user", "More?", "K"), (1, 3, "assistant", "Yes.", "K"), (2, 0, "system", "S.", "K"), (2, 1, "user", "", "I"), (2, 2, "assistant", "A.", "K")]


def test_empty_and_dropped(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cv.report(none).count() == 0 and cv.repaired(none).count() == 0
    ids = spark.createDataFrame([(7,), (None,), (7,)], "conv_id long")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert as_dict(cv.report(none, ids)) == {7: nothing, None: nothing}


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "?"), (1, 1, "assistant", "a" * 500_000 + ".")]
    assert as_dict(cv.report(spark.createDataFrame(rows, SCHEMA))) == plain(rows, damage=False)
