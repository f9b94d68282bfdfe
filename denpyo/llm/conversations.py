"""Conversation structure repair by the auction shortest-path algorithm.

A conversation's rows, by turn (nulls first; ties by role, then the first HEAD characters of the text, then hashes of it), are to give role
initials of the form (s?(ua)+)?. Edits: Keep, Rerole to user or assistant, Delete (required for blank and duplicate rows), Insert an empty row of user or
assistant anywhere. A row's first fault counts: blank (no character other than white space), duplicate (role and text seen earlier in the
conversation), truncated (last such character not . ! or ?). A truncated row that stays costs TRUNCATED more.

The lattice has a node for each row boundary and state of the form; arcs are edits with their integer costs. The auction keeps a path from an
origin and a price for each node: where the cheapest way on, arc and price of its end, exceeds the price of the path's last node, the price rises to it and the path
contracts by a node; else the path extends along that arc. Prices never exceed distances, and the origin's is exact when the path arrives. Boundaries are
settled from the end of the conversation, STRIDE rows at a time, so each path is short. Then every arc of every cheapest path is tight (price equals cost and
the next price); tight arcs that lead to the end are traced letter by letter, by all states at once, for the ASCII-least string of edits.

Long conversations are cut into blocks of BLOCK rows. A block gives the cost from each state before it to each after it; the same auction over these prices all
boundaries; each block then tells from which sets of states the trace leads to which, and at last writes its part of the edits. So no task holds more than BLOCK rows,
and for a conversation 16 numbers for each BLOCK rows, save the stream that applies the edits: the repaired rows of a conversation, and the
chained digest of them, come from one task, which reads the rows in order and holds one letter a row.

Null role and text count as one space. An empty role has no initial and can't be kept. A null turn counts for order only. A null conv_id is a conversation. Repeated rows
are duplicates. A conversation without rows gets zeros, an empty audit and the digest of the empty string. An empty table gives none. Columns of other names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import joined, ranked
from .tables import Workspace, column, read

BLOCK, STRIDE, HEAD = 4096, 8, 64
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Codes of role initials; any other is 3.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: Faults of a row.
FINE, BLANK, DUPLICATE, SHORT = range(4)
#: States: nothing yet, after s, after u, after ua; and where an initial leads.
STATES = 4
NEXT = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
#: What is missing after the last row, in inserted rows, by state.
MISSING = (0, 2, 1, 0)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
NEVER = 1 << 60
ENDS = [m * INSERT for m in MISSING]

Arc = tuple[int, int, str]  # cost, node, letter


def edit_arcs(codes: bytes) -> list[list[Arc]]:
    """Arcs of each node of a run of rows (4 * initial + fault); node 4 * i + q is state q before row i."""
    out: list[list[Arc]] = []
    for i, code in enumerate(codes):
        initial, fault = divmod(code, 4)
        more = TRUNCATED if fault == SHORT else 0
        for q in range(STATES):
            way = NEXT[q]
            turned = way.get(USER) or way[ASSISTANT]
            arcs = [(DELETE, 4 * i + 4 + q, "D"), (INSERT, 4 * i + turned, "I")]
            if fault in (FINE, SHORT):
                if initial in way:
                    arcs.append((more, 4 * i + 4 + way[initial], "K"))
                arcs.append((REROLE + more, 4 * i + 4 + turned, "R"))
            out.append(arcs)
    return out


def block_arcs(matrices: list[list[int]]) -> list[list[Arc]]:
    """The same for a run of blocks, from the cost of each way through a block."""
    return [[(cost, 4 * i + 4 + r, "") for r, cost in enumerate(m[4 * q : 4 * q + 4]) if cost < NEVER] for i, m in enumerate(matrices) for q in range(STATES)]


def auction(arcs: list[list[Arc]], price: list[int], settled: int, origin: int) -> None:
    """Raises prices until a path from origin reaches a node from `settled` on, whose prices are exact; then the origin's price is exact."""
    path = [origin]
    while path[-1] < settled:
        node = path[-1]
        best, to = min((cost + price[j], j) for cost, j, _ in arcs[node])
        if price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def priced(arcs: list[list[Arc]], ends: list[int], stride: int = STRIDE) -> tuple[list[list[Arc]], list[int]]:
    """Arcs that lead to the end, and prices: exact at the first boundary and every `stride` rows, elsewhere at most the distance. ends: costs after the last row (NEVER: none)."""
    n = len(arcs)
    alive = [False] * n + [e < NEVER for e in ends]
    kept: list[list[Arc]] = [[]] * n
    for row in range(n - STATES, -1, -STATES):
        for _ in range(3):  # inserts stay in the row
            for node in range(row, row + STATES):
                alive[node] = alive[node] or any(alive[a[1]] for a in arcs[node])
        for node in range(row, row + STATES):
            kept[node] = [a for a in arcs[node] if alive[a[1]]]
    price = [NEVER] * n + ends
    settled = n
    while settled:
        first = max(0, settled - stride * STATES)
        low = min(price[settled : settled + STATES])
        for node in range(first, settled):
            price[node] = low if alive[node] else NEVER
        for node in range(first, first + STATES):
            if alive[node]:
                auction(kept, price, settled, node)
        settled = first
    return kept, price


def tight_arcs(arcs: list[list[Arc]], price: list[int]) -> list[list[Arc]]:
    """Arcs of cheapest ways: tight, and leading to the end by tight arcs."""
    n = len(arcs)
    good = [False] * n + [p < NEVER for p in price[n:]]
    out: list[list[Arc]] = [[a for a in own if price[node] == a[0] + price[a[1]]] for node, own in enumerate(arcs)]
    for row in range(n - STATES, -1, -STATES):
        for _ in range(3):
            for node in range(row, row + STATES):
                good[node] = good[node] or any(good[a[1]] for a in out[node])
        for node in range(row, row + STATES):
            out[node] = [a for a in out[node] if good[a[1]]]
    return out


def trace(tight: list[list[Arc]], states: frozenset[int] | set[int]) -> tuple[str, set[int]]:
    """The least letters from any of the states before the first row to after the last, and the states there."""
    at, out = set(states), []
    while at and min(at) < len(tight):
        letter = min((a[2] for node in at for a in tight[node]), default=None)
        if letter is None:
            return "".join(out), set()
        at = {a[1] for node in at for a in tight[node] if a[2] == letter}
        out.append(letter)
    return "".join(out), {node - len(tight) for node in at}


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and least edits of a whole conversation."""
    arcs, price = priced(edit_arcs(codes), ENDS)
    piece, states = trace(tight_arcs(arcs, price), {0})
    return price[0], piece + "I" * MISSING[min(states)]


def through(codes: bytes) -> list[int]:
    """The cost of the cheapest way from each state before a run of rows to each after it."""
    columns = [priced(edit_arcs(codes), [0 if r == q else NEVER for r in range(STATES)])[1][:STATES] for q in range(STATES)]
    return [columns[r][q] for q in range(STATES) for r in range(STATES)]


def _subset(code: int) -> set[int]:
    return {q for q in range(STATES) if code >> q & 1}


def leads(codes: bytes, ends: list[int]) -> list[int]:
    """For each set of states (bits) before a run of rows, the set that the trace leads to."""
    arcs, price = priced(edit_arcs(codes), ends)
    tight = tight_arcs(arcs, price)
    return [sum(1 << q for q in trace(tight, _subset(code))[1]) if code else 0 for code in range(1 << STATES)]


# Spark


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role and text of `rows` with null role and text as a space, head, h1, h2 (order), and code without duplicates."""
    get = {n: column(rows, n, "string") for n in ("role", "text")}
    base = rows.select(
        column(rows, "conv_id", rows.schema["conv_id"].dataType.simpleString()).alias("conv"), column(rows, "turn", "long").alias("turn"),
        F.coalesce(get["role"], F.lit(" ")).alias("role"), F.coalesce(get["text"], F.lit(" ")).alias("text"),
    )
    ink = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(F.length(ink) == 0, BLANK).when(~F.substring(ink, -1, 1).isin(".", "!", "?"), SHORT).otherwise(FINE)
    return base.withColumns({"head": F.substring("text", 1, HEAD), "h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1)), "code": (4 * initial + fault).cast("int")})


ORDER = ["turn", "role", "head", "h1", "h2"]
_COUNTED = "blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long"


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for total, block, items in zip(*(batch.column(c).to_pylist() for c in ("total", "block", "items"))):
                own = [x for x in items if x["at"] < size]
                codes = bytes(x["code"] for x in own)
                pairs = list(zip(items, items[1:]))
                turns = [x["turn"] for x in own if x["turn"] is not None]
                row = {"codes": codes, "blank": 0, "duplicate": 0, "truncated": 0}
                for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", SHORT)):
                    row[name] = sum(c % 4 == fault for c in codes)
                row["illegal"] = sum((x["code"] // 4, y["code"] // 4) not in LEGAL for x, y in pairs)
                row["first_turn"], row["last_turn"] = min(turns, default=None), max(turns, default=None)
                row["turns"] = sum(y["turn"] is not None and y["turn"] != x["turn"] for x, y in pairs) + (block == 0 and items[0]["turn"] is not None)
                row["cost"], row["piece"] = repair(codes) if total <= size else (None, None)
                row["matrix"] = None if total <= size else through(codes)
                out.append(row)
            made = pa.RecordBatch.from_pylist(out, pa.schema([("codes", pa.binary()), *((x.split()[0], pa.int64()) for x in _COUNTED.split(", ")), ("cost", pa.int64()), ("piece", pa.string()), ("matrix", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("total"), batch.column("block"), *made.columns], names=["conv", "total", "block", *made.schema.names])

    return run


def _rows(names: list[str], schema: pa.Schema, work):
    """A function for mapInArrow: the column conv as it is, then what `work` makes of the named columns of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.RecordBatch.from_pylist([work(*x) for x in zip(*(batch.column(n).to_pylist() for n in names))], schema)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *made.columns], names=["conv", *schema.names])

    return run


def _boundaries(of_blocks: list[dict]) -> dict:
    _, price = priced(block_arcs([x["matrix"] for x in of_blocks]), ENDS, stride=1)
    return {"cost": price[0], "ends": [price[4 * k + 4 : 4 * k + 8] for k in range(len(of_blocks))]}


def _entries(of_blocks: list[dict]) -> dict:
    at, out = 1, []
    for x in of_blocks:
        out.append(at)
        at = x["leads"][at]
    return {"entries": out}


def _piece(codes: bytes, ends: list[int], entry: int, last: bool) -> dict:
    arcs, price = priced(edit_arcs(codes), ends)
    piece, states = trace(tight_arcs(arcs, price), _subset(entry))
    return {"piece": piece + ("I" * MISSING[min(states)] if last else "")}


def edits(ws: Workspace, marked: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of rows as `faults` gives them: counts of each block, and the pieces of edits (conv, block, piece, cost)."""
    kind = marked.schema["conv"].dataType.simpleString()
    rows = ws.keep(ranked(ws, marked.drop("text"), ["conv"], ORDER), "ranked")
    again = rows.groupBy("conv", "role", "h1", "h2").agg(F.min("index").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = joined(rows, again, ["conv", "role", "h1", "h2"], "left").select("conv", "total", "index", "turn", "code", "first")
    code = F.when((F.col("code") % 4 != BLANK) & (F.col("index") > F.col("first")), F.floor(F.col("code") / 4) * 4 + DUPLICATE).otherwise(F.col("code"))
    own = F.floor(F.col("index") / block).cast("long")
    places = F.array(F.struct(own.alias("block"), (F.col("index") % block).cast("int").alias("at")), F.struct((own - 1).alias("block"), F.lit(block).alias("at")))
    placed = rows.select("conv", "total", "turn", code.cast("int").alias("code"), F.inline(F.slice(places, 1, F.when((F.col("index") > 0) & (F.col("index") % block == 0), 2).otherwise(1))))
    blocks = placed.groupBy("conv", "total", "block").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "code"))).alias("items"))
    done = ws.keep(blocks.mapInArrow(_blocks(block), f"conv {kind}, total long, block long, codes binary, {_COUNTED}, cost long, piece string, matrix array<long>"), "blocks")

    long = done.where(F.col("total") > block)
    by_conv = long.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "matrix"))).alias("m"))
    bounds = by_conv.mapInArrow(_rows(["m"], pa.schema([("cost", pa.int64()), ("ends", pa.list_(pa.list_(pa.int64())))]), _boundaries), f"conv {kind}, cost long, ends array<array<long>>")
    bounds = bounds.select("conv", F.col("cost").alias("whole"), F.posexplode("ends").alias("block", "ends")).withColumn("block", F.col("block").cast("long"))
    last = (F.col("block") == F.floor((F.col("total") - 1) / block)).alias("last")
    ready = ws.keep(joined(long.drop("cost", "piece"), bounds, ["conv", "block"]).select("conv", "block", "codes", "ends", "whole", last), "bounds")
    steps = ready.mapInArrow(_rows(["block", "codes", "ends"], pa.schema([("block", pa.int64()), ("leads", pa.list_(pa.int32()))]), lambda b, c, e: {"block": b, "leads": leads(c, e)}), f"conv {kind}, block long, leads array<int>")
    by_conv = steps.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "leads"))).alias("m"))
    entries = by_conv.mapInArrow(_rows(["m"], pa.schema([("entries", pa.list_(pa.int32()))]), _entries), f"conv {kind}, entries array<int>")
    entries = entries.select("conv", F.posexplode("entries").alias("block", "entry")).withColumn("block", F.col("block").cast("long"))
    pieces = joined(ready, entries, ["conv", "block"]).select("conv", "block", "codes", "ends", "entry", "last", "whole")
    whole = pa.schema([("block", pa.int64()), ("piece", pa.string()), ("cost", pa.int64())])
    pieces = pieces.mapInArrow(_rows(["block", "codes", "ends", "entry", "last", "whole"], whole, lambda b, c, e, s, last, w: {"block": b, "cost": w} | _piece(c, e, s, last)), f"conv {kind}, block long, piece string, cost long")
    return done, done.where(F.col("total") <= block).select("conv", "block", "piece", "cost").union(pieces)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, edit, role, text) of each repaired row, and (conv, None, audit, cost) after each conversation's."""
    conv, seen, audit, at, state, cost = None, False, "", 0, 0, 0

    def inserted():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state = NEXT[state].get(USER) or NEXT[state][ASSISTANT]
            at += 1
            yield conv, "I", "user" if state == 2 else "assistant", ""

    for batch in batches:
        for row in batch.to_pylist():
            if not seen or row["conv"] != conv:
                if seen:
                    yield from inserted()
                    yield conv, None, audit, cost
                conv, seen, pieces, audit, at, state = row["conv"], True, [], "", 0, 0
            if row["text"] is None:
                pieces.append(row["piece"])
                cost = row["cost"]
                continue
            audit = audit or "".join(pieces)
            yield from inserted()
            letter = audit[at]
            at += 1
            if letter == "K":
                state = NEXT[state][{"s": SYSTEM, "u": USER, "a": ASSISTANT}[row["role"][0]]]
                yield conv, letter, row["role"], row["text"]
            elif letter == "R":
                state = NEXT[state].get(USER) or NEXT[state][ASSISTANT]
                yield conv, letter, "user" if state == 2 else "assistant", row["text"]
    if seen:
        yield from inserted()
        yield conv, None, audit, cost


def _flow(marked: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pieces of edits, then rows in order, conversation by conversation."""
    rows = marked.select("conv", F.lit(None).cast("long").alias("block"), *ORDER, "text", F.lit(None).cast("string").alias("piece"), F.lit(None).cast("long").alias("cost"))
    empty = [F.lit(None).cast(marked.schema[c].dataType).alias(c) for c in (*ORDER, "text")]
    both = rows.union(pieces.select("conv", "block", *empty, "piece", "cost"))
    return both.repartition("conv").sortWithinPartitions("conv", F.col("text").isNotNull(), "block", *ORDER).select("conv", "role", "text", "piece", "cost")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, out, hash_, first = None, [], hashlib.sha256(), True
    schema = None

    def full():
        return pa.RecordBatch.from_pylist(out, schema)

    def watched():
        nonlocal kind, schema
        for batch in batches:
            kind = batch.schema.field("conv").type
            schema = pa.schema([("conv", kind), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            yield batch

    for conv, edit, role, text in _applied(watched()):
        if edit is None:
            out.append({"conv": conv, "cost": text, "audit": role, "repaired_sha256": hash_.hexdigest()})
            hash_, first = hashlib.sha256(), True
            if len(out) >= 1000:
                yield full()
                out = []
        else:
            hash_.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
    if out:
        yield full()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, out, place, size = None, [], 0, 0

    def watched():
        nonlocal schema
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv").type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
            yield batch

    for conv, edit, role, text in _applied(watched()):
        if edit is None:
            place = 0
            continue
        out.append({"conv_id": conv, "place": place, "role": role, "text": text, "edit": edit})
        place, size = place + 1, size + len(text)
        if len(out) >= 1000 or size > 1 << 20:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), role, text and edit (K, R or I)."""
    ws, marked = Workspace(rows.sparkSession, "repair"), faults(rows)
    flow = _flow(marked, edits(ws, marked, block)[1])
    return flow.mapInArrow(_listed, f"conv_id {marked.schema['conv'].dataType.simpleString()}, place long, role string, text string, edit string")


def report(rows: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """A row per conversation (of `ids`, a frame with conv_id, too): counts of faults, cost and edits, and the digest of the repaired rows."""
    ws, marked = Workspace(rows.sparkSession, "repair"), faults(rows)
    kind = marked.schema["conv"].dataType.simpleString()
    counted, pieces = edits(ws, marked, block)
    hashed = _flow(marked, pieces).mapInArrow(_digested, f"conv {kind}, cost long, audit string, repaired_sha256 string")
    known = (rows if ids is None else ids).select(F.col("conv_id").alias("conv")).distinct()
    out = counted.select("conv", *(x.split()[0] for x in _COUNTED.split(", "))).unionByName(hashed, True).unionByName(known, True)
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    total = {n: zero(F.sum(n)).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")}
    gaps = zero(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns")).alias("gaps")
    last = [zero(F.max("cost")).alias("cost"), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")]
    return out.groupBy("conv").agg(gaps, *total.values(), *last).withColumnRenamed("conv", "conv_id")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults by the checksum of conv_id and turn: dropped, emptied, without ends of sentences, repeated, or given to the user."""
    text = {n: F.coalesce(column(rows, n, "string"), F.lit(" ")) for n in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    new_text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text["text"], "[.!?]", "")).otherwise(text["text"])
    copies = F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(text["role"]).alias("role"), new_text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return report(damaged(rows), rows)
