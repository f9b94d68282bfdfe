"""Line dedup by an exact set-similarity join.

A line is the set of its words (runs of bytes other than space and \\t..\\r, A-Z
lower-cased). Tokens are ordered by how often their bucket of a table of fixed size
occurs in all lines, rarest first. Two similar sets share a token in their prefixes, the
shorter one in the first few of them already; pairs that share one and pass the length and
positional filters, and whose 128-bit maps of the parities of tokens differ in no more places than
similar sets can, are verified by their Jaccard similarity on whole sets. A line is removed where a
similar line comes earlier, by doc_id, then text hash, then line number, whether that one
stays or not.

Equal sets are one group from the start. One earlier similar line decides, so the few candidates
of each set whose maps differ least are verified first; only sets that this leaves open meet all
their candidates. Sets that share a token are compared side by
side in the partition of that token. A token in more than CROWD prefixes, or in so many that it
would stand out in a partition, takes another way: its sets first try the earliest one of about their
length, then all. This is exact; only a crowd of mutually unlike lines that share rare tokens costs the square of its size.

Lines of fewer than `shortest` words are never removed; by default every line with a word
takes part. Sets too small to be similar to any other (three tokens or fewer
at 80 percent) meet their equals only and have no prefix. A null text stays null; a text
loses its lines only. Repeated rows (same id and text) count as one document: neither removes the
other's lines. Null ids come first. Extra columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Workspace, bitmap, maybe_in, read
from .text import Chunk, U, Powers, chunks, mix, words

TABLE_BITS = 18
CROWD = 1024
SHORTEST = 1
#: A token is 48 bits of its word's hash, TABLE_BITS of which name its bucket; 16 bits of line make it a sortable number.
LINES, TOKEN = 1 << 16, U((1 << 48) - 1)
LOW = U(48 - TABLE_BITS)
#: An entry's number: 40 bits of its token, 16 of the set's size, 8 of the token's position; larger ones count as the largest.
MOST_N, MOST_I = (1 << 16) - 1, (1 << 8) - 1
#: Buckets of tokens that stand out in a task: more than HOT_LEAST entries and more than one in HOT_SHARE.
HOT_BITS, HOT_LEAST, HOT_SHARE = 20, 64, 2000
#: Buckets whose counts travel as one row, and documents whose hashes may be broadcast.
COUNTS, BROADCAST = 512, 1 << 18
#: Candidates that a set tries first.
FIRST = 4
#: Entries of a partition, on average at most, those that a task deals out at a time, and those whose tokens are compared at a time.
ENTRIES, DEALT, COMPARED = 1 << 20, 1 << 18, 1 << 12
#: Sets that are verified against one copy of another.
SHARE = 256
#: Pairs compared at a time, and bytes of token sets verified at a time.
PAIRS, VERIFIED = 1 << 20, 1 << 23


class Lines:
    """The eligible lines of a chunk and their words."""

    def __init__(self, c: Chunk, powers: Powers, shortest: int):
        breaks = np.flatnonzero(c.data == 10) + 1
        ends = np.unique(np.concatenate((breaks, c.ends)))
        w = words(Chunk(0, 0, c.data, ends), powers)
        n = np.bincount(w.row, minlength=len(ends)) if len(w.row) else np.zeros(len(ends), np.int64)
        long = n >= max(shortest, 1)
        self.at = np.flatnonzero(long)
        used = long[w.row] if len(w.row) else np.zeros(0, bool)
        self.hash = w.hash[used]
        self.line = (np.cumsum(long) - 1)[w.row[used]]
        end = ends[self.at]
        self.row = np.searchsorted(c.ends, end, side="left")
        # An empty text ends where the one before it does, and has no lines here.
        start = np.concatenate(([0], c.ends[:-1]))[self.row]
        self.number = np.searchsorted(breaks, end, side="left") - np.searchsorted(breaks, start, side="right")

    def parts(self, ranks: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Runs of at most LINES lines: their places, and their distinct tokens and where each line's begin.

        Tokens come in the order of `ranks` (of buckets), and with the rank in place of the bucket.
        """
        for a in range(0, len(self.at), LINES):
            i, j = np.searchsorted(self.line, [a, a + LINES])
            bucket = self.hash[i:j] >> U(64 - TABLE_BITS)
            token = ((bucket if ranks is None else ranks[bucket.astype(np.int64)]) << LOW) | (self.hash[i:j] & ((U(1) << LOW) - U(1)))
            both = np.sort(((self.line[i:j] - a).astype(U) << U(48)) | token)
            both = both[np.concatenate(([True], both[1:] != both[:-1]))]
            n = np.bincount((both >> U(48)).astype(np.int64), minlength=min(LINES, len(self.at) - a))
            yield slice(a, a + LINES), both & TOKEN, np.concatenate(([0], np.cumsum(n)))


def set_keys(tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set of distinct tokens."""
    return tuple(np.add.reduceat(mix(tokens * U(k)), begin[:-1]) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _mapped(docs: DataFrame, make, schema: str, last=None, only=None) -> DataFrame:
    """make(chunk, powers, batch, state) gives the columns of a chunk's rows, a run of lines at a time; last(state) those of a task's end."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, state = Powers(), {}
        for batch in batches:
            batch = only(batch) if only else batch
            for c in chunks(batch.column("text")):
                for columns in make(c, powers, batch, state):
                    yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=names)
        if last:
            yield pa.RecordBatch.from_arrays(last(state), names=names)

    return docs.mapInArrow(run, schema)


def token_counts(docs: DataFrame, shortest: int) -> DataFrame:
    """How many tokens of all lines each bucket has, COUNTS buckets (long integers) a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = Powers(), np.zeros(1 << TABLE_BITS, np.int64)
        for batch in batches:
            for c in chunks(batch.column("text")):
                h = Lines(c, powers, shortest).hash if shortest > 1 else words(c, powers).hash
                total += np.bincount((h >> U(64 - TABLE_BITS)).astype(np.int64), minlength=1 << TABLE_BITS)
        yield rows({int(b): total[b : b + COUNTS] for b in range(0, len(total), COUNTS) if total[b : b + COUNTS].any()})

    def rows(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int32()), pa.array((n.tobytes() for n in counts.values()), pa.binary())], names=["first", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for first, n in zip(batch.column("first").to_pylist(), batch.column("n").to_pylist()):
                counts[first] = counts.get(first, 0) + np.frombuffer(n, np.int64)
        yield rows(counts)

    return docs.mapInArrow(run, "first int, n binary").repartition("first").mapInArrow(add, "first int, n binary")


def token_ranks(docs: DataFrame, shortest: int) -> np.ndarray:
    """The place of each bucket of tokens when the buckets are ordered by their tokens' number, over all lines."""
    total = np.zeros(1 << TABLE_BITS, np.int64)
    for r in token_counts(docs, shortest).toArrow().to_pylist():  # 2**TABLE_BITS counts at most
        total[r["first"] : r["first"] + COUNTS] = np.frombuffer(r["n"], np.int64)
    rank = np.empty(len(total), U)
    rank[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=U)
    return rank


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n ordered tokens a partner of any size must share one of; none where even one token more is too many."""
    return np.where(100 * n >= percent * (n + 1), n - -(-percent * n // 100) + 1, 0)


def _count(state: dict) -> None:
    new = np.concatenate([np.zeros(0, U), *state["new"]]).astype(np.int64)
    state["seen"] += np.bincount(new, minlength=1 << HOT_BITS)
    state["new"] = []


def _described(docs: DataFrame, percent: int, shortest: int, ranks) -> DataFrame:
    """A row a line: its place, hashes and map of its set, and the numbers of its prefix entries (null for a set met before in the chunk).

    Rows of line -1 carry in s1 the buckets of tokens that stand out in the task's prefixes.
    """

    def make(c: Chunk, powers: Powers, batch: pa.RecordBatch, state: dict):
        lines = Lines(c, powers, shortest)
        if "bucket" not in state:
            order = ranks.value
            state["bucket"] = np.empty(len(order), U)
            state["bucket"][order.astype(np.int64)] = np.arange(len(order), dtype=U)
            state["seen"], state["new"] = np.zeros(1 << HOT_BITS, np.int64), []
        for place, ordered, begin in lines.parts(ranks.value):
            tokens = (state["bucket"][(ordered >> LOW).astype(np.int64)] << LOW) | (ordered & ((U(1) << LOW) - U(1)))
            n = np.diff(begin)
            s1, s2 = set_keys(tokens, begin)
            bit = U(1) << (tokens & U(63))
            upper = (tokens & U(64)) > 0
            maps = [np.bitwise_xor.reduceat(np.where(x, bit, U(0)), begin[:-1]).view(np.int64) for x in (~upper, upper)]
            once = np.zeros(len(n), bool)
            once[np.unique(s1, return_index=True)[1]] = True
            size = np.where(once, prefix_sizes(n, percent), 0)
            first = np.concatenate(([0], np.cumsum(size)))
            position = np.arange(first[-1]) - np.repeat(first[:-1], size)
            picked = tokens[position + np.repeat(begin[:-1], size)]
            key = mix(picked) & ~U((1 << 24) - 1)
            state["new"].append(key >> U(64 - HOT_BITS))
            if sum(map(len, state["new"])) > 1 << HOT_BITS:
                _count(state)
            key |= (np.minimum(np.repeat(n, size), MOST_N).astype(U) << U(8)) | np.minimum(position, MOST_I).astype(U)
            keys = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(key.view(np.int64)), mask=pa.array(size == 0))
            rows = pa.array(lines.row[place] + c.first)
            yield batch.column("doc_id").take(rows), batch.column("h").take(rows), lines.number[place].astype(np.int64), s1.view(np.int64), s2.view(np.int64), *maps, keys

    def last(state: dict) -> list[pa.Array]:
        if state:
            _count(state)
        seen = state.get("seen", np.zeros(1, np.int64))
        hot = np.flatnonzero(seen > max(HOT_LEAST, seen.sum() // HOT_SHARE))
        same = lambda x: pa.array(np.full(len(hot), x, np.int64))
        return [same(0), same(0), same(-1), pa.array(hot), same(0), same(0), same(0), pa.nulls(len(hot), pa.list_(pa.int64()))]

    return _mapped(docs, make, "doc_id long, h long, line long, s1 long, s2 long, m1 long, m2 long, keys array<bigint>", last)


def _lines_of(docs: DataFrame, shortest: int, wanted: tuple, texts: tuple | None = None) -> DataFrame:
    """Place, s1 and s2 of the lines whose s1 a bitmap may hold; of texts that another one may hold, tokens (six bytes each in order) for s2."""
    shared, tokens = docs.sparkSession.sparkContext.broadcast((wanted, texts)), texts is not None

    def make(c: Chunk, powers: Powers, batch: pa.RecordBatch, state: dict):
        lines = Lines(c, powers, shortest)
        for place, token, begin in lines.parts():
            s1, s2 = set_keys(token, begin)
            hit = np.flatnonzero(maybe_in(s1, *shared.value[0]))
            rows = pa.array(lines.row[place][hit] + c.first)
            out = batch.column("doc_id").take(rows), batch.column("h").take(rows), lines.number[place][hit].astype(np.int64), s1[hit].view(np.int64)
            if not tokens:
                yield *out, s2[hit].view(np.int64)
                continue
            six = token.view(np.uint8).reshape(-1, 8)[:, :6]
            yield *out, pa.array([six[begin[i] : begin[i + 1]].tobytes() for i in hit], pa.binary())

    only = (lambda batch: batch.filter(pa.array(maybe_in(batch.column("h").to_numpy(), *shared.value[1])))) if tokens else None
    return _mapped(docs, make, "doc_id long, h long, line long, s1 long, " + ("tokens binary" if tokens else "s2 long"), only=only)


def _dealt(sets: DataFrame, hot: np.ndarray, n: int) -> DataFrame:
    """The n entries of `sets` (s1, m1, m2, doc, keys), but those of hot buckets, placed by token: many of them, five numbers each, in a row."""
    shared = sets.sparkSession.sparkContext.broadcast(hot)
    partitions = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ENTRIES))
    parts = 4 * partitions

    def rows(entries: list[np.ndarray]) -> pa.RecordBatch:
        table = np.concatenate(entries)
        part = (mix((table[:, 0] >> 24).view(U)) % U(parts)).astype(np.int32)
        table = table[np.argsort(part, kind="stable")]
        size = np.bincount(part, minlength=parts)
        used = np.flatnonzero(size)
        offsets = np.concatenate(([0], np.cumsum(size[used]))) * table.itemsize * table.shape[1]
        blobs = pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(table)])
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), blobs], names=["part", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0
        for batch in batches:
            k, row = batch.column("keys").flatten().to_numpy(), batch.column("keys").value_parent_indices().to_numpy()
            if len(shared.value):
                cool = ~np.isin(k.view(U) >> U(64 - HOT_BITS), shared.value)
                k, row = k[cool], row[cool]
            held.append(np.stack([k, *(batch.column(c).to_numpy()[row] for c in Met.names[1:])], axis=1))
            have += len(k)
            if have > DEALT:
                yield rows(held)
                held, have = [], 0
        if have:
            yield rows(held)

    return sets.mapInArrow(run, "part int, entries binary").repartition(partitions, "part")


class Met:
    """The entries of a partition of tokens, sorted by number (token, size, position) and met by those of their token."""

    names = ("k", "s1", "m1", "m2", "doc")

    def __init__(self, percent: int, crowd: int):
        self.percent, self.crowd = percent, crowd

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(b"".join(x for batch in batches for x in batch.column("entries").to_pylist()), np.int64).reshape(-1, len(self.names))
        order = np.argsort(table[:, 0], kind="stable")
        columns = [x[order] for x in table.T]
        token = columns[0] >> 24
        at = 0
        while at < len(token):
            to = int(np.searchsorted(token, token[min(at + COMPARED, len(token)) - 1], side="right"))
            yield from self.groups([x[at:to] for x in columns])
            at = to

    def groups(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k = columns[0]
        token = k >> 24
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.concatenate((start, [len(k)])))
        through = np.repeat(size > self.crowd, size)
        if through.any():
            yield self._rows(1, *(columns[c][through] for c in (1, 0, 4, 2, 3)))
        yield from self.pairs(*(c[~through & np.repeat(size > 1, size)] for c in columns))

    @staticmethod
    def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(x) for x in columns)], names=["kind", "s1", "other", "doc", "m1", "m2"])

    def pairs(self, k: np.ndarray, s1: np.ndarray, m1: np.ndarray, m2: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        """For each set and token the candidates to try first (s1: the set, other: the candidate, doc: its document).

        In m1 is how much their maps differ, in m2 how many more candidates there are.
        """
        p = self.percent
        sized = k >> 8
        n, i = sized & MOST_N, k & MOST_I
        last = ((k >> 24) << 16) | np.minimum(n * 100 // p, MOST_N)
        many = np.searchsorted(sized, last, side="right") - np.arange(len(k)) - 1
        # The shorter of two similar sets has the token among its first few.
        many[(i > n - -(-2 * p * n // (100 + p))) & (n < MOST_N) & (i < MOST_I)] = 0
        ends = np.cumsum(many)
        found = [np.zeros((3, 0), np.int64)]
        at = 0
        while at < len(k):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            c = many[at:to]
            a = np.repeat(np.arange(at, to), c)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
            both = n[a] + n[b]
            far = sum(np.bitwise_count((m[a] ^ m[b]).view(U)).astype(np.int64) for m in (m1, m2))
            good = (((100 + p) * far <= (100 - p) * both) | (n[b] == MOST_N)) & (s1[a] != s1[b])
            a, b, both, far = a[good], b[good], both[good], far[good]
            good = (100 + p) * np.minimum(n[a] - i[a], n[b] - i[b]) >= p * both
            good |= n[b] == MOST_N
            a, b, far = a[good], b[good], far[good]
            found += [np.stack((x[o], y[o], far[o])) for x, y in ((a, b), (b, a)) for o in [doc[x] <= doc[y]]]
            at = to
        early, later, far = np.concatenate(found, axis=1)
        if len(later):
            order = np.lexsort((s1[early], doc[early], far, later))
            early, later, far = early[order], later[order], far[order]
            new = np.flatnonzero(np.concatenate(([True], later[1:] != later[:-1])))
            count = np.diff(np.concatenate((new, [len(later)])))
            few = np.arange(len(later)) - np.repeat(new, count) < FIRST
            more = np.repeat(np.maximum(count - FIRST, 0), count)
            yield self._rows(0, s1[later][few], s1[early][few], doc[early][few], far[few], more[few])


_FAR = "(bit_count(p.m1 ^ q.m1) + bit_count(p.m2 ^ q.m2))"


def _filters(percent: int) -> str:
    """Length, positional and map filters of entries p and q (k, m1, m2) of two sets.

    Where two maps differ a token is in one set only, and similar sets have few such tokens.
    """
    pn, qn, pi, qi = "(shiftright(p.k, 8) & 65535)", "(shiftright(q.k, 8) & 65535)", "(p.k & 255)", "(q.k & 255)"
    lengths = f"100 * least({pn}, {qn}) >= {percent} * greatest({pn}, {qn})"
    places = f"{100 + percent} * least({pn} - {pi}, {qn} - {qi}) >= {percent} * ({pn} + {qn})"
    maps = f"{100 + percent} * {_FAR} <= {100 - percent} * ({pn} + {qn})"
    return f"p.s1 <> q.s1 AND p.doc <= q.doc AND ({pn} = {MOST_N} OR {qn} = {MOST_N} OR ({lengths} AND {places} AND {maps}))"


def _candidates(sets: DataFrame, entries: DataFrame, n: int, hot: DataFrame, percent: int, crowd: int, ws: Workspace) -> DataFrame:
    """later, the candidates to try (early; none if only a crowd may have any) and whether there may be others (open); n: how many entries."""
    token = F.shiftright("k", 24)
    bucket = F.shiftrightunsigned("k", 64 - HOT_BITS)
    buckets = hot.distinct().toArrow().column("hot").to_numpy().astype(U)  # 2**HOT_BITS rows at most
    # A token that is not hot has a small share of the entries, so partitions are about as large as one another.
    met = ws.keep(_dealt(sets, buckets, n).mapInArrow(Met(percent, crowd), "kind int, s1 long, other long, doc long, m1 long, m2 long"), "met")
    passed = met.where("kind = 1").select("s1", "m1", "m2", "doc", F.col("other").alias("k"))
    many = passed.union(entries.join(F.broadcast(hot), bucket == F.col("hot"), "left_semi").select("s1", "m1", "m2", "doc", "k")) if len(buckets) else passed
    length = F.floor(F.log(F.shiftright("k", 8).bitwiseAND(MOST_N).cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    many = ws.keep(many.withColumn("token", token).withColumn("length", length), "many")
    leads = many.groupBy("token", "length").agg(F.min(F.struct("doc", "s1", "m1", "m2", "k")).alias("lead")).select("token", F.explode(F.array(*(F.col("length") + d for d in (-1, 0, 1)))).alias("length"), "lead.*")
    led = many.alias("q").join(ws.keep(leads, "leads").alias("p"), F.expr(f"p.token = q.token AND p.length = q.length AND {_filters(percent)}"))
    rows = met.where("kind = 0").select(F.col("s1").alias("later"), F.struct(F.col("m1").alias("far"), "doc", F.col("other").alias("early")).alias("c"), (F.col("m2") > 0).alias("open"))
    rows = rows.union(led.select("q.s1", F.struct(F.expr(f"cast({_FAR} AS long)"), "p.doc", "p.s1"), F.lit(True)))
    rows = rows.union(many.select("s1", F.lit(None).cast("struct<far:bigint,doc:bigint,early:bigint>"), F.lit(True)))
    # At most FIRST candidates a token in a set's prefix.
    tried = rows.groupBy("later").agg(F.array_sort(F.collect_set("c")).alias("c"), F.bool_or("open").alias("open"))
    return ws.keep(tried.select("later", F.transform(F.slice("c", 1, FIRST), lambda c: c["early"]).alias("early"), (F.col("open") | (F.size("c") > FIRST)).alias("open")), "tried")


def _verified(docs: DataFrame, groups: DataFrame, pairs: DataFrame, percent: int, shortest: int, ws: Workspace) -> DataFrame:
    """The sets (later) of `pairs` that are similar to the early one, which comes before them."""
    wanted = ws.keep(pairs.select(F.explode(F.array("early", "later")).alias("s1")).distinct(), "wanted")
    texts = ws.keep(groups.join(wanted, "s1", "left_semi").select("first.h").distinct(), "texts")
    if texts.count() <= BROADCAST:
        docs = docs.join(F.broadcast(texts), "h", "left_semi")
    found = _lines_of(docs, shortest, bitmap(wanted, "s1", hashed=True), bitmap(texts, "h", hashed=True))
    sets = found.groupBy("s1").agg(F.min(F.struct("doc_id", "h", "line")).alias("place"), F.any_value("tokens").alias("tokens"))
    # A set that very many others try first is copied for each SHARE of them.
    shares = ws.keep(pairs.groupBy("early").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")), "shares")
    dealt = pairs.join(shares, "early").select("early", "later", F.pmod(F.xxhash64("later"), F.col("shares")).cast("int").alias("share"))
    mine = sets.select(F.col("s1").alias("later"), F.col("place").alias("mine"), F.col("tokens").alias("y"))
    other = sets.select(F.col("s1").alias("early"), F.col("place").alias("other"), F.col("tokens").alias("x"))
    other = other.join(shares, "early").select("early", "other", "x", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    sided = dealt.join(mine, "later").join(other, ["early", "share"]).where("other < mine").select("later", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column("x"), batch.column("y")]
            sizes = [np.diff(np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1]) for s in sides]
            ends = np.cumsum(sizes[0] + sizes[1], dtype=np.int64)
            at = 0
            while at < len(ends):
                to = min(at + (1 << 14), max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + VERIFIED, side="right"))))
                token = []
                for side, size in zip(sides, sizes):
                    six = np.frombuffer(b"".join(side.slice(at, to - at).to_pylist()), np.uint8).reshape(-1, 6)
                    whole = np.zeros((len(six), 8), np.uint8)
                    whole[:, :6] = six
                    token.append(whole.view(U).ravel() | np.repeat(np.arange(to - at, dtype=U) << U(48), size[at:to] // 6))
                both = np.sort(np.concatenate(token))
                twice = np.bincount((both[1:][both[1:] == both[:-1]] >> U(48)).astype(np.int64), minlength=to - at)
                total = (sizes[0][at:to] + sizes[1][at:to]) // 6
                yield pa.RecordBatch.from_arrays([batch.column("later").slice(at, to - at).filter(pa.array((100 + percent) * twice >= percent * total))], names=["later"])
                at = to

    return sided.mapInArrow(run, "later long")


def _first_document() -> Column:
    return F.coalesce(F.col("first.doc_id"), F.lit(-(1 << 63))).alias("doc")


def removed_lines(docs: DataFrame, percent: int = 80, shortest: int = SHORTEST, crowd: int = CROWD, workspace: Workspace | None = None) -> DataFrame:
    """doc_id, h (hash of the text) and the sorted numbers of the lines that go."""
    spark = docs.sparkSession
    ws = workspace or Workspace(spark, "lines")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    ranks = spark.sparkContext.broadcast(token_ranks(docs.select("text"), shortest))
    place = F.struct("doc_id", "h", "line")
    described = _described(docs, percent, shortest, ranks)
    groups = ws.keep(described.groupBy("s1", "s2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.any_value("m1").alias("m1"), F.any_value("m2").alias("m2"), F.any_value("keys", True).alias("keys")), "groups")
    ws.release()
    hot = groups.where("first.line < 0").select(F.col("s1").alias("hot"))
    groups = groups.where("first.line >= 0")
    sets = groups.where("keys IS NOT NULL").select("s1", "m1", "m2", _first_document(), "keys")
    entries = sets.select("s1", "m1", "m2", "doc", F.explode("keys").alias("k"))
    n = groups.agg(F.sum(F.when(F.col("keys").isNotNull(), F.size("keys")))).first()[0] or 0
    tried = _candidates(sets, entries, n, hot, percent, crowd, ws)
    ws.release()
    decided = ws.keep(_verified(docs, groups, tried.select("later", F.explode("early").alias("early")), percent, shortest, ws).distinct(), "decided")
    ws.release()
    # What that leaves open meets all its candidates.
    undecided = ws.keep(tried.where("open").join(decided, "later", "left_anti").select(F.col("later").alias("s1")), "undecided")
    asking = groups.where("keys IS NOT NULL").join(undecided, "s1", "left_semi").select("s1", "m1", "m2", _first_document(), F.explode("keys").alias("k"))
    asking = ws.keep(asking, "asking")
    rest = asking.alias("q").join(entries.alias("p"), F.expr(f"shiftright(p.k, 24) = shiftright(q.k, 24) AND {_filters(percent)}"))
    rest = rest.select(F.col("q.s1").alias("later"), F.col("p.s1").alias("early")).distinct()
    rest = ws.keep(rest.join(tried.select("later", F.explode("early").alias("early")), ["later", "early"], "left_anti"), "rest")
    if not rest.isEmpty():
        decided = ws.keep(decided.union(_verified(docs, groups, rest, percent, shortest, ws).distinct()), "decided")
    ws.release()
    stays = groups.select("s1", "s2", "first", "copies").join(decided.withColumnRenamed("later", "s1").withColumn("similar", F.lit(True)), "s1", "left")
    stays = ws.keep(stays.where("copies > 1 OR similar").select("s1", "s2", F.when(F.col("similar"), F.lit(None)).otherwise(F.col("first")).alias("first")), "stays")
    lines = _lines_of(docs, shortest, bitmap(stays, "s1", hashed=True)).select("s1", "s2", place.alias("place"))
    gone = lines.join(stays, ["s1", "s2"]).where("first IS NULL OR place > first")
    return gone.groupBy("place.doc_id", "place.h").agg(F.sort_array(F.collect_set("place.line")).alias("gone"))


def dedup_lines(docs: DataFrame, text: str = "text", removed: str | None = None, workspace: Workspace | None = None, **options) -> DataFrame:
    """`docs` with the lines removed from `text`; `removed` names a column for how many went (replacing one of that name)."""
    ws = workspace or Workspace(docs.sparkSession, "lines")
    carried = [c for c in docs.columns if c != removed]
    gone = ws.keep(removed_lines(docs.select("doc_id", F.col(f"`{text}`").alias("text")), workspace=ws, **options), "gone")
    ws.release()
    left = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("_h"))
    joined = left.join(gone, F.expr("_id <=> doc_id AND _h = h"), "left").drop("_id", "_h", "doc_id", "h")
    at = carried.index(text)
    schema = docs.select(*(F.col(f"`{c}`") for c in carried)).schema
    if removed:
        schema = schema.add(removed, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(at), batch.column("gone")
            some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                new = texts.to_pylist()
                for i in some:
                    away = set(lists[i].as_py())
                    new[i] = "\n".join(x for k, x in enumerate(new[i].split("\n")) if k not in away)
                texts = pa.array(new, pa.string())
            columns = [texts if i == at else batch.column(i) for i in range(len(carried))]
            if removed:
                columns.append(pa.array([len(x) if x.is_valid else 0 for x in lists], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=carried + [removed] * bool(removed))

    return joined.mapInArrow(run, schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, removed="n_removed", shortest=SHORTEST)
    return out.select("doc_id", "n_removed", F.size(F.split("text", "\n", -1)).cast("long").alias("n_kept"), F.sha2(F.col("text"), 256).alias("text_sha256"))
