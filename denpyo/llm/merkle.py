"""Merkle manifest of a table, stored in van Emde Boas order.

A row's leaf is the SHA-256 of its columns, each `-` if null, else its length in UTF-8 bytes, `:` and its value. The
leaves of a group (a source) ascend by key, rows of one key by leaf; while several nodes remain, every FAN consecutive ones
become the digest of their digests' hexadecimal texts. The groups' roots, by group (null first, by bytes), give the root likewise.

A tree of D steps from leaf to root is cut at half its height, again and again, until what is left at the
bottom has at most MOST_STEPS steps. The aligned subtrees at the bottom are blocks of at most FAN**MOST_STEPS leaves; each
is built by one task call, whatever the size of its group, and the roots of the blocks are the items of the next stage, which is cut
in the same way. Within a block the nodes lie in van Emde Boas order: the upper half, then the lower subtrees from left to right, each
split likewise. `addresses` computes a node's place from its level and index alone; building writes, and
reading siblings reads, through it. A block's root is stored in its block and as an item of the block above, so
one block a stage holds all siblings of a path.

Null and empty texts are values like any other and differ in their leaves. Repeated rows have equal leaves side by side and each a
place. A null key sorts first; a null group is a group. An empty table has no rows and no root. Columns of any
other name do not matter. What a task holds at a time is a batch of blocks; nothing of the tree passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import joined, ranked
from .tables import Workspace, column, read

FAN = 16
#: Steps of the tallest block. Short blocks spread a large group over many tasks; each further stage has 1/256 of the items.
MOST_STEPS = 2
BYTES = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def part(value: Column) -> Column:
    """How a column enters a leaf."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The leaf of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(part(v) for v in values)).cast("binary"), 256))


def digest(nodes: bytes) -> bytes:
    """The parent of nodes of BYTES bytes each, one after the other."""
    return hashlib.sha256(nodes.hex().encode()).digest()


def widths(items: int, steps: int) -> list[int]:
    """Nodes of each level of a block, from its root down to its items."""
    out = [items]
    for _ in range(steps):
        out.append(-(-out[-1] // FAN))
    return out[::-1]


def addresses(items: int, steps: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in van Emde Boas order of the nodes `index` at `depth` below the root of a block of so many items and steps.

    The block is filled from the left: of the lower subtrees only the last may have fewer items, so each one's place follows from full sizes.
    """
    levels = steps + 1
    if levels == 1:
        return np.zeros(len(index), np.int64)
    upper = levels // 2
    lower_steps = levels - upper - 1
    full_items = FAN**lower_steps
    roots = -(-items // full_items)
    upper_items = -(-roots // FAN)
    if depth < upper:
        return addresses(upper_items, upper - 1, depth, index)
    begin = sum(widths(upper_items, upper - 1))
    below = FAN ** (depth - upper)
    tree, inner = index // below, index % below
    out = begin + tree * sum(widths(full_items, lower_steps))
    last = tree == roots - 1
    for of, n in ((~last, full_items), (last, items - (roots - 1) * full_items)):
        if of.any():
            out[of] += addresses(n, lower_steps, depth - upper, inner[of])
    return out


def build(items: np.ndarray, steps: int) -> np.ndarray:
    """All nodes of a block (rows of BYTES bytes) in van Emde Boas order, the root first."""
    n = len(items)
    sizes = widths(n, steps)
    out = np.zeros((sum(sizes), BYTES), np.uint8)
    out[addresses(n, steps, steps, np.arange(n))] = items
    for depth in range(steps - 1, -1, -1):
        children = out[addresses(n, steps, depth + 1, np.arange(sizes[depth + 1]))]
        made = b"".join(digest(children[i : i + FAN].tobytes()) for i in range(0, len(children), FAN))
        out[addresses(n, steps, depth, np.arange(sizes[depth]))] = np.frombuffer(made, np.uint8).reshape(-1, BYTES)
    return out


def paths(nodes: np.ndarray, items: int, steps: int) -> Iterator[list[tuple[int, bytes]]]:
    """For each item of a stored block, level by level up to below the root: its place in its run, and the run's other nodes."""
    levels = []
    for depth in range(steps, 0, -1):
        width = widths(items, steps)[depth]
        levels.append(nodes[addresses(items, steps, depth, np.arange(width))].tobytes())
    for i in range(items):
        path = []
        for level in levels:
            place, first = i % FAN, (i - i % FAN) * BYTES
            run = level[first : first + FAN * BYTES]
            path.append((place, run[: place * BYTES] + run[(place + 1) * BYTES :]))
            i //= FAN
        yield path


def packed(path: list[tuple[int, bytes]]) -> bytes:
    """A path as bytes: for each level the place, the number of siblings, the siblings."""
    return b"".join(bytes((place, len(others) // BYTES)) + others for place, others in path)


def unpacked(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        place, n = data[at], data[at + 1]
        out.append((place, data[at + 2 : at + 2 + n * BYTES]))
        at += 2 + n * BYTES
    return out


def folded(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a node and its siblings give."""
    for place, others in path:
        node = digest(others[: place * BYTES] + node + others[place * BYTES :])
    return node


def steps_up(total: Column) -> Column:
    """Steps from so many items to one root."""
    out = F.lit(15)
    for d in range(14, -1, -1):
        out = F.when(total <= FAN**d, F.lit(d)).otherwise(out)
    return out


def block_steps(steps: Column) -> Column:
    """Steps of a block at the bottom of a tree: the whole tree if it is small, else what is left after halving its height."""
    out = F.lit(None).cast("int")
    for d in range(15, -1, -1):
        own = d
        while own > MOST_STEPS:
            own = (own + 1) // 2
        out = F.when(steps == d, F.lit(own)).otherwise(out)
    return out


@dataclass
class Tree:
    """Stages of blocks, from the leaves up. A block: group, block (its number), steps, items (array of structs), nodes, root, done (no stage above)."""

    group: list[str]
    stages: list[DataFrame] = field(default_factory=list)

    def roots(self) -> DataFrame:
        """group, root."""
        out = None
        for s in self.stages:
            own = s.where("done").select(*self.group, "root")
            out = own if out is None else out.union(own)
        return out


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, made, roots = batch.column("items"), [], []
        for i, steps in enumerate(batch.column("steps").to_pylist()):
            hashes = items[i].values.field("hash")
            nodes = build(np.frombuffer(b"".join(hashes.to_pylist()), np.uint8).reshape(-1, BYTES), steps)
            made.append(nodes.tobytes())
            roots.append(nodes[0].tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary()), pa.array(roots, pa.binary())], names=[*batch.schema.names, "nodes", "root"])


def grow(ws: Workspace, items: DataFrame, group: list[str]) -> Tree:
    """The tree of each group over `items`: group, index, total, hash, and what else an item carries."""
    tree = Tree(group)
    carried = [c for c in items.columns if c not in (*group, "total")]
    while True:
        up = steps_up(F.col("total"))
        cut = items.withColumn("steps", block_steps(up)).withColumn("done", up <= MOST_STEPS)
        cut = cut.withColumn("block", F.floor(F.col("index") / F.pow(F.lit(float(FAN)), F.col("steps"))).cast("long"))
        blocks = cut.groupBy(*group, "block").agg(
            F.first("steps").alias("steps"), F.first("done").alias("done"), F.first("total").alias("total"),
            F.sort_array(F.collect_list(F.struct(*carried))).alias("items"),
        )
        stored = blocks.withColumns({"nodes": F.lit(None).cast("binary"), "root": F.lit(None).cast("binary")})
        stage = ws.keep(blocks.mapInArrow(_built, stored.schema), "blocks")
        tree.stages.append(stage)
        more = stage.where("NOT done")
        if more.isEmpty():
            return tree
        fewer = F.ceil(F.col("total") / F.pow(F.lit(float(FAN)), F.col("steps"))).cast("long")
        items = more.select(*group, F.col("block").alias("index"), fewer.alias("total"), F.col("root").alias("hash"))
        carried = ["index", "hash"]


def _path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each item of each block its index and its path, the block's own path after it."""
    for batch in batches:
        items, names = batch.column("items"), [c for c in batch.schema.names if c not in ("items", "nodes", "steps", "above")]
        rest = zip(batch.column("steps").to_pylist(), batch.column("nodes").to_pylist(), batch.column("above").to_pylist())
        for i, (steps, nodes, above) in enumerate(rest):
            index = items[i].values.field("index")
            found = [packed(p) + above for p in paths(np.frombuffer(nodes, np.uint8).reshape(-1, BYTES), len(index), steps)]
            own = [batch.column(c).take(pa.array([i] * len(index), pa.int32())) for c in names]
            yield pa.RecordBatch.from_arrays([*own, index, pa.array(found, pa.binary())], names=[*names, "index", "path"])


def blocks_with_paths(ws: Workspace, tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """The blocks of the leaves, each with the packed path from its own root up (column above), and `above`'s other columns.

    `above`: group, path (that of the group's root) and more columns; without it, paths end at the groups' roots.
    """
    more = [] if above is None else [c for c in above.columns if c not in (*tree.group, "path")]
    known = None
    for k, stage in reversed(list(enumerate(tree.stages))):
        done, rest = stage.where("done"), stage.where("NOT done")
        if above is None:
            out = done.withColumn("above", F.lit(b""))
        else:
            out = joined(done, above.withColumnRenamed("path", "above"), tree.group)
        if known is not None:
            out = out.unionByName(joined(rest, known.withColumnRenamed("path", "above"), [*tree.group, "block"]))
        if k:
            schema = out.select(*tree.group, *more, F.lit(0).cast("long").alias("index"), F.lit(b"").alias("path")).schema
            known = ws.keep(out.select(*tree.group, *more, "steps", "items", "nodes", "above").mapInArrow(_path_rows, schema), "paths").withColumnRenamed("index", "block")
    return out


@dataclass
class Manifest:
    """The stored trees of a table: `leaves` by group, `groups` over the groups' roots. carried: what items hold besides index and hash."""

    ws: Workspace
    leaves: Tree
    groups: Tree
    carried: list[str]

    def root(self) -> DataFrame:
        return self.groups.roots()


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, claimed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of `docs`; missing columns count as null.

    claimed: columns whose values, as someone claims them, differ from those of `docs`; `checked` compares the leaves of the claimed rows.
    """
    ws = Workspace(docs.sparkSession, "merkle")
    value = {c: column(docs, c, "string" if c not in docs.columns else docs.schema[c].dataType.simpleString()) for c in {*columns, key, group}}
    hash_ = leaf(*(value[c] for c in columns))
    other = leaf(*((claimed or {}).get(c, value[c]) for c in columns))
    rows = docs.select(value[group].cast("string").alias("g"), value[key].alias("key"), hash_.alias("hash"), F.nullif(other, hash_).alias("claim"))
    rows = ranked(ws, ws.keep(rows, "leaves"), ["g"], ["key", "hash"])
    trees = grow(ws, rows.select("g", "total", "index", "hash", "claim", "key"), ["g"])
    roots = trees.roots().withColumnRenamed("root", "hash")
    over = grow(ws, ranked(ws, ws.keep(roots, "subroots"), [], ["g"]).select("total", "index", "hash", "g"), [])
    return Manifest(ws, trees, over, ["claim", "key"])


def _checked(siblings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            rest = zip(*(batch.column(c).to_pylist() for c in ("g", "steps", "nodes", "above", "subroot", "root")))
            for i, (g, steps, nodes, above, subroot, root) in enumerate(rest):
                own = items[i].values
                upper = unpacked(above)
                tail = b"".join(others for _, others in upper)
                folds, proofs, lists = [], [], []
                each = zip(paths(np.frombuffer(nodes, np.uint8).reshape(-1, BYTES), len(own), steps), own.field("hash").to_pylist(), own.field("claim").to_pylist())
                for path, hash_, claim in each:
                    folds.append(folded(hash_ if claim is None else claim, path + upper))
                    proofs.append(digest(b"".join(others for _, others in path) + tail).hex())
                    if siblings:
                        lists.append([[others[j : j + BYTES].hex() for j in range(0, len(others), BYTES)] for _, others in path + upper])
                n = len(own)
                out = [own.field("key"), pa.array([g] * n, pa.string()), own.field("index"), pa.array([h.hex() for h in own.field("hash").to_pylist()], pa.string())]
                out += [pa.array([x] * n, pa.string()) for x in (subroot.hex(), root.hex())]
                out += [pa.array(proofs, pa.string()), pa.array([x.hex() for x in folds], pa.string()), pa.array([x == root for x in folds], pa.bool_())]
                if siblings:
                    out.append(pa.array(lists, pa.list_(pa.list_(pa.string()))))
                yield pa.RecordBatch.from_arrays(out, names=["key", "group", "place", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["siblings"] * siblings)

    return run


def checked(m: Manifest, siblings: bool = False) -> DataFrame:
    """A row per leaf: key, group, place in the group, leaf, subroot, root, proof_sha256 (of all siblings), folded_root (from the claimed leaf and the stored siblings) and verified.

    siblings: also those, as lists of hexadecimal texts by level.
    """
    top = m.root().first()  # none of an empty table
    root = F.lit(bytes(top.root) if top else b"")
    found = blocks_with_paths(m.ws, m.groups).select("items", "steps", "nodes", "above", root.alias("root")).mapInArrow(_group_paths, "g string, path binary, subroot binary, top binary")
    blocks = blocks_with_paths(m.ws, m.leaves, m.ws.keep(found, "group-paths"))
    key = m.leaves.stages[0].schema["items"].dataType.elementType["key"].dataType.simpleString()
    schema = f"key {key}, group string, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", siblings array<array<string>>" * siblings
    return blocks.select("g", "steps", "nodes", "items", "above", "subroot", F.col("top").alias("root")).mapInArrow(_checked(siblings), schema)


def _group_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column("items")
        for i, (steps, nodes, above, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("steps", "nodes", "above", "root")))):
            own = items[i].values
            found = [packed(p) + above for p in paths(np.frombuffer(nodes, np.uint8).reshape(-1, BYTES), len(own), steps)]
            yield pa.RecordBatch.from_arrays([own.field("g"), pa.array(found, pa.binary()), own.field("hash"), pa.array([root] * len(own), pa.binary())], names=["g", "path", "subroot", "top"])


def _fifth(key: Column) -> Column:
    """Whether the query tampers with the row."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.when(_fifth(F.col("doc_id")), F.translate("text", upper, lower)).otherwise(F.col("text"))
    out = checked(manifest(docs, claimed={"text": tampered}))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", F.col("group").alias("source"), "place")


def _sql_tree(name: str, start: str, group: str) -> str:
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT {group}level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 15) // 16) FROM {name} WHERE n > 1 GROUP BY {group}level, idx // 16
)"""


def _sql_runs(name: str, tree: str, group: str) -> str:
    run = f"PARTITION BY {group}level, idx // 16 ORDER BY idx"
    before = f"coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')"
    after = f"coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')"
    return f"{name} AS (SELECT {group}level, idx, {before} || '|' || {after} AS others FROM {tree} WHERE n > 1)"


_FIELDS = {c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS}
_CLAIMED = _FIELDS | {"text": "coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')"}
#: CRC-32 of a decimal number, a bit a step.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::VARCHAR, '')])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"""
_FOLD = "list_reduce(list_prepend({}, coalesce(path, [])), lambda a, e: sha256(split_part(e, '|', 1) || a || split_part(e, '|', 2)))"

OP11_SQL = f"""WITH RECURSIVE hashed AS (
  SELECT doc_id, source, coalesce('v' || source, '') AS g, sha256({" || ".join(_FIELDS.values())}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({" || ".join(_CLAIMED.values())}) END AS claim
  FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
{_sql_tree("tree", "SELECT g, 0 AS level, place AS idx, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed", "g, ")},
tops AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS spot FROM tree WHERE n = 1),
{_sql_tree("upper_tree", "SELECT 0 AS level, spot AS idx, subroot AS h, count(*) OVER () AS n FROM tops", "")},
{_sql_runs("runs", "tree", "g, ")},
{_sql_runs("upper_runs", "upper_tree", "")},
steps AS (
  SELECT p.g, p.place, 0 AS part, r.level, r.others FROM placed p JOIN runs r ON r.g = p.g AND r.idx = p.place // pow(16, r.level)::BIGINT
  UNION ALL
  SELECT p.g, p.place, 1, r.level, r.others FROM placed p JOIN tops t ON t.g = p.g JOIN upper_runs r ON r.idx = t.spot // pow(16, r.level)::BIGINT
), paths AS (SELECT g, place, list(others ORDER BY part, level) AS path FROM steps GROUP BY g, place),
found AS (
  SELECT p.*, t.subroot, (SELECT h FROM upper_tree WHERE n = 1) AS root, sha256(replace(coalesce(array_to_string(path, ''), ''), '|', '')) AS proof_sha256,
    {_FOLD.format("coalesce(claim, leaf)")} AS folded_root
  FROM placed p JOIN tops t ON t.g = p.g LEFT JOIN paths ON paths.g = p.g AND paths.place = p.place
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified, source, place FROM found"""
