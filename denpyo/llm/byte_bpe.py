"""Byte-level BPE through a sentencepiece model made from a rank file.

The rank file's byte strings become pieces over 256 printable characters, one
a byte; a piece's score is its negative rank, so that the best pair to merge
is the one of lowest rank, and ids equal ranks. Normalisation is the identity.
Texts are cut by the vocabulary's pattern and each match is encoded alone;
decoding looks up the byte string of every id.

A null or empty text has no ids. Rows are independent: repeated rows give
repeated results, and columns other than the text are passed through.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import fresh, small_batches
from .text import CHUNK_BYTES

#: Pre-tokens whose ids a worker remembers before it starts anew.
REMEMBERED = 300_000


def ranks_of(path: str) -> list[bytes]:
    """Byte strings by rank; ranks must run from 0 without gaps."""
    found = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece, rank = line.split()
                found[int(rank)] = base64.b64decode(piece)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [found[i] for i in range(len(found))]


def byte_characters() -> str:
    """A printable character for each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    kept = set(plain)
    return "".join(chr(b) if b in kept else chr(next(rest)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: an int or bool as varint, a float as fixed 32 bits, bytes or text with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def serialise(ranks: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces in rank order, then the unknown piece that the library asks for."""
    letters = byte_characters()
    missing = set(range(256)) - {r[0] for r in ranks if len(r) == 1}
    if missing:
        raise ValueError("every single byte must have a rank")
    pieces = [_field(1, "".join(letters[b] for b in r)) + _field(2, -float(k)) + _field(3, 1) for k, r in enumerate(ranks)]
    pieces.append(_field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(35, 0) + _field(40, len(ranks)) + _field(41, -1 & (1 << 64) - 1) + _field(42, -1 & (1 << 64) - 1) + _field(43, -1 & (1 << 64) - 1)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


#: Characters below this one are told apart by plain `re` classes, which match twice as fast.
NARROW = 0x3000


def _class(matches) -> str:
    """The characters below NARROW that `matches` accepts, as ranges of a character class."""
    has = np.array([bool(matches(chr(c))) for c in range(NARROW)])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], has, [0]))))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in edges.reshape(-1, 2))


def finder(pattern: str):
    """A function that lists a text's matches of `pattern`, as the regex module does.

    Texts of characters below NARROW go to `re`, with the Unicode classes of the
    pattern spelt out from the regex module's own; others go to the regex module.
    """
    full = regex.compile(pattern).findall
    narrow = pattern
    for bare in (r"\p{L}", r"\p{N}", r"\s"):
        ranges = _class(regex.compile(bare).match)
        narrow = re.sub(r"(\[\^?(?:[^\]\\]|\\.)*?)" + re.escape(bare), lambda m, r=ranges: m[1] + r, narrow)  # within a class
        narrow = narrow.replace(bare, f"[{ranges}]")
        if bare == r"\s":
            narrow = narrow.replace(r"\S", f"[^{ranges}]")
    quick = re.compile(narrow).findall
    wide = re.compile(f"[^\\u0000-\\u{NARROW - 1:04x}]").search
    return lambda text: full(text) if wide(text) else quick(text)


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids, and back to bytes."""

    def __init__(self, model: bytes, pattern: str, pieces: list[bytes]):
        self.find = finder(pattern)
        self.pieces = np.array(pieces, dtype=object)
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_characters()

        class Known(dict):
            def __missing__(self, word: str) -> bytes:
                ids = processor.encode("".join([letters[b] for b in word.encode()]))
                self[word] = out = np.array(ids, "<u4").tobytes()
                return out

        self.known = Known()

    def encode(self, text: str | None) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.find(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.pieces[np.frombuffer(ids, "<u4")])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`docs` with a binary column `ids`; `keep` names the other columns to carry (all of them if None).

    A column of docs named like `ids` is replaced.
    """
    carried = [c for c in (docs.columns if keep is None else keep) if c != ids]
    schema = docs.select(*(F.col(f"`{c}`") for c in carried)).withColumn(ids, F.lit(b"")).schema
    return _mapped(docs, path, pattern, text, carried, schema, lambda codec, t: (codec.encode(t),))


def digest(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each text encoded and its ids decoded: `keep` (without columns named like those made), n_tokens, ids_sha256, decoded_sha256, round_trip."""
    keep = tuple(c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "round_trip"))
    out = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = out.withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit(""), "round_trip": F.lit(True)}).schema

    def row(codec: Codec, t: str) -> tuple:
        ids = codec.encode(t)
        back = codec.decode(ids)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == t.encode()

    return _mapped(docs, path, pattern, text, list(keep), schema, row)


def _mapped(docs: DataFrame, path: str, pattern: str, text: str, carried: list[str], schema, row) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    pieces = ranks_of(path)
    shipped = spark.sparkContext.broadcast((serialise(pieces), pieces))  # as large as the vocabulary
    arrow = [(f.name, f.dataType) for f in schema.fields[len(carried) :]]
    name = fresh(carried, "t")
    source = docs.select(*(F.col(f"`{c}`") for c in carried), F.col(f"`{text}`").cast("string").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ranks = shipped.value
        codec = Codec(model, pattern, ranks)
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        for batch in batches:
            for part in sliced(batch, name):
                rows = [row(codec, t or "") for t in part.column(name).to_pylist()]
                made = [pa.array([r[i] for r in rows], kinds[k.simpleString()]) for i, (_, k) in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried_at), *made], names=[*carried, *(n for n, _ in arrow)])

    carried_at = list(range(len(carried)))
    return source.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most about `limit` bytes of text, a row at least."""
    size = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(size, (size[first - 1] if first else 0) + limit, side="right"))
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
