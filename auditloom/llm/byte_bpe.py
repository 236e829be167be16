"""Byte-level BPE through a sentencepiece BPE model that is serialised straight from a rank file.

Each token becomes a piece of byte-mapped characters (a printable character for every byte) with its negative rank as
score; the normaliser is the identity. Sentencepiece then merges the best-scored neighbours first, which is the merge
order of the ranks. Every match of the split pattern is encoded on its own; ids decode by the inverse mapping.

Defined cases: null or empty text has no ids (the digests are those of the empty string); texts of any length are
encoded piece by piece; repeated rows give equal rows; an empty table gives no rows; extra columns are ignored. A text that holds unpaired surrogates can't
occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MEMO = 200_000  #: pre-tokens whose ids a task remembers at once


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next free one from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes | int | float) -> bytes:
    """A protocol-buffer field: length-delimited bytes, a varint, or a 32-bit float."""
    import struct

    if isinstance(payload, bytes):
        return _varint(number << 3 | 2) + _varint(len(payload)) + payload
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    return _varint(number << 3) + _varint(payload)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown piece, piece r + 1 the token of rank r."""
    of = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0 to n - 1")
    pieces = [_field(1, _field(1, "<unk>".encode()) + _field(2, 0.0) + _field(3, 2))]
    for token, rank in by_rank:
        pieces.append(_field(1, _field(1, "".join(of[b] for b in token).encode()) + _field(2, float(-rank))))
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1) + _field(35, 0) + _field(24, 0)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encodes and decodes texts by a rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.split = regex.compile(pattern).findall
        self.tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.table = str.maketrans(dict(enumerate(byte_characters())))
        self.memo: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def encode_part(self, part: str) -> tuple[int, ...]:
        """Ids of one pre-token. One that is itself a token is that token, as in the rank encoder."""
        raw = part.encode()
        if (rank := self.ranks.get(raw)) is not None:
            return (rank,)
        return tuple(i - 1 for i in self.model.encode(raw.decode("latin-1").translate(self.table)))

    def part(self, part: str) -> tuple[tuple[int, ...], str, bytes]:
        """(ids, ids as text, their bytes) of one pre-token."""
        got = self.memo.get(part)
        if got is None:
            ids = self.encode_part(part)
            got = ids, " ".join(map(str, ids)), self.decode(ids)
            if len(part) < 100:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[part] = got
        return got

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in self.part(p)[0]]

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        got = [self.part(p) for p in self.split(text)]
        n = sum([len(x[0]) for x in got])
        ids = hashlib.sha256(" ".join([x[1] for x in got]).encode()).hexdigest()
        return n, ids, hashlib.sha256(b"".join([x[2] for x in got])).hexdigest()


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of each row."""

    def run(batches):
        codec = ByteBPE(path, pattern)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids)."""

    def run(batches):
        codec = ByteBPE(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or ()) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, keep..., n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes that they decode to. ``keep``: columns of ``docs`` that go along."""

    def run(batches):
        codec = ByteBPE(path, pattern)
        for b in slices(batches):
            got = [codec.digest(t or "") for t in b.column(1).to_pylist()]
            new = [pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got]), pa.array([x[2] for x in got])]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *new], names=["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    types = [f"`{c}` {docs.schema[s].dataType.simpleString()}" for c, s in [("doc_id", doc_id), *((c, c) for c in keep)]]
    used = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)
    return used.mapInArrow(run, ", ".join([*types, "n_tokens long, ids_sha256 string, decoded_sha256 string"]))
