"""WARC archives in Zstandard: written with a dictionary, and read back.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, then has one frame per record.
Archives are written as rows of a table (archive, data) in the shared folder, each of bounded size, so they can be on any store
that Spark reads and a lost executor loses nothing; they are read from such a table or from ``.warc.zst`` files. The reader loads the dictionary from the leading frame, decodes one frame per record, and
checks the version line, the mandatory headers, the declared length and the digests of blocks and payloads.

Records with equal payloads: the one with the largest id is the response, the others are revisits that refer to it and
repeat its HTTP head (with the full payload's length) but no body. Payloads smaller than ``least`` bytes are always responses.

Defined cases: null html is an empty payload; rows with the same id are records of their own (all rows
with the largest id of a payload are responses); a null id or an empty or null url is written as an empty field and read back as null; white space and control characters of a
url, which no URI can hold, are percent-encoded and read back so; a row
longer than an archive's bound has an archive of its own; an empty table gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20  #: payload bytes of an archive, or one record
DICTIONARY = 32 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def uri(url: str) -> str:
    """The url with white space and control characters percent-encoded."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(page_id, url, payload: bytes, kind: str, refers_to, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit's block has the HTTP head only."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = {
        "WARC-Type": kind, "WARC-Record-ID": name(page_id), "WARC-Date": date, "WARC-Target-URI": uri(url or ""),
        "WARC-Payload-Digest": "sha1:" + sha1_base32(payload), "WARC-Block-Digest": "sha1:" + sha1_base32(block), "Content-Type": "application/http; msgtype=response",
    }
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to)}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes], level: int = 3) -> bytes:
    """An archive: the dictionary in a skippable frame, then one frame per record."""
    import zstandard

    sample, size = [], 0
    for r in records:
        if size >= 100 * DICTIONARY:
            break
        sample.append(r[: 128 << 10])
        size += len(sample[-1])
    try:
        content = zstandard.train_dictionary(min(DICTIONARY, max(1024, size // 10)), sample).as_bytes()
    except zstandard.ZstdError:  # too few records to train on: the first one's head is the dictionary
        content = (records[0] if records else b"WARC/1.1\r\n")[:DICTIONARY].ljust(8, b" ")
    coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True, write_content_size=True)
    stored = zstandard.ZstdCompressor(level=level).compress(content)
    return struct.pack("<II", SKIPPABLE, len(stored)) + stored + b"".join(coder.compress(r) for r in records)


class Malformed(ValueError):
    """An archive or a record that breaks the format."""


def frames(data: bytes):
    """The decoded frames of an archive, one after the other."""
    import zstandard

    magic, size = struct.unpack_from("<II", data) if len(data) >= 8 else (0, 0)
    if magic != SKIPPABLE or len(data) < 8 + size:
        raise Malformed("no leading dictionary frame")
    stored = data[8 : 8 + size]
    content = zstandard.ZstdDecompressor().decompress(stored) if stored[:4] == b"\x28\xb5\x2f\xfd" else stored
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    rest = memoryview(data)[8 + size :]
    while len(rest):
        one = decoder.decompressobj()
        try:
            out = one.decompress(rest)
        except zstandard.ZstdError as e:
            raise Malformed(str(e)) from e
        if not one.eof:
            raise Malformed("an archive ends within a frame")
        unused = len(one.unused_data)
        yield out
        rest = rest[len(rest) - unused :]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record, validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Malformed("no WARC version line")
    fields = {}
    for line in lines[1:]:
        k, sep, v = line.partition(":")
        if not sep:
            raise Malformed(f"no header: {line[:80]}")
        fields[k.strip().lower()] = v.strip()
    if lack := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise Malformed(f"headers are missing: {sorted(lack)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Malformed("the length doesn't hold")
    block = rest[:-4]
    if (d := fields.get("warc-block-digest")) and d != "sha1:" + sha1_base32(block):
        raise Malformed("the block's digest doesn't hold")
    return fields, block


def _page(name: str):
    i = name.removeprefix("<urn:page:").removesuffix(">")
    return int(i) if i else None


def unpack(data: bytes) -> Iterator[tuple]:
    """(page_id, url, payload or None, payload_bytes, payload_digest, record_type, refers_to) of each record, one after the other."""
    for raw in frames(data):
        h, block = parse(raw)
        http, gap, body = block.partition(b"\r\n\r\n")
        declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if not gap or declared is None:
            raise Malformed("no HTTP head")
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        if h["warc-type"] == "response" and (len(body) != declared or sha1_base32(body) != digest):
            raise Malformed("the payload doesn't match its length or digest")
        back = h.get("warc-refers-to")
        if (h["warc-type"] == "revisit") != (back is not None):
            raise Malformed("only a revisit refers to a record")
        yield _page(h["warc-record-id"]), h["warc-target-uri"] or None, body if h["warc-type"] == "response" else None, declared, digest, h["warc-type"], _page(back) if back is not None else None


def plan(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, kind, refers_to) of each page. Payloads are compared by SHA-1 and length.

    Digests alone meet by payload; texts are moved by (id, digest), so one very common payload is spread over its pages.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha1(F.encode("text", "utf-8"))).withColumn("size", F.octet_length("text"))
    names = rows.where(F.col("size") >= least).select("page_id", "digest", "size")
    last = names.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1 and last is not null").drop("copies")
    back = names.join(last, ["digest", "size"]).where("not page_id <=> last").distinct().select(F.col("page_id").alias("id"), F.col("digest").alias("d"), F.col("size").alias("s"), "last")
    out = rows.join(back, rows["page_id"].eqNullSafe(back["id"]) & (rows["digest"] == back["d"]) & (rows["size"] == back["s"]), "left")
    return out.select("page_id", "url", "text", F.when(F.col("last").isNull(), "response").otherwise("revisit").alias("kind"), F.col("last").alias("refers_to"))


def write(planned: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes archives of at most ARCHIVE_BYTES of payload, or one record; returns the table (archive, records, data)."""

    def run(batches):
        held, size, n = [], 0, 0

        def emit():
            data = pack(held)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()[:32]]), pa.array([len(held)], pa.int64()), pa.array([data], pa.binary())], names=["archive", "records", "data"])

        for b in slices(batches):
            for page, url, text, kind, back in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "text", "kind", "refers_to")), strict=True):
                payload = text.encode()
                if held and size + len(payload) > ARCHIVE_BYTES:
                    yield emit()
                    held, size = [], 0
                held.append(record(page, url, payload, kind, back))
                size += len(payload)
        if held:
            yield emit()

    return scratch.save(planned.mapInArrow(run, "archive string, records long, data binary"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """The records of the archives in a column ``data``; a malformed archive stops the job. html is null for a revisit."""
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def emit(rows):
        cols = list(zip(*rows, strict=True))
        cols[2] = [None if x is None else x.decode() for x in cols[2]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for data in b.column(b.schema.get_field_index("data")):
                rows, size = [], 0
                for r in unpack(data.as_py()):
                    rows.append(r)
                    size += len(r[2] or b"")
                    if len(rows) >= 500 or size >= ARCHIVE_BYTES:
                        yield emit(rows)
                        rows, size = [], 0
                if rows:
                    yield emit(rows)

    return archives.select("data").mapInArrow(run, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ``.warc.zst`` files in a folder; a file is one task's work and at most 2 GB."""
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.col("content").alias("data")))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages to archives and reads them back."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read(write(plan(pages, least), scratch)).drop("html")
