"""Shared helpers: scratch tables, Arrow access to text, word hashing, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch  # noqa: F401  (the operators take it from here)


def held_out(doc_id: str, modulus: int, remainder: int):
    """True where crc32 of the id's text leaves ``remainder``; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def sample_ends(sizes, docs: dict, most_bytes: int) -> dict:
    """The hash with which each group's sample ends, from rows (group, hash, size): the smallest hashes, ``docs[group]`` rows and ``most_bytes`` at most, but one row always."""
    ends, n, total = {}, dict.fromkeys(docs, 0), dict.fromkeys(docs, 0)
    for group, x, size in sorted(map(tuple, sizes)):
        n[group] += 1
        total[group] += size
        if n[group] == 1 or (n[group] <= docs[group] and total[group] <= most_bytes):
            ends[group] = x
        else:
            n[group] = docs[group] + 1  # the sample ends here
    return ends


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column of an Arrow batch; a null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.fill_null("") if a.null_count else a
    a = a.cast(pa.large_binary()) if not pa.types.is_large_binary(a.type) else a
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches, most_bytes: int = 1 << 20, text: str = "text"):
    """Cuts Arrow batches so that each has about ``most_bytes`` of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        size = utf8(b.column(b.schema.get_field_index(text)))[1]
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + most_bytes, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


_RNG = np.random.default_rng(0x5EED)
_PLACE = _RNG.integers(1, 2**63, (64, 256), dtype=np.uint64).ravel()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def _hash_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``data``; a word also ends at each place in ``breaks``."""
    ink = ~_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    first[cut] = ink[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    word = np.cumsum(first) - 1
    place = np.arange(len(data)) - starts[np.maximum(word, 0)]
    term = _PLACE[((place & 63) << 8) | _LOWER[data]]
    if int(place.max(initial=0)) >= 64:
        term = term * ((place >> 6).astype(np.uint64) * U(2) + U(1))
    term[~ink] = U(0)
    sums = np.add.reduceat(term, starts)
    size = np.add.reduceat(ink.astype(np.int64), starts).astype(np.uint64)
    return mix(sums + size * U(0x9E3779B97F4A7C15)), starts


def word_hashes(data: np.ndarray, off: np.ndarray, part: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z in lower case) of all texts, and the bounds of each text's words.

    Very long input is hashed in parts that end at white space, so memory stays in proportion to the number of words.
    """
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + part)
        while end < len(data) and not _SPACE[data[end]]:
            gap = np.flatnonzero(_SPACE[data[end : end + 4096]])
            end = min(len(data), end + (int(gap[0]) if len(gap) else 4096))
        h, s = _hash_words(data[at:end], off - at)
        hashes.append(h)
        starts.append(s + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, off, "left")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", steps: int | None = None) -> DataFrame:
    """Connected components of undirected ``edges`` by alternating large-star and small-star steps.

    Returns (node, component): each node of an edge with the smallest node that it reaches. Every step is two joins and
    aggregates on node ids, written to the scratch folder; only two numbers a step reach the driver. With ``steps`` it
    ends after so many: nodes of one label are connected then, but a component may still have several labels.
    """
    e = scratch.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state, done = None, 0
    while done != steps:
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = scratch.save(new.select("x.u", "x.v").where("u <> v").distinct(), "stars")
        scratch.drop(e)
        e, done = new, done + 1
        if steps is None:
            now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == state:
                break
            state = now
    least = e.groupBy("u").agg(F.min("v").alias("v"))
    out = least.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(least.select(F.col("u").alias("node")), "node", "left_anti"))
    out._scratch_path = e._scratch_path  # noqa: SLF001
    return out
