"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for two primes, the sum of code point * base**position over each prefix. From them the hash
of any span follows in a few operations (spans of equal content agree wherever they stand), spans are compared for equality, and
longest common extensions are found by binary search. The arrays of an edited text are put together from those of its two parts.

A fingerprint is a string: the hash and length of the whole text; hashes of its beginnings and of its ends at lengths that grow
by a quarter; and sketches, the smallest mixed hashes of all its spans of 24 code points (of 6 too, where the text is
shorter than 192; of what there is, where it is shorter than a span). The likeness is a function of two such strings alone, the greater of two shares: the part of both texts'
spans that is common (twice the common over all of both, from the resemblance of the sketches), and the common
beginning and end over the longer length, both located in the stored hashes by binary search. It is 1 for equal texts.

``neighbours`` works on texts in the order of their ids: ids are dealt to ranges of about equal size, each range goes to
one task together with the row that follows it, and is read in order, so only two texts are held at once. The cuts
between ranges are at most MOST_RANGES numbers, so what is broadcast doesn't grow beyond 1 MB. An id (or null) with more rows than a range is cut into
ranges of its own by the hash of the text.

Defined cases: null text is empty; the empty text has a fingerprint of its own, with likeness 1 to itself and 0 to any other;
a null id comes first; rows with the same id are ordered by their text, or by its hash first where they are more than a range; equal rows
that follow one another are compared once; a table of one row is its own next document; an empty table gives no rows; texts of any length are hashed whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, mix

PRIMES = (2147483629, 2147483587)
BASES = (911382323, 972663749)
SPAN, NARROW = 24, 6  #: code points of a span
SHORT = 192  #: texts below this length have a sketch of narrow spans too
SKETCH = 64
MOST_RANGES = 65_536
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
        for table, base in ((_POWERS, b), (_INVERSE, pow(b, -1, p))):
            while len(table[k]) < n:  # doubling: the next half is this one times base**length
                step = pow(base, len(table[k]), p)
                table[k] = np.concatenate([table[k], table[k] * U(step) % U(p)])


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        _grow(self.n + 1)
        x = codes.astype(np.uint64) + U(1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _POWERS[k][: self.n] % U(p)) % U(p)]) for k, p in enumerate(PRIMES)]

    @classmethod
    def of(cls, text: str) -> PrefixHash:
        return cls(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))

    def span(self, start, end) -> np.ndarray:
        """62-bit hashes of the spans [start, end), which may be arrays."""
        a, b = np.asarray(start), np.asarray(end)
        h = [(self.sums[k][b] + U(p) - self.sums[k][a]) % U(p) * _INVERSE[k][a] % U(p) for k, p in enumerate(PRIMES)]
        return h[0] << U(31) | h[1]

    def _one(self, k: int, start: int, end: int) -> int:
        p = PRIMES[k]
        return (int(self.sums[k][end]) - int(self.sums[k][start])) % p * int(_INVERSE[k][start]) % p

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Are the spans of this length from i here and from j there equal?"""
        return i + length <= self.n and j + length <= other.n and all(self._one(k, i, i + length) == other._one(k, j, j + length) for k in (0, 1))

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension to the right of position i here and j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.equal(i, other, j, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def extension_left(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension to the left of position i here and j there."""
        lo, hi = 0, min(i, j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.equal(i - mid, other, j - mid, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def joined(self, keep: int, other: PrefixHash, k: int) -> PrefixHash:
        """The prefix arrays of this text's first ``keep`` code points followed by the other's first ``k``."""
        out = PrefixHash.__new__(PrefixHash)
        out.n = keep + k
        _grow(out.n + 1)
        out.sums = [np.concatenate([self.sums[i][: keep + 1], (self.sums[i][keep] + other.sums[i][1 : k + 1] * _POWERS[i][keep] % U(p)) % U(p)]) for i, p in enumerate(PRIMES)]
        return out

    def spans(self, width: int, start: int = 0) -> np.ndarray:
        """Mixed 40-bit hashes of the spans of this width from ``start`` on; of the whole text, where it is shorter."""
        at = np.arange(start, max(1, self.n - width + 1))
        return mix(self.span(at, np.minimum(at + width, self.n))) >> U(24)


def lowest(h: np.ndarray) -> np.ndarray:
    """The SKETCH smallest distinct numbers."""
    if len(h) > 8 * SKETCH and len(few := np.unique(np.partition(h, 4 * SKETCH)[: 4 * SKETCH])) >= SKETCH:
        return few[:SKETCH]
    return np.unique(h)[:SKETCH]


def _lengths(n: int, made: list[int] = []) -> np.ndarray:  # noqa: B006  the list is kept between calls
    """1 to 16 and from there on by a quarter more, up to n."""
    while not made or made[-1] <= n:
        made.append(len(made) + 1 if len(made) < 16 else made[-1] * 5 // 4)
    return np.array([x for x in made if x <= n], np.int64)


class Fingerprint:
    """A fingerprint, of a text or read from its string. Lists: hashes of beginnings, of ends, narrow sketch, wide sketch."""

    SIZES = (6, 6, 10, 10)  #: hexadecimal digits of a number of each list

    def __init__(self, whole: str, lists: list[np.ndarray]):
        self.whole, self.n, self.lists = whole, int(whole[16:], 16), lists

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        whole, *lists = text.split(":")
        return cls(whole, [np.array([int(x[i : i + k], 16) for i in range(0, len(x), k)], np.uint64) for x, k in zip(lists, cls.SIZES, strict=True)])

    def __str__(self) -> str:
        return ":".join([self.whole, *("".join([f"{x:0{k}x}" for x in v.tolist()]) for v, k in zip(self.lists, self.SIZES, strict=True))])

    def likeness(self, other: Fingerprint) -> float:
        if self.whole == other.whole:
            return 1.0
        if not self.n or not other.n:
            return 0.0
        least, most = min(self.n, other.n), max(self.n, other.n)
        lengths = _lengths(least)
        ends = sum(int(lengths[k - 1]) for x, y in zip(self.lists[:2], other.lists[:2], strict=True) if (k := _common(x, y, len(lengths))))
        a, b = next((a, b) for a, b in zip(self.lists[2:], other.lists[2:], strict=True) if len(a) and len(b))
        both = np.union1d(a, b)[:SKETCH]
        shared = len(np.intersect1d(np.intersect1d(both, a, assume_unique=True), b, assume_unique=True))
        return max(2 * shared / (len(both) + shared), min(ends, least) / most)


def _common(x: np.ndarray, y: np.ndarray, n: int) -> int:
    """How many of the first ``n`` hashes of growing beginnings are equal, by binary search."""
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[mid - 1] == y[mid - 1]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprint strings, 0 to 1."""
    return Fingerprint.parse(a).likeness(Fingerprint.parse(b))


class Document:
    """A text with its prefix arrays, span hashes and fingerprint."""

    def __init__(self, text: str, arrays: PrefixHash | None = None, spans: dict[int, np.ndarray] | None = None):
        self.text, self.hash = text, arrays or PrefixHash.of(text)
        h, n = self.hash, self.hash.n
        self.spans = spans or {w: h.spans(w) for w in self.widths(n)}
        of = _lengths(n)
        cut = lambda x: mix(x) >> U(40)
        lists = [cut(h.span(np.zeros(len(of), np.int64), of)), cut(h.span(n - of, np.full(len(of), n))), *(lowest(self.spans[w]) if w in self.spans else np.zeros(0, np.uint64) for w in (NARROW, SPAN))]
        self.print = Fingerprint(f"{int(h.span(0, n)):016x}{n:08x}", lists)

    @staticmethod
    def widths(n: int) -> tuple[int, ...]:
        return () if not n else (SPAN,) if n >= SHORT else (NARROW, SPAN)

    def edited(self, following: Document) -> Document:
        """The last floor(n / 4) code points replaced by the first as many of the following text; what stays isn't hashed again."""
        n = self.hash.n
        k = n // 4
        take = min(k, following.hash.n)
        text, arrays = edited(self.text, following.text), self.hash.joined(n - k, following.hash, take)
        spans = {}
        for w in self.widths(arrays.n):
            same = max(0, n - k - w + 1) if w in self.spans else 0
            spans[w] = np.concatenate([self.spans[w][:same], arrays.spans(w, same)]) if same else arrays.spans(w)
        return Document(text, arrays, spans)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 4) code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compare(own: Document, then: Document) -> tuple:
    other = own.edited(then)
    return own.hash.n, hashlib.sha256(other.text.encode("utf-8", "surrogatepass")).hexdigest(), str(own.print), str(other.print), own.print.likeness(other.print), own.print.likeness(then.print)


class Ranges:
    """Maps an id, and the text's hash where the id is hot, to its range: a step function of both."""

    def __init__(self, cuts: list[int], hot: dict[int, int], range_rows: int):
        self.cuts = np.array(sorted({*cuts, *hot, *(k - 1 for k in hot if k > -(2**63))}), np.int64)
        self.of = np.ones(len(self.cuts) + 1, np.uint64)  # ranges of each slot
        for k, c in hot.items():
            self.of[np.searchsorted(self.cuts, k)] = math.ceil(c / range_rows)
        self.first = np.concatenate([[0], np.cumsum(self.of.astype(np.int64))])

    def place(self, k: np.ndarray, h: np.ndarray) -> np.ndarray:
        slot = np.searchsorted(self.cuts, k)
        return (self.first[slot] + ((h.astype(np.uint64) * self.of[slot]) >> U(31)).astype(np.int64)).astype(np.int32)


def _own_tasks(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` numbers a key that ``repartition(parts, key)`` sends to a task of its own."""
    out: dict[int, int] = {}
    at, step = 0, 4 * parts + 64
    while len(out) < parts:
        for r in spark.range(at, at + step).select(F.col("id").cast("int").alias("id")).groupBy(F.expr(f"pmod(hash(id), {parts})").alias("task")).agg(F.min("id").alias("id")).collect():  # at most ``parts`` rows
            out.setdefault(r.task, r.id)
        at += step
    return [out[i] for i in range(parts)]


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_rows: int = 4000) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness to the next document's.

    The ids alone are read to lay out the ranges; texts are read and moved once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = rows.withColumn("k", F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], out)
    range_rows = max(range_rows, math.ceil(n / MOST_RANGES))
    parts = math.ceil(n / range_rows)
    hot = {r.k: r.c for r in rows.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > range_rows).collect()}  # fewer than ``parts``
    cuts = [int(c) for c in rows.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)] if parts > 1 else []
    ranges = Ranges(cuts, hot, range_rows)
    shared, many = spark.sparkContext.broadcast(ranges), int(ranges.first[-1])

    @F.pandas_udf("int")
    def place(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.place(k.to_numpy(np.int64), h.to_numpy(np.int64)))

    # 31 bits of the text's hash order the rows of hot ids; the texts aren't read for it where there are none.
    rows = rows.withColumn("h", F.when(F.col("k").isin(list(hot)), F.shiftrightunsigned(F.xxhash64("text"), 33)).otherwise(0) if hot else F.lit(0).cast("long"))
    rows = rows.withColumn("part", place("k", "h"))
    firsts = sorted((r.part, r.x.k, r.x.h) for r in rows.groupBy("part").agg(F.min(F.struct("k", "h")).alias("x")).collect())  # one row a range
    task = {p: x for (p, _, _), x in zip(firsts, _own_tasks(spark, len(firsts)), strict=True)}
    # The first rows of a range also go to the range before it; those of the whole follow the last range.
    before = spark.createDataFrame([(k, h, task[firsts[i - 1][0]], firsts[i - 1][0]) for i, (_, k, h) in enumerate(firsts)], "k long, h long, task int, part int")
    tasks = spark.createDataFrame(list(task.items()), "part int, task int")
    dealt = rows.join(F.broadcast(tasks), "part").join(F.broadcast(before.select("k", "h", F.struct("task", "part", F.lit(1).alias("tail")).alias("before"))), ["k", "h"], "left")
    here = F.struct("task", "part", F.lit(0).alias("tail"))
    dealt = dealt.select("doc_id", "text", "k", "h", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, "before"))).alias("x"))
    dealt = dealt.select("doc_id", "text", "k", "h", "x.*").repartition(len(firsts), "task").sortWithinPartitions("part", "tail", "k", "h", "text")

    def run(batches):
        names = out.replace(",", "").split()[::2]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        held, got, skip, same = None, [], False, None

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for doc, t, part, tail in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "part", "tail")), strict=True):
                if tail and skip:  # only the first of the rows that stand for what follows the range
                    continue
                now = held[2] if held and held[0] == part and held[2].text == t else Document(t)
                if held and held[0] == part:
                    if held[2] is not now or same is None:
                        made = _compare(held[2], now)
                    else:
                        made = same
                    same = made if held[2] is now else None
                    got.append((held[1], *made))
                held = (part, doc, now)
                skip = bool(tail)
                if len(got) >= 500:
                    yield emit()
                    got = []
                if tail:
                    held = same = None
        if got:
            yield emit()

    return dealt.mapInArrow(run, out)
