"""How far the sources of a language are apart, and by which terms, by sketch-prefiltered exact counts.

1. A count-min sketch of document frequencies over (language, term): every task sketches its documents, the tasks' tables
   are added. A cell holds at least the frequency of each term that falls on it, so a term whose least cell is under
   the limit can't be frequent. Cells stop at the limit, in the tasks and in the sum, which keeps that true.
2. The second pass counts the terms that may be frequent, pre-aggregated in each task: the others are never shuffled. The exact
   document frequency then decides which terms a language keeps.
3. Shares p = 1 + floor(10^9 (count + 5) / (N + 5 V)) are whole numbers: N the counts of the group, V the kept terms of its language.
4. Two sources differ by the sum of |p - q| over all V terms. Only terms that both have are joined. With a0, b0 the
   shares of absent terms, and |x - y| summed over

       the terms of a against b0 + the terms of b against a0 + (V - terms of a - terms of b) |a0 - b0|
       + over the common terms: |a - b| - |a - b0| - |b - a0| + |a0 - b0|

   The first two sums need a source's distribution of shares only: running sums over its distinct shares, read at the
   absent share of each other source.
5. The terms of a source that are above its language's share, the 50 with the greatest difference; each task keeps 50 of a source before the shuffle.

Defined cases: null text, language or source is ''; a group without terms takes part with shares of absent terms; a language
without kept terms has differences 0 and no term rows; a language of one source has no pair rows; repeated rows and rows of one id
are documents of their own; ties of differences go by the item's UTF-8 bytes; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices

BITS = 22  #: log2 of the cells of a row of the sketch: 16 MB in all, at every input size
ROWS = 4
PARTS = 64  #: the sketch is added in so many parts
HELD = 200_000  #: terms that a task holds before it hands them on
LEAST, TOP = 30, 50
#: Bytes of terms (letters, and all of other characters) keep, A-Z lowered; the rest separates.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SEPARATOR = re.compile(rb"[^A-Za-z\x80-\xff]")


def term_lists(text: bytes, part: int = 1 << 20):
    """The terms of a text in lists; a long text is cut after separators, so that a list stays small."""
    at = 0
    while at < len(text):
        end = min(len(text), at + part)
        if end < len(text):
            cut = SEPARATOR.search(text, end - 1)
            end = cut.end() if cut else len(text)
        yield text[at:end].translate(FOLD).split()
        at = end


def distinct_terms(text: bytes) -> set[bytes]:
    out = set()
    for terms in term_lists(text):
        out.update(terms)
    return out


def cells(lang: bytes, terms, bits: int = BITS) -> np.ndarray:
    """(ROWS, terms): the places of (lang, term) in the sketch, laid out as one array."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(lang + b"\0" + t) for t in terms), np.uint64, len(terms))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    r = np.arange(ROWS, dtype=np.uint64)[:, None]
    return (((low + r * high) & np.uint64((1 << bits) - 1)) + (r << np.uint64(bits))).astype(np.int64)


def _columns(b):
    """(lang, source, text) of each row of an Arrow batch, as bytes."""
    return zip(*(b.column(k).cast(pa.binary()).to_pylist() for k in range(3)), strict=True)


def sketch(docs: DataFrame, least: int = LEAST, bits: int = BITS, most: int = HELD) -> np.ndarray:
    """The merged sketch of (lang, term) document frequencies up to ``least``."""
    parts = min(PARTS, ROWS << bits)
    width, kind = (ROWS << bits) // parts, np.uint8 if least < 256 else np.uint32

    def count(batches):
        table, held = np.zeros(ROWS << bits, np.uint32), {}

        def put():
            for lang, c in held.items():
                n = np.minimum(np.fromiter(c.values(), np.int64, len(c)), least).astype(np.uint32)
                np.add.at(table, cells(lang, c, bits).ravel(), np.tile(n, ROWS))
                np.minimum(table, least, out=table)
            held.clear()

        for b in slices(batches):
            for lang, _, text in _columns(b):
                c = held.setdefault(lang, Counter())
                c.update(distinct_terms(text))
            if sum(map(len, held.values())) > most:
                put()
        put()
        blocks = [table[k * width : (k + 1) * width] for k in range(parts)]
        some = [k for k in range(parts) if blocks[k].any()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "cells": pa.array([zlib.compress(blocks[k].astype(kind).tobytes(), 1) for k in some], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = np.minimum(sums.get(k, np.zeros(width, np.uint32)) + np.frombuffer(zlib.decompress(c), kind), least)
        if sums:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "cells": pa.array([zlib.compress(v.astype(kind).tobytes(), 1) for v in sums.values()], pa.binary())})

    schema = "part int, cells binary"
    out = np.zeros(ROWS << bits, kind)
    for r in docs.mapInArrow(count, schema).repartition(parts, "part").mapInArrow(add, schema).collect():  # PARTS rows, 16 MB at most
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(zlib.decompress(bytes(r.cells)), kind)
    return out


def survivors(docs: DataFrame, table: np.ndarray, least: int = LEAST, most: int = HELD) -> DataFrame:
    """(lang, source, term, n, df) of the terms that may be frequent, exact; a row of null term for each (lang, source)."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(table), (len(table) // ROWS).bit_length() - 1

    def count(batches):
        known, held, wide = shared.value, {}, 0

        def rows():
            out = []
            for (lang, source), (n, df) in held.items():
                out.append((lang, source, None, 0, 0))
                if n:
                    may = (known[cells(lang, n, bits)] >= least).all(axis=0)
                    out += [(lang, source, t, c, df[t]) for (t, c), keep in zip(n.items(), may.tolist(), strict=True) if keep]
            held.clear()
            names = zip("lang source term".split(), range(3))
            return pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in out], pa.binary()).cast(pa.string()) for name, k in names} | {"n": pa.array([r[3] for r in out], pa.int64()), "df": pa.array([r[4] for r in out], pa.int64())})

        for b in slices(batches):
            for lang, source, text in _columns(b):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                wide -= len(n)
                seen = set()
                for terms in term_lists(text):
                    n.update(terms)
                    seen.update(terms)
                df.update(seen)
                wide += len(n) + 1
            if wide > most:
                yield rows()
                wide = 0
        if held:
            yield rows()

    out = docs.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact; 0 where there are no kept terms."""
    wide = "1000000000 * (cast({} as decimal(19, 0)) + 5)".format(count)
    return F.expr(f"if({kept} = 0, 0L, 1 + ({wide}) div nullif(cast({total} as decimal(19, 0)) + 5 * {kept}, 0))")


def _both(a: Column, b: Column, forth: Column, back: Column) -> Column:
    return F.explode(F.array(F.struct(a.alias("source"), b.alias("item"), forth.alias("value")), F.struct(b.alias("source"), a.alias("item"), back.alias("value")))).alias("x")


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP, bits: int = BITS, most: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for the other sources of the language, ``term`` for the terms above its share.

    ``bits`` and ``most`` (terms that a task holds) change the work, not the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = scratch.save(survivors(d, sketch(d, least, bits, most), least, most), "counts")
    terms = counted.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n_lang")).where(F.col("df") >= least).drop("df")
    own = scratch.save(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "kept")
    of_lang = own.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total_lang"))
    of_source = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = counted.where("term is null").select("lang", "source").join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0)
    groups = scratch.save(groups.withColumn("p0", share("0L", "total", "v")), "groups")

    shares = own.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "v"), "q": share("n_lang", "total_lang", "v")})
    shares = scratch.save(shares.select("lang", "source", "term", "p", "q", "p0"), "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # a source's shares against the absent share of each other source: running sums over distinct shares
    levels = shares.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count("*").alias("m"))
    sums = levels.groupBy("lang", "source").agg(F.sum(F.expr("m * at")).alias("all_p"))
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    both_absent = F.expr("(a.v - a.terms - b.terms) * abs(a.p0 - b.p0)")
    reads = pairs.select("a.lang", "a.source", F.col("b.p0").alias("at"), F.lit(0).cast("long").alias("m"), F.col("b.source").alias("item"), F.col("a.terms").alias("terms"), both_absent.alias("base"))
    events = levels.withColumns({"item": F.lit(None).cast("string"), "terms": F.lit(0).cast("long"), "base": F.lit(0).cast("long")}).unionByName(reads)
    upto = Window.partitionBy("lang", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumns({"below": F.sum("m").over(upto), "below_p": F.sum(F.expr("m * at")).over(upto)}).where("item is not null")
    run = run.join(sums, ["lang", "source"], "left").fillna(0, ["all_p"])
    apart = F.expr("at * (2 * below - terms) + all_p - 2 * below_p")
    one_sided = run.select("lang", _both(F.col("source"), F.col("item"), apart + F.col("base"), apart)).select("lang", "x.*")

    a, b = shares.alias("a"), shares.alias("b")
    meet = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    common = meet.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("x"), F.col("b.source").alias("y")).agg(F.sum(F.expr("abs(a.p - b.p) - abs(a.p - b.p0) - abs(b.p - a.p0) + abs(a.p0 - b.p0)")).alias("value"))
    common = common.select("lang", _both(F.col("x"), F.col("y"), F.col("value"), F.col("value"))).select("lang", "x.*")
    values = one_sided.unionByName(common).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    values = values.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return values.unionByName(above)
