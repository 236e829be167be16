"""N-gram Jaccard join with rare-first prefix filtering.

Two documents link when 100 * |A & B| >= 75 * |A | B| over their sets of word 5-grams. Plan:

1. A table of fixed size counts how often the n-grams of each hash bucket occur in the whole corpus. It is a sum over
   all documents and orders n-grams from rare to frequent, the same way everywhere; any such order is correct for
   prefix filtering, the counts only make prefixes selective.
2. Each document is reduced to (size, digest of the set, rare-first prefix, parity bits of the set). Equal sets become
   one class, joined through its smallest id, so exact copies are never paired.
3. Leader rounds. Among the documents of a prefix n-gram the leader is the one in which it comes first in the common
   order: in a group of near copies that is the copy with the fewest n-grams of its own, to which most others link.
   Each document proposes the leader it shares most prefix n-grams with; links that verify give labels. A round costs
   one verification a document, and rounds go on while they reduce the pairs that are left.
4. All remaining pairs between different labels meet on a prefix n-gram and pass the length and positional
   filters inside the join's condition (postings without a possible partner are gone before), then the suffix filter, for which the parity bits of only their
   documents are moved; what is left is verified once each on the whole texts. Of an n-gram's postings only those outside its most frequent label
   start pairs, so a merged group costs nothing; a frequent n-gram's postings are dealt to cells. No cap on partners or candidates anywhere.
5. Where links are counted, the classes of each component are dealt to blocks, and each two blocks of a component are
   compared in one row, all sets with all: every link lies inside a component, so none is missed, and pairs of
   documents never become rows.

The suffix filter: let a common n-gram be the first in the common order that two sets share. All n-grams before it differ,
so the sets' symmetric difference is pos_a + pos_b and that of the suffixes behind it. The latter is bounded from below
by the parity bits of the suffixes (those of the whole set, with the prefix up to the n-gram taken out): each
n-gram that is in one suffix only flips one bit.

Defined cases: null or blank text has an empty set and links with nothing; fewer words than n form one n-gram; repeated
rows of one id give one result row each; where their texts differ the id's component is that of all its texts, and each row has class and links
of its own text; an empty table gives no rows; a null id is allowed and takes part like any other row of its class only when
its class has a non-null id, else it stays alone with a null component; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import Scratch, U, components, mix, slices, utf8, word_hashes

BITS = 20  #: log2 of the buckets of the frequency table: 4 MB, at every input size
PARTS = 64  #: the table is summed in so many parts
HOT = 50_000  #: an n-gram in a bucket over this count is dealt to SALTS groups
SALTS = 64
SUFFIX_WORDS = 1024  #: 64-bit words of a suffix's parity bits at most, all that the low 16 bits of an n-gram address; fewer bits prune less
KEY = 40  #: bits of an n-gram's hash by which postings meet; where two n-grams share them more pairs are verified
CELL = 20_000  #: postings of an n-gram in a cell of the join, pairs of a leader in a cell of the verification
BLOCK = 128  #: classes of a component in a block, on average, when links are counted


def shingle_sets(batch, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit n-gram hashes of each text of an Arrow batch."""
    words, bound = word_hashes(*utf8(batch.column(batch.schema.get_field_index("text"))))
    return sets_of(words, bound, n)


def digest_of(grams: np.ndarray) -> tuple[int, int]:
    """(key, check) of a sorted set: 128 bits that stand for it."""
    d = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sets_of(words: np.ndarray, bound: np.ndarray, n: int) -> list[np.ndarray]:
    runs = max(0, len(words) - n + 1)
    grams = mix(words[:runs] ^ U(n))
    for k in range(1, n):
        grams = mix(grams * U(0x9E3779B97F4A7C15) + words[k : k + runs])
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = mix(words[a : a + 1] ^ U(b - a))
            for k in range(a + 1, b):
                h = mix(h * U(0x9E3779B97F4A7C15) + words[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def frequency_table(texts: DataFrame, n: int) -> np.ndarray:
    """Occurrences of the n-grams of each of 2**BITS hash buckets over all documents."""
    width = (1 << BITS) // PARTS

    def count(batches):
        total = np.zeros(1 << BITS, np.uint32)
        for b in slices(batches):
            grams = np.concatenate(shingle_sets(b, n))
            total += np.bincount((grams >> U(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "counts": pa.array([total[k * width : (k + 1) * width].tobytes() for k in range(PARTS)], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, np.zeros(width, np.int64)) + np.frombuffer(c, np.uint32)
        if sums:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in sums.values()], pa.binary())})

    schema = "part int, counts binary"
    rows = texts.select("text").mapInArrow(count, schema).repartition(PARTS, "part").mapInArrow(add, schema).collect()  # PARTS rows, 4 MB
    table = np.zeros(1 << BITS, np.uint32)
    for r in rows:
        table[r.part * width : (r.part + 1) * width] = np.frombuffer(bytes(r.counts), np.uint32)
    return table


def words_for(n: int) -> int:
    """64-bit words of the parity bits of a set of n: a power of two, about four bits an element."""
    return 1 << max(3, (max(1, n) // 16).bit_length())


def parity(grams: np.ndarray, words: int) -> np.ndarray:
    """One bit for each hash residue: is the number of elements there odd? Sets that differ in d elements differ in d bits at most."""
    odd = np.bincount((grams & U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _profiles(texts: DataFrame, table, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, class key, check, rare-first prefix, how many of it aren't hot, parity bits) of each document."""

    def profile(batches):
        counts = table.value
        for b in slices(batches):
            size, key, check, prefix, cold, sig = [], [], [], [], [], []
            for s in shingle_sets(b, n):
                m = len(s)
                k, d = digest_of(s)
                c = counts[(s >> U(64 - BITS)).astype(np.int64)].astype(np.uint64)
                p = m - (percent * m + 99) // 100 + 1 if m else 0
                first = np.argsort((np.minimum(c, U((1 << 24) - 1)) << U(40)) | (s & U((1 << 40) - 1)), kind="stable")[:p]
                size.append(m)
                key.append(k)
                check.append(d)
                prefix.append(s[first].view(np.int64))
                cold.append(int((c[first] <= HOT).sum()))
                sig.append(parity(s, words_for(m)))
            off = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), pa.array(size, pa.int64()), pa.array(key, pa.int64()), pa.array(check, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(prefix) if prefix else [], pa.int64())), pa.array(cold, pa.int32()), pa.array(sig, pa.list_(pa.int64()))],
                names=["doc_id", "n", "key", "check", "prefix", "cold", "sig"],
            )

    return texts.mapInArrow(profile, "doc_id long, n long, key long, check long, prefix array<long>, cold int, sig array<long>")


def _verify(texts: DataFrame, pairs: DataFrame, n: int, percent: int, small: int = 300_000) -> DataFrame:
    """The pairs (a, b) of which two whole texts link; each pair is looked at once. Saved ``pairs`` are read four times.

    Only texts of ids in ``pairs`` are moved. The id list is broadcast where it has at most ``small`` rows (2.4 MB);
    a longer list is joined by shuffle. The pairs of one b are dealt to cells, so that a leader of many has its text in as many places as it takes.
    """
    degree = pairs.groupBy("b").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(degree.select(F.col("b").alias("doc_id"))).distinct()
    few = ids.limit(small + 1).count() <= small
    used = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").repartition("doc_id").distinct()
    right = used.join(degree.withColumnRenamed("b", "doc_id"), "doc_id").select(F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("text").alias("other"))
    left = pairs.join(degree, "b").select("a", "b", F.expr("int(pmod(xxhash64(a), cells))").alias("cell")).join(used.withColumnRenamed("doc_id", "a"), "a")
    both = left.join(right, ["b", "cell"])

    def check(batches):
        for b in slices(batches):
            left = shingle_sets(b, n)
            right = shingle_sets(pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("other"))], names=["text"]), n)
            ok = []
            for x, y in zip(left, right, strict=True):
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(bool(same) and 100 * same >= percent * (len(x) + len(y) - same))
            m = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("a")).filter(m), b.column(b.schema.get_field_index("b")).filter(m)], names=["a", "b"])

    return both.select("a", "b", "text", "other").mapInArrow(check, "a long, b long")


def _alpha(x: str, y: str, percent: int):
    """Least overlap of linked sets of these sizes: ceil(percent * (x + y) / (100 + percent))."""
    return F.expr(f"({percent} * ({x} + {y}) + {99 + percent}) div {100 + percent}")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, most_pairs: float = 2.0, gain: float = 0.2, count: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id and, with ``count``, links: how many other classes its class links with.

    ``component_id`` is the smallest doc_id reachable through links. Leader rounds go on while the pairs of
    postings with different labels outnumber the postings ``most_pairs`` times and the last round has taken away the share ``gain``
    of them; both change the work, not the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-jaccard")
    texts = _texts(docs, doc_id, text)
    table = spark.sparkContext.broadcast(frequency_table(texts, n))
    prof = scratch.save(_profiles(texts, table, n, percent), "profiles")
    table.destroy()
    scratch.release()
    known = prof.where("n > 0 and doc_id is not null")
    classes = scratch.save(known.groupBy("key", "check", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = prof.join(classes.select("key", "check", "n", F.col("rep").alias("doc_id")), ["key", "check", "n", "doc_id"], "left_semi")
    post = reps.select(F.col("doc_id").alias("rep"), "n", "cold", F.posexplode("prefix").alias("pos", "h")).withColumn("salt", F.expr(f"if(pos >= cold, pmod(rep, {SALTS}), -1)"))
    met = Observation()
    post = scratch.save(_met(post, percent).observe(met, F.count_if(F.expr("salt >= 0 or before1_n is not null or behind1_n is not null")).alias("n")).where("salt >= 0 or partner").select("h", "rep", "n", "pos"), "postings")
    scratch.release()
    total, sig = met.get["n"], prof.select(F.col("doc_id").alias("rep"), "n", "sig")

    # The links of ids with several texts: each of their classes is reached.
    several = known.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id")
    links = [known.select("doc_id", "key", "check", "n").join(several, "doc_id", "left_semi").join(classes, ["key", "check", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")]
    label, before = None, float("inf")
    while True:
        cur = _labelled(post, label)
        cells = _cells(cur)
        cross = cells.agg(F.coalesce(F.sum(F.col("others").cast("double") * F.col("k")), F.lit(0.0))).first()[0]
        if cross <= most_pairs * total or cross > (1 - gain) * before:
            break
        before = cross
        pairs = scratch.save(_leader_pairs(cur, sig, len(links) - 1, percent), "proposed")
        links.append(scratch.save(_verify(texts, pairs, n, percent), "links"))
        old, label = label, scratch.save(components(spark, _union(links[1:]), scratch, steps=2), "labels")
        scratch.drop(pairs, old)
        scratch.release()
    rows = scratch.save(cur.join(cells.select("h", "most", "cells"), "h"), "apart")
    scratch.drop(post, label)
    scratch.release()
    met_at = scratch.save(_cross_pairs(rows, percent), "met")
    scratch.drop(rows)
    scratch.release()
    pairs = scratch.save(_behind(met_at, prof, percent), "pairs")
    scratch.drop(met_at)
    scratch.release()
    links.append(scratch.save(_verify(texts, pairs, n, percent), "links"))
    scratch.drop(pairs)
    scratch.release()
    final = scratch.save(components(spark, _union(links), scratch), "components")
    named = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    if count:
        named = named.join(_count_links(texts, classes, final, n, percent), ["key", "check"], "left")
    named = named.select("key", "check", "n", "rep", F.coalesce("component", "rep").alias("component"), *([F.coalesce("links", F.lit(0)).cast("long").alias("links")] if count else []))
    out = prof.select("doc_id", "n", "key", "check").join(named, ["key", "check", "n"], "left")
    alone = (F.col("n") == 0) | F.col("rep").isNull()
    out = out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("class_id"),
        *([F.coalesce("links", F.lit(0)).alias("links")] if count else []),
    )
    out = scratch.save(out, "result")
    scratch.drop(prof, classes, final, *links)
    scratch.release()
    return out


def _count_links(texts: DataFrame, classes: DataFrame, comp: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, check, links): the exact number of links of each class whose representative is in ``comp`` (node, component).

    An id with several texts may represent several classes, so classes go by their digests, not by their ids.
    """
    known = classes.join(comp.select(F.col("node").alias("rep"), "component"), "rep").select("key", "check", "rep", "component")
    large = known.groupBy("component").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK).select("component", F.ceil(F.col("k") / BLOCK).cast("long").alias("of"))
    place = known.join(large, "component", "left").select("key", "check", "component", F.coalesce("of", F.lit(1)).alias("of"))
    used = texts.join(known.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text").distinct()

    def sets(batches):
        for b in slices(batches):
            all_ = shingle_sets(b, n)
            both = [digest_of(x) for x in all_]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in both], pa.int64()), pa.array([c for _, c in both], pa.int64()), pa.array([x.tobytes() for x in all_], pa.binary())], names=["key", "check", "grams"])

    own = used.mapInArrow(sets, "key long, check long, grams binary").groupBy("key", "check").agg(F.first("grams").alias("grams"))  # equal digests, equal sets
    own = own.join(place, ["key", "check"]).withColumn("block", F.expr("pmod(xxhash64(key, check), of)"))
    blocks = own.groupBy("component", "of", "block").agg(F.collect_list(F.struct("key", "check", "grams")).alias("s"))
    left = blocks.select("component", "s", F.col("block").alias("i"), F.explode(F.expr("sequence(block, of - 1)")).alias("block"))
    right = blocks.select("component", "block", F.col("s").alias("t"))
    pairs = left.join(right, ["component", "block"]).select("s", F.when(F.col("i") < F.col("block"), F.col("t")).alias("t"))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                s, t = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                links = _links_between([x["grams"] for x in s], None if t is None else [x["grams"] for x in t], percent)
                rows = s + (t or [])
                yield pa.RecordBatch.from_arrays([pa.array([x["key"] for x in rows], pa.int64()), pa.array([x["check"] for x in rows], pa.int64()), pa.array(links, pa.int64())], names=["key", "check", "links"])

    return pairs.mapInArrow(run, "key long, check long, links long").groupBy("key", "check").agg(F.sum("links").alias("links"))


def _links_between(s: list[bytes], t: list[bytes] | None, percent: int) -> list[int]:
    """Links of each set of ``s`` and ``t`` across both, or within ``s`` where ``t`` is none. No set is empty."""
    rows = s + (t or [])
    grams = [np.frombuffer(x, np.uint64) for x in rows]
    size = np.array([len(x) for x in grams], np.int64)
    word = np.unique(np.concatenate(grams), return_inverse=True)[1]
    bound = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(word.max()) + 1, np.int64)
    links = np.zeros(len(rows), np.int64)
    for a in range(len(s)):
        own = word[bound[a] : bound[a + 1]]
        mark[own] = 1
        first = a + 1 if t is None else len(s)
        if first < len(rows):
            same = np.add.reduceat(mark[word[bound[first] :]], bound[first:-1] - bound[first])
            hit = (same > 0) & (100 * same >= percent * (size[a] + size[first:] - same))
            links[a] += hit.sum()
            links[first:] += hit
        mark[own] = 0
    return links.tolist()


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _labelled(post: DataFrame, label: DataFrame | None) -> DataFrame:
    """The postings with the label ``c`` of their document."""
    if label is None:
        return post.withColumn("c", F.col("rep"))
    return post.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")


def _near(na: str, pa_: str, nb: str, pb: str, percent: int) -> str:
    """The length and positional filters of two postings of an n-gram."""
    return f"""(100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})
               and {pa_} + {pb} + abs(({na} - {pa_}) - ({nb} - {pb})) <= {na} + {nb} - 2 * (({percent} * ({na} + {nb}) + {99 + percent}) div {100 + percent}))"""


def _met(post: DataFrame, percent: int) -> DataFrame:
    """``post`` with the neighbours of each posting among its n-gram's, by size, and ``partner``: may another one pass the filters with it?

    Of two postings each is the other's only partner, so both filters decide; of more, one whose neighbours on both sides fail the length filter has none.
    """
    # An n-gram and its salt travel as one number, size and position as another: the exchange of all postings is the widest of the join.
    w = Window.partitionBy("key").orderBy("x")
    post = post.select(F.expr(f"(h & {(1 << KEY) - 1}) | shiftleft(salt + 1, {KEY})").alias("key"), "rep", F.expr("shiftleft(bigint(n), 32) | pos").alias("x"))
    post = post.select("*", *(f("x", k).over(w).alias(f"{x}{k}") for f, x in ((F.lag, "before"), (F.lead, "behind")) for k in (1, 2)))
    part = lambda x, at: [F.shiftright(x, 32).alias(f"{at}n"), F.expr(f"int({x} & {(1 << 31) - 1})").alias(f"{at}pos")]
    post = post.select(F.expr(f"key & {(1 << KEY) - 1}").alias("h"), (F.shiftright("key", KEY) - 1).alias("salt"), "rep", *part("x", ""), *part("before1", "before1_"), *part("behind1", "behind1_"), "before2", "behind2")
    length = f"(100 * before1_n >= {percent} * n or 100 * n >= {percent} * behind1_n)"
    only = lambda x: _near("n", "pos", f"{x}1_n", f"{x}1_pos", percent)
    return post.withColumn("partner", F.expr(f"case when before1_n is null and behind2 is null then {only('behind')} when behind1_n is null and before2 is null then {only('before')} else {length} end"))


def _cells(cur: DataFrame) -> DataFrame:
    """(h, k, most, others, cells) of the n-grams that meet in several labels: postings, the most frequent label, postings of other labels, cells."""
    by = cur.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.sum("k").alias("k"), F.max(F.struct("k", "c")).alias("x"))
    return by.where("k > x.k").select("h", "k", F.col("x.c").alias("most"), (F.col("k") - F.col("x.k")).alias("others"), F.ceil(F.col("k") / CELL).cast("int").alias("cells"))


def _apart(sa: str, sb: str):
    """Bits in which two parity words lists differ; the longer list is folded to the length of the shorter."""
    xor = lambda x, y: x.bitwiseXOR(y)

    def to(s: str, other: str):
        m = F.size(other)
        return F.when(F.size(s) > m, F.zip_with(F.slice(s, 1, m), F.slice(s, m + 1, m), xor)).otherwise(F.col(s))

    return F.aggregate(F.zip_with(to(sa, sb), to(sb, sa), lambda x, y: F.bit_count(xor(x, y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def _leader_pairs(cur: DataFrame, sig: DataFrame, round_: int, percent: int) -> DataFrame:
    """(a, b): each document with the leader, among those of its prefix n-grams with another label, that it shares most n-grams with.

    An n-gram has two leaders: in the first round those in which it comes first and last in the common order, later those
    of the least and greatest hash.
    """
    priority = F.xxhash64("rep", F.lit(round_)) if round_ else F.col("pos").cast("long")
    order = F.struct(priority.alias("x"), F.col("rep"), F.col("n"), F.col("c"))
    lead = cur.groupBy("h").agg(F.min(order).alias("l"), F.max(order).alias("m")).where("l.rep <> m.rep")
    votes = cur.join(lead, "h").select(F.col("rep").alias("a"), F.col("n").alias("na"), "c", F.explode(F.array("l", "m")).alias("l"))
    votes = votes.select("a", "na", "c", F.col("l.rep").alias("b"), F.col("l.n").alias("nb"), F.col("l.c").alias("d"))
    votes = votes.where(f"c <> d and 100 * least(na, nb) >= {percent} * greatest(na, nb)").groupBy("a", "na", "b", "nb").agg(F.count("*").alias("k"))
    best = votes.groupBy("a", "na").agg(F.max(F.struct("k", "b", "nb")).alias("x")).select("a", "na", F.col("x.b").alias("b"), F.col("x.nb").alias("nb"))
    by = lambda k: sig.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
    both = best.join(by("a"), ["a", "na"]).join(by("b"), ["b", "nb"])
    return both.where(_apart("sa", "sb") <= F.col("na") + F.col("nb") - 2 * _alpha("na", "nb", percent)).select("a", "b").distinct()


def folded(sig: np.ndarray) -> np.ndarray:
    """The parity bits of a set in SUFFIX_WORDS words at most."""
    return np.bitwise_xor.reduce(sig.reshape(-1, min(len(sig), SUFFIX_WORDS)), 0)


def suffix_parity(prefix: np.ndarray, sig: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """(len(pos), words) parity bits of what comes behind each position of the prefix; ``sig`` are those of the whole set. At most SUFFIX_WORDS words, to which longer ones are folded.

    Of an n-gram only the low 16 bits count, so ``prefix`` may hold no more of them.
    """
    now = folded(sig).view(np.uint64)
    words = len(now)
    bit = prefix.astype(np.int64).view(np.uint64) & U(64 * words - 1)
    word, flip = (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63))
    out, at = np.empty((len(pos), words), np.uint64), 0
    for i in np.argsort(pos, kind="stable").tolist():
        end = int(pos[i]) + 1
        np.bitwise_xor.at(now, word[at:end], flip[at:end])
        out[i], at = now, max(at, end)
    return out.view(np.int64)


def _cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, na, b, nb, at) of all documents with postings of an n-gram that have different labels and pass the length and positional filters; ``at``: these n-grams (their low 16 bits) and both positions.

    Bits don't travel here: of many postings that meet few documents are left.
    """
    side = lambda d, k: d.select("h", "cell", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "n", "pos", "c")), *["most"] * (k == "b"))
    x = side(rows.where("c <> most").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))), "a")
    y = side(rows.withColumn("cell", F.expr("int(pmod(xxhash64(rep), cells))")), "b")
    # Of a linked pair's common n-grams the first in the common order passes all filters. They are in the join's
    # condition, so that only pairs that pass them leave it.
    cond = f"c_a <> c_b and (c_b = most or rep_a < rep_b) and {_near('n_a', 'pos_a', 'n_b', 'pos_b', percent)}"
    pairs = x.join(y, ["h", "cell"]).where(cond)
    turned = lambda c, d: F.when(F.col("rep_a") < F.col("rep_b"), F.col(c)).otherwise(F.col(d))
    at = F.struct(F.expr("h & 65535").cast("int").alias("h"), turned("pos_a", "pos_b").alias("pa"), turned("pos_b", "pos_a").alias("pb"))
    pairs = pairs.select(turned("rep_a", "rep_b").alias("a"), turned("n_a", "n_b").alias("na"), turned("rep_b", "rep_a").alias("b"), turned("n_b", "n_a").alias("nb"), at.alias("at"))
    return pairs.groupBy("a", "na", "b", "nb").agg(F.collect_list("at").alias("at"))  # no more than a document's prefix


def _behind(met: DataFrame, prof: DataFrame, percent: int, small: int = 300_000) -> DataFrame:
    """The pairs (a, b) of ``met`` that pass the suffix filter at some n-gram. Saved ``met`` is read twice.

    Only what ids in ``met`` have is moved; their list is broadcast where it has at most ``small`` rows (2.4 MB).
    """

    def pack(batches):
        """What suffix_parity looks at: the low 16 bits of the n-grams and the folded parity bits."""
        for b in batches:
            prefix, sig = (b.column(b.schema.get_field_index(c)) for c in ("prefix", "sig"))
            (po, pv), (so, sv) = ((np.asarray(x.offsets), x.values.to_numpy(zero_copy_only=False)) for x in (prefix, sig))
            low = [pv[po[i] : po[i + 1]].astype(np.int16).tobytes() for i in range(b.num_rows)]
            bits = [folded(sv[so[i] : so[i + 1]]).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("rep", "n", "key")), pa.array(low, pa.binary()), pa.array(bits, pa.binary())], names=["rep", "n", "key", "prefix", "sig"])

    def check(batches):
        for b in batches:
            at = b.column(b.schema.get_field_index("at"))
            off, (h, *pos) = np.asarray(at.offsets), (at.values.field(k).to_numpy(zero_copy_only=False) for k in ("h", "pa", "pb"))
            text = {c: b.column(b.schema.get_field_index(c)) for c in ("pre_a", "sig_a", "pre_b", "sig_b")}
            na, nb = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("na", "nb"))
            ok = []
            for i in range(b.num_rows):
                own = slice(off[i], off[i + 1])
                pre = [np.frombuffer(text[c][i].as_py(), np.int16) for c in ("pre_a", "pre_b")]
                sig = [np.frombuffer(text[c][i].as_py(), np.int64) for c in ("sig_a", "sig_b")]
                # An id may have several texts of one size: an n-gram counts where both texts have it there. The bits of the wrong text only add pairs, which are verified.
                keep = np.logical_and(*(p[np.minimum(q[own], len(p) - 1)] == h[own].astype(np.int16) for p, q in zip(pre, pos, strict=True)))
                p, q = (x[own][keep] for x in pos)
                s, t = suffix_parity(pre[0], sig[0], p), suffix_parity(pre[1], sig[1], q)
                words = min(s.shape[1], t.shape[1])
                s, t = (np.bitwise_xor.reduce(x.reshape(len(x), x.shape[1] // words, words), 1) for x in (s, t))
                most = na[i] + nb[i] - 2 * ((percent * (na[i] + nb[i]) + 99 + percent) // (100 + percent))
                ok.append(bool((np.bitwise_count((s ^ t).view(np.uint64)).sum(1, dtype=np.int64) <= most - p - q).any()))
            m = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).filter(m) for c in ("a", "b")], names=["a", "b"])

    ids = met.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    few = ids.limit(small + 1).count() <= small
    own = prof.where("n > 0").select(F.col("doc_id").alias("rep"), "n", "key", "prefix", "sig").join(F.broadcast(ids) if few else ids, "rep", "left_semi")
    own = own.mapInArrow(pack, "rep long, n long, key long, prefix binary, sig binary").dropDuplicates(["rep", "n", "key"])
    by = lambda k: own.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("prefix").alias(f"pre_{k}"), F.col("sig").alias(f"sig_{k}"))
    return met.join(by("a"), ["a", "na"]).join(by("b"), ["b", "nb"]).mapInArrow(check, "a long, b long").distinct()
