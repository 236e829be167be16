"""Lexical, dense and hybrid retrieval as joins and aggregates.

BM25 counts each distinct query token once. Scores cover all documents of the universe: those without a hit have 0, and
minimum and maximum are taken over the whole universe before any label mask. Zero-score documents are only made where
the caller wants them; the minimum over all documents follows from the number of hits.

Scores come as they are. ``digits`` rounds them before anything is ranked or scaled, for results that are to be compared with those of
another engine; without it a score is added by size of its parts, so that equal documents tie wherever their rows come from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tokens
from ..scratch import Scratch

K1, B, LEAST_IDF = 1.5, 0.75, 1e-4
MEET = 16  #: blocks of documents that a task of ``dense_top_k`` reads
TASK_ROWS = 1_000  #: notes of a task that scores them against a label base


def postings(docs: DataFrame, doc: str = "doc", text: str = "text", within: list[str] | None = None) -> DataFrame:
    """(within..., doc, token, tf, dl)."""
    keys = [*(within or []), doc]
    t = docs.select(*keys, tokens(F.col(text)).alias("t")).select(*keys, F.size("t").alias("dl"), F.explode("t").alias("token"))
    return t.groupBy(*keys, "dl", "token").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text", within: list[str] | None = None) -> DataFrame:
    """(within..., n, avgdl): the number of documents and their mean length."""
    return docs.groupBy(*(within or [])).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(tokens(F.col(text)))), F.lit(0.0)).alias("avgdl"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def bm25(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B, within: list[str] | None = None, query: str = "query", doc: str = "doc", digits: int | None = None) -> DataFrame:
    """(within..., query, doc, score) of the documents that share a token with the query. ``within``: keys inside which documents form a corpus of their own; queries without these keys are asked of each."""
    w = within or []
    p = postings(docs, doc, "text", w)
    df = p.groupBy(*w, "token").agg(F.count("*").alias("df"))
    stats = F.broadcast(corpus_stats(docs, "text")) if not w else corpus_stats(docs, "text", w)  # one row without ``within``
    terms = (df.crossJoin(stats) if not w else df.join(stats, w)).withColumn("idf", idf(F.col("df"), F.col("n"))).where(F.col("idf") >= LEAST_IDF)
    own = [c for c in w if c in queries.columns]
    q = queries.select(*own, query, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = p.join(terms.select(*w, "token", "idf", "avgdl"), [*w, "token"]).join(q, [*own, "token"])
    total = F.aggregate(F.array_sort(F.collect_list(weight)), F.lit(0.0), lambda s, x: s + x) if digits is None else F.round(F.sum(weight), digits)
    return hits.groupBy(*w, query, doc).agg(total.alias("score"))


def dealt(df: DataFrame, by: str, rows: int = TASK_ROWS, tasks: int | None = None) -> DataFrame:
    """``df`` dealt by a key to tasks of about ``rows`` rows, so that a task's memory doesn't follow the input; aggregates and windows by the key and more keep that."""
    return df.repartition(tasks or max(1, -(-df.count() // rows)), by)


def bm25_of_base(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B, digits: int | None = None, zeros: bool = False, tasks: int | None = None) -> DataFrame:
    """``bm25`` over a label base: its weights are broadcast and only the queries' texts are shuffled, by query, which later windows by query keep. ``zeros``: also the pairs without a hit.

    A base of more than 10,000 documents goes through the shuffle joins of ``bm25``.
    """
    if docs.limit(10_001).count() > 10_000:
        hits = bm25(queries, docs, k1, b, digits=digits)
        return universe(queries, docs, hits) if zeros else hits
    p = postings(docs)
    terms = p.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus_stats(docs))).withColumn("idf", idf(F.col("df"), F.col("n"))).where(F.col("idf") >= LEAST_IDF)  # one row
    w = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weights = p.join(terms, "token").select("token", "doc", w.alias("w"))
    words = F.array_distinct(tokens(F.col("text")))
    if zeros:  # the empty token, which no text has, pairs everything at weight 0
        weights, words = weights.unionByName(docs.select(F.lit("").alias("token"), "doc", F.lit(0.0).alias("w"))), F.concat(words, F.array(F.lit("")))
    q = dealt(queries.select("query", "text"), "query", tasks=tasks).select("query", F.explode(words).alias("token"))
    return q.join(F.broadcast(weights), "token").groupBy("query", "doc").agg(_sum("w", digits).alias("score"))


def _sum(w: str, digits: int | None) -> Column:
    return F.aggregate(F.array_sort(F.collect_list(w)), F.lit(0.0), lambda s, x: s + x) if digits is None else F.round(F.sum(w), digits)


def bm25_of_notes(queries: DataFrame, chunks: DataFrame, k1: float = K1, b: float = B, digits: int | None = None, zeros: bool = False, encode=None, tasks: int | None = None) -> DataFrame:
    """(note, query, doc, score) as by ``bm25`` within notes, with one shuffle of texts by note; what follows by note needs no other.

    ``queries``: (note, query, text), asked of their note, or (query, text), a label base that is broadcast up to 10,000 labels and asked of every note. ``zeros``: also the pairs without a hit;
    ``encode`` (with ``zeros``): also ``cosine`` of each pair, every text encoded once. A query meets the chunks where they share a token, in the aggregate of a note's token; the empty
    token, which no text has, pairs everything at weight 0.
    """
    own = "note" in queries.columns
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = chunks.select("note", "doc", none(queries, "query"), "text", F.lit(True).alias("_d"))
    if own:
        rows = rows.unionByName(queries.select("note", none(chunks, "doc"), "query", "text", F.lit(False).alias("_d")))
    if tasks is None:
        tasks = max(1, -(-chunks.select("note").distinct().count() // TASK_ROWS))
    vector = lambda: encode(F.col("text")) if encode else F.lit(None).cast("array<double>")
    words = lambda t: F.concat(F.transform(t, lambda x: F.struct(x.alias("token"), F.lit(None).cast("array<double>").alias("v"))), F.array(F.struct(F.lit("").alias("token"), vector().alias("v")))) if zeros else F.transform(t, lambda x: F.struct(x.alias("token"), F.lit(None).cast("array<double>").alias("v")))
    note = Window.partitionBy("note")
    t = rows.repartition(tasks, "note").withColumn("_t", tokens(F.col("text")))
    t = t.withColumn("n", F.count_if("_d").over(note)).withColumn("avgdl", F.avg(F.when(F.col("_d"), F.size("_t"))).over(note))
    t = t.select("note", "doc", "query", "_d", "n", "avgdl", F.size("_t").alias("dl"), F.explode(words(F.col("_t"))).alias("x")).select("*", "x.token")
    vec = [F.max("x.v").alias("v")] if encode else []
    p = t.groupBy("note", "doc", "query", "_d", "n", "avgdl", "dl", "token").agg(F.count("*").alias("tf"), *vec)
    v = ["v"] if encode else []
    met = p.groupBy("note", "token").agg(F.collect_list(F.when(F.col("_d"), F.struct("doc", "tf", "dl", "n", "avgdl", *v))).alias("ds"), *([F.collect_list(F.when(~F.col("_d"), F.struct("query", *v))).alias("qs")] if own else []))
    if not own:
        asked = queries.select("query", F.explode(words(F.array_distinct(tokens(F.col("text"))))).alias("x")).select("x.token", F.struct("query", *([F.col("x.v").alias("v")] if encode else [])).alias("q"))
        asked = asked.groupBy("token").agg(F.collect_list("q").alias("qs"))
        few = queries.limit(10_001).count() <= 10_000
        met = met.join(F.broadcast(asked) if few else asked, "token")
    idf_ = idf(F.size("ds"), F.col("d.n"))
    weight = F.when(F.col("token") == "", 0.0).otherwise(idf_ * F.col("d.tf") * (k1 + 1) / (F.col("d.tf") + k1 * (1 - b + b * F.col("d.dl") / F.col("d.avgdl"))))
    hits = met.where((F.size("ds") > 0) & (F.size("qs") > 0)).select("note", "token", "ds", "qs", F.explode("ds").alias("d")).where((F.col("token") == "") | (idf_ >= LEAST_IDF)).select("note", "token", "d", weight.alias("w"), F.explode("qs").alias("q"))
    dense = []
    if encode:
        norm = lambda c: F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-9))
        dot = F.aggregate(F.zip_with("q.v", "d.v", lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
        hits = hits.withColumn("c", F.when(F.col("token") == "", dot / (norm(F.col("q.v")) * norm(F.col("d.v")))))
        dense = [F.max("c").alias("cosine")]
    return hits.select("note", "q.query", "d.doc", "w", *(["c"] if encode else [])).groupBy("note", "query", "doc").agg(_sum("w", digits).alias("score"), *dense)


def normalised(table: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vectors divided by max(norm, 1e-9)."""
    x = F.transform(vec, lambda v: v.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)), F.lit(1e-9))
    return table.withColumn(vec, F.transform(x, lambda v: v / norm))


def cosine(queries: DataFrame, docs: DataFrame, digits: int | None = None) -> DataFrame:
    """(query, doc, score) of every query with every document. ``queries``: (query, q); ``docs``: (doc, v); both normalised. A query set of checked size."""
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    if queries.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 queries: use dense_top_k, which works in blocks")
    return docs.join(F.broadcast(queries)).select("query", "doc", rounded(dot, digits).alias("score"))


def dense_top_k(table: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", queries: int = 16384, docs: int = 8192, asked: str | None = None) -> DataFrame:
    """(query, doc, score, rank): the k best rows by cosine of every row of ``table``, itself included, ties by doc. ``asked``: a condition on ``id`` that the queries meet.

    Rows are dealt to blocks; a query block meets up to ``MEET`` document blocks one after the other in a task, which holds its k best so far,
    so pairs of rows never become rows; the k best of its tasks are merged. Every row is sent once to each query block, and a query block once to each of its tasks. Rows without a vector are no query and no document.
    """
    single = table.schema[vec].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    rows = table.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>" if single else "array<double>").alias("v"))
    wanted = rows if asked is None else rows.where(asked)
    n, n_asked = rows.count(), wanted.count()
    queries = min(queries, max(1024, -(-n_asked // table.sparkSession.sparkContext.defaultParallelism)))  # few queries are dealt over the cores

    def pack(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, flat = b.column(1)[i].values.field("id"), b.column(1)[i].values.field("v")
                yield pa.RecordBatch.from_pydict({"block": pa.array([b.column(0)[i].as_py()], pa.int64()), "ids": pa.array([ids.to_numpy().tobytes()], pa.binary()), "vs": pa.array([flat.flatten().to_numpy().astype(kind).tobytes()], pa.binary())})

    def blocks(of: DataFrame, n: int, size: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // size)))).cast("long")
        return of.groupBy(block.alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("x")).mapInArrow(pack, "block long, ids binary, vs binary")

    def unit(b, ids: str, vs: str, i: int):
        at = lambda c: b.column(b.schema.get_field_index(c))[i].as_py()
        ids_ = np.frombuffer(at(ids), np.int64)
        sort = np.argsort(ids_, kind="stable")
        v = np.frombuffer(at(vs), kind).reshape(len(ids_), -1)[sort].astype(np.float64)
        return ids_[sort], v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)

    def best(q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best of a block for each query; one whole number orders by score, then by id, so ties cost nothing extra."""
        order = np.rint(q @ v.T * -1e5).astype(np.int64) * len(ids) + np.arange(len(ids))
        order = np.partition(order, k - 1, axis=1)[:, :k] if len(ids) > k else order
        return order // len(ids) / -1e5, ids[order % len(ids)]

    def run(batches):
        held, ids, score, doc = None, None, None, None

        def emit():
            m = score.shape[1]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(doc.ravel()), pa.array(score.ravel()), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(ids)))], names=["query", "doc", "score", "rank"])

        for b in batches:
            for i in range(b.num_rows):
                if b.column(1)[i].as_py() < 0:  # the queries come first
                    if held is not None:
                        yield emit()
                    held = b.column(0)[i].as_py()
                    ids, q = unit(b, "ids", "vs", i)
                    score, doc = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
                    continue
                if b.column(0)[i].as_py() != held:
                    continue  # no query fell into that block
                others, v = unit(b, "ids", "vs", i)
                parts = [best(q[at : at + 256], others, v) for at in range(0, len(ids), 256)]
                score, doc = (np.concatenate([old, np.concatenate([p[c] for p in parts])], 1) for c, old in enumerate((score, doc)))
                first = np.lexsort((doc, -score), axis=1)[:, :k]
                score, doc = np.take_along_axis(score, first, 1), np.take_along_axis(doc, first, 1)
        if held is not None:
            yield emit()

    q, d = blocks(wanted, n_asked, queries), blocks(rows, n, docs)
    q_blocks, d_blocks = max(1, -(-n_asked // queries)), max(1, -(-n // docs))
    slices = -(-d_blocks // MEET)
    to = lambda f, m: F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"), f))
    one = q.select(to(lambda s: F.col("block") * slices + s, slices).alias("unit"), F.lit(-1).cast("long").alias("other"), "ids", "vs")
    met = d.select(to(lambda b: b * slices + F.pmod(F.col("block"), F.lit(slices)), q_blocks).alias("unit"), F.col("block").alias("other"), "ids", "vs")
    found = one.unionByName(met).repartition(q_blocks * slices, "unit").sortWithinPartitions("unit", "other").mapInArrow(run, "query long, doc long, score double, rank int")
    return found if slices == 1 else top_k(found.drop("rank"), k).select("query", "doc", "score", "rank")


def universe(queries: DataFrame, docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores for every query and document, 0 where there was no hit: for small universes such as a label base."""
    if docs.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 documents: use best_of_all, which makes no rows for documents without a hit")
    u = queries.select("query").join(F.broadcast(docs.select("doc")))
    return u.join(scores, ["query", "doc"], "left").select("query", "doc", F.coalesce("score", F.lit(0.0)).alias("score"))


def min_max(scores: DataFrame, by: list[str] = ("query",), digits: int | None = None) -> DataFrame:  # noqa: B006
    """``mm``: scores between 0 and 1 within each query; a constant vector becomes 0."""
    w = Window.partitionBy(*by)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("mm", rounded(F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0), digits))


def min_max_hits(hits: DataFrame, docs: DataFrame, digits: int | None = None) -> DataFrame:
    """``mm`` of the hits as over all documents: where a query misses some, the minimum is 0; documents without a hit have 0 and no row."""
    n = docs.agg(F.count("*").alias("_n"))
    w = Window.partitionBy("query")
    hi, lo = F.max("score").over(w), F.when(F.count("*").over(w) < F.col("_n"), F.lit(0.0)).otherwise(F.min("score").over(w))
    return hits.crossJoin(F.broadcast(n)).withColumn("mm", rounded(F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0), digits)).drop("_n")


def best_of_all(queries: DataFrame, docs: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The k best of all documents for each query, where documents without a hit score 0, ties by document.

    ``hits`` is worked out once: its k best of each query are written. Rows of score 0 are only made for queries with fewer than k hits, all of which are among
    those written, and for those of the first 2k documents, among which such a query has k at least.
    """
    best = Scratch(queries.sparkSession, "best").save(top_k(hits.select("query", "doc", "score"), k).drop("rank"), "hits")
    few = queries.select("query").distinct().join(best.groupBy("query").agg(F.count("*").alias("_h")), "query", "left").where(F.coalesce("_h", F.lit(0)) < k).select("query")
    zero = few.crossJoin(F.broadcast(docs.select("doc").orderBy("doc").limit(2 * k))).join(best.select("query", "doc"), ["query", "doc"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.unionByName(zero), k)


def bm25_of_distinct(queries: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """``bm25`` that scores equal query texts once and gives each query the scores of its text."""
    q = queries.select("query", F.xxhash64("text").alias("_t"), "text")
    once = q.groupBy("_t", "text").agg(F.min("query").alias("_first"))
    scores = bm25(once.select(F.col("_first").alias("query"), "text"), docs, **options).withColumnRenamed("query", "_first")
    return q.join(once, ["_t", "text"]).select("query", "_first").join(scores, "_first").drop("_first")


def note_local(queries: DataFrame, chunks: DataFrame, k: int, alpha: float = 1.0, encode=None, tasks: int | None = None) -> DataFrame:
    """(note, query, doc, score, rank, skipped_dense): the max(1, k) best chunks of the query's own note, all statistics those of the note.

    ``queries``: (note, query, text), or (query, text) to ask every note; ``chunks``: (note, doc, text). BM25 and, with ``encode`` (a function of a text column to a vector column) and alpha below 1,
    cosine, each min-max scaled over the note's chunks. Pairs are those of a query with its own note's chunks only.
    """
    keys, both = ["note", "query"], encode is not None and alpha < 1.0
    out = min_max(bm25_of_notes(queries, chunks, zeros=True, encode=encode if both else None, tasks=tasks), keys).withColumn("score", F.col("mm"))
    if both:
        x = min_max(out.withColumnRenamed("mm", "_lex").withColumn("score", F.col("cosine")), keys)
        out = x.withColumn("score", alpha * F.col("_lex") + (1 - alpha) * F.col("mm"))
    best = top_k(out.select("note", "query", "doc", "score"), max(1, k), by=keys)
    return best.withColumn("skipped_dense", F.lit(encode is None))


def encode_with(table: DataFrame, encoder, text: str = "text", vec: str = "embedding", batch: int = 64) -> DataFrame:
    """The slot for an encoder: ``encoder`` maps at most ``batch`` texts to as many vectors; null texts are encoded as empty ones."""
    import pandas as pd

    def run(batches):
        for b in batches:
            texts = b[text].fillna("").tolist()
            made = [list(map(float, v)) for at in range(0, len(texts), batch) for v in encoder(texts[at : at + batch])]
            yield b.assign(**{vec: pd.Series(made, index=b.index, dtype=object)})

    rest = table.drop(vec)
    return rest.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in rest.dtypes), f"`{vec}` array<double>"]))


def hybrid(lexical: DataFrame | None, dense: DataFrame | None, alpha: float, digits: int | None = None) -> DataFrame:
    """(query, doc, score, skipped_dense): alpha * lexical + (1 - alpha) * dense after min-max over all documents that both sides have.

    alpha 0 or 1 leaves the other side out of the plan; a side that is None is replaced by the other one. ``skipped_dense`` tells
    that the dense side took no part. Without the side that alpha asks for alone, or without both, it is an error.
    """
    if (alpha == 1.0 and lexical is None) or (alpha == 0.0 and dense is None) or (lexical is None and dense is None):
        raise ValueError("no index for this search")
    one = lambda side, skipped: min_max(side, digits=digits).select("query", "doc", F.col("mm").alias("score"), F.lit(skipped).alias("skipped_dense"))
    if alpha == 1.0 or dense is None:
        return one(lexical, True)
    if alpha == 0.0 or lexical is None:
        return one(dense, False)
    both = lexical.select("query", "doc", F.col("score").alias("x")).join(dense.select("query", "doc", F.col("score").alias("y")), ["query", "doc"])
    return blended(both, alpha, digits)


def blended(both: DataFrame, alpha: float, digits: int | None = None) -> DataFrame:
    """``hybrid`` of (query, doc, x, y), the lexical and the dense score of each pair."""
    w = Window.partitionBy("query")
    norm = lambda c: rounded(F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))).otherwise(0.0), digits)
    return both.withColumn("a", norm("x")).withColumn("b", norm("y")).select("query", "doc", rounded(alpha * F.col("a") + (1 - alpha) * F.col("b"), digits).alias("score"), F.lit(False).alias("skipped_dense"))


def top_k(scores: DataFrame, k: int, by: list[str] = ("query",), mask: DataFrame | None = None, doc: str = "doc") -> DataFrame:  # noqa: B006
    """The k best of each query, ties by document; ``mask``: only documents of this table, applied after scores are final."""
    s = scores if mask is None else scores.join(mask.select(doc).distinct(), doc, "left_semi")
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), doc))
    return s.withColumn("rank", r).where(F.col("rank") <= k)


def threshold(scores: DataFrame, least: float) -> DataFrame:
    return scores.where(F.col("score") >= least)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A stand-in encoder: the eight little-endian words of the SHA-256 digest, modulo 10007, repeated to ``dim`` numbers."""

    def word(h: Column, i: int) -> Column:
        part = F.substr(h, F.lit(i * 8 + 1), F.lit(8))
        swapped = F.concat(*[F.substr(part, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)])
        return (F.conv(swapped, 16, 10).cast("long") % 10007) / 10007

    eight = F.transform(F.array(F.sha2(text, 256)), lambda h: F.array(*[word(h, i) for i in range(8)]))[0]  # the text is digested once
    return F.slice(F.flatten(F.array_repeat(eight, -(-dim // 8))), 1, dim)


def leakage(evidence: DataFrame) -> DataFrame:
    """Shares of evidence from the query's own note, another note of the subject, another subject. ``evidence``: (note, subject, from_note, from_subject)."""
    n = F.count("*")
    return evidence.agg(n.alias("n"), F.round(F.count_if(F.expr("note = from_note")) / n, 6).alias("own"), F.round(F.count_if(F.expr("note <> from_note")) / n, 6).alias("cross_note"), F.round(F.count_if(F.expr("subject <> from_subject")) / n, 6).alias("cross_subject"))
