"""Notes scored one after the other against a label base that every task holds, in Arrow batches.

What ``retrieval`` works out with joins and aggregates (a row for each token, and for each pair of query and chunk) is worked out here within a note: a note's text goes
through one shuffle, nothing of it but its result leaves the task. Scores are the same sums: weights of a pair are added by size. A base of more than ``LABELS`` labels stays with the joins.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import chunks, words_longer_than
from .retrieval import K1, LEAST_IDF, TASK_ROWS, B

LABELS = 10_000  #: labels of a base that a task holds
PART = 512  #: labels whose scores for all chunks of a note are held at once
BLOCK = 64  #: chunks of a note that meet a part of the labels at once
CELLS = 1 << 22  #: products of vectors that are held at once
ROWS = 1 << 17  #: rows after which a batch is sent
HEAD = 120  #: characters of the evidence that are kept
APART = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))  #: leaves the words of ``words_longer_than`` in a lower-case text


@functools.lru_cache(maxsize=256)
def _idf(n: int) -> np.ndarray:
    """By document frequency, among ``n`` documents; 0 below ``LEAST_IDF``."""
    x = np.array([math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in range(n + 1)])
    return np.where(x >= LEAST_IDF, x, 0.0)


def _scaled(score: np.ndarray, axis: int) -> np.ndarray:
    """Between 0 and 1 along an axis, 0 where all are equal; NaN stands for null."""
    lo, hi = np.fmin.reduce(score, axis, keepdims=True), np.fmax.reduce(score, axis, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(hi > lo, (score - lo) / (hi - lo), 0.0)


class Base:
    """A label base: ``labels`` in their order, the words of their texts (BM25 of a note against the base) and of their queries (BM25 of a label against a note's chunks), the long words of their titles, vectors."""

    def __init__(self, labels: list, texts: list[bytes], queries: list[bytes], titles: list[list[bytes]], vectors: list[list[float] | None] | None, k1: float, b: float):
        self.labels, self.k1, self.b = labels, k1, b
        self.titles = [frozenset(t) for t in titles]
        split = [t.split() for t in texts]
        asked = [dict.fromkeys(q.split()) for q in queries]
        self.vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for x in (*split, *asked) for t in x))}
        get, n = self.vocabulary.__getitem__, len(labels)
        self.asked = [np.array([get(t) for t in q], np.int64) for q in asked]
        tf = [Counter(t) for t in split]
        df, avgdl = Counter(t for c in tf for t in c), sum(map(len, split)) / max(1, n)
        entries = sorted((_idf(n)[df[t]] * f * (k1 + 1) / (f + k1 * (1 - b + b * len(split[i]) / avgdl)), i, get(t)) for i, c in enumerate(tf) for t, f in c.items() if _idf(n)[df[t]] > 0)
        self.weight, self.label, self.token = (np.array([e[c] for e in entries], kind) for c, kind in enumerate((np.float64, np.int64, np.int64)))
        self.parts = []  # (first label, labels, where a token's labels begin, labels by token)
        for first in range(0, n, PART):
            own = self.asked[first : first + PART]
            token, label = np.concatenate(own), np.repeat(np.arange(len(own)), [len(q) for q in own])
            begin = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(self.vocabulary)))])
            self.parts.append((first, len(own), begin, label[np.argsort(token, kind="stable")]))
        if vectors is not None:
            dim = max((len(v) for v in vectors if v), default=0)
            self.vectors = np.array([v if v and len(v) == dim and None not in v else [math.nan] * dim for v in vectors], np.float64).reshape(n, dim)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, itertools.repeat(-1)), np.int64, len(words))

    def among(self, ids: np.ndarray) -> np.ndarray:
        has = np.zeros(len(self.vocabulary) + 1, bool)
        has[ids] = True  # -1 has the last place
        return has

    def distinct(self, ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.among(ids)[:-1])

    def retrieval(self, ids: np.ndarray) -> np.ndarray:
        """BM25 of a note's words for each label, scaled over the base."""
        on = np.flatnonzero(self.among(ids)[self.token])
        return _scaled(np.bincount(self.label[on], self.weight[on], minlength=len(self.labels)), 0)

    def chunk_weights(self, ids: np.ndarray, tokens: np.ndarray, n: int, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each of some tokens in each of the note's ``n`` chunks, with a last column of zeros, and the column of each token of the vocabulary."""
        column = np.full(len(self.vocabulary) + 1, len(tokens))
        column[tokens] = np.arange(len(tokens))
        at = column[ids]
        tf = np.stack([np.bincount(at[i * step : i * step + size], minlength=len(tokens) + 1) for i in range(n)])
        tf[:, -1] = 0
        dl = np.array([min(size, len(ids) - i * step) for i in range(n)])
        return _idf(n)[(tf > 0).sum(0)] * tf * (self.k1 + 1) / (tf + (self.k1 * (1 - self.b + self.b * dl / (dl.sum() / n)))[:, None]), column

    def passages(self, ids: np.ndarray, labels: np.ndarray, k: int, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of some labels: its ``k`` best chunks, best first, and the score of the best, scaled over the note's chunks."""
        n = count(len(ids), size, step)
        if n < 2:  # nothing to tell apart
            return np.zeros((len(labels), n), np.int64), np.zeros(len(labels))
        asked = [self.asked[i] for i in labels]
        w, column = self.chunk_weights(ids, self.distinct(np.concatenate(asked)), n, size, step)
        padded = np.full((len(asked), max(1, *map(len, asked))), len(self.vocabulary))
        for row, q in zip(padded, asked):
            row[: len(q)] = q
        score = _scaled(np.add.accumulate(np.sort(w[:, column[padded]], axis=2), axis=2)[:, :, -1], 0)
        return np.argsort(-score, axis=0, kind="stable")[:k].T, score.max(0)

    def chunk_scores(self, ids: np.ndarray, n: int, size: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first label, BM25 of labels by chunks) for one part of the labels after the other."""
        tokens = self.distinct(ids)
        w = self.chunk_weights(ids, tokens, n, size, step)[0][:, :-1]
        for first, m, begin, label in self.parts:
            out = np.zeros((m, n))
            for a in range(0, n, BLOCK):
                c, t = np.nonzero(w[a : a + BLOCK])
                x = w[a : a + BLOCK][c, t]
                order = np.argsort(x, kind="stable")
                c, t, x = c[order], tokens[t[order]], x[order]
                many = begin[t + 1] - begin[t]
                at = np.repeat(begin[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
                width = min(BLOCK, n - a)
                out[:, a : a + BLOCK] = np.bincount(label[at] * width + np.repeat(c, many), np.repeat(x, many), minlength=m * width).reshape(m, width)
            yield first, out

    def cosines(self, first: int, m: int, v: np.ndarray) -> np.ndarray:
        """Of some labels with the vectors of chunks; products are added in the order of the dimensions."""
        norm = lambda x: np.maximum(np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1]), 1e-9)
        own, out, a_time = self.vectors[first : first + m], np.empty((m, len(v))), max(1, CELLS // max(1, v.size))
        for a in range(0, m, a_time):
            q = own[a : a + a_time]
            dot = np.add.accumulate(q.T[:, :, None] * v.T[:, None, :], axis=0)[-1]
            out[a : a + a_time] = dot / (norm(q)[:, None] * norm(v))
        return out


def count(words: int, size: int, step: int) -> int:
    """Chunks of a text of so many words, as by ``columns.chunks``."""
    return max(1, -(-(words - size + step) // step)) if words else 0


def held(base: DataFrame, label: str, query: Column | None = None, encode: Callable[[Column], Column] | None = None, k1: float = K1, b: float = B):
    """A broadcast ``Base`` of (label, text), in the order of the labels; None where it has more than ``LABELS`` labels, or where a label is null or not alone. ``query``: what is asked for a label, by default its text."""
    binary = lambda c: F.lower(F.coalesce(c, F.lit(""))).cast("binary")
    words = F.transform(words_longer_than(F.col("text")), lambda w: w.cast("binary"))
    rows = base.select(F.col(label).alias("label"), binary(F.col("text")).alias("text"), binary(F.col("text") if query is None else query).alias("query"), words.alias("words"), (encode(F.col("text")) if encode else F.lit(None)).alias("vector")).limit(LABELS + 1).collect()
    if len(rows) > LABELS or any(r.label is None for r in rows) or len({r.label for r in rows}) < len(rows):
        return None
    rows.sort(key=lambda r: r.label.encode() if isinstance(r.label, str) else r.label)
    as_bytes = lambda xs: [bytes(x) for x in xs]
    made = Base([r.label for r in rows], as_bytes(r.text for r in rows), as_bytes(r.query for r in rows), [as_bytes(r.words or []) for r in rows], [r.vector for r in rows] if encode else None, k1, b)
    return base.sparkSession.sparkContext.broadcast(made)


def candidates(base, k: int, passages: int = 2, size: int = 256, overlap: int = 32) -> Callable[[Column, Column], Column]:
    """A function of a note's text and its lower-case form (both as bytes) to its k best labels of a held base: an array of structs of code, candidate_rank, retrieval_score, doc (the best chunk; null
    without text), evidence_score, head (the first ``HEAD`` characters of the best chunks joined by line breaks) and share (of the label's long words that these chunks have)."""
    step = size - overlap

    def run(text: pa.Array, lower: pa.Array) -> pa.Array:
        of = base.value
        titles = frozenset().union(*of.titles)
        sizes, label, rank, score, doc, best, head, share = ([] for _ in range(8))
        for whole, low in zip(text.to_pylist(), lower.to_pylist()):
            words, low = (whole or b"").split(), (low or b"").split()
            ids = of.ids(low)
            mm = of.retrieval(ids) if of.labels else np.zeros(0)
            top = np.argsort(-mm, kind="stable")[:k]
            found, scaled = of.passages(ids, top, passages, size, step) if len(top) else (np.zeros((0, 0), np.int64), np.zeros(0))
            long = {i: titles.intersection(b" ".join(low[i * step : i * step + size]).translate(APART).split()) for i in set(found.ravel().tolist())}
            start = {i: b" ".join(words[i * step : i * step + min(size, HEAD)]) for i in long}  # so many words have more characters
            seen = {}  # most labels have the same chunks
            for at, chunk in zip(top.tolist(), map(tuple, found.tolist())):
                if chunk not in seen:
                    seen[chunk] = b"\n".join(start[i] for i in chunk)[: 4 * HEAD].decode("utf-8", "replace")[:HEAD], frozenset().union(*map(long.get, chunk))
                first, there = seen[chunk]
                title = of.titles[at]
                share.append(len(title & there) / len(title) if title else 0.0)
                head.append(first)
                doc.append(chunk[0] if chunk else None)
            sizes.append(len(top))
            label.append(top)
            rank.extend(range(1, len(top) + 1))
            score.append(mm[top])
            best.append(scaled)
        flat = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
        code = pa.array(of.labels, pa.string()).take(pa.array(flat(label, np.int64)))
        fields = {"code": code, "candidate_rank": pa.array(rank, pa.int32()), "retrieval_score": pa.array(flat(score, np.float64)), "doc": pa.array(doc, pa.int32()), "evidence_score": pa.array(flat(best, np.float64)), "head": pa.array(head, pa.string()), "share": pa.array(share, pa.float64())}
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    made = F.arrow_udf(run, "array<struct<code:string,candidate_rank:int,retrieval_score:double,doc:int,evidence_score:double,head:string,share:double>>").asNondeterministic()  # or Spark moves a filter on its result below the exchange and works it out twice
    return lambda text, lower: made(text, lower)


def note_local_of_base(notes: DataFrame, labels: DataFrame, k: int, alpha: float = 1.0, encode: Callable[[Column], Column] | None = None, size: int = 256, overlap: int = 32, tasks: int | None = None, k1: float = K1, b: float = B) -> DataFrame | None:
    """``retrieval.note_local`` of all labels (query, text) and the chunks of each of the notes (note, text); ``encode`` is of built-in functions. None where the base isn't one to hold (``held``).

    Vectors are made where a note has two chunks or more; one chunk alone scores 0 for every label.
    """
    both, step, k = encode is not None and alpha < 1.0, size - overlap, max(1, k)
    of_labels = held(labels, "query", encode=encode if both else None, k1=k1, b=b)
    if of_labels is None:
        return None
    kind = to_arrow_type(labels.schema["query"].dataType)
    vectors = F.transform(F.array(chunks(F.col("text"), size, overlap)), lambda c: F.when(F.size(c) > 1, F.transform(c, lambda t: encode(t))))[0] if both else F.lit(None).cast("array<array<double>>")

    def run(batches):
        base = of_labels.value
        every, names = np.arange(len(base.labels)), pa.array(base.labels, kind)
        for batch in batches:
            note, query, doc, score, rank, rows = [], [], [], [], [], 0

            def sent():
                flat = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
                s = flat(score, np.float64)
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(flat(note, np.int64))), names.take(pa.array(flat(query, np.int64))), pa.array(flat(doc, np.int32)), pa.array(s, mask=np.isnan(s)), pa.array(flat(rank, np.int32))], names=["note", "query", "doc", "score", "rank"])
                for x in (note, query, doc, score, rank):
                    x.clear()
                return out

            for i, low in enumerate(batch.column(1).to_pylist()):
                ids = base.ids(low.split())
                n = count(len(ids), size, step)
                if n == 0 or not base.labels:
                    continue
                if n == 1:
                    parts = [(every, np.zeros((len(every), 1), np.int32), np.zeros((len(every), 1)))]
                else:
                    v = matrix(batch.column(2)[i].values, base.vectors.shape[1]) if both else None
                    parts = []
                    for first, x in base.chunk_scores(ids, n, size, step):
                        x = _scaled(x, 1)
                        if both:
                            x = alpha * x + (1 - alpha) * _scaled(base.cosines(first, len(x), v), 1)
                        top = np.argsort(-x, axis=1, kind="stable")[:, :k]
                        parts.append((every[first : first + len(x)], top, np.take_along_axis(x, top, 1)))
                for own, top, x in parts:
                    m = top.shape[1]
                    note.append(np.full(top.size, i))
                    query.append(np.repeat(own, m))
                    doc.append(top.ravel())
                    score.append(x.ravel())
                    rank.append(np.tile(np.arange(1, m + 1), len(own)))
                    rows += top.size
                if rows >= ROWS:
                    yield sent()
                    rows = 0
            if rows:
                yield sent()

    dealt = notes.select("note", "text").repartition(tasks or max(1, -(-notes.count() // TASK_ROWS)), "note")
    types = f"note {notes.schema['note'].dataType.simpleString()}, query {labels.schema['query'].dataType.simpleString()}, doc int, score double, rank int"
    out = dealt.select("note", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("low"), vectors.alias("v")).mapInArrow(run, types)
    return out.withColumn("skipped_dense", F.lit(encode is None))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows; one that is null, of another length or holds a null is NaN."""
    flat = vectors.flatten()
    if len(flat) == dim * len(vectors) and not vectors.null_count and not flat.null_count and all(x == dim for x in vectors.value_lengths().to_pylist()):
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    return np.array([x if x and len(x) == dim and None not in x else [math.nan] * dim for x in vectors.to_pylist()], np.float64).reshape(len(vectors), dim)
