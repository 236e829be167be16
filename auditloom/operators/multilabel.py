"""TF-IDF and linear models of all labels in one pass over the notes a step.

- Features: words of two characters or more, in lower case, without stop words; the ``features`` most frequent of the training notes (ties by word).
  idf = ln((1 + n) / (1 + df)) + 1, unit length. The vocabulary is a table of bounded size, so a note's vector needs no shuffle.
- For each label the model minimises |w|^2 / 2 + c * sum of losses, logistic or squared hinge, over its notes against all others; a constant
  feature of 1 is the bias and is penalised like the rest.
- All labels go through limited-memory BFGS side by side. The vectors are saved as sparse blocks of BLOCK notes at most, by note and by feature, so that a step
  sorts, unpacks and fills nothing. It reads them once: a task multiplies a block with the weights of all labels, keeps one block of gradients of features by labels, and blocks of equal place are added by shuffle, so a task sends features x labels numbers,
  however many notes it has read. Labels keep steps of their own; those that have converged stand still.

The weights (features x AT_ONCE labels) are what the driver holds and broadcasts; more labels go in several runs.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

AT_ONCE = 256  #: labels of a run
PARTS = 32  #: places in which a gradient is added
BATCH = 256  #: notes that are multiplied at once
BLOCK = 512  #: notes of a saved block
NUMBERS = 1 << 21  #: products that a block makes at once
_TYPES = (np.int32, np.int32, np.int32, np.float32, np.int32, np.int32, np.float32, np.int32)  #: of a block's columns behind ``notes``
WORD = re.compile(r"\b\w\w+\b")


def stop_words() -> set[str]:
    from pyspark.ml.feature import StopWordsRemover

    return set(StopWordsRemover.loadDefaultStopWords("english"))


def _loss(kind: str, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses of margins ``z`` with labels ``y`` (-1, 1), and their slopes."""
    m = y * z
    if kind == "logistic":
        return np.logaddexp(0, -m), -y * np.exp(-np.logaddexp(0, m))
    gap = np.maximum(0, 1 - m)
    return gap * gap, -2 * y * gap


class MultiLabelLinear:
    """One linear model for each code. ``kind``: ``logistic`` (scores are probabilities) or ``squared_hinge`` (margins, scaled to 0..1 within each note)."""

    def __init__(self, kind: str = "logistic", features: int = 10_000, c: float = 1.0, iterations: int = 60, tolerance: float = 1e-3, stop: set[str] | None = None):
        if kind not in ("logistic", "squared_hinge"):
            raise ValueError(kind)
        self.kind, self.features, self.c, self.iterations, self.tolerance, self.stop = kind, features, c, iterations, tolerance, stop

    def fit(self, docs: DataFrame, labels: DataFrame) -> MultiLabelLinear:
        """``docs``: (note, text), one row a note, null texts are empty; ``labels``: (note, code). Codes without a note of ``docs`` get a model that says no."""
        scratch = Scratch(docs.sparkSession, "multilabel")
        self.codes = [r.code for r in labels.select("code").where("code is not null").distinct().orderBy("code").collect()]  # the label set
        self._vocabulary(docs)
        x = scratch.save(self._vectors(docs), "vectors")
        weights = []
        for at in range(0, len(self.codes), AT_ONCE):
            group = self.codes[at : at + AT_ONCE]
            y = labels.where(F.col("code").isin(group)).groupBy("note").agg(F.collect_set("code").alias("codes"))
            rows = scratch.save(self._blocks(x.join(y, "note", "left").select("idx", "val", F.coalesce("codes", F.array().cast("array<string>")).alias("codes")), group), "blocks")
            weights.append(self._minimise(rows, group))
            scratch.drop(rows)
        scratch.drop(x)
        self.weights = np.concatenate(weights, axis=1) if weights else np.zeros((len(self.idf) + 1, 0))
        return self

    def _vocabulary(self, docs: DataFrame) -> None:
        stop = self.stop if self.stop is not None else stop_words()

        def count(batches):
            for b in batches:
                n, df = Counter(), Counter()
                for t in b.column(0).to_pylist():
                    own = WORD.findall((t or "").lower())
                    n.update(own)
                    df.update(set(own))
                for w in stop:
                    n.pop(w, None)
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.string()), "n": pa.array(n.values(), pa.int64()), "df": pa.array([df[w] for w in n], pa.int64())})

        words = docs.select("text").mapInArrow(count, "word string, n long, df long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        top = words.orderBy(F.desc("n"), "word").limit(self.features).collect()  # ``features`` rows
        n = docs.count()
        self.vocabulary = {r.word: i for i, r in enumerate(top)}
        self.idf = np.array([math.log((1 + n) / (1 + r.df)) + 1 for r in top])

    def _vectors(self, docs: DataFrame) -> DataFrame:
        """(note, idx, val): places and values of each note's features, as bytes of int32 and float32."""
        known = docs.sparkSession.sparkContext.broadcast((self.vocabulary, self.idf))

        def run(batches):
            place, idf = known.value
            for b in batches:
                idx, val = [], []
                for t in b.column(1).to_pylist():
                    own = Counter(map(place.get, WORD.findall((t or "").lower())))
                    own.pop(None, None)
                    i = np.array(sorted(own), np.int32)
                    v = np.array([own[k] for k in i.tolist()]) * idf[i] if len(i) else np.zeros(0)
                    idx.append(i.tobytes())
                    val.append((v / max(math.sqrt((v * v).sum()), 1e-12)).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["note", "idx", "val"])

        return docs.select("note", "text").mapInArrow(run, f"note {docs.schema['note'].dataType.simpleString()}, idx binary, val binary")

    @staticmethod
    def _dense(idx: list[bytes], val: list[bytes], bias: int) -> tuple[np.ndarray, np.ndarray]:
        """The features that a batch has, the bias last, and its matrix over them."""
        i, v = [np.frombuffer(x, np.int32) for x in idx], [np.frombuffer(x, np.float32) for x in val]
        used, at = np.unique(np.concatenate([*i, np.zeros(0, np.int32)]), return_inverse=True)
        m = np.zeros((len(i), len(used) + 1))
        m[np.repeat(np.arange(len(i)), [len(x) for x in i]), at] = np.concatenate([*v, np.zeros(0, np.float32)])
        m[:, -1] = 1
        return np.append(used, bias), m

    @staticmethod
    def _blocks(rows: DataFrame, group: list[str]) -> DataFrame:
        """Sparse blocks of (idx, val, codes): ``val`` and the place ``idx`` of each feature in ``used``, note by note from ``start``; ``note`` and ``by`` are notes and values feature
        by feature from ``first``; ``label``: places in notes by labels that are 1. All as bytes."""
        place, size = {k: j for j, k in enumerate(group)}, len(group)
        names = ["notes", "used", "start", "idx", "val", "first", "note", "by", "label"]

        def block(idx, val, codes):
            i, v = [np.frombuffer(x, np.int32) for x in idx], np.concatenate([np.frombuffer(x, np.float32) for x in val])
            length = np.array([len(x) for x in i])
            used, at, count = np.unique(np.concatenate(i), return_inverse=True, return_counts=True)
            turn = np.argsort(at, kind="stable")
            note = np.repeat(np.arange(len(i), dtype=np.int32), length)
            label = np.array([r * size + place[c] for r, own in enumerate(codes) for c in own], np.int32)
            start = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            return [len(i), *(x.tobytes() for x in (used, start(length), at.astype(np.int32), v, start(count), note[turn], v[turn], label))]

        def run(batches):
            for b in batches:
                for k in range(0, b.num_rows, BLOCK):
                    made = block(*(b.column(c).slice(k, BLOCK).to_pylist() for c in range(3)))
                    yield pa.RecordBatch.from_arrays([pa.array([made[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in made[1:])], names=names)

        return rows.mapInArrow(run, "notes int, " + ", ".join(f"{x} binary" for x in names[1:]))

    @staticmethod
    def _times(start: np.ndarray, at: np.ndarray, val: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The rows of a sparse matrix (values ``val`` in columns ``at``, rows from ``start``) times ``w``, NUMBERS products at once."""
        out, most = np.zeros((len(start) - 1, w.shape[1])), max(1, NUMBERS // max(1, w.shape[1]))
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(start, start[a] + most, "right")) - 1)
            full = np.flatnonzero(start[a + 1 : b + 1] > start[a:b]) + a  # reduceat gives empty rows the next one's first product
            if len(full):
                x = slice(start[a], start[b])
                out[full] = np.add.reduceat(val[x, None] * w[at[x]], start[full] - start[a], axis=0)
            a = b
        return out

    def _evaluate(self, blocks: DataFrame, group: list[str], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Objective and gradient of every label of ``group`` at ``w``."""
        shared = blocks.sparkSession.sparkContext.broadcast(w)
        kind, size = self.kind, len(group)
        bounds = np.linspace(0, len(w) + 1, PARTS + 1).astype(int)  # the row behind the gradient is the loss

        def run(batches):
            at, total = shared.value, np.zeros((len(shared.value) + 1, size))
            for b in batches:
                for k in range(b.num_rows):
                    used, start, idx, val, first, note, by, label = (np.frombuffer(b.column(c)[k].as_py(), t) for c, t in enumerate(_TYPES, 1))
                    y = np.full((b.column(0)[k].as_py(), size), -1.0)
                    y.ravel()[label] = 1
                    loss, slope = _loss(kind, self._times(start, idx, val, at[used]) + at[-1], y)
                    total[used] += self._times(first, note, by, slope)
                    total[-2] += slope.sum(0)
                    total[-1] += loss.sum(0)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "sums": pa.array([total[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())})

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sums[k] = sums.get(k, 0) + np.frombuffer(x)
            if sums:
                yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "sums": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

        schema, total = "part int, sums binary", np.zeros((len(w) + 1, size))
        for r in blocks.mapInArrow(run, schema).repartition(min(PARTS, 8), "part").mapInArrow(add, schema).collect():  # PARTS rows, features x labels numbers
            total[bounds[r.part] : bounds[r.part + 1]] = np.frombuffer(bytes(r.sums)).reshape(-1, size)
        shared.destroy()
        return 0.5 * (w * w).sum(0) + self.c * total[-1], w + self.c * total[:-1]

    def _minimise(self, rows: DataFrame, group: list[str], history: int = 6) -> np.ndarray:
        """The weights (features and bias, labels): BFGS with limited memory, all labels side by side."""
        w = np.zeros((len(self.idf) + 1, len(group)))
        f, g = self._evaluate(rows, group, w)
        least, pairs = self.tolerance * np.maximum(1, np.abs(g).max(0)), []
        for _ in range(self.iterations):
            live = np.abs(g).max(0) > least
            if not live.any():
                break
            q, alphas = g * live, []
            for s, y, rho in reversed(pairs):
                a = rho * (s * q).sum(0)
                q = q - a * y
                alphas.append(a)
            if pairs:
                s, y, rho = pairs[-1]
                yy = (y * y).sum(0)
                q = q * np.where(rho > 0, 1 / np.maximum(rho * yy, 1e-300), 1.0)
            else:
                q = q / np.maximum(1, np.sqrt((g * g).sum(0)))
            for (s, y, rho), a in zip(pairs, reversed(alphas), strict=True):
                q = q + (a - rho * (y * q).sum(0)) * s
            d = -q * live
            slope = (g * d).sum(0)
            d = np.where(slope < 0, d, -g * live)
            slope = (g * d).sum(0)
            step, done = live.astype(float), ~live
            f2, g2 = f, g
            for _ in range(25):
                f2, g2 = self._evaluate(rows, group, w + step * d)
                done = done | (f2 <= f + 1e-4 * step * slope + 1e-12 * np.abs(f))
                if done.all():
                    break
                step = np.where(done, step, step / 2)
            step = np.where(done, step, 0)
            s = step * d
            y = np.where(step > 0, g2 - g, 0)
            sy = (s * y).sum(0)
            pairs = [*pairs, (s, y, np.where(sy > 1e-12, 1 / np.maximum(sy, 1e-300), 0))][-history:]
            w, f, g = w + s, np.where(step > 0, f2, f), np.where(step > 0, g2, g)
            if not (step > 0).any():
                break
        return w

    def scores(self, docs: DataFrame, top: int | None = None) -> DataFrame:
        """(note, code, score, rank) of each note with all codes, or its ``top`` best, ties by code: all labels from one pass."""
        shared = docs.sparkSession.sparkContext.broadcast(self.weights)
        codes, kind, bias, most = np.array(self.codes, object), self.kind, len(self.idf), min(top or len(self.codes), len(self.codes))

        def run(batches):
            w = shared.value
            for b in batches:
                for k in range(0, b.num_rows, BATCH):
                    note, idx, val = (b.column(c).slice(k, BATCH) for c in range(3))
                    used, m = self._dense(idx.to_pylist(), val.to_pylist(), bias)
                    z = m @ w[used]
                    if kind == "logistic":
                        z = np.exp(-np.logaddexp(0, -z))
                    elif z.size:
                        lo, hi = z.min(1, keepdims=True), z.max(1, keepdims=True)
                        z = np.where(hi > lo, (z - lo) / np.where(hi > lo, hi - lo, 1), 0)
                    first = np.argsort(-z, axis=1, kind="stable")[:, :most]
                    n, rank = len(z), np.tile(np.arange(1, most + 1, dtype=np.int32), len(z))
                    yield pa.RecordBatch.from_arrays([note.take(pa.array(np.repeat(np.arange(n), most))), pa.array(codes[first].ravel(), pa.string()), pa.array(np.take_along_axis(z, first, 1).ravel()), pa.array(rank)], names=["note", "code", "score", "rank"])

        return self._vectors(docs).mapInArrow(run, f"note {docs.schema['note'].dataType.simpleString()}, code string, score double, rank int")
