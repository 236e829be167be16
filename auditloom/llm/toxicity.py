"""Toxicity by compression distance with two trained zstandard dictionaries.

A bounded sample of labelled documents trains three dictionaries: one on whole windows of ordinary text, which both
sides share, and one each on short windows of toxic and of ordinary text, of the same number and size. A toxic document is mostly ordinary
prose, so its toxic windows are those around words with a stretch that toxic documents hold far more often than
ordinary ones (all its windows, where there is none). Each window of a few words of a text is compressed with both sides; text like the toxic sample comes out
shorter with the toxic dictionary. The differences of a document's windows are turned into a score by a logistic curve fitted to
sample documents that the dictionaries did not see, then shifted so that 0.3 is the cut that separates them best.

The sample: of each label the documents with the smallest hashes of their ids, SAMPLE documents and SAMPLE_BYTES bytes at
most; of their texts all is read. Equal texts count once.

Defined cases: null or blank text scores 0; texts of any length are read window by window; without both labels in the
sample every score is 0; repeated rows give equal rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import collections
import math
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sample_ends, slices

SAMPLE = {1: 1200, 0: 2400}  #: sample documents of each label
SAMPLE_BYTES = 8 << 20  #: bytes of sample documents of each label
GRAMS = (4, 5, 8)  #: lengths of the stretches that are compared
BASE, OWN = 16_384, 1_024  #: bytes of the shared dictionary and of those of each side
WINDOW = 6  #: words of a window
FEATURES = 6
CUT = 0.3


def windows(text: str, size: int = WINDOW):
    w = text.lower().split()
    for i in range(0, len(w), size):
        yield (" " + " ".join(w[i : i + size]) + " ").encode()


def _grams(word: str) -> set[str]:
    return {word[i : i + k] for k in GRAMS for i in range(len(word) - k + 1)}


def telling(toxic: list[str], ordinary: list[str]) -> set[str]:
    """The stretches inside words that toxic documents hold far more often than ordinary ones."""
    t, o = (collections.Counter(g for x in side for g in set().union(*(_grams(f" {w} ") for w in set(x.lower().split())))) for side in (toxic, ordinary))
    n, m, good = len(toxic), len(ordinary), set()
    for g, c in t.items():
        p, q = (c + 0.5) / (n + 1), (o[g] + 0.5) / (m + 1)
        z = (p - q) / math.sqrt((c + o[g] + 1) / (n + m + 2) * (1 / n + 1 / m))
        if c >= 3 and p > 4 * q and z > 5:
            good.add(g)
    return good


def toxic_windows(text: str, good: set[str]):
    """The words of a text that hold one of the stretches, each with its neighbours."""
    w = text.lower().split()
    for i, x in enumerate(w):
        if not good.isdisjoint(_grams(f" {x} ")):
            yield (" " + " ".join(w[max(0, i - 1) : i + 2]) + " ").encode()


def train(samples: list[bytes], size: int, **kind: int) -> bytes:
    """The content of a trained dictionary; where there is too little to train on, the samples themselves."""
    import zstandard

    random.Random(0).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, **kind).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    base: bytes
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray  # of the features and 1
    shift: float

    def meters(self):
        """Compressors with the ordinary and the toxic dictionary, each after the shared one."""
        import zstandard

        return [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(self.base + d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False).compress for d in (self.ordinary, self.toxic)]

    def saved(self, text: str, meters) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        a, b = meters
        return np.array([len(a(w)) - len(b(w)) for w in windows(text)], float)

    def features(self, text: str, meters) -> np.ndarray:
        d = self.saved(text, meters)
        if not len(d):
            return np.zeros(FEATURES)
        top = np.sort(d)[::-1]
        return np.array([top[0], top[1] if len(d) > 1 else 0.0, math.log1p(np.maximum(d - 2, 0).sum()), 10 * np.maximum(d - 1, 0).mean(), 10 * d.mean(), math.log1p(len(d))])

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack([features, np.ones(len(features))]) @ self.weights + self.shift, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method on balanced classes."""
    x = np.column_stack([x, np.ones(len(x))])
    c = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (p - y)) + ridge * len(y) * w
        h = (x * (c * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, toxic) rows: two thirds make the dictionaries, one third the curve and the cut."""
    rows = list({t: (t, y) for t, y in rows}.values())
    made = [r for i, r in enumerate(rows) if i % 3]
    rest = [r for i, r in enumerate(rows) if i % 3 == 0]
    toxic, ordinary = ([t for t, y in made if y == k] for k in (1, 0))
    if not toxic or not ordinary:
        return Model(b"", b"", b"", np.array([0.0] * FEATURES + [-30.0]), 0.0)
    good = telling(toxic, ordinary)
    bad = [w for t in toxic for w in toxic_windows(t, good)] or [w for t in toxic for w in windows(t, 3)]
    plain = [w for t in ordinary for w in windows(t, 3)]
    random.Random(1).shuffle(plain)
    own = {"k": 16, "d": 6}
    model = Model(train([w for t in ordinary for w in windows(t, 8)], BASE, k=200, d=8), train(plain[: len(bad)], OWN, **own), train(bad, OWN, **own), np.zeros(FEATURES + 1), 0.0)
    meters = model.meters()
    x, y = np.array([model.features(t, meters) for t, _ in rest]), np.array([k for _, k in rest])
    if not 0 < y.sum() < len(y):
        model.weights = np.array([0.5, *[0.0] * (FEATURES - 1), -3.0])
        return model
    model.weights = _logistic(x, y)
    s = model.score(x)
    order = np.sort(np.unique(s))
    best = max(((2 * ((s >= c) & (y == 1)).sum() / max(1, (s >= c).sum() + y.sum()), float(c)) for c in order), key=lambda v: v[0])[1]
    lower = order[order < best]
    cut = min(max((best + (lower[-1] if len(lower) else 0)) / 2, 1e-9), 1 - 1e-9)
    model.shift = math.log(CUT / (1 - CUT)) - math.log(cut / (1 - cut))
    return model


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fold: tuple[int, int] = (4, 2)) -> Model:
    """A model from a bounded sample of the labelled documents outside the held-out fold; see the module."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    known = known.where(~held_out("id", *fold)).withColumn("x", F.xxhash64("id"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}

    def below(limits: dict[int, int]) -> DataFrame:
        """Documents whose hash is at most that of their label: about 1.5 * sum(SAMPLE) rows, whatever the input."""
        ids = known.where(F.col("x") <= F.create_map(*(F.lit(v) for kv in limits.items() for v in kv))[F.col("y")]).select("id", "y")
        rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") > 0)
        return rows.join(F.broadcast(ids), "id").select("y", F.xxhash64("id").alias("x"), "text")

    limits = {y: int((share - 0.5) * (2**64 - 1)) if (share := 1.5 * (k + 20) / n[y]) < 1 else 2**63 - 1 for y, k in SAMPLE.items() if n.get(y)}
    if not limits:
        return fit([])
    sizes = below(limits).select("y", "x", F.octet_length("text").alias("size")).distinct().collect()
    ends = sample_ends(sizes, SAMPLE, SAMPLE_BYTES)
    got = sorted((r.x, r.text, r.y) for r in below(ends).distinct().collect()) if ends else []
    return fit([(t, y) for _, t, y in got])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, saved): score 0 to 1 and the most bytes that the toxic dictionary saves in a window."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        meters = m.meters() if m.toxic else None
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            x = np.array([m.features(t, meters) if meters and t and t.strip() else np.zeros(FEATURES) for t in texts])
            s = m.score(x)
            s[[not (meters and t and t.strip()) for t in texts]] = 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(x[:, 0], pa.float64())], names=["doc_id", "score", "saved"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double, saved double")
