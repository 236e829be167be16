"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of orders 0 to ``order`` holds the frozen counts of a bounded sample. A byte's
probability in its longest seen context follows escape method C, blended down to the uniform distribution over all 256
bytes, so a text has an exact code length under every language. The language with the shortest code wins; the score is
its share when all code lengths are taken as probabilities, per 16 bytes at most 64 bits apart.

A tree is kept sparse: the sorted codes of the byte strings seen in each order with their cost in bits, and those of
the contexts with the cost of an escape. A byte's cost depends only on the ``order`` bytes before it, so each distinct string of
a batch of whole texts is looked up once for each language.

The sample: of each language the different documents with the smallest hashes of id and text, SAMPLE_DOCS documents and SAMPLE_BYTES bytes at most
(one document, however long, always counts; equal rows count once, so null or equal ids and repeated rows neither crowd nor empty it). All contexts of the sample are kept.

Defined cases: null text or text without a letter gives ``und`` with score 0; ties go to the smallest language name;
no learnable language gives ``und`` everywhere; repeated rows give equal rows; texts of any length are scored whole, CHUNK bytes at a time; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sample_ends, slices, utf8

SAMPLE_DOCS = 300  #: documents a language in the learned sample
SAMPLE_BYTES = 2 << 20  #: bytes a language in the learned sample
CHUNK = 1 << 20  #: bytes that are scored at once


def _codes(data: np.ndarray, k: int) -> np.ndarray:
    """The strings of k + 1 bytes as numbers, first byte highest."""
    out = np.zeros(max(0, len(data) - k), np.int64)
    for i in range(k + 1):
        out = out << 8 | data[i : len(data) - k + i]
    return out


def _at(codes: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted code in the sorted ``codes``, and whether it is there."""
    i = np.minimum(np.searchsorted(codes, want), max(0, len(codes) - 1))
    return i, codes[i] == want if len(codes) else np.zeros(len(want), bool)


class Tree:
    """The context tree of one language."""

    def __init__(self, texts: list[bytes], order: int):
        self.order = order
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []  # by order: codes of context and byte, bits of the byte there
        self.escape: list[tuple[np.ndarray, np.ndarray]] = []  # by order: codes of contexts, bits of an escape
        lower = None
        for k in range(order + 1):
            parts = [_codes(np.frombuffer(t, np.uint8).astype(np.int64), k) for t in texts if len(t) > k]
            code, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            context, at = np.unique(code >> 8, return_inverse=True)
            n, kinds = np.bincount(at, count, len(context)), np.bincount(at, minlength=len(context))
            below = np.full(len(code), 1 / 256) if lower is None else lower[1][_at(lower[0], code & ((1 << 8 * k) - 1))[0]]
            p = (count + kinds[at] * below) / (n + kinds)[at]
            self.seen.append((code, -np.log2(p)))
            self.escape.append((context, -np.log2(kinds / (n + kinds))))
            lower = code, p

    def bits(self, code: np.ndarray, have: np.ndarray) -> np.ndarray:
        """Cost of the last byte of each string of ``have`` + 1 bytes: of the longest string seen, and the escapes to it."""
        out, live = np.zeros(len(code)), np.arange(len(code))
        for k in range(self.order, -1, -1):
            now = live[have[live] >= k]
            at, hit = _at(self.seen[k][0], code[now] & ((1 << 8 * (k + 1)) - 1))
            out[now[hit]] += self.seen[k][1][at[hit]]
            miss = now[~hit]
            at, hit = _at(self.escape[k][0], (code[miss] >> 8) & ((1 << 8 * k) - 1))
            out[miss[hit]] += self.escape[k][1][at[hit]]
            live = np.concatenate([live[have[live] < k], miss])
        out[live] += 8
        return out


@dataclass
class Trees:
    """The context trees of all languages."""

    languages: list[str]
    order: int
    trees: list[Tree]

    def totals(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, languages): code length of each text data[off[i]:off[i + 1]] in bits."""
        out = np.zeros((len(off) - 1, len(self.trees)))
        for at in range(0, len(data), CHUNK):
            place = np.arange(at, min(len(data), at + CHUNK))
            text = np.searchsorted(off, place, "right") - 1
            have = np.minimum(place - off[text], self.order)
            code = np.zeros(len(place), np.int64)
            for j in range(self.order + 1):
                use = have >= j
                code[use] |= data[place[use] - j].astype(np.int64) << 8 * j
            key, back = np.unique(have << 8 * (self.order + 1) | code, return_inverse=True)
            code, have = key & ((1 << 8 * (self.order + 1)) - 1), key >> 8 * (self.order + 1)
            for i, tree in enumerate(self.trees):
                out[:, i] += np.bincount(text, tree.bits(code, have)[back], len(out))
        return out


def fit(samples: dict[str, list[bytes]], order: int = 3) -> Trees:
    """Trees from sample texts by language. ``order``: 0 to 5."""
    languages = sorted(samples)
    return Trees(languages, order, [Tree(samples[k], order) for k in languages])


def learn(docs: DataFrame, order: int = 3, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold: tuple[int, int] = (3, 1)) -> Trees:
    """Trees from a bounded sample of the labelled rows outside the held-out fold; see the module."""
    rows = docs.where(~held_out(doc_id, *fold)).where(F.col(lang).isNotNull() & (F.octet_length(text) > 0))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id), F.col(text).cast("string")).alias("x"), F.octet_length(F.col(text)).alias("size"), F.col(text).cast("string").alias("text"))
    share = {r.lang: min(1.0, 1.5 * (SAMPLE_DOCS + 20) / max(1, r.n)) for r in rows.groupBy("lang").agg(F.approx_count_distinct("x").alias("n")).collect()}  # one row a language
    if not share:
        return fit({}, order)

    def below(limits: dict[str, int]):
        return F.col("x") <= F.create_map(*(F.lit(v) for kv in limits.items() for v in kv))[F.col("lang")]

    sizes = rows.where(below({k: int((v - 0.5) * (2**64 - 1)) if v < 1 else 2**63 - 1 for k, v in share.items()})).groupBy("lang", "x").agg(F.min("size")).collect()  # about 1.5 * SAMPLE_DOCS rows a language
    last = sample_ends(sizes, dict.fromkeys(share, SAMPLE_DOCS), SAMPLE_BYTES)
    samples: dict[str, list[bytes]] = {}
    for r in rows.where(below(last)).groupBy("lang", "x").agg(F.first("text").alias("text")).collect() if last else []:
        samples.setdefault(r.lang, []).append(r.text.encode())
    return fit(samples, order)


def predict(trees: Trees, column) -> tuple[list, list, list]:
    """(language, score, bits per byte) of each text of an Arrow column."""
    import regex

    letter = regex.compile(r"\p{L}").search
    names = trees.languages
    data, off = utf8(column)
    totals = trees.totals(data, off) if names else None
    lang, score, rate = [], [], []
    for i, text in enumerate(column.to_pylist()):
        if not names or not text or not letter(text):
            lang.append("und")
            score.append(0.0)
            rate.append(None)
            continue
        total, size = totals[i], int(off[i + 1] - off[i])
        k = int(total.argmin())
        gap = np.clip((total - total[k]) * 16 / max(16, size), 0, 64)
        lang.append(names[k])
        score.append(float(1 / np.exp2(-gap).sum()))
        rate.append(float(total[k] / size))
    return lang, score, rate


def keep_identified(docs: DataFrame, trees: Trees, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns; ``lang`` becomes the language that was found."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in slices(batches, 1 << 20, text):
            found = predict(shared.value, b.column(b.schema.get_field_index(text)))[0]
            at = b.schema.get_field_index(lang)
            b = b.set_column(at, b.schema.field(at), pa.array(found, pa.string()).cast(b.schema.field(at).type))
            yield b.filter(pa.array([x != "und" for x in found]))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of each row, from its whole text only."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in slices(batches):
            lang, score, rate = predict(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")
