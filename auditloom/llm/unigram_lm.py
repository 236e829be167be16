"""Language-model scores by subword lattice likelihood.

A text is its words, each led by a word mark, and one end. The pieces of an existing vocabulary span a lattice over every word; their
own scores weight all segmentations: a piece's probability is in proportion to exp(score / temperature), normalised once over
the pieces that lower-cased words can hold. Scores that are log probabilities have temperature 1; those that are negative
ranks have n / ln n for n pieces, so that the last piece weighs 1 / n of the first. The forward recursion in log space sums
over all segmentations, and a text's score is the sum of log10 of its words' marginals and of the end's probability, which
is that of an average piece. Bytes that no piece spells share one thousandth.

``reestimate`` steps of forward-backward over all training words, weighted by their counts, fit the piece probabilities (and the end's, as its share of
the symbols) to the corpus; no piece is added, and no word is a unit of its own. Its default is 0: the vocabulary's scores as they are.

Words are counted exactly over all training documents. Documents are dealt to blocks of about BLOCK_BYTES of text; each block
asks once for the counts of its distinct words, so what is moved follows the number of distinct words per block, not of
tokens, and no vocabulary is broadcast; only the piece table (fixed size) is.

Defined cases: null text is empty and scores its end alone; a null id is a training row; repeated rows give equal rows
(and count as often as they occur); without training rows nothing is re-estimated; a word of any length is one lattice, in a batch of its own where it is
very long; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U, held_out, mix

MARK = "▁"
BLOCK_BYTES = 40 << 20
CELLS = 1 << 21  #: lattice edges held at once
_B = 0x9E3779B97F4A7C15


class Pieces:
    """The piece table: hashes of the pieces and their log probabilities."""

    def __init__(self, pieces: list[str], weights: np.ndarray):
        use = [i for i, p in enumerate(pieces) if p and MARK not in p[1:] and not any("A" <= c <= "Z" for c in p)]
        index = {pieces[i]: i for i in use}
        self.pieces = sorted(index)
        w = np.array([weights[index[p]] for p in self.pieces])
        self.count = len(self.pieces)
        self.longest = max(map(len, self.pieces), default=1)
        self.hash = np.array([self._hash(p) for p in self.pieces], np.uint64)
        self.slots = []
        left = np.arange(self.count)
        for shift in (44, 24, 4):
            slot = ((mix(self.hash[left]) >> U(shift)) & U((1 << 20) - 1)).astype(np.int64)
            table = np.full(1 << 20, -1, np.int32)
            table[slot[::-1]] = left[::-1]
            self.slots.append((shift, table))
            left = left[table[slot] != left]
        if len(left):
            raise ValueError("the piece table can't be laid out")
        self.set(np.concatenate([w / w.sum() * 0.999, np.full(256, 0.001 / 256)]))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _B + ord(c) + 1) & (2**64 - 1)
        return h

    def set(self, p: np.ndarray) -> None:
        """Probabilities of the pieces and of the 256 bytes."""
        self.scaled, self.spelling = False, 0.0
        with np.errstate(divide="ignore"):  # a piece may have no probability
            self.logp = np.append(np.log(p[: self.count]), -np.inf)
        self.byte = np.log(p[self.count :])

    def scale(self, log: float) -> None:
        """Adds ``log`` to the log probabilities of all pieces; each byte is one too. Once only."""
        if not self.scaled:
            self.logp, self.spelling, self.scaled = self.logp + log, log, True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece of each hash, or ``count``."""
        m = mix(h)
        out = np.full(h.shape, self.count, np.int32)
        for shift, table in self.slots:
            i = table[((m >> U(shift)) & U((1 << 20) - 1)).astype(np.int64)]
            hit = (i >= 0) & (self.hash[i] == h)
            out[hit] = i[hit]
            if shift == 44 and not (~hit & (i >= 0)).any():
                break
        return out


def _spell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words])
    codes = np.zeros((len(words), int(size.max())), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(words)), size)
    codes[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return codes, size


class Lattice:
    """The lattices of a batch of words (each with its mark), padded to one length."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.p = pieces
        self.codes, self.size = _spell(words)
        n, length = self.codes.shape
        pre = np.zeros((n, length + 1), np.uint64)
        for j in range(length):
            pre[:, j + 1] = pre[:, j] * U(_B) + self.codes[:, j].astype(np.uint64) + U(1)
        power = [pow(_B, k, 2**64) for k in range(pieces.longest + 1)]
        self.edge = [pieces.find(pre[:, k:] - pre[:, : length + 1 - k] * U(power[k])) for k in range(1, min(pieces.longest, length) + 1)]  # edge[k - 1][:, i]: from i to i + k
        kinds, at = np.unique(self.codes, return_inverse=True)
        self.kinds = [chr(int(c)).encode("utf-8", "surrogatepass") for c in kinds]
        self.at = at.reshape(self.codes.shape)
        spelt = np.array([(pieces.byte[list(b)] + pieces.spelling).sum() for b in self.kinds])
        self.spelt = spelt[self.at]
        self.one = np.logaddexp(pieces.logp[self.edge[0]], self.spelt)  # a character as a piece or by its bytes

    def weight(self, k: int, i: int) -> np.ndarray:
        return self.one[:, i] if k == 1 else self.p.logp[self.edge[k - 1][:, i]]

    def forward(self) -> np.ndarray:
        """alpha[:, j]: log probability of all segmentations of the first j characters."""
        n, length = self.codes.shape
        a = np.full((n, length + 1), -np.inf)
        a[:, 0] = 0
        for j in range(1, length + 1):
            x = np.stack([a[:, j - k] + self.weight(k, j - k) for k in range(1, min(j, len(self.edge)) + 1)])
            top = x.max(0)  # finite: a character is always spelt by its bytes
            a[:, j] = top + np.log(np.exp(x - top).sum(0))
        return a

    def totals(self) -> np.ndarray:
        return self.forward()[np.arange(len(self.size)), self.size]

    def expected(self, counts: np.ndarray) -> np.ndarray:
        """Expected uses of the pieces and the bytes, weighted by the words' counts."""
        n, length = self.codes.shape
        a = self.forward()
        rows = np.arange(n)
        z = a[rows, self.size]
        b = np.full((n, length + 1), -np.inf)
        b[rows, self.size] = 0
        out, spelt = np.zeros(self.p.count + 1), np.zeros(len(self.kinds))
        for i in range(length - 1, -1, -1):
            with np.errstate(invalid="ignore", divide="ignore"):
                x = np.stack([self.weight(k, i) + b[:, i + k] for k in range(1, min(length - i, len(self.edge)) + 1)])
                top = np.where(np.isfinite(m := x.max(0)), m, 0)
                b[:, i] = np.maximum(b[:, i], np.where(np.isfinite(m), top + np.log(np.exp(x - top).sum(0)), -np.inf))
            post = np.exp(x + (a[:, i] - z)) * counts
            for k in range(2, len(x) + 1):
                out += np.bincount(self.edge[k - 1][:, i], post[k - 1], minlength=self.p.count + 1)
            share = np.exp(self.spelt[:, i] - self.one[:, i])
            out += np.bincount(self.edge[0][:, i], post[0] * (1 - share), minlength=self.p.count + 1)
            spelt += np.bincount(self.at[:, i], post[0] * share, minlength=len(self.kinds))
        by = np.zeros(256)
        for raw, v in zip(self.kinds, spelt, strict=True):
            for c in raw:
                by[c] += v
        return np.concatenate([out[:-1], by])


def batches_of(words: list[bytes], longest: int):
    """(indices, marked words) in runs of similar length and bounded lattice size."""
    text = [MARK + w.decode("utf-8", "replace") for w in words]
    order = sorted(range(len(text)), key=lambda i: len(text[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * (len(text[order[end]]) + 1) * longest <= CELLS:
            end += 1
        yield order[at:end], [text[i] for i in order[at:end]]
        at = end


def read_pieces(path: str, temperature: float | None = None) -> Pieces:
    """The pieces of a sentencepiece model that are text, weighted by exp(score / temperature); see the module for the default."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    score = np.array([m.get_score(i) for i in ids])
    if temperature is None:
        ranks = np.exp(np.minimum(score, 0)).sum() < 2 and (score == np.round(score)).all()
        temperature = len(ids) / math.log(len(ids)) if ranks else 1.0
    return Pieces([m.id_to_piece(i) for i in ids], np.exp((score - score.max()) / temperature))


def score(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", fold: tuple[int, int] = (5, 1), reestimate: int = 0, temperature: float | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "unigram-lm")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.encode(F.col(text).cast("string"), "utf-8"), F.lit(b"")).alias("text"), held_out(doc_id, *fold).alias("held"))
    size, ends = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held"))).first()
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    rows = rows.withColumn("block", F.expr(f"int(pmod(xxhash64(doc_id, text), {blocks}))"))

    def count(batches):
        def emit(block, seen):
            words = list(seen)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int32()), pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], names=["block", "word", "c"])

        now, seen = None, Counter()
        for b in batches:
            for block, t, held in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "text", "held")), strict=True):
                if block != now:
                    yield from emit(now, seen)
                    now, seen = block, Counter()
                words = t.lower().split()
                if held:
                    for w in words:
                        seen.setdefault(w, 0)
                else:
                    seen.update(words)
        yield from emit(now, seen)

    asked = rows.repartition(blocks, "block").sortWithinPartitions("block").select("block", "text", "held").mapInArrow(count, "block int, word binary, c long")
    asked = scratch.save(asked, "asked")
    vocab = scratch.save(asked.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    tokens, types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = tokens + ends, types + (ends > 0)
    pieces = read_pieces(vocabulary, temperature)
    p_end = 1 / (pieces.count + 1)
    for _ in range(reestimate if tokens else 0):
        shared = spark.sparkContext.broadcast(pieces)

        def expect(batches, shared=shared):
            p = shared.value
            out = np.zeros(p.count + 256)
            for b in batches:
                c = b.column(1).to_numpy().astype(float)
                for at, words in batches_of(b.column(0).to_pylist(), p.longest):
                    out += Lattice(p, words).expected(c[at])
            used = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out[used])], names=["piece", "uses"])

        got = vocab.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # one row a piece
        shared.destroy()
        uses = np.full(pieces.count + 256, 0.01)
        for r in got:
            uses[r.piece] += r.uses
        pieces.set(uses / uses.sum())
        p_end = float(ends / (uses.sum() + ends))
    shared = spark.sparkContext.broadcast(pieces)
    more = math.log(1 - p_end)  # each piece is drawn where the end isn't

    def likelihood(batches):
        p = shared.value
        p.scale(more)
        for b in batches:
            lp = np.empty(b.num_rows)
            for at, words in batches_of(b.column(0).to_pylist(), p.longest):
                lp[at] = Lattice(p, words).totals()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lp / math.log(10))], names=["word", "c", "lp"])

    scored = vocab.select("word", "c").mapInArrow(likelihood, "word binary, c long, lp double")
    scored = scratch.save(scored, "scored")
    known = asked.select("block", "word").join(scored, "word")
    floor = total + 0.5 * (distinct + 1)
    end_base, end_score = math.log10((ends + 0.5) / floor), math.log10(p_end)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def block_scores(texts: pa.Table, words: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        c, lp = words.column("c").to_numpy(), words.column("lp").to_numpy()
        base = np.log10((c + 0.5) / floor) if len(c) else c
        n, known_, b_, s_ = [], [], [], []
        for t in texts.column("text"):
            at = [place[w] for w in t.as_py().lower().split()]
            n.append(len(at) + 1)
            known_.append(int((c[at] > 0).sum()) + (ends > 0) if at else int(ends > 0))
            b_.append(float(base[at].sum() if at else 0.0) + end_base)
            s_.append(float(lp[at].sum() if at else 0.0) + end_score)
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known_, pa.int64()), "train_tokens": pa.array([total] * len(n), pa.int64()), "base_score": pa.array(b_, pa.float64()), "score": pa.array(s_, pa.float64())})

    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(block_scores, schema)
