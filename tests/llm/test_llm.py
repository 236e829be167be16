"""The training-data operators against brute force, with the defined edge cases: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import byte_bpe, common, language_id, mtree, ngram_jaccard, pfair_mix, pii_surrogates, prefix_hash, queries, toxicity, unigram_lm, warc_zstd

DIR = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, part int, block string"


def docs(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), 7, "k", 3, "b") for i, t, l, s in rows], DOCS)


EDGE = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t", None, None), (4, "one two", "en", "b"), (5, "one two", "de", "b"), (5, "one two", "de", "b"), (6, "Straße ÀÉ 12 ŁÓDŹ \U0001f600", "fr", None), (7, "word " * 30000, "en", "c"), (None, "no id here at all", None, "c")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(table):
    return {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}


# 1 ----------------------------------------------------------------------------------------------------------------


def words(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    s = {i: shingles(t) for i, t in rows.items()}
    up = {i: i for i in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(rows, 2):
        c = len(s[a] & s[b])
        if c and 100 * c >= 75 * len(s[a] | s[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s[i]), root(i)) for i in rows}


def test_jaccard_matches_brute_force(spark, texts):
    rng = random.Random(3)
    rows = dict(itertools.islice(texts.items(), 80))
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    for k in range(60):  # a group of near copies that chain, around the threshold
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows[1000 + k] = " ".join(w)
    rows |= {2000: None, 2001: "", 2002: " \n", 2003: "a b", 2004: "A\tb", 2005: "a b c", 2006: "word " * 3000, 2007: "word " * 3001}
    d = docs(spark, [(i, t, "en", "s") for i, t in rows.items()] + [(2003, "a b", "en", "s"), (None, "a b", "en", "s")])
    got = ngram_jaccard.jaccard_components(d).collect()
    want = brute_components(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        else:
            assert r.component_id == 2003


@pytest.mark.parametrize(("block", "most"), [(128, 2.0), (7, 0.0), (7, 1e9)])
def test_links_match_brute_force(spark, monkeypatch, block, most):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    rng = random.Random(5)
    base, rows = [f"w{rng.randrange(500)}" for _ in range(60)], {}
    for k in range(50):  # a group of near copies, in which most pairs link
        w = list(base)
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows[k] = " ".join(w)
    rows |= {100: "a b", 101: "A\tb", 102: None, 103: "on its own here", 104: ""}
    s = {i: frozenset(shingles(t)) for i, t in rows.items()}
    least = {}
    for i in rows:
        least.setdefault(s[i], i)
    want = {i: sum(a != s[i] and 100 * len(a & s[i]) >= 75 * len(a | s[i]) for a in least if a and s[i]) for i in rows}
    got = ngram_jaccard.jaccard_components(docs(spark, [(i, t, "en", "s") for i, t in rows.items()]), most_pairs=most).collect()
    assert {r.doc_id: r.links for r in got} == want and max(want.values()) > 10


def test_postings_without_partner_leave(spark):
    """A posting stays if some other of its n-gram passes the length filter with it, of two postings both filters; all others go before anything else reads them."""
    rng = np.random.default_rng(7)
    rows = [(int(h), -1, i, int(n), int(n * rng.random() / 4)) for i, (h, n) in enumerate(zip(rng.integers(0, 150, 400), np.exp(rng.normal(4, 1, 400)) + 4, strict=True))]
    got = {r.rep for r in ngram_jaccard._met(spark.createDataFrame(rows, "h long, salt long, rep long, n long, pos int"), 75).where("partner").collect()}
    group = {}
    for h, _, *x in rows:
        group.setdefault(h, []).append(x)
    want, first = set(), set()
    for g in group.values():
        for r, n, p in g:
            for q, m, o in g:
                if q != r and 100 * min(n, m) >= 75 * max(n, m):
                    both = p + o + abs((n - p) - (m - o)) <= n + m - 2 * ((75 * (n + m) + 174) // 175)
                    first |= {r} if both else set()
                    want |= {r} if both or len(g) > 2 else set()
    assert first <= got == want and len(got) < len(rows) / 2


def test_long_texts_are_told_apart_by_all_their_bits(spark):
    """Sets of thousands that share one n-gram don't come to be verified, those that link do, also where an id has a second text of the size."""
    rng = np.random.default_rng(5)
    x, z, other = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(3))
    y, z[0] = np.concatenate([x[:4700], rng.integers(0, 2**63, 300).astype(np.uint64)]), x[0]
    rows = [(i, 5000, k, s[:1251].view(np.int64).tolist(), ngram_jaccard.parity(s, ngram_jaccard.words_for(5000)).tolist()) for k, (i, s) in enumerate([(0, x), (0, other), (1, y), (2, z)])]
    prof = spark.createDataFrame(rows, "doc_id long, n long, key long, prefix array<long>, sig array<long>")
    at = [(int(x[0] & np.uint64(65535)), 0, 0)]
    met = spark.createDataFrame([(0, 5000, 1, 5000, at), (0, 5000, 2, 5000, at), (1, 5000, 2, 5000, at)], "a long, na long, b long, nb long, at array<struct<h int, pa int, pb int>>")
    assert [tuple(r) for r in ngram_jaccard._behind(met, prof, 75).collect()] == [(0, 1)]


def test_suffix_parity_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 40, 200, 3000):
        s = rng.integers(0, 2**63, n).astype(np.uint64)
        sig, pos = ngram_jaccard.parity(s, ngram_jaccard.words_for(n)), np.array([n - 1, 0, n // 2, n // 2])
        for got, p in zip(ngram_jaccard.suffix_parity(s.view(np.int64), sig, pos), pos, strict=True):
            assert (got == ngram_jaccard.parity(s[p + 1 :], min(len(sig), ngram_jaccard.SUFFIX_WORDS))).all()


def test_ids_with_several_texts_have_the_links_of_all(spark):
    t = [" ".join(f"{k}{i}" for i in range(40)) for k in "abc"]
    rows = [(5, t[0]), (3, t[0] + " x"), (5, t[1]), (9, t[1]), (9, t[2]), (9, t[2]), (12, t[2] + " y"), (20, "alone")]
    got = ngram_jaccard.jaccard_components(docs(spark, [(i, x, "en", "s") for i, x in rows]), count=False).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == {3: 3, 5: 3, 9: 3, 12: 3, 20: 20}


def test_components_of_chains_and_stars(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (200, 201)]
    d = spark.createDataFrame(e, "a long, b long")
    got = {r.node: r.component for r in common.components(spark, d, common.Scratch(spark, "t")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[201] == 200


def test_word_hashes_in_parts():
    t = ("ab cd\x0bEF " * 50).encode() + b"x" * 300
    data, off = np.frombuffer(t, np.uint8), np.array([0, 100, 100, len(t)])
    a, b = common.word_hashes(data, off), common.word_hashes(data, off, part=37)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and len(set(a[0].tolist())) <= 6


# 2 ----------------------------------------------------------------------------------------------------------------


def test_lattice_matches_enumeration():
    p = unigram_lm.read_pieces(P.path("piece_bpe_32k.model"))
    known = {q: p.logp[i] for i, q in enumerate(p.pieces)}

    def total(w):
        a = [0.0] + [-math.inf] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(j):
                if w[i:j] in known:
                    a[j] = np.logaddexp(a[j], a[i] + known[w[i:j]])
            a[j] = np.logaddexp(a[j], a[j - 1] + sum(p.byte[b] for b in w[j - 1].encode()))
        return a[-1]

    ws = ["▁the", "▁a", "▁thenation", "▁\U0001f600x", "▁" + "ab" * 40]
    assert np.allclose(unigram_lm.Lattice(p, ws).totals(), [total(w) for w in ws])
    # expected uses: each word's characters are covered exactly once
    e = unigram_lm.Lattice(p, ["▁thenation"]).expected(np.array([2.0]))
    assert abs(sum(len(q) * u for q, u in zip(p.pieces, e, strict=False)) + e[p.count :].sum() - 20) < 0.1


def segmentations(w, p, known):
    """(log probability, pieces and bytes) of every segmentation of a marked word; a character is a piece or its bytes."""
    if not w:
        yield 0.0, ()
        return
    for i in range(1, len(w) + 1):
        for lp, rest in segmentations(w[i:], p, known):
            if w[:i] in known:
                yield lp + known[w[:i]], (w[:i], *rest)
            if i == 1:
                raw = w[0].encode()
                yield lp + sum(p.byte[b] for b in raw), (*raw, *rest)


@pytest.mark.parametrize("steps", [0, 1, 2])
def test_lm_scores_match_enumeration(spark, steps):
    """The returned score against the sum over all segmentations, re-estimated by enumeration too."""
    rows = [(i, t, "en", "s") for i, t in enumerate(["the cat sat", "The cats, on 12 mats", None, "", "zqx \U0001f600 the", "a a a the", "thin then than", "cat the thé", "on", "unseen wordy"])]
    rows += [(None, "the cat", None, None), (4, "zqx the", "en", "s")]
    path = P.path("piece_bpe_32k.model")
    p = unigram_lm.read_pieces(path)
    train = [t or "" for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = collections.Counter(x for t in train for x in words(t))
    end = 1 / (p.count + 1)
    for _ in range(steps):
        known = {q: p.logp[i] for i, q in enumerate(p.pieces)}
        place = {q: i for i, q in enumerate(p.pieces)} | {b: p.count + b for b in range(256)}
        uses = np.full(p.count + 256, 0.01)
        for w, c in counts.items():
            all_ = list(segmentations("▁" + w, p, known))
            z = sum(math.exp(lp) for lp, _ in all_)
            for lp, parts in all_:
                for q in parts:
                    uses[place[q]] += c * math.exp(lp) / z
        p.set(uses / uses.sum())
        end = len(train) / (uses.sum() + len(train))
    known = {q: p.logp[i] for i, q in enumerate(p.pieces)}

    def score(t):
        out = math.log10(end)
        for w in words(t):
            out += math.log10(sum(math.exp(lp + len(parts) * math.log(1 - end)) for lp, parts in segmentations("▁" + w, p, known)))
        return out

    got = unigram_lm.score(docs(spark, rows), path, reestimate=steps).collect()
    want = collections.Counter((i, round(score(t), 6)) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, round(r.score, 6)) for r in got) == want


def test_lm_counts_and_base(spark, texts):
    rows = [(i, t, "en", "s") for i, t in list(texts.items())[100:160]] + EDGE
    got = unigram_lm.score(docs(spark, rows), P.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, ends = collections.Counter(), 0
    for i, t, *_ in rows:
        if not held(i):
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    by = {i: t for i, t, *_ in rows}
    for r in got:
        w = words(by[r.doc_id])
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base)) and r.score < 0 and math.isfinite(r.score)
    assert unigram_lm.score(docs(spark, rows).where("false"), P.path("piece_bpe_32k.model")).count() == 0


# 3 ----------------------------------------------------------------------------------------------------------------


def test_bpe_equals_rank_encoder(spark, texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    c = byte_bpe.ByteBPE(path, P.PATTERN)
    rng = random.Random(1)
    odd = ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(0xA0, 0x250), rng.randrange(0x4E00, 0x4F00), 0x1F600])) for _ in range(rng.randrange(50))) for _ in range(500)]
    for t in [*texts.values(), *odd, "", "a" * 3000, " " * 500, "<|endoftext|> ▁<unk>"]:
        ids = e.encode_ordinary(t)
        assert c.encode(t) == ids and c.decode(ids).decode() == t
    d = docs(spark, EDGE)
    for r in byte_bpe.round_trip(d, path, P.PATTERN).collect():
        t = {i: t for i, t, *_ in EDGE}[r.doc_id] or ""
        ids = e.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    both = byte_bpe.decode(byte_bpe.encode(d, path, P.PATTERN), path, P.PATTERN)
    assert sorted(bytes(r["bytes"]) for r in both.collect()) == sorted((t or "").encode() for _, t, *_ in EDGE)
    assert byte_bpe.round_trip(d.where("false"), path, P.PATTERN).count() == 0


# 4 ----------------------------------------------------------------------------------------------------------------


def test_mtree_matches_brute_force():
    rng = np.random.default_rng(5)
    v = np.floor(1024 * rng.normal(size=(3000, 16)) / 4)
    v[100:400] = v[100]  # ties
    ids = rng.permutation(3000)
    t = mtree.MTree(ids, v)
    for q in range(0, 3000, 150):
        s = v @ v[q]
        want = sorted(((-x, i) for x, i in zip(s, ids, strict=True) if i != ids[q]))[:10]
        got = [(-s_, -i) for s_, i in reversed(t.search(v[q], 10, ids[q]))]
        assert got == [(a, b) for a, b in want]
    assert mtree.MTree(ids[:0], v[:0]).search(v[0], 3, 1) == []


def test_mtree_prunes_clusters():
    rng = np.random.default_rng(6)
    v = np.floor(1024 * (rng.normal(size=(50, 1, 16)) * 3 + rng.normal(size=(50, 80, 16)) * 0.05).reshape(-1, 16))
    v = np.floor(1024 * v / np.linalg.norm(v, axis=1, keepdims=True))
    t = mtree.MTree(np.arange(4000), v)
    t.search(v[0], 10, 0)
    assert t.computed < 2000


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_top_k_matches_brute_force(spark, monkeypatch, kind):
    """Many cells, of which some are cut into parts, with ties, equal vectors and queries in several blocks."""
    monkeypatch.setattr(mtree, "PART", 40)
    monkeypatch.setattr(mtree, "CELLS", 7)
    monkeypatch.setattr(mtree, "BLOCK", 3)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(12, 1, 8)) + rng.normal(size=(12, 50, 8)) * (0.02 if kind == "clusters" else 5)
    v = (v / np.linalg.norm(v, axis=2, keepdims=True)).reshape(-1, 8).astype(np.float32)
    v[40:130] = v[40]
    ids = [int(i) - 200 for i in rng.permutation(len(v))]
    w = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    d = spark.createDataFrame([(i, x.tolist(), 1) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>, cell int")
    got = collections.defaultdict(list)
    for r in mtree.top_k(d, 10, 20).sort("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    want = {q: sorted((-int(w[a] @ w[b]), i) for b, i in enumerate(ids) if i != q)[:10] for a, q in enumerate(ids) if q % 20 == 0}
    assert got == want


def test_top_k_refuses_scores_that_are_not_exact(spark):
    e = spark.createDataFrame([(0, [1e6] * 8), (1, [1.0] * 8)], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="2\\*\\*53"):
        mtree.top_k(e)


def test_top_k_edges(spark):
    e = spark.createDataFrame([(0, [0.5, -0.5], 1), (100, [0.5, -0.5], 1), (1, [0.5, -0.5], 2), (2, [1.0, 1.0], 3), (2, [1.0, 1.0], 3), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.0, 0.0], 1), (None, [0.1, 0.1], 1)], "vec_id long, embedding array<float>, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(e).collect())
    top = 512 * 512 * 2
    assert got == [(0, 1, 1, top), (0, 2, 100, top), (0, 3, 2, 0), (100, 1, 0, top), (100, 2, 1, top), (100, 3, 2, 0)]
    assert mtree.top_k(e.where("false")).count() == 0


# 5 ----------------------------------------------------------------------------------------------------------------


def brute_code_lengths(samples, text, order):
    """Bits of ``text`` under the frozen counts of each language, byte by byte."""
    out = {}
    for lang, own in samples.items():
        trees = {}
        for k in range(order + 1):
            for s in own:
                for i in range(len(s) - k):
                    trees.setdefault(s[i : i + k], collections.Counter())[s[i + k]] += 1
        bits = 0.0
        for i, c in enumerate(text):
            p = 1 / 256
            for k in range(min(order, i) + 1):
                if d := trees.get(text[i - k : i]):
                    p = (d[c] + len(d) * p) / (sum(d.values()) + len(d))
            bits -= math.log2(p)
        out[lang] = bits
    return out


def test_ppm_matches_direct_counts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(language_id, "CHUNK", 7)  # texts go over the bounds of chunks
    samples = {"a": [b"abracadabra abra", b"cad"], "b": [b"zebra zab", "größe ñ".encode()], "c": [b"x"]}
    texts_ = ["abra zcad", "", "größe zebra", "q", "ab", None, "x" * 30, "12 3"]
    for order in (0, 2, 3):
        got = list(zip(*language_id.predict(language_id.fit(samples, order), pa.array(texts_, pa.string())), strict=True))
        for t, (lang, score, rate) in zip(texts_, got, strict=True):
            if not t or not any(c.isalpha() for c in t):
                assert (lang, score, rate) == ("und", 0, None)
                continue
            bits = brute_code_lengths(samples, t.encode(), order)
            best = min(bits, key=lambda k: (bits[k], k))
            gaps = [min(64, (x - bits[best]) * 16 / max(16, len(t.encode()))) for x in bits.values()]
            assert lang == best and abs(rate * len(t.encode()) - bits[best]) < 1e-6 and abs(score - 1 / sum(2**-g for g in gaps)) < 1e-9


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 5)
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 100)
    d = docs(spark, [(i, "abc " * (1000 if i % 2 else 2) + str(i), "en" if i % 2 else "de", "s") for i in range(0, 600)])
    trees = language_id.learn(d)
    assert trees.languages == ["de", "en"]  # a language of long texts only is learned from one of them, whole
    assert all((2.0 ** -t.seen[0][1]).sum() <= 1 for t in trees.trees)


def test_language_edges_and_accuracy(spark, table):
    trees = language_id.learn(table)
    got = {r.doc_id: r for r in language_id.identify(table, trees).collect()}
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    tested = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == truth[i] for i in tested) >= 0.9 * len(tested)
    d = docs(spark, [*EDGE, (20, "1234 !!", "en", "a")])
    e = {r.doc_id: r for r in language_id.identify(d, trees).collect()}
    assert all(e[i].lang_pred == "und" and e[i].score == 0 for i in (1, 2, 3, 20)) and all(0 <= r.score <= 1 for r in e.values())
    kept = language_id.keep_identified(d, trees)
    assert kept.columns == d.columns and kept.count() == len(EDGE) + 1 - 4
    assert language_id.identify(d, language_id.learn(d.where("false"))).where("lang_pred <> 'und'").count() == 0


# 6 ----------------------------------------------------------------------------------------------------------------


def edf(weights):
    """Slots of one period by a plain earliest-deadline-first loop."""
    p, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(p):
        ready = [(math.ceil((done[k] + 1) * p / w), k) for k, w in weights.items() if done[k] * p // w <= t]
        _, k = min(ready)
        out.append((k, done[k], t))
        done[k] += 1
    return out


def test_pattern_is_earliest_deadline_first(spark):
    weights = {"a": 5, "b": 3, "c": 1, "d": 1}
    w = spark.createDataFrame(list(weights.items()), "key string, weight int")
    got = sorted(((r.key, r.turn, r.slot) for r in pfair_mix.pattern(w).collect()), key=lambda x: x[2])
    assert got == edf(weights)
    done = dict.fromkeys(weights, 0)
    for k, _, t in got:
        done[k] += 1
        assert all(abs(done[x] - (t + 1) * weights[x] / 10) < 1 for x in weights)


def test_mix_places_every_document(spark, table):
    m = pfair_mix.mix(docs(spark, EDGE), block=2).collect()
    assert len(m) == len(EDGE) and len({(r.slot, r.place) for r in m}) == len(m)
    m = pfair_mix.mix(table, block=3).toPandas()
    assert len(m) == table.count() and ((m.slot >= m.release) & (m.slot < m.deadline)).all()
    given = spark.createDataFrame([("src0", 9), ("src1", 0), ("nowhere", 4)], "source string, weight int")
    x = pfair_mix.mix(table, given, block=3)
    assert x.where("source = 'src0' and block < 9").agg(F.max("slot")).first()[0] < 9 + x.select("source").distinct().count()
    assert pfair_mix.mix(table.where("false")).count() == 0


# 7 ----------------------------------------------------------------------------------------------------------------


def test_prefix_hash_spans_and_extensions():
    a, b = "abracadabra\U0001f600", "xxabracadabry"
    x, y = prefix_hash.PrefixHash.of(a), prefix_hash.PrefixHash.of(b)
    for i, j, n in itertools.product(range(len(a)), range(len(b)), range(1, 6)):
        if i + n <= len(a) and j + n <= len(b):
            assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
    assert x.extension(0, y, 2) == 10 and x.extension_left(10, y, 12) == 10 and x.extension(0, x, 0) == len(a) and x.extension(0, y, 0) == 0
    joined = x.joined(6, y, 5)
    assert [z.tolist() for z in joined.sums] == [z.tolist() for z in prefix_hash.PrefixHash.of(a[:6] + b[:5]).sums]
    f = lambda t: str(prefix_hash.Document(t).print)
    assert prefix_hash.likeness(f(""), f("")) == 1 and prefix_hash.likeness(f(""), f("a")) == 0 and f(a) == f("abracadabra😀")


def brute_likeness(a, b):
    """What two fingerprints say, from the texts by definition: bottom-k resemblance of spans and the common ends at the stored lengths."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    lengths = [*range(1, 17)]
    while lengths[-1] * 5 // 4 <= min(len(a), len(b)):
        lengths.append(lengths[-1] * 5 // 4)
    ends = sum(max([n for n in lengths if n <= min(len(a), len(b)) and x[:n] == y[:n]], default=0) for x, y in ((a, b), (a[::-1], b[::-1])))
    width = 6 if max(len(a), len(b)) < 192 else 24
    low = []
    for t in (a, b):
        h = prefix_hash.PrefixHash.of(t)
        spans = {t[i : i + width]: int(prefix_hash.mix(h.span([i], [min(i + width, len(t))]))[0]) >> 24 for i in range(max(1, len(t) - width + 1))}
        low.append(sorted(spans.values())[:64])
    both = sorted({*low[0], *low[1]})[:64]
    shared = len({*both} & {*low[0]} & {*low[1]})
    return max(2 * shared / (len(both) + shared), min(ends, len(a), len(b)) / max(len(a), len(b)))


def test_likeness_is_that_of_the_strings():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 9)))
    for n in (0, 1, 3, 5, 20, 30, 34, 60, 300, 2000):
        t = " ".join(word() for _ in range(n))
        for other in (t, t[: 3 * len(t) // 4] + "zz zz", t[len(t) // 3 :], " ".join(word() for _ in range(n)), "", "x", t * 3):
            x, y = prefix_hash.Document(t), prefix_hash.Document(other)
            got = prefix_hash.likeness(str(x.print), str(y.print))
            assert got == x.print.likeness(y.print) == prefix_hash.likeness(str(y.print), str(x.print)) == pytest.approx(brute_likeness(t, other))
            made = x.edited(y)
            assert str(made.print) == str(prefix_hash.Document(prefix_hash.edited(t, other)).print)


def test_hot_ids_are_cut_into_ranges(spark):
    rows = [(None if i % 2 else i, f"text number {i} of many", "en", "s") for i in range(200)] + [(6, "equal rows", "en", "s")] * 60
    got = prefix_hash.neighbours(docs(spark, rows), range_rows=10).collect()
    r = prefix_hash.Ranges([5, 9], {-(2**63): 100, 7: 35}, 10)
    k = np.array([-(2**63)] * 3 + [5, 6, 7, 7, 8, 9, 10])
    h = np.array([0, 2**30, 2**31 - 1, 0, 0, 0, 2**31 - 1, 0, 0, 0])
    assert r.place(k, h).tolist() == [0, 5, 9, 10, 11, 12, 15, 16, 16, 17]
    assert len(got) == 260 and sum(x.doc_id == 6 for x in got) == 61 and sum(x.near_next == 1 for x in got) == 59
    assert len({x.fingerprint for x in got}) == 201


@pytest.mark.parametrize("rows_per_range", [4000, 13, 1])
def test_neighbours_match_brute_force(spark, texts, rows_per_range):
    rows = [(i, t, "en", "s") for i, t in list(texts.items())[100:140]] + EDGE
    got = prefix_hash.neighbours(docs(spark, rows), range_rows=rows_per_range).collect()
    order = sorted(((-(2**63) if i is None else i, t or "") for i, t, *_ in rows))
    want = collections.Counter()
    for k, (_, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        e = t[: len(t) - n] + follow[:n]
        want[(len(t), hashlib.sha256(e.encode()).hexdigest())] += 1
    assert collections.Counter((r.n_chars, r.edited_sha256) for r in got) == want
    prints = collections.Counter()
    for k, (_, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        own, e, then = (str(prefix_hash.Document(x).print) for x in (t, prefix_hash.edited(t, follow), follow))
        prints[own, e, prefix_hash.likeness(own, e), prefix_hash.likeness(own, then)] += 1
    assert collections.Counter((r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == prints


@pytest.mark.parametrize("n", range(4, 61))
def test_likeness_of_short_texts(n):
    rng = random.Random(n)
    word = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    t, apart = word(n, "abcdefghijklmnopqrstuvwxyz"), word(n, "0123456789")
    f = lambda x, y: prefix_hash.likeness(*(str(prefix_hash.Document(z).print) for z in (x, y)))
    assert f(t, prefix_hash.edited(t, apart)) >= 0.8 * (n - n // 4) / n  # beginnings are stored at lengths a quarter apart
    near = t[: n // 2] + "0" + t[n // 2 + 1 :]  # one letter in the middle
    assert f(t, near) >= 0.5 and f(t, apart) == 0 and f(t, t) == 1


def test_neighbours_of_none_and_one(spark):
    assert prefix_hash.neighbours(docs(spark, [])).count() == 0
    r = prefix_hash.neighbours(docs(spark, [(9, "abcdefgh", "en", "s")])).collect()
    assert len(r) == 1 and r[0].near_next == 1 and r[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


# 8 ----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    p = spark.createDataFrame([(1, "u1", "same", 0), (5, "u5", "same", 0), (5, "u5", "same", 0), (3, "u\r\n3", None, 0), (4, None, "", 0), (6, "u6", "ü" * 9_000_000, 0), (None, "x", "other", 0)], "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_zstd.round_trip(p).collect()), key=str)
    d = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, 4, d("same"), "revisit", 5), (5, 4, d("same"), "response", None), (5, 4, d("same"), "response", None), (3, 0, d(""), "revisit", 4), (4, 0, d(""), "response", None), (6, 18_000_000, d("ü" * 9_000_000), "response", None), (-1, 5, d("other"), "response", None)]
    assert got == sorted(want, key=str)
    assert warc_zstd.round_trip(p, least=5).where("record_type = 'revisit'").count() == 0
    assert warc_zstd.round_trip(p.where("false")).count() == 0


def test_warc_files_and_urls(spark, tmp_path):
    urls = [" ", "a b\t\u2028c", "http://x/%20y", "", None]
    p = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    want = {0: "%20", 1: "a%20b%09%E2%80%A8c", 2: "http://x/%20y", 3: None, 4: None}
    assert {r.page_id: r.url for r in warc_zstd.round_trip(p).collect()} == want
    for k in range(3):
        data = warc_zstd.pack([warc_zstd.record(10 * k + i, f"http://x/{i}", b"<p>%d</p>" % i * 50, "response", None) for i in range(40)])
        (tmp_path / f"{k}.warc.zst").write_bytes(data)
    (tmp_path / "other.txt").write_text("no archive")
    got = warc_zstd.read_files(spark, str(tmp_path)).collect()
    assert len(got) == 120 and all(r.html == "<p>%d</p>" % int(r.url[9:]) * 50 for r in got)


def test_warc_rejects_damage():
    rec = [warc_zstd.record(i, f"http://x/{i}", b"<p>%d</p>" % i * 50, "response", None) for i in range(40)]
    data = warc_zstd.pack(rec)
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D and list(warc_zstd.frames(data)) == rec
    with pytest.raises(warc_zstd.Malformed):
        list(warc_zstd.frames(data[:-3]))
    with pytest.raises(warc_zstd.Malformed):
        list(warc_zstd.frames(b"WARC" + data))
    bad = rec[0].replace(b"Content-Length: ", b"Content-Length: 1", 2)
    with pytest.raises(warc_zstd.Malformed):
        warc_zstd.parse(bad)
    with pytest.raises(warc_zstd.Malformed):
        warc_zstd.parse(rec[0].replace(b"<p>", b"<q>", 1))


# 9 ----------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_a_planted_word(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abdeilnorst") for _ in range(rng.randrange(2, 8))) for _ in range(80))
    rows = []
    for i in range(600):
        w = text().split()
        if i % 6 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grumpfwort", "zackmurx", "quabbelig"])
        rows.append((i, " ".join(w), "en", "s"))
    d = docs(spark, [*rows, (None, "x", None, None), (9000, None, "en", "s"), (9001, "", "en", "s")])
    y = spark.createDataFrame([(i, int(i % 6 == 0), None) for i in range(600)] + [(None, 1, None), (3, None, None)], "doc_id long, toxic int, text string")
    m = toxicity.learn(d, y)
    got = {r.doc_id: r.score for r in toxicity.score(d, m).collect()}
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == (i % 6 == 0) for i in test)
    assert right >= 0.95 * len(test) and got[9000] == got[9001] == 0
    import zstandard

    raw = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(m.base + x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for x in (m.ordinary, m.toxic)]
    for i, t, *_ in rows[:40]:  # the score by definition
        w = t.lower().split()
        gap = [len(raw[0].compress(x)) - len(raw[1].compress(x)) for k in range(0, len(w), 6) for x in [f" {' '.join(w[k : k + 6])} ".encode()]]
        top = sorted(gap)[::-1]
        f = [top[0], top[1], math.log1p(sum(max(x - 2, 0) for x in gap)), 10 * sum(max(x - 1, 0) for x in gap) / len(gap), 10 * sum(gap) / len(gap), math.log1p(len(gap)), 1]
        assert abs(got[i] - 1 / (1 + math.exp(-(float(np.dot(f, m.weights)) + m.shift)))) < 1e-9
    none = toxicity.score(d, toxicity.learn(d, y.where("false"))).agg(F.max("score")).first()[0]
    assert none == 0


# 10 ---------------------------------------------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_surrogates_keep_type_format_and_coreference(spark):
    t = [
        "call +1 (743) 555-3824 or (743) 555-3824; re.46@mail8.example.com Re.46@mail8.example.com 10.2.3.4 v 2.0.",
        "card 4111 1111 1111 1111 or 4111111111111111, ssn 123-45-6789, DE89 3704 0044 0532 0130 00",
        "Mrs. Anna Kowalska met Mr Иван Петров and Herr Müller; key \"f33e61083db5dbdf4bd2369d2f80176e57f7fda2\" again 10.2.3.4",
        "nothing 12 to find 3.", "", None, "+1 (743) 555-3824" * 1, "10.2.3.4 " * 2000,
    ]
    d = docs(spark, [(i, x, "en", "s") for i, x in enumerate(t)] + [(None, t[0], "en", "s")])
    got = {r.doc_id: r for r in pii_surrogates.replace(d, "k").collect()}
    assert d.columns + ["n_entities"] == pii_surrogates.replace(d, "k").columns
    a = got[0].text
    phones = re.findall(r"\(\d{3}\) \d{3}-\d{4}", a)
    assert len(phones) == 2 and phones[0] == phones[1] and "555-3824" not in a and a.startswith("call +1 (")
    mails = re.findall(r"\S+@\S+", a)
    assert mails[0].lower() == mails[1].lower() and mails[1][0].isupper() and re.fullmatch(r"[a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mails[0]) and "re.46" not in a and "example" not in a
    ips = [re.findall(r"\b\d+\.\d+\.\d+\.\d+\b", got[i].text) for i in (0, 2, 7)]
    assert {x for y in ips for x in y} == {ips[0][0]} and ips[0][0] != "10.2.3.4" and a.endswith(" v 2.0.")
    cards = re.findall(r"\d{4}(?: ?\d{4}){3}", got[1].text)
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and luhn(cards[1])
    assert "123-45-6789" not in got[1].text and got[1].text.count("DE") == 1
    assert re.match(r"Mrs\. \w+ [A-Z]\w+ met Mr [А-Яа-я]+ [А-Яа-я]+ and Herr [A-Z]", got[2].text) and "Müller" not in got[2].text
    assert (got[3].text, got[3].n_entities, got[4].text, got[5].text, got[5].n_entities) == (t[3], 0, "", None, 0)
    assert got[None].text == a
    assert pii_surrogates.replace(d.where("false"), "k").count() == 0


def test_surrogates_stay_distinct(spark):
    names = [f"Herr {a}{b}{c}" for a in "ABCDEFGH" for b in "aeiou" for c in "lmnr"]  # many more than given names
    for ids in (range(len(names)), [None] * len(names), [7] * len(names)):
        d = docs(spark, [(i, x, "de", "s") for i, x in zip(ids, names, strict=True)])
        got = [r.text for r in pii_surrogates.replace(d, "k").collect()]
        assert len(set(got)) == len(names) and not set(got) & set(names)


def mod97(iban):
    t = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97


def test_surrogates_of_units(spark):
    """Every mention of a person, domain or number agrees with the others, in every form; scripts, genders and check digits hold."""
    t = [
        "Mrs. Anna Kowalska wrote; Mrs. Kowalska and Dr. KOWALSKA agree, Anna Kowalska too. Mr. Kowalska-Nowak",
        "г-н Иван Петров и г-жа Мария Петров, господин Петров; κ. Γεώργιος Παππάς και κα Παππάς",
        "John Miller is no listed name, but Robert Miller and Mr. Miller are",
        "a.b@corp.example.org c.d@corp.example.org A.B@corp.example.org x@other.net",
        "DE89 3704 0044 0532 0130 00 or DE89370400440532013000, GB82 WEST 1234 5698 7654 32; wrong DE00370400440532013000",
        "password=e3b3ed3cc8548923d6 and token:abcDEF123456 but password=short",
        "+1 743 555 3824, (743) 555-3824, 743-555-3824",
    ]
    got = [r.text for r in pii_surrogates.replace(docs(spark, [(None, x, "en", "s") for x in t]), "k").sort(F.length("text")).collect()]
    by = lambda *words_: next(x for x in got if all(w in x for w in words_))
    a = re.fullmatch(r"Mrs\. (\w+) (\w+) wrote; Mrs\. (\w+) and Dr\. (\w+) agree, (\w+) (\w+) too\. Mr\. (\w+-\w+)", by("wrote"))
    g, f, f2, f3, g2, f4, other = a.groups()
    assert f == f2 == f3.capitalize() == f4 != "Kowalska" and f3.isupper() and g == g2 and g.lower() in {x.lower() for x in pii_surrogates.NAMES["latin_f"]} and other[0].isupper()
    c = re.fullmatch(r"г-н (\w+) (\w+) и г-жа (\w+) (\w+), господин (\w+); κ\. (\w+) (\w+) και κα (\w+)", by("г-н"))
    assert c[2] == c[4] == c[5] != "Петров" and re.fullmatch("[А-Яа-я]+", c[2]) and c[1] in pii_surrogates.NAMES["cyrillic_m"] and c[3] in pii_surrogates.NAMES["cyrillic_f"]
    assert c[7] == c[8] != "Παππάς" and c[6] in pii_surrogates.NAMES["greek_m"]
    m = re.fullmatch(r"John Miller is no listed name, but (\w+) (\w+) and Mr\. (\w+) are", by("listed"))
    assert m[2] == m[3] != "Miller" and m[1] in pii_surrogates.NAMES["latin_m"]
    e = by("@").split()
    assert e[0].lower() == e[2].lower() != e[1] and e[2][0].isupper() and e[2][2].isupper() and e[0].split("@")[1] == e[1].split("@")[1] and e[0].endswith(".org") and e[3].endswith(".net") and "example" not in by("@")
    i = re.fullmatch(r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) or (DE\d{20}), (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d); wrong (DE\d{20})", by("wrong"))
    assert i[1].replace(" ", "") == i[2] != "DE89370400440532013000" and mod97(i[1]) == mod97(i[3]) == 1
    assert re.fullmatch(r"password=(?!e3b3ed3)[0-9a-f]{18} and token:(?!abcDEF)[a-z]{3}[A-Z]{3}\d{6} but password=short", by("password"))
    p = re.fullmatch(r"\+1 (\d{3}) (\d{3}) (\d{4}), \((\d{3})\) (\d{3})-(\d{4}), (\d{3})-(\d{3})-(\d{4})", by("+1 "))
    assert p.groups()[:3] == p.groups()[3:6] == p.groups()[6:] != ("743", "555", "3824")


def test_surrogates_are_injective_over_all_kinds_and_forms(spark):
    """By brute force: every unit's surrogate over a table with many units in small spaces, in several forms."""
    rng = random.Random(4)
    family = [f"{a}{b}" for a in "BCDFGHKLMNPRST" for b in "aeiou"] + ["Lee", "LEE", "Wu"]
    texts_ = [f"Mr. {x}" for x in family] + [f"Frau {x}a {y}" for x in ("Ev", "Ad", "Id") for y in family[:20]] + [f"{a}@x.io" for a in "abcdefghijklmnop"] + [f"q@{a}.io" for a in "abcdefghijklmnop"]
    texts_ += [f"{rng.randrange(100, 1000)}-{rng.randrange(10, 100)}-{rng.randrange(1000, 10000)}" for _ in range(50)] + [f"10.0.0.{k}" for k in range(200)]
    d = docs(spark, [(None if i % 3 else i, x, "en", str(i)) for i, x in enumerate(texts_)])
    got = {texts_[int(r.source)]: r.text for r in pii_surrogates.replace(d, "k").collect()}
    assert len(got) == len(set(texts_)) and all(got[x] != x for x in got)
    mapped = {}
    for x, y in got.items():
        parts = list(zip(*((z.lower().split()[1:] if z.startswith(("Mr.", "Frau")) else [z.lower()]) for z in (x, y)), strict=True))
        for k, (u, v) in enumerate(parts):
            u, v = ((parts[1][i] if len(parts) > 1 and k == 0 else "", z) for i, z in enumerate((u, v)))  # a given name is its person's
            assert mapped.setdefault(u, v) == v
    assert len(set(mapped.values())) == len(mapped)
    assert not {v for _, v in mapped.values() if not _} & {u for _, u in mapped if not _}


# pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_matches_brute_force(spark, table, texts, tmp_path):
    import corpus_pipeline

    small = [(i, t) for i, t in itertools.islice(texts.items(), 60)] + [(500, "1 2 3"), (501, None)]
    rows = spark.createDataFrame([(i, t, "en", f"s{i % 3}", None) for i, t in small], table.schema)
    (tmp_path / "x").mkdir()
    rows.write.parquet(str(tmp_path / "x" / "documents.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path / "x")).collect()}
    kept = {i: t for i, t in small if t and re.search(r"[^\W\d_]", t)}
    want = {i for i, (_, c) in brute_components(kept).items() if c == i}
    assert set(out) == want
    left = spark.createDataFrame([(i, kept[i], "en", "s", None) for i in sorted(want)], table.schema)
    written = {r.doc_id: r.text for r in pii_surrogates.replace(left, corpus_pipeline.PII_KEY).collect()}
    assert any(written[i] != kept[i] for i in want) and all(out[i].decoded_sha256 == hashlib.sha256(written[i].encode()).hexdigest() for i in want)
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_pipeline_returns_the_mix(spark, texts, table, tmp_path, monkeypatch):
    import corpus_pipeline

    small = [(i, t, "en", "big" if k % 5 else "few", None) for k, (i, t) in enumerate(itertools.islice(texts.items(), 60))]
    (tmp_path / "x").mkdir()
    spark.createDataFrame(small, table.schema).repartition(4).write.parquet(str(tmp_path / "x" / "documents.parquet"))
    stages = [s for s in corpus_pipeline.STAGES if s[0] in ("mixing", "byte_bpe")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    out = corpus_pipeline.run(spark, str(tmp_path / "x"))
    mixed = pfair_mix.mix(spark.read.parquet(str(tmp_path / "x" / "documents.parquet")))
    place = lambda t: {r.doc_id: (r.slot, r.place, r.exact) for r in t.collect()}
    assert place(out) == place(mixed) and len({(s, p) for s, p, _ in place(out).values()}) == 60
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages[1:])
    bare = corpus_pipeline.run(spark, str(tmp_path / "x"))
    assert set(out.columns) - set(bare.columns) == {"slot", "place", "exact"} and bare.count() == 60


def test_near_duplicates_keep_one_row_of_a_repeated_id(spark, table):
    import corpus_pipeline

    words_ = " ".join(f"w{i}" for i in range(40))
    rows = [(7, words_ + " b", "en", "y", 2), (7, words_ + " a", "en", "z", 1), (7, words_ + " a", "en", "x", 1), (9, words_, "en", "s", 3), (None, words_, "en", "s", 4), (None, words_, "en", "s", 4), (20, None, "en", "s", None)]
    d = spark.createDataFrame(rows, table.schema)
    got = sorted(corpus_pipeline.drop_near_duplicates(spark, d, "").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(7, words_ + " a", "en", "x", 1), (None, words_, "en", "s", 4), (None, words_, "en", "s", 4), (20, None, "en", "s", None)], key=lambda r: str(d.sparkSession.createDataFrame([r], table.schema).first()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rel = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    key = lambda rows, at: sorted((tuple(r[k] for k in at) for r in rows), key=repr)
    assert key(df.collect(), cols) == key(rel.fetchall(), [names.index(c) for c in cols])


def test_registered_queries():
    names = queries.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)] == [1] * 13
