"""The written index against brute force: equal scores, ties, empty texts, pruning, and leakage by hand."""

import math
import random

import pytest

from auditloom.operators import lexical_index as li


def brute(docs, query, k, k1=1.5, b=0.75):
    toks = {i: (t or "").lower().split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / max(1, len(docs))
    out = []
    for i, ts in toks.items():
        parts = []
        for w in set((query or "").lower().split()):
            df = sum(w in t for t in toks.values())
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            if w in ts and idf >= 1e-4:
                tf = ts.count(w)
                parts.append(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ts) / avg)))
        if parts:
            s = 0.0
            for p in sorted(parts):
                s += p
            out.append((-s, i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize(("per_block", "first"), [(1, 1), (7, 2)])
def test_search_is_exact(spark, tmp_path, per_block, first):
    rng = random.Random(per_block)
    docs = {i: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 12))) for i in range(150)}
    docs |= {200 + i: "Same text a" for i in range(9)} | {300: None, 301: "", 302: " \n"}
    queries = {"q1": "a b unknown", "q2": "same A a", "q3": None, "q4": "", "q5": "unknown", "q6": "cc dd ee ff", "q7": "same A a"}
    d = spark.createDataFrame(list(docs.items()), "doc long, text string")
    q = spark.createDataFrame(list(queries.items()), "query string, text string")
    index = li.write(d, str(tmp_path / "x"), per_block=per_block)
    found, steps = li.search(index, q, 5, first=first)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query, []).append((r.doc, r.score))
    want = {k: v for k, t in queries.items() if (v := brute(docs, t, 5))}
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for k in want for a, b in zip(got[k], want[k], strict=True))
    once = {(r.query, r.doc, r["rank"]) for r in li.search_distinct(li.read(spark, str(tmp_path / "x")), q, 5).collect()}
    assert once == {(k, i, n + 1) for k, v in want.items() for n, (i, _) in enumerate(v)}
    total = li.read_share(steps).first()
    assert 0 < total.read <= total.postings


def test_blocks_are_pruned(spark, tmp_path):
    """Groups with words of their own share blocks: a query reads those of its group and few others."""
    rng = random.Random(3)
    rows = [(f"{g}-{i}", g, " ".join(["common"] + [f"g{g}w{rng.randrange(20)}" for _ in range(8)])) for g in range(60) for i in range(20)]
    d = spark.createDataFrame(rows, "id string, grp int, text string")
    index = li.write(d, str(tmp_path / "x"), doc="id", group="grp", per_block=20)
    found, steps = li.search(index, spark.createDataFrame([(g, f"common g{g}w1 g{g}w2 g{g}w3") for g in range(60)], "query int, text string"), 3)
    share = li.read_share(steps).first()
    assert share.pruned > 0.7
    assert all(r.doc.split("-")[0] == str(r.query) for r in found.collect())
    assert set(index.postings.columns) == {"token", "block", "doc", "w"} and "common" in {r.token for r in index.terms.collect()}


def test_documents_are_scored_where_they_lie(spark, tmp_path):
    """A task gives k rows a query at most, and neither documents nor pairs with queries are shuffled."""
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i % 5}") for i in range(400)], "doc long, text string")
    index = li.write(docs, str(tmp_path / "x"), per_block=50)
    asked = spark.createDataFrame([(q, t) for q in range(6) for t in ("b1", "c2", f"c{q % 5}")], "query int, token string").distinct().join(index.terms.select("token", "idf"), "token").collect()
    found = li.score(index, index.docs, asked, "int", 4)
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert 24 <= found.count() <= index.docs.rdd.getNumPartitions() * 6 * 4 < 6 * 400


def test_passes_and_small_batches_change_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    docs = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 9))) for i in range(120)}
    queries = {i: " ".join(rng.choice("abcdefghz") for _ in range(3)) for i in range(7)}
    index = li.write(spark.createDataFrame(list(docs.items()), "doc long, text string"), str(tmp_path / "x"), per_block=5)
    monkeypatch.setattr(li, "AT_ONCE", 2)
    monkeypatch.setattr(li, "CELLS", 8)
    found, steps = li.search(index, spark.createDataFrame(list(queries.items()), "query long, text string"), 3, first=1)
    got = {(r.query, r["rank"]): (r.doc, r.score) for r in found.collect()}
    assert got == {(q, n + 1): hit for q, t in queries.items() for n, hit in enumerate(brute(docs, t, 3))}
    w = {(r.token, r.block): r.most for r in index.postings.groupBy("token", "block").agg({"w": "max"}).withColumnRenamed("max(w)", "most").collect()}
    bound = {(r.token, r.block): r.most * r.idf for r in index.bounds.join(index.terms, "token").groupBy("token", "block", "idf").agg({"most": "sum"}).withColumnRenamed("sum(most)", "most").collect()}
    assert w.keys() == bound.keys() and all(bound[k] * li.SLACK >= v for k, v in w.items())


def test_index_of_nothing(spark, tmp_path):
    d = spark.createDataFrame([], "doc long, text string")
    q = spark.createDataFrame([(1, "a")], "query int, text string")
    found, steps = li.search(li.write(d, str(tmp_path / "x")), q, 5)
    assert found.collect() == [] and steps.collect() == []


def test_leakage_by_hand(spark):
    found = spark.createDataFrame([("A", 1, 10), ("A", 2, 10), ("B", 3, 11), ("B", 1, 10)], "query string, from_note int, from_subject int")
    asked = spark.createDataFrame([(1, 10, "A"), (1, 10, "B"), (2, 10, "B"), (4, 12, "C")], "note int, subject int, query string")
    r = li.leakage(found, asked).first()
    # note 1: A gives its own and note 2, B gives note 3 of another subject and its own; note 2: B gives notes 3 and 1; note 4: nothing
    assert (r.notes_evaluated, r.code_queries, r.retrieved_chunks) == (3, 4, 6)
    assert (r.cross_admission_rate, r.cross_patient_rate, r.notes_with_own_evidence_rate) == (4 / 6, 2 / 6, 1 / 3)
    none = li.leakage(found.where("false"), asked).first()
    assert none.cross_admission_rate is None and none.retrieved_chunks == 0
