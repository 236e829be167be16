"""Notes against a label base that every task holds: the same rows as by joins, without a row for a token or a pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.functions.columns import chunks
from auditloom.operators import label_base as lb
from auditloom.operators import retrieval
from auditloom.plans import coding


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    words = "fever cough, Pain chest KNEE acute-left right of the Ärzte naïve x9 icd-10 a01: (heart) failure".split()
    texts = [" ".join(rng.choice(words[: 3 + n % 14]) for _ in range(n)) for n in (1, 5, 31, 32, 33, 255, 256, 257, 480, 481, 700, 1500)]
    texts += [None, "", " \n\t", "heart\x0bfailure pain\n" * 200, " ".join(["acute"] * 600), "w" * 130 + " pain", "two\nlines " * 30]
    notes = spark.createDataFrame(list(enumerate(texts)), "note long, text string")
    base = spark.createDataFrame([("B02", "Acute left KNEE pain"), ("A01", "heart failure, acute-left"), ("A02", "heart failure, acute-left"), ("A03", "the cough of fever x9"), ("C01", ""), ("C02", None), ("C03", "zebra of"), ("Ä01", "naïve ärzte pain pain")], "code string, text string")
    return notes, base


def rows(df, columns=None):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(columns or df.columns)).collect()), key=repr)


@pytest.mark.parametrize("k", [3, 20])
def test_held_base_gives_the_rows_of_joins(spark, tables, k):
    notes, base = tables
    want = coding._joined(notes, base, k, 1.0, None)
    columns = ["note", "code", "candidate_rank", "retrieval_score", "evidence_preview", "evidence_quote", "evidence_chunk_id", "evidence_score", "confidence", "supported"]
    got = coding._held(notes, base, k)
    assert {f.name: f.dataType for f in got.schema if f.name in columns} == {f.name: f.dataType for f in want.schema if f.name in columns}
    assert rows(got, columns) == rows(want, columns)
    assert coding._held(notes, base.limit(0), k).count() == 0 == coding._held(notes.limit(0), base, k).count()


def test_coded_makes_rows_of_candidates_only(spark, tables):
    notes, base = tables
    for options in ({}, {"mode": "flag", "legacy": True}):
        plan = coding.coded(notes, base, contrast=True, **options)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Generate ") == 1 == plan.count("ArrowEvalPython") and "Join" not in plan
        assert plan.count("Exchange hashpartitioning(note") == 2  # texts, then what is left of them


@pytest.mark.parametrize(("alpha", "encode"), [(0.5, retrieval.hash_embedding), (0.0, retrieval.hash_embedding), (1.0, retrieval.hash_embedding), (1.0, None)])
def test_note_local_of_a_held_base_gives_the_rows_of_joins(spark, tables, alpha, encode):
    notes, base = tables
    labels = base.withColumnRenamed("code", "query")
    c = notes.select("note", F.posexplode(chunks(F.col("text"))).alias("doc", "text"))
    want, got = retrieval.note_local(labels, c, 2, alpha, encode, tasks=2), lb.note_local_of_base(notes, labels, 2, alpha, encode)
    assert {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in want.schema}
    assert rows(got) == rows(want)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_other_bases_go_through_joins(spark, tables, monkeypatch):
    notes, base = tables
    assert coding._held(notes, base.union(base.limit(1)), 3) is None  # a label twice
    assert lb.held(spark.createDataFrame([(None, "a")], "code string, text string"), "code") is None
    monkeypatch.setattr(lb, "LABELS", 7)
    assert coding._held(notes, base, 3) is None and lb.note_local_of_base(notes, base.withColumnRenamed("code", "query"), 2) is None
    assert coding.coded(notes, base, k=3, mode="off").where("note = 9").count() == 3


def test_parts_and_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    words = [b"w%d" % i for i in range(60)]
    texts = [b" ".join(rng.choice(words, 8)) for _ in range(23)]
    vectors = rng.integers(-3, 4, (23, 5)).astype(float).tolist()
    make = lambda: lb.Base(list(range(23)), texts, texts, [[]] * 23, [*vectors[:-1], None], 1.5, 0.75)
    base = make()
    ids = base.ids(rng.choice([*words, b"unknown"], 900).tolist())
    v = rng.integers(-3, 4, (lb.count(900, 64, 56), 5)).astype(float)
    (_, want), cosines = *base.chunk_scores(ids, len(v), 64, 56), base.cosines(0, 23, v)
    assert np.isnan(cosines[-1]).all() and want.any()
    monkeypatch.setattr(lb, "PART", 4)
    monkeypatch.setattr(lb, "BLOCK", 3)
    monkeypatch.setattr(lb, "CELLS", 100)
    base = make()
    parts = list(base.chunk_scores(ids, len(v), 64, 56))
    assert [f for f, _ in parts] == list(range(0, 23, 4)) and np.array_equal(np.concatenate([x for _, x in parts]), want)
    assert np.array_equal(base.cosines(0, 23, v), cosines, equal_nan=True)


def test_hash_embedding_digests_a_text_once(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string").select(retrieval.hash_embedding(F.col("t"), 12).alias("v"))
    assert df._jdf.queryExecution().analyzed().toString().count("sha2(") == 1
    a, none = (r.v for r in df.collect())
    assert len(a) == 12 and a[:4] == a[8:] and none == [None] * 12


def test_legacy_plan_of_all_documents_gives_the_rows_of_joins(spark, monkeypatch):
    from auditloom.queries.coding import plan_legacy

    d = "/root/testdata/sf0.001"
    held = plan_legacy(spark, d)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Generate ") == 1
    got = rows(held)
    monkeypatch.setattr(lb, "LABELS", 1)
    assert got == rows(plan_legacy(spark, d)) and got
