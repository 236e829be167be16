"""Scores by one shuffle of texts: those of notes against their own chunks, and of notes against a label base."""

from pyspark.sql import functions as F

from auditloom.functions.columns import chunks
from auditloom.operators import retrieval
from auditloom.plans import coding


def tables(spark):
    words = "fever cough pain chest knee knee acute left right of the".split()
    notes = [(n, " ".join(words[(n * 7 + i * i) % len(words)] for i in range(n * 3))) for n in range(9)] + [(9, None)]
    chunked = [(n, i, (t or "")[i * 20 : i * 20 + 20]) for n, t in notes for i in range(len(t or "") // 20 + 1)]
    labels = [(c, t) for c, t in enumerate(["acute chest pain", "left knee pain", "fever the cough", "", "nothing known"])]
    return notes, spark.createDataFrame(notes, "note int, text string"), spark.createDataFrame(chunked, "note int, doc int, text string"), spark.createDataFrame(labels, "query int, text string")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(note")


def test_note_scores_are_those_of_joins_with_one_shuffle_by_note(spark):
    _, notes, c, labels = tables(spark)
    key = lambda df: sorted((r.note, r.query, r.doc, r.score) for r in df.collect())
    want = key(retrieval.bm25(labels, c, within=["note"]))
    asked = notes.select("note").crossJoin(labels)
    for q in (labels, asked):
        got = retrieval.bm25_of_notes(q, c, tasks=3)
        assert exchanges(got) == 1
        assert key(got) == want
        every = key(retrieval.bm25_of_notes(q, c, zeros=True, tasks=3))
        assert [x for x in every if x[3] > 0] == want and len(every) == c.count() * 5


def test_base_scores_are_those_of_joins_with_one_shuffle_of_texts(spark):
    _, notes, _, labels = tables(spark)
    q, b = notes.withColumnRenamed("note", "query"), labels.withColumnRenamed("query", "doc")
    key = lambda df: sorted((r.query, r.doc, r.score) for r in df.collect())
    got = retrieval.bm25_of_base(q, b, tasks=3)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(query") == 1
    assert key(got) == key(retrieval.bm25(q, b))
    assert key(retrieval.bm25_of_base(q, b, zeros=True, tasks=3)) == key(retrieval.universe(q, b, retrieval.bm25(q, b)))


def test_evidence_texts_are_not_shuffled(spark):
    notes, n, _, labels = tables(spark)
    base = labels.select(F.concat(F.lit("A0"), "query").alias("code"), "text")
    plan = coding.coded(n, base, k=3, mode="flag", contrast=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    above, below = text.split("Generate explode(own", 1)  # where the evidence is cut from the note's text
    assert "Exchange" not in above and "hashpartitioning(note" in below


def test_chunks_split_a_text_once(spark):
    got = spark.createDataFrame([(" ".join(map(str, range(600))),), (None,), ("a",)], "text string").select(chunks(F.col("text")).alias("c"))
    c = got.collect()
    assert [x.split()[0] for x in c[0].c] == ["0", "224", "448"] and c[1].c == [] and c[2].c == ["a"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
