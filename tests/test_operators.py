"""Edge cases of the operators on a few literal rows."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from auditloom.functions import columns as fc
from auditloom.operators import evaluation as ev
from auditloom.operators import learners, reports, retrieval, scoring, search
from auditloom.operators import statistics as st


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in cols.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in cols.values()) or (1,)], schema).select(expr.alias("v")).first().v


@pytest.mark.parametrize(("quote", "source", "expected"), [("Ab  c", "x aB\nC y", True), ("zz", "abc", False), ("", "abc", None), (None, "abc", None), ("a", " ", None)])
def test_verbatim(spark, quote, source, expected):
    assert one(spark, fc.verbatim(F.col("q"), F.col("s")), q=("string", quote), s=("string", source)) is expected


@pytest.mark.parametrize(("text", "value", "present"), [("0.5", 0.5, True), ("1.7", 1.0, True), ("-2", 0.0, True), ("NaN", 0.0, False), ("x", 0.0, False), (None, 0.0, False), ("0", 0.0, True)])
def test_confidence(spark, text, value, present):
    assert one(spark, fc.as_confidence(F.col("t")), t=("string", text)) == value
    assert one(spark, fc.has_confidence(F.col("t")), t=("string", text)) is present


def test_codes(spark):
    assert one(spark, fc.norm_audit(F.lit(" a01.5 "))) == "A015"
    assert one(spark, fc.norm_model(F.lit(" a0 1.5"))) == "A015"
    assert one(spark, fc.parent(F.lit("a01.55"))) == "A01"


def test_budgeted_keeps_long_tails_only(spark):
    parts = F.array(F.lit("a" * 10), F.lit("b" * 10), F.lit("c" * 10))
    assert one(spark, fc.budgeted(parts, 25, 4)) == "a" * 10 + "\n" + "b" * 10 + "\n" + "c" * 5
    assert one(spark, fc.budgeted(parts, 25, 5)) == "a" * 10 + "\n" + "b" * 10


def test_weighted_query_rounds_half_even(spark):
    s = F.array(F.struct(F.lit("a").alias("name"), F.lit("x").alias("text"), F.lit(2.5).alias("weight")), F.struct(F.lit("b").alias("name"), F.lit("y").alias("text"), F.lit(0.2).alias("weight")))
    assert one(spark, fc.weighted_query(s)) == "x x y"


def test_chunks_of_blank_text(spark):
    assert one(spark, F.size(fc.chunks(F.lit("  \n")))) == 0
    assert one(spark, F.size(fc.chunks(F.lit("a b c")))) == 1
    assert one(spark, fc.chunks(F.lit("a b c d e"), 3, 1)) == ["a b c", "c d e"]


FACTS = "note long, code string, in_gold boolean, in_pred boolean, rank int, supported boolean, confidence double"


def test_published_identities(spark):
    # Sums published for a run of 17,151 notes and 50 labels.
    c = spark.createDataFrame([(0, 10994, 73127 - 10994, 92288 - 10994)], "note long, tp long, fp long, fn long")
    r = c.agg(*ev.micro(None)).first()
    assert abs(r.micro_f1 - 0.132926) < 1e-6
    assert round((62133 + 81294) / (17151 * 50), 6) == 0.167252


def test_at_k_skips_notes_without_gold_for_recall_only(spark):
    f = spark.createDataFrame([(1, "A", True, True, 1, True, 0.9), (1, "B", True, False, None, None, None), (2, "A", False, True, 1, None, 0.1)], FACTS)
    notes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "note long")  # the last two have neither gold nor predicted codes
    r = ev.at_k(f, notes, [1]).first()
    assert (r.p_at_1, r.r_at_1) == (0.25, 0.5)


def test_notes_without_facts_count(spark):
    f = spark.createDataFrame([(1, "A", True, True, 1, True, 0.9), (2, "A", False, True, 1, None, 0.1)], FACTS)
    notes = spark.createDataFrame([(i,) for i in range(1, 5)], "note long")
    r = ev.classification(f, notes, spark.createDataFrame([("A",), ("B",)], "code string")).first()
    assert (r.notes, r.labels, r.hamming, r.exact_match, r.p_at_5, r.r_at_5, r.label_coverage) == (4, 2, 0.125, 0.75, 0.25, 1.0, 0.5)
    none = ev.classification(f.where("false"), notes.where("false")).first().asDict()
    assert none.pop("hamming") == 1.0 and not any(none.values())


def test_reliability_has_nulls_for_empty_bases(spark):
    p = spark.createDataFrame([(1, "A", 0.5, None, 1)], "note long, code string, confidence double, supported boolean, rank int")
    r = ev.reliability(p).first()
    assert r.evidence_judged_codes == 0 and r.evidence_support_rate is None and r.evidence_quote_verbatim_rate is None and r.confidence_missing_rate == 0
    r = ev.reliability(p.where("false")).first()
    assert r.total_predicted_codes == 0 and r.unsupported_code_rate is None and r.hallucination_flag_rate == r.llm_contrastive_rate == 0


def test_reliability_prefers_stored_verdicts_and_skips_mocks(spark):
    rows = [("A", "heart pain", "Heart  pain here", None, False), ("B", "zz", "heart", True, False), ("C", "heart", "heart", False, False), ("D", "heart", "heart", True, True), ("E", "", "heart", None, False)]
    d = spark.createDataFrame(rows, "code string, evidence_quote string, evidence_preview string, evidence_quote_verbatim boolean, mock_llm boolean").selectExpr("*", "0.5 as confidence", "true as supported")
    r = ev.reliability(d).first()
    assert (r.evidence_quote_checked_codes, r.evidence_quote_verbatim_rate, r.evidence_quote_rate) == (3, 0.666667, 1.0)


def test_lift_is_null_without_right_unsupported_codes(spark):
    c = spark.createDataFrame([(1, 1, 1, 0, 1)], "sg long, st long, dummy long, ug long, ut long").withColumn("ug", F.lit(0))
    assert ev.lift(c).first().lift is None


def test_min_max_of_equal_scores_is_zero(spark):
    s = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0)], "query int, doc int, score double")
    assert [r.mm for r in retrieval.min_max(s).collect()] == [0.0, 0.0]


def test_bm25_ignores_query_frequency_and_unknown_tokens(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d"), (4, "")], "doc int, text string")
    q = spark.createDataFrame([(1, "a"), (2, "a a a zzz"), (3, "zzz"), (4, None)], "query int, text string")
    s = {(r.query, r.doc): r.score for r in retrieval.bm25(q, d).collect()}
    assert s[(1, 1)] == s[(2, 1)] > 0 and {q for q, _ in s} == {1, 2}


def test_mask_applies_after_normalisation(spark):
    s = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (1, 3, 0.0)], "query int, doc int, score double")
    m = spark.createDataFrame([(2,), (3,)], "doc int")
    r = retrieval.top_k(retrieval.min_max(s), 5, mask=m).orderBy("rank").collect()
    assert [(x.doc, x.mm) for x in r] == [(2, 0.5), (3, 0.0)]


def test_salvage_and_parse(spark):
    assert scoring.salvage_objects('x [{"a":"}"},{"b":"\\"{"},{"c":') == [{"a": "}"}, {"b": '"{'}]
    t = 'so: ```json\n[{"code":"A1","supported":true,"confidence":"0.5"}]\n```'
    r = spark.createDataFrame([(t,), ("nothing",), (None,)], "t string").select(scoring.parse_items(F.col("t")).alias("x")).collect()
    assert r[0].x[0].code == "A1" and r[1].x is None and r[2].x is None


def test_gap_of_exactly_the_margin_is_borderline(spark):
    p = spark.createDataFrame([(1, "A01.1", 0.5, True, 1), (1, "A01.2", 0.3, True, 2), (1, "B01.1", 0.9, True, 3)], "note long, code string, confidence double, supported boolean, rank int")
    assert [(r.best, r.runner_up) for r in scoring.borderline(p).collect()] == [("A01.1", "A01.2")]


def test_pareto_of_equal_and_single_points(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 2.0)], "k int, a double, b double")
    assert sorted(r.k for r in search.pareto(p, ["a", "b"]).collect()) == [1, 2]
    assert search.knee(p.where("k = 1"), ["a", "b"], "k").first().k == 1


def test_search_drivers_find_a_front():
    space = search.Space({"x": list(range(11)), "y": list(range(11))})
    objective = lambda c: [c["x"], 10 - c["x"] + c["y"]]
    for found in (search.nsga2(space, objective, 12, 8, 2), search.mopso(space, objective, 12, 8, 2), search.random_search(space, objective, 50, 2)):
        best = [f for _, f in found if not any(search.dominates(g, f) for _, g in found)]
        assert best
    assert space.decode(space.encode({"x": 3, "y": 7})) == {"x": 3, "y": 7}


def test_number_is_dense(spark):
    d = st.number(spark.range(1000).selectExpr("id * 7 % 1000 as k"), "k").collect()
    assert all(r.k == r.pos for r in d)


def test_one_replicate(spark):
    n = spark.createDataFrame([(1, 1, 0, 0, 1, 0, 0)], "note long, tp_a long, fp_a long, fn_a long, tp_b long, fp_b long, fn_b long")
    assert st.interval(st.bootstrap(n, 1, 1, {"d": st.delta_f1()}), "d").first().replicates == 1


def test_poisson_thresholds():
    import numpy as np

    u = np.random.default_rng(1).integers(0, 2**32, 200_000)
    w = sum((u >= t).astype(int) for t in st.POISSON)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and st.POISSON[-1] < 2**32


@pytest.mark.parametrize("parts", [1, 7])
def test_resample_matches_note_by_note_moments(spark, parts):
    """Merged notes against the moments of notes drawn one by one; the same sums however the notes are dealt."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.randrange(3), rng.randrange(2), rng.randrange(3), rng.randrange(2), rng.randrange(3)) for i in range(400)]
    cols = ["tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b"]
    d = spark.createDataFrame(rows, "note long, " + ", ".join(f"{c} long" for c in cols)).repartition(parts)
    boot = {r.rep: r for r in st.resample(d, 3000, 5).collect()}
    assert len(boot) == 3000
    for k, c in enumerate(cols, 1):
        x = [r[k] for r in rows]
        got = [r[c] for r in boot.values()]
        mean, var = sum(got) / len(got), sum((g - sum(got) / len(got)) ** 2 for g in got) / len(got)
        wide = sum(v * v for v in x) - sum(x) ** 2 / len(x)  # of the sum of n draws
        assert abs(mean - sum(x)) < 4 * math.sqrt(wide / 3000) and abs(var / wide - 1) < 0.15
    assert all(r.drawn == 400 for r in boot.values())
    swapped = st.resample(d, 3000, 5, [st.sides("a", "b")]).collect()
    both = sum(r[1] + r[4] for r in rows)
    assert all(r.tp_a + r.tp_b == both for r in swapped) and abs(sum(r.tp_a for r in swapped) / 3000 - both / 2) < 1
    again = {r.rep: r for r in st.resample(d.repartition(5), 3000, 5).collect()}
    assert all(again[k] == boot[k] for k in boot)


def test_contrasts_find_a_difference_and_none(spark):
    rows = [(i, 3, 1, 1, 1, 3, 3) for i in range(100)] + [(i, 1, 1, 1, 1, 1, 1) for i in range(100, 200)]
    d = spark.createDataFrame(rows, "note long, tp_a long, fp_a long, fn_a long, tp_b long, fp_b long, fn_b long")
    r = st.contrasts(d, {"d": st.f1_of("a") - st.f1_of("b"), "none": st.f1_of("a") - st.f1_of("a")}, 500, 1, {"d": [st.sides("a", "b")]}).collect()
    by = {x.name: x for x in r}
    assert by["d"].lo > 0 and by["d"].verdict == "excludes 0" and by["d"].p == round(1 / 501, 6) and by["none"].verdict == "spans 0" and by["none"].p is None


def test_best_of_all_matches_every_document(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc long")
    queries = spark.createDataFrame([(i,) for i in range(12)], "query long")
    hits = {(q, x): rng.randrange(1, 4) / 2 for q in range(12) for x in rng.sample(range(0, 60, 2), q)}
    h = spark.createDataFrame([(q, x, s) for (q, x), s in hits.items()], "query long, doc long, score double")
    got = sorted((r.query, r["rank"], r.doc, r.score) for r in retrieval.best_of_all(queries, docs, h, 5).collect())
    want = []
    for q in range(12):
        best = sorted((-hits.get((q, x), 0.0), x) for x in range(0, 60, 2))[:5]
        want += [(q, i + 1, x, -s) for i, (s, x) in enumerate(best)]
    assert got == want


def test_hybrid_without_a_side(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (1, 3, 0.0)], "query int, doc int, score double")
    b = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9)], "query int, doc int, score double")
    rows = lambda x: sorted((r.doc, r.score, r.skipped_dense) for r in x.collect())
    assert rows(retrieval.hybrid(a, None, 0.5)) == [(1, 1.0, True), (2, 0.5, True), (3, 0.0, True)] == rows(retrieval.hybrid(a, b, 1.0))
    assert rows(retrieval.hybrid(None, b, 0.5)) == [(1, 0.0, False), (2, 1.0, False)] == rows(retrieval.hybrid(a, b, 0.0))
    assert rows(retrieval.hybrid(a, b, 0.5)) == [(1, 0.5, False), (2, 0.5, False)]  # min-max over what both have
    for bad in ((None, b, 1.0), (a, None, 0.0), (None, None, 0.5)):
        with pytest.raises(ValueError, match="no index"):
            retrieval.hybrid(*bad)


def test_equal_queries_are_scored_once(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d")], "doc int, text string")
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c d"), (4, None), (5, None)], "query int, text string")
    key = lambda x: sorted((r.query, r.doc, r.score) for r in x.collect())
    assert key(retrieval.bm25_of_distinct(q, d)) == key(retrieval.bm25(q, d))


def test_encoder_slot_gets_small_batches(spark):
    def encoder(texts):
        assert len(texts) <= 3
        return [[len(t), 1.0] for t in texts]

    d = spark.createDataFrame([(i, "x" * i if i else None, 5) for i in range(10)], "k int, text string, embedding int").coalesce(1)
    got = {r.k: r.embedding for r in retrieval.encode_with(d, encoder, batch=3).collect()}
    assert got == {i: [float(i), 1.0] for i in range(10)}


def test_zero_shot_keeps_first_mentions_of_the_closed_set(spark):
    a = spark.createDataFrame([(1, '["B1", {"code": "A1"}, "B1", "X9"]'), (2, "nothing"), (3, None)], "note int, t string")
    labels = spark.createDataFrame([("A1",), ("B1",), ("C1",)], "code string")
    rows = lambda x: sorted((r.note, r["rank"], r.code, r.confidence, r.supported) for r in x.collect())
    assert rows(scoring.zero_shot(a, "t")) == [(1, 1, "B1", 0.8, True), (1, 2, "A1", 0.8, True), (1, 3, "X9", 0.8, True)]
    assert rows(scoring.zero_shot(a, "t", labels)) == [(1, 1, "B1", 0.8, True), (1, 2, "A1", 0.8, True)]


def test_report_cells_and_numbers(spark):
    d = spark.createDataFrame([(0.12345, 0.01, 3, 0.1235, 4), (0.5, None, 1, 0.5, 2), (None, None, 0, 1.0, 1), (2.5, 0.0, 1, 2.0, 0), (0.123456789, 0.0, 1, 0.12345679, 8)], "m double, s double, n int, stated double, k int")
    got = d.select(reports.cell(F.col("m"), F.col("s"), F.col("n")).alias("c"), reports.holds(F.col("m"), F.col("stated"), F.col("k")).alias("ok")).collect()
    assert [r.c for r in got] == ["0.1235 ± 0.0100", "0.5000", "—", "2.5000", "0.1235"] or got[0].c == "0.1234 ± 0.0100"
    assert [r.ok for r in got] == [True, True, False, True, True]
    m = spark.createDataFrame([("a.b.c", 1.0)], "metric string, value double")
    p = spark.createDataFrame([("a.b.c",), ("a.b",)], "path string")
    assert {r.path: r.value for r in reports.by_path(m, p).collect()} == {"a.b.c": 1.0, "a.b": None}


def test_decide_falls_back(spark):
    s = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.3), (2, "a", 0.9), (2, "b", 0.8)], "note int, code string, score double")
    assert sorted((r.note, r.code) for r in learners.decide(s, 0.5).collect()) == [(1, "b"), (2, "a"), (2, "b")]


def test_tfidf_learner(spark):
    d = spark.createDataFrame([(i, "heart pain chest" if i % 2 else "broken bone leg") for i in range(20)], "note int, text string")
    y = spark.createDataFrame([(i, "H" if i % 2 else "B") for i in range(20)], "note int, code string")
    m = learners.TfidfLinear().fit(d, y)
    top = learners.decide(m.scores(d), 0.5).collect()
    assert {(r.note, r.code) for r in top} == {(i, "H" if i % 2 else "B") for i in range(20)}
    assert not math.isnan(top[0].score)


def test_coded_plan(spark):
    from auditloom.plans import coding

    filler = " ".join(f"w{i}" for i in range(300))
    phrase = "the patient had chest pain and acute heart failure"
    notes = spark.createDataFrame([(1, f"{phrase} {filler}"), (2, None), (3, ""), (4, phrase)], "note int, text string")
    base = spark.createDataFrame([("A01", "acute heart failure"), ("B01", "broken leg")], "code string, text string")
    kept = lambda **o: {(r.note, r.code) for r in coding.coded(notes, base, **o).collect()}
    assert kept() == {(1, "A01")}  # a note of one chunk keeps nothing
    assert {x for x in kept(mode="off") if x[0] in (1, 4)} >= {(1, "A01"), (4, "A01")}
    flagged = {(r.note, r.code): r for r in coding.coded(notes, base, mode="flag").collect()}
    assert flagged[4, "A01"].risk_flag == "weak_evidence" and not flagged[4, "A01"].supported and flagged[4, "A01"].evidence_score == 0
    assert flagged[1, "A01"].risk_flag == "none" and flagged[1, "A01"].evidence_score == 1
    assert kept(least=0.0) >= {(1, "A01"), (4, "A01")}


def test_evidence_of_equal_chunks_scores_zero(spark):
    from auditloom.plans import coding

    same = " ".join(["acute heart failure"] * 75 + ["x"] * 31)  # two chunks, in which each token is in both
    notes = spark.createDataFrame([(1, same), (2, "one " * 300 + "acute " + "two " * 300)], "note int, text string")
    base = spark.createDataFrame([("A01", "acute heart failure")], "code string, text string")
    cand = spark.createDataFrame([(1, "A01"), (2, "A01")], "note int, code string")
    e = {r.note: r for r in coding.evidence(notes, cand, base, k=1).collect()}
    assert e[2].evidence_score == 1 and "acute" in e[2].evidence and e[2].evidence_chunk_id == "chunk_1"
    assert e[1].evidence_score in (0, 1) and e[1].evidence


def test_dense_over_all_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(120, 4)), 1).astype(np.float32)
    v[60:90] = v[5]  # ties over blocks
    v[7] = 0
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "vec_id long, embedding array<float>")
    u = v.astype(float) / np.maximum(np.sqrt((v.astype(float) ** 2).sum(1, keepdims=True)), 1e-9)
    s = np.round(u @ u.T, 5)
    want = {(i, int(d), r + 1, s[i, d]) for i in range(120) for r, d in enumerate(np.lexsort((np.arange(120), -s[i]))[:10])}
    for queries, docs in ((2048, 8192), (11, 23), (50, 3)):
        assert {(r.query, r.doc, r["rank"], r.score) for r in retrieval.dense_top_k(t, 10, queries=queries, docs=docs).collect()} == want
    assert retrieval.dense_top_k(t.where("false"), 10).count() == 0


def _tables(spark, folder, n_docs=60, n_items=50):
    """Documents, labels and vectors with ids beyond 20 and 40."""
    import random

    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    docs = [(i, text(600 if i % 9 == 0 else 12)) for i in range(n_docs)] + [(n_docs, None)]
    items = [(i, text(6)) for i in range(n_items)]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(55)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string"), ("embeddings", vectors, "vec_id long, embedding array<float>")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return docs, items, vectors


def _scale(x):
    return [(v - min(x)) / (max(x) - min(x)) if max(x) > min(x) else 0.0 for v in x]


def test_hybrid_over_the_whole_base(spark, tmp_path):
    import numpy as np

    from auditloom import catalog

    docs, items, vectors = _tables(spark, tmp_path)
    tok = [t.split() for _, t in items]
    mean = sum(map(len, tok)) / len(tok)
    df = {w: sum(w in t for t in tok) for t in tok for w in t}
    weight = lambda w, t: math.log(1 + (len(tok) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean))
    v = np.array([np.float32(x) for _, x in vectors], float)
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    got = {}
    for r in catalog.queries()["ret_hybrid_topk_all"](spark, str(tmp_path)).collect():
        got.setdefault(r.query, {})[r["rank"]] = (r.doc, r.score)
    assert set(got) == set(range(55))
    for i, text in docs[:55]:
        lex = _scale([sum(weight(w, t) for w in set(text.split()) if w in t) for t in tok])
        den = _scale([round(float(v[i] @ v[j]), 5) for j in range(50)])
        score = [0.6 * a + 0.4 * b for a, b in zip(lex, den, strict=True)]
        assert [got[i][r][1] for r in range(1, 6)] == pytest.approx(sorted(score, reverse=True)[:5], abs=1e-5)
        assert all(score[d] == pytest.approx(x, abs=1e-5) for d, x in got[i].values())


def test_queries_over_all_labels(spark, tmp_path):
    """The whole queries agree with their SQL once its filters are gone, and go beyond what it keeps."""
    import duckdb

    from auditloom import catalog

    _tables(spark, tmp_path)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    filters = {"ret_note_local_evidence": " where note % 20 = 0", "scr_mock_scores": " where d.doc_id % 20 = 0"}
    for name, part in filters.items():
        sql = catalog.oracle_sql()[name]
        assert sql.count(part) == 1
        df = catalog.queries()[f"{name}_all"](spark, str(tmp_path))
        rel = con.execute(sql.replace(part, ""))
        names = [x[0] for x in rel.description]
        assert sorted(names) == sorted(df.columns)
        key = [c for c in names if c in ("note", "query", "doc", "item_id", "doc_id")]
        cut = lambda r: tuple(round(v, 5) if isinstance(v, float) else v for v in r)
        want = sorted((cut(r) for r in rel.fetchall()), key=repr)
        got = sorted((cut([r[c] for c in names]) for r in df.collect()), key=repr)
        assert key and len(got) == len(want) > len(con.execute(sql).fetchall())
        bad = [(a, b) for a, b in zip(got, want, strict=True) if a[: len(key)] != b[: len(key)] or any(x != y and (None in (x, y) or abs(x - y) > 2e-5) for x, y in zip(a, b, strict=True))]
        assert not bad, (name, bad[:5])


def test_full_grids_and_replicates(spark, monkeypatch):
    import collections
    import hashlib

    from auditloom import catalog
    from auditloom.queries import evaluation, statistics

    small = "/root/testdata/sf0.001"
    rows = evaluation.facts(spark, small).collect()
    q = catalog.queries()
    ts = [i / 100.0 for i in range(5, 71)]
    by = collections.defaultdict(list)
    for r in rows:
        by[r.code].append(r)
    want = {}
    for code, own in by.items():
        g = sum(r.in_gold for r in own)
        sure = [r for r in own if r.in_pred and r.confidence is not None]
        f = [round(2 * sum(r.in_gold for r in sure if r.confidence >= t) / (sum(r.confidence >= t for r in sure) + g), 9) if g else 0 for t in ts]
        want[code] = ts[f.index(max(f))] if g else 0.5
    assert {r.code: r.threshold for r in q["ml_label_thresholds_full"](spark, small).collect()} == want
    assert not set(want.values()) <= {0.1, 0.3, 0.5, 0.7}

    notes = collections.defaultdict(list)
    for r in rows:
        notes[r.note].append(r)
    score = {h: {} for h in (0, 1)}
    for h in (0, 1):
        g = sum(r.in_gold for r in rows if r.note % 2 == h)
        ranked = [sorted((r for r in own if r.in_pred), key=lambda r: r["rank"]) for n, own in notes.items() if n % 2 == h]
        for t in [i / 20 for i in range(20)]:
            for only in (False, True):
                kept = [[r.in_gold for r in own if (r.confidence is None or r.confidence >= t) and (r.supported or not only)] for own in ranked]
                for cap in statistics.CAPS:
                    score[h][t, cap, only] = (sum(sum(k[:cap]) for k in kept), sum(len(k[:cap]) for k in kept) + g)
    f1 = lambda h, c: round(2 * score[h][c][0] / score[h][c][1], 9)
    got = {r.tuned_on: r for r in q["st_split_half_full"](spark, small).collect()}
    for h in (0, 1):
        top = min(score[h], key=lambda c: (-f1(h, c), c))
        assert (got[h].t, got[h].cap, got[h].supported_only, got[h].tuned_f1, got[h].held_out_f1) == (*top, f1(h, top), f1(1 - h, top))
    whole = {c: round(2 * (score[0][c][0] + score[1][c][0]) / (score[0][c][1] + score[1][c][1]), 9) for c in score[0]}
    top = min(whole, key=lambda c: (-whole[c], c))
    assert (got[2].t, got[2].cap, got[2].supported_only, got[2].tuned_f1, got[2].held_out_f1) == (*top, whole[top], None)

    assert (statistics.FULL, statistics.FULL_METRIC) == (10_000, 1_000)
    # Intervals of merged notes against those of notes that are weighted one by one (the form with SQL).
    full, each = statistics.bootstrap_delta_full(spark, small, 2000).first(), statistics.bootstrap_delta(spark, small, 400).first()
    assert full.replicates == 2000 and abs(full.lo - each.lo) < 0.01 and abs(full.hi - each.hi) < 0.01
    report = {r.name: r for r in statistics.paired_report(spark, small, 500).collect()}
    assert abs(report["delta_micro_f1"].lo + full.hi) < 0.01 and report["delta_micro_f1"].verdict == "spans 0" and report["delta_micro_f1"].p > 0.05
    spark.catalog.clearCache()


def test_sections_and_prompts(spark):
    t = "before\nChief Complaint: pain\n in chest\nFOLLOW-UP :\nnone: a\nHospital Course:\n \nx Follow-up: no heading"
    heads = ["Chief Complaint", "Follow-up", "Hospital Course"]
    got = spark.createDataFrame([(t,), ("",), (None,), ("no heading",)], "t string").select(fc.sections(F.col("t"), heads).alias("s")).collect()
    assert [tuple(x) for x in got[0].s] == [("", "before"), ("Chief Complaint", "pain\n in chest"), ("FOLLOW-UP", "none: a"), ("Hospital Course", "x Follow-up: no heading")]
    assert got[1].s == [] and got[2].s is None and [tuple(x) for x in got[3].s] == [("", "no heading")]
    c = F.array(F.struct(F.lit("A1").alias("code"), F.lit("title").alias("title"), F.lit("abcdef").alias("evidence")), F.struct(F.lit("B1").alias("code"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("evidence")))
    p = one(spark, fc.prompt(c, "note", F.lit("n" * 50), snippet_cap=3, note_cap=10))
    assert "1. A1 (title)\n   Evidence: abc\n2. B1 ()\n   Evidence: \n" in p and "n" * 10 in p and "n" * 11 not in p
    assert len(one(spark, fc.prompt(c, cap=40))) == 40


def test_note_local_scores_stay_in_the_note(spark):
    q = spark.createDataFrame([(1, "a", "heart pain"), (2, "a", "heart pain"), (2, "b", "zzz"), (3, "a", "heart")], "note int, query string, text string")
    c = spark.createDataFrame([(1, 0, "heart rate"), (1, 1, "pain in heart pain"), (2, 0, "nothing here"), (2, 1, "pain"), (4, 0, "heart")], "note int, doc int, text string")
    got = {(r.note, r.query, r["rank"]): (r.doc, r.score, r.skipped_dense) for r in retrieval.note_local(q, c, 0).collect()}  # one chunk at least
    assert got == {(1, "a", 1): (1, 1.0, True), (2, "a", 1): (1, 1.0, True), (2, "b", 1): (0, 0.0, True)}
    both = retrieval.note_local(q, c, 2, 0.5, lambda t: F.transform(F.array(F.length(t), F.lit(1)), lambda x: x.cast("double"))).collect()
    assert len(both) == 6 and all(0 <= r.score <= 1 and not r.skipped_dense for r in both)


def test_whole_plans(spark):
    from auditloom.plans import coding

    notes = spark.createDataFrame([(1, "chest pain and a broken leg bone" + " filler" * 300), (2, ""), (3, "unrelated words only")], "note int, text string")
    base = spark.createDataFrame([("A01.1", "chest pain"), ("A01.2", "chest pressure"), ("B01.1", "broken bone"), ("C01.1", "zebra fever")], "code string, text string")
    p = coding.coded(notes, base, k=4, mode="off")
    assert p.where("note = 1").count() == 4 and p.where("note = 1 and rank = 1").first().supported
    kept = {r.code for r in coding.coded(notes, base, k=4).where("note = 1").collect()}
    assert {"A01.1", "B01.1"} <= kept and "C01.1" not in kept
    flagged = {r.code: r for r in coding.coded(notes, base, k=4, mode="flag").where("note = 1").collect()}
    assert flagged["C01.1"].supported is False and flagged["C01.1"].risk_flag == "weak_evidence"
    fewer = {r.code for r in coding.coded(notes, base, k=4, mode="off", contrast=True, legacy=True).where("note = 1").collect()}
    assert "A01.2" not in fewer and "A01.1" in fewer  # the family's runner-up is rejected


def test_dense_blocks_are_dealt_once_to_each_query_block(spark, monkeypatch):
    """Vectors of query and document blocks aren't joined; the k best of several tasks are merged."""
    import numpy as np

    rng = np.random.default_rng(4)
    t = spark.createDataFrame([(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(60)], "vec_id long, embedding array<float>").cache()
    whole = retrieval.dense_top_k(t, 5)
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    want = {tuple(r) for r in whole.collect()}
    monkeypatch.setattr(retrieval, "MEET", 1)
    got = retrieval.dense_top_k(t, 5, queries=9, docs=7)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 300


def test_hybrid_pairs_are_not_shuffled(spark):
    """Texts and vectors meet by document; no pair of document and label goes through a shuffle."""
    from auditloom.queries.retrieval import hybrid_topk_all

    plan = hybrid_topk_all(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query" in plan and not re.search(r"hashpartitioning\(query#\d+L?, doc#", plan)


def test_mock_scores_meet_by_words(spark):
    """Every note with every label, counted by words where the note lies; no Cartesian product of texts."""
    from auditloom.queries.scoring import mock_all

    d = "/root/testdata/sf0.001"
    got = mock_all(spark, d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    notes, labels = (spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("documents", "benchmark"))
    assert got.count() == got.select("item_id", "doc_id").distinct().count() == notes * labels
