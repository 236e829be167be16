"""Readers, sinks and the streaming runner on small files."""

import json

import random

import pytest
from pyspark.sql import functions as F

from auditloom.sources import readers, sinks
from auditloom.streaming import runner


def test_csv_with_line_breaks_and_missing_columns(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text('subject_id,hadm_id,text,other\n1,2,"a ""b""\nc",x\n3,4,,y\n')
    rows = readers.csv(spark, str(p), readers.NOTES).collect()
    assert rows[0].text == 'a "b"\nc' and rows[1].text is None
    with pytest.raises(readers.MissingColumns):
        readers.csv(spark, str(p), readers.DIAGNOSES)


def test_corpus_orders_codes(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("subject_id,hadm_id,seq_num,icd_code,icd_version\n1,2,2,B,10\n1,2,1,A,10\n1,2,x,C,10\n1,2,0,Z,9\n")
    notes = spark.createDataFrame([("1", "2", "t"), ("9", "9", "u")], "subject_id string, hadm_id string, text string")
    r = readers.corpus(notes, readers.diagnoses(spark, str(p))).collect()
    assert [x.gold_codes for x in r] == [["A", "B", "C"]]


def test_json_lines_strict_and_tolerant(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2\n{"a": 3}\n')
    good, bad = readers.json_lines_tolerant(spark, str(p), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 3] and len(bad.collect()) == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(p), "a int").collect()


def test_latest_success(spark):
    d = spark.createDataFrame([("success", 1, "a", 0), ("success", 1, "b", 1), ("failed", 2, "c", 2), ("success", None, "d", 3)], "status string, global_sample_index long, v string, o int")
    assert [r.v for r in readers.latest_success(d, "o").collect()] == ["b"]
    assert sorted(r.v for r in readers.latest_success(d, "o", fallback=True).collect()) == ["d"]  # one index so far, so d has index 1 too


def test_fallback_index_counts_what_came_before(spark):
    rng = random.Random(2)
    rows = [("success" if rng.random() < 0.8 else "failed", rng.choice([None, rng.randrange(12)]), r, o) for o in range(120) for r in "xy"]
    d = spark.createDataFrame(rows, "status string, global_sample_index long, run string, o long").repartition(5)
    want = {}
    for status, i, r, o in rows:
        kept = want.setdefault(r, {})
        if status == "success":
            kept[i if i is not None else len(kept)] = o
    got = {}
    for x in readers.latest_success(d, "o", fallback=True, run="run").collect():
        got.setdefault(x.run, {})[x.global_sample_index] = x.o
    assert got == want
    one = readers.latest_success(d.where("run = 'x'"), "o", fallback=True).collect()
    assert {x.global_sample_index: x.o for x in one} == want["x"]


def test_score_matrix_and_probe(spark, tmp_path):
    p = tmp_path / "m.md"
    p.write_text("| s | src | " + " | ".join("YN?–-YYYYY") + " |\n| bad | row |\n|---|---|\n")
    r = readers.score_matrix(spark, str(p)).collect()
    assert len(r) == 1 and r[0].study == "s" and len(r[0].scores) == 10
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n')
    assert readers.probe(spark, str(tmp_path / "x.jsonl"), "a int").first().a == 1


def test_catalogue_and_sinks(spark, tmp_path):
    for run in ("E1_seed42", "E1_seed52"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "test_predictions.jsonl").write_text(json.dumps({"status": "success", "global_sample_index": 1}) + "\n")
    assert sorted(r.run for r in readers.run_catalogue(spark, str(tmp_path), "test").collect()) == ["E1_seed42", "E1_seed52"]
    d = spark.createDataFrame([("a", None), ("b", 1)], "k string, v int")
    assert "—" in sinks.report_table(d) and "\\hline" in sinks.report_table(d, "latex")
    sinks.split_folders(d.withColumn("split", F.col("k")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'a'").count() == 1


def test_stream_resumes_and_stops(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "1.json").write_text("".join(json.dumps({"global_sample_index": i}) + "\n" for i in range(20)))
    go = lambda f: runner.run(spark, src, "global_sample_index long", sink, ck, lambda b: b.withColumn("failed", f))
    go(F.lit(False))
    (tmp_path / "src" / "2.json").write_text("".join(json.dumps({"global_sample_index": i}) + "\n" for i in range(15, 40)))
    go(F.lit(False))
    assert spark.read.parquet(sink).count() == 40
    (tmp_path / "src" / "3.json").write_text("".join(json.dumps({"global_sample_index": i}) + "\n" for i in range(50, 70)))
    with pytest.raises(Exception, match="failed"):
        go(F.lit(True))
