"""Queries of the sources and sinks: tables are written in a stored format to the shared folder and read back through the reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as rt
from ..operators import scoring as sc
from ..scratch import Scratch
from ..sources import fixtures as fx
from ..sources import readers, sinks
from ..sources.fixtures import with_
from .registry import query
from .retrieval import _BASE, DIGITS, base, notes


def _folder(spark, name: str) -> str:
    return f"{Scratch(spark, name).root}/{name}"


def _csv(df, path: str) -> str:
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return path


#: Note texts with quotes, commas and line breaks.
_TEXT = """'"' || c_name || '", ' || chr(10) || c_mktsegment"""


@query("src_csv", f"select c_custkey::varchar subject_id, (c_custkey * 7)::varchar hadm_id, {_TEXT} \"text\" from customer")
def csv(spark, d):
    """Notes as CSV with quoted line breaks; further columns are dropped, required ones checked."""
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), (F.col("c_custkey") * 7).alias("hadm_id"), F.expr(_TEXT).alias("text"), F.lit("x").alias("other"))
    return readers.csv(spark, _csv(c, _folder(spark, "csv")), readers.NOTES)


@query("src_corpus", with_("gold", """with c as (select note, subject, code, case when note % 5 = 0 then null else row_number() over (partition by note order by code desc) end seq from gold where note % 3 <> 0)
 select subject::varchar subject_id, note::varchar hadm_id, 'note ' || note "text", string_agg(code, ',' order by seq nulls last, code) codes from c group by subject, note"""))
def corpus(spark, d):
    """Notes and codes of two versions as CSV; numbers that don't parse are missing and come last, notes without codes go."""
    from pyspark.sql import Window

    g = fx.gold(spark, d)
    seq = F.row_number().over(Window.partitionBy("note").orderBy(F.desc("code"))).cast("string")
    ten = g.where("note % 3 <> 0").select(F.col("subject").alias("subject_id"), F.col("note").alias("hadm_id"), F.when(F.col("note") % 5 == 0, "n/a").otherwise(seq).alias("seq_num"), F.col("code").alias("icd_code"), F.lit("10").alias("icd_version"))
    nine = g.select(F.col("subject").alias("subject_id"), F.col("note").alias("hadm_id"), F.lit("1").alias("seq_num"), F.lit("OLD").alias("icd_code"), F.lit("9").alias("icd_version"))
    texts = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.concat(F.lit("note "), "o_orderkey").alias("text"))
    n = readers.csv(spark, _csv(texts, _folder(spark, "notes")), readers.NOTES)
    c = readers.diagnoses(spark, _csv(ten.unionByName(nine), _folder(spark, "diagnoses")))
    return readers.corpus(n, c, fx.tasks_for(fx.table(spark, d, "lineitem"))).select("subject_id", "hadm_id", "text", F.array_join("gold_codes", ",").alias("codes"))


@query("src_json_lines", "select event_id, event_type, value from events")
def json_lines(spark, d):
    """Records as JSON lines, some files blank lines, read strictly; the sink of the same name writes them in two goes."""
    e, path = fx.table(spark, d, "events").select("event_id", "event_type", "value"), _folder(spark, "lines")
    sinks.json_lines(e.where("event_id % 2 = 0"), path)
    sinks.json_lines(e.where("event_id % 2 = 1"), path, append=True)
    spark.range(3).select(F.lit("  ").alias("value")).write.mode("append").text(path)
    return readers.json_lines(spark, path, "event_id long, event_type string, value double")


@query("src_json_damaged", "select event_type, count(*) filter (event_id % 11 <> 0) good, count(*) filter (event_id % 11 = 0) damaged from events group by 1")
def json_damaged(spark, d):
    """JSON lines of which every eleventh is cut off: the good ones are read, the damaged ones counted."""
    e, path = fx.table(spark, d, "events"), _folder(spark, "damaged")
    line = F.to_json(F.struct("event_type", "event_id"))
    e.select(F.when(F.col("event_id") % 11 == 0, F.regexp_replace(line, ",.*", "")).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.json_lines_tolerant(spark, path, "event_id long, event_type string")
    kinds = good.select("event_type", F.lit(1).alias("g")).unionByName(bad.select(F.regexp_extract("_corrupt_record", '"event_type":"([^"]*)"', 1).alias("event_type"), F.lit(0).alias("g")))
    return kinds.groupBy("event_type").agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("damaged"))


@query("src_probe", "select s_suppkey, s_nationkey from supplier")
def probe(spark, d):
    """A table asked for as JSON lines of which only the Parquet sibling is there."""
    path = _folder(spark, "probe")
    fx.table(spark, d, "supplier").select("s_suppkey", "s_nationkey").write.parquet(f"{path}.parquet")
    return readers.probe(spark, f"{path}.jsonl")


_CELL = "case when substr({t}, {i} + 1, 1) in ('a','e') then 'Y' when substr({t}, {i} + 1, 1) in (' ') then 'N' when substr({t}, {i} + 1, 1) = 't' then '?' else '–' end"


@query("src_score_matrix", "select item_id::varchar study, 'b' source, string_agg(" + _CELL.format(t="text", i="i") + ", '' order by i) scores from benchmark, range(10) t(i) group by item_id")
def score_matrix(spark, d):
    """A Markdown table of scores between other lines; rows of other widths and heads aren't scores."""
    b, path = fx.table(spark, d, "benchmark"), _folder(spark, "matrix")
    cells = F.array_join(F.array(*(F.expr(_CELL.format(t="text", i=i)) for i in range(10))), " | ")
    rows = b.select(F.concat(F.lit("| "), F.col("item_id").cast("string"), F.lit(" | b | "), cells, F.lit(" |")).alias("value"))
    rest = b.select(F.explode(F.array(F.lit("# Scores"), F.lit("| study | source |"), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.lit(12))))).alias("value"))
    rows.unionByName(rest).write.text(path)
    return readers.score_matrix(spark, path).select("study", "source", F.array_join("scores", "").alias("scores"))


@query("src_run_catalogue", with_("pred_a", "select 'E1_seed' || note % 3 run, count(*) records from (select distinct note from pred_a) group by 1"))
def run_catalogue(spark, d):
    """Records of three runs in folders of their own, among files of another split."""
    r, path = fx.predictions(spark, d).select("note").distinct(), _folder(spark, "runs")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for k in range(3):
        for split in ("test", "validation"):
            one = r.where(F.col("note") % 3 == k).select(F.lit("success").alias("status"), F.col("note").alias("global_sample_index"))
            one.coalesce(1).write.json(f"{path}/tmp/{k}-{split}")  # a run's stored file is one file
            fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
            part = next(s.getPath() for s in fs.listStatus(hadoop(f"{path}/tmp/{k}-{split}")) if s.getPath().getName().startswith("part"))
            fs.mkdirs(hadoop(f"{path}/runs/E1_seed{k}"))
            fs.rename(part, hadoop(f"{path}/runs/E1_seed{k}/{split}_predictions.jsonl"))
    return readers.run_catalogue(spark, f"{path}/runs", "test").groupBy("run").agg(F.count("*").alias("records"))


@query("snk_split_folders", with_("splits", "select split, count(*) notes, count(distinct subject) subjects from splits group by 1"))
def split_folders(spark, d):
    """A table in a folder for each split, read back one folder at a time."""
    path = _folder(spark, "splits")
    sinks.split_folders(fx.splits(spark, d), path)
    out = None
    for s in ("train", "validation", "test"):
        one = spark.read.parquet(path).where(F.col("split") == s).groupBy("split").agg(F.count("*").alias("notes"), F.countDistinct("subject").alias("subjects"))
        out = one if out is None else out.unionByName(one)
    return out


@query("rel_score_threshold", f"with {_BASE} select query, doc, score from hit where score >= 2.5")
def score_threshold(spark, d):
    return rt.threshold(rt.bm25(notes(spark, d), base(spark, d), digits=DIGITS), 2.5)


@query("scr_zero_shot", with_("pred_a gold", """with a as (select note, code, "rank" r from pred_a where "rank" <= 4 union all select note, code, 9 from pred_a where "rank" = 1), s as (select distinct code from gold where note % 2 = 0), f as (select note, code, min(r) r from a where code in (from s) group by 1, 2)
 select note, code, 0.8::double confidence, true supported, (row_number() over (partition by note order by r))::int "rank" from f"""))
def zero_shot(spark, d):
    """A model's list of codes, the first of which comes twice: known labels only, each at its first mention."""
    p = fx.predictions(spark, d).where("rank <= 4")
    item = F.concat(F.lit('{"code":"'), "code", F.lit('"}'))
    said = p.unionByName(p.where("rank = 1").withColumn("rank", F.lit(9))).groupBy("note").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("i")))).alias("x"))
    answers = said.select("note", F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: v["i"]), ","), F.lit("]")).alias("text"))
    return sc.zero_shot(answers, "text", fx.gold(spark, d).where("note % 2 = 0"))


@query("txt_config_hash", "select c_custkey, substr(md5('{\"a\": ' || c_nationkey || ', \"segment\": \"' || c_mktsegment || '\", \"z\": [1, 2]}'), 1, 8) config_hash from customer")
def config_hash(spark, d):
    """The short hash of a configuration: MD5 of its JSON with sorted keys."""
    from ..functions.columns import config_hash as f

    c = fx.table(spark, d, "customer")
    return c.select("c_custkey", f({"z": F.lit("[1, 2]"), "a": F.col("c_nationkey").cast("string"), "segment": F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))}).alias("config_hash"))
