"""Queries of structured scoring and of the reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import u32, words_longer_than
from ..operators import reports
from ..operators import retrieval as rt
from ..operators import scoring as sc
from ..sources import fixtures as fx
from ..sources.fixtures import with_
from .evaluation import counts
from .registry import query

_JS = """js as (select note, case note%5 when 0 then j when 1 then 'Here: ```json' || chr(10) || j || chr(10) || '```' when 2 then 'The answer is ' || j || ' as asked' when 3 then substr(j, 1, length(j)-6) else 'no answer' end j from (select note, '[' || string_agg('{"code":"' || code || '","supported":' || case when supported then 'true' else 'false' end || ',"confidence":"' || case when confidence is null then 'n/a' else '0.' || lpad((round(confidence*97)::int%100)::varchar,2,'0') end || '","q":"x ' || code || '"}', ',' order by "rank") || ']' j from pred_a group by note))"""


def answers(spark, d):
    """Scorer answers of run a as JSON text, damaged in four ways by note."""
    c = F.when(F.col("confidence").isNull(), F.lit("n/a")).otherwise(F.concat(F.lit("0."), F.lpad((F.round(F.col("confidence") * 97).cast("int") % 100).cast("string"), 2, "0")))
    one = F.concat(F.lit('{"code":"'), "code", F.lit('","supported":'), F.when(F.col("supported"), "true").otherwise("false"), F.lit(',"confidence":"'), c, F.lit('","q":"x '), "code", F.lit('"}'))
    g = fx.predictions(spark, d).groupBy("note").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("o")))).alias("x"))
    j = g.select("note", F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: v["o"]), ","), F.lit("]")).alias("j"))
    m = F.col("note") % 5
    return j.select("note", F.when(m == 0, F.col("j")).when(m == 1, F.concat(F.lit("Here: ```json\n"), "j", F.lit("\n```"))).when(m == 2, F.concat(F.lit("The answer is "), "j", F.lit(" as asked"))).when(m == 3, F.substr("j", F.lit(1), F.length("j") - 6)).otherwise(F.lit("no answer")).alias("j"))


def items(spark, d):
    return answers(spark, d).select("note", F.posexplode(sc.parse_items(F.col("j"))).alias("pos", "raw")).select("note", "pos", sc.coerce(F.col("raw")).alias("item"))


_ITEMS = _JS + """, whole as (select note, case note%5 when 0 then j when 1 then regexp_extract(j, '(?s)```(?:json)?\\s*(.*?)```', 1) when 2 then regexp_extract(j, '(?s)(\\[.*\\])', 1) when 3 then case when json_valid(regexp_extract(j, '(?s)(\\{.*\\})', 1)) and contains(j, '}') then '[' || regexp_extract(j, '(?s)(\\{.*\\})', 1) || ']' end end k from js),
 it as (select note, i::int pos, json_extract(k, '$[' || i || ']') o from whole, range(64) r(i) where k is not null and i < json_array_length(k))"""


@query("txt_json_scores", with_("pred_a", f"with {_ITEMS} select note, pos, o->>'code' code, (o->>'supported')='true' supported, case when try_cast(o->>'confidence' as double) is null then 0 else greatest(0,least(1,try_cast(o->>'confidence' as double))) end confidence, try_cast(o->>'confidence' as double) is not null confidence_present, o->>'q' evidence_quote from it"))
def json_scores(spark, d):
    return items(spark, d).select("note", "pos", "item.code", "item.supported", "item.confidence", "item.confidence_present", "item.evidence_quote")


@query("txt_json_salvage", with_("pred_a", """select note, code, case when supported then 'true' else 'false' end supported from pred_a where note % 5 = 3 qualify "rank" < max("rank") over (partition by note)"""))
def json_salvage(spark, d):
    """Complete objects of the truncated answers, a stack machine. The cut goes through the last object of each, so all but the last code of a note come back."""
    cut = answers(spark, d).where("note % 5 = 3")
    return cut.select("note", F.explode(sc.salvage("j")).alias("o")).select("note", F.col("o")["code"].alias("code"), F.col("o")["supported"].alias("supported"))


@query("txt_json_stages", with_("pred_a", """select case note % 5 when 0 then 'whole' when 1 then 'whole' when 2 then 'list' when 3 then case n when 1 then 'none' when 2 then 'object' else 'salvage' end else 'none' end stage, count(*) answers, sum(case note % 5 when 3 then n - 1 when 4 then 0 else n end)::bigint items
 from (select note, count(*) n from pred_a group by note) group by 1"""))
def json_stages(spark, d):
    """The parser stage that reads each answer, and how many items it finds."""
    return sc.parse_answers(answers(spark, d), "j").groupBy("stage").agg(F.count("*").alias("answers"), F.sum(F.size("items")).cast("long").alias("items"))


@query("txt_schema_coerce", with_("pred_a", f"with {_ITEMS} select count(*) items, count(*) filter (o->>'code' is not null and o->>'supported' is not null and try_cast(o->>'confidence' as double) is not null) valid, count(*) filter (try_cast(o->>'confidence' as double) is null) no_confidence from it"))
def schema_coerce(spark, d):
    return items(spark, d).agg(F.count("*").alias("items"), F.count_if("item.schema_valid").alias("valid"), F.count_if(~F.col("item.confidence_present")).alias("no_confidence"))


@query("jn_align_scores", with_("pred_a gold", f"with {_ITEMS}, last as (select note, o->>'code' code, arg_max(o, pos) o from it group by 1, 2) select g.note, g.code, (o->>'supported')='true' supported, case when try_cast(o->>'confidence' as double) is null then 0 else greatest(0,least(1,try_cast(o->>'confidence' as double))) end confidence, coalesce(try_cast(o->>'confidence' as double) is not null, false) confidence_present from gold g left join last l on g.note=l.note and g.code=l.code"))
def align(spark, d):
    it = items(spark, d).select("note", F.col("item.code").alias("code"), "pos", "item")
    return sc.align(fx.gold(spark, d).select("note", "code"), it, ["note", "code"])


_RANK = 'row_number() over (partition by note order by (not coalesce(supported,false))::int, (confidence is null)::int, coalesce(-confidence,0), "rank")'


@query("rel_null_aware_rank", with_("pred_a", f"select note, code, ({_RANK})::int final_rank from pred_a"))
def rank(spark, d):
    return fx.predictions(spark, d).select("note", "code", sc.null_aware_rank().alias("final_rank"))


@query("rel_threshold_min_kept", with_("pred_a", 'with k as (select *, count(*) filter (confidence is null or confidence>=0.6) over (partition by note) n from pred_a) select note, code, "rank" from k where ((confidence is null or confidence>=0.6) and n>=2) or (n<2 and "rank"<=2)'))
def min_kept(spark, d):
    return sc.keep_threshold(fx.predictions(spark, d), 0.6, 2).select("note", "code", "rank")


def _scored(spark, d):
    """Run a with an evidence score of its own for each code."""
    return fx.predictions(spark, d).withColumn("evidence_score", (F.col("note") + 3 * F.col("rank")) % 10 / 10)


_ES = "(select *, (note + 3*\"rank\") % 10 / 10.0::double es from pred_a)"


@query("scr_constraint_filter", with_("pred_a", f"select note, code from {_ES} where es>=0.4 and coalesce(supported,false)"))
def c_filter(spark, d):
    return sc.constrain(_scored(spark, d), 0.4, score="evidence_score").select("note", "code")


@query("scr_constraint_flag", with_("pred_a", f"select note, code, case when es<0.4 or not coalesce(supported,false) then false else supported end supported, case when es<0.4 then 'weak_evidence' when not coalesce(supported,false) then 'ambiguous' else 'none' end risk_flag from {_ES}"))
def c_flag(spark, d):
    return sc.constrain(_scored(spark, d), 0.4, "flag", score="evidence_score").select("note", "code", "supported", "risk_flag")


_BORDER = "bl as (select note, family, code best, runner_up from (select note, substr(code,1,3) family, code, confidence, row_number() over w r, lead(code) over w runner_up, lead(confidence) over w c2 from pred_a window w as (partition by note, substr(code,1,3) order by confidence desc nulls last, code)) where r=1 and confidence is not null and c2 is not null and round(confidence-c2,9)<=0.2)"


@query("scr_borderline_family", with_("pred_a", f"with {_BORDER} select * from bl"))
def border(spark, d):
    return sc.borderline(fx.predictions(spark, d))


@query("scr_drop_rejected", with_("pred_a", f"with {_BORDER} select note, code from pred_a p where not exists (select 1 from bl where bl.note=p.note and bl.runner_up=p.code)"))
def rejected(spark, d):
    p = fx.predictions(spark, d)
    return sc.drop_rejected(p, sc.borderline(p).select("note", F.col("runner_up").alias("rejected"))).select("note", "code")


@query("scr_fallback_pool", with_("kb pred_a pred_b", """with best as (select note, code from pred_a where "rank"=1), src as (select p.note, p.code, 0 src, p."rank" ord from pred_a p join best b on p.note=b.note and substr(p.code,1,3)=substr(b.code,1,3) union all select b.note, k.code, 1, 0 from best b join kb k on k.parent=substr(b.code,1,3) and k.code<>b.code union all select note, code, 2, "rank" from pred_b),
 once as (select note, code, min((src, ord)) place from src group by 1,2) select o.note, o.code, (row_number() over (partition by o.note order by place, o.code))::int pool_rank from once o anti join best b on o.note=b.note and o.code=b.code qualify pool_rank<=3"""))
def pool(spark, d):
    a, b = fx.predictions(spark, d), fx.predictions(spark, d, "b")
    best = a.where("rank = 1").select("note", "code")
    fam = a.select("note", "code", F.col("rank").alias("order"), F.substring("code", 1, 3).alias("f")).join(best.select("note", F.substring("code", 1, 3).alias("f")), ["note", "f"])
    sib = fx.knowledge_base(spark, d).select(F.col("code").alias("own"), F.explode("siblings").alias("code"))
    kin = best.select("note", F.col("code").alias("own")).join(sib, "own").select("note", "code", F.lit(0).alias("order"))
    return sc.fallback_pool(best, [fam, kin, b.select("note", "code", F.col("rank").alias("order"))])


@query("scr_fallback_sources", with_("kb pred_a pred_b", """with best as (select note, code, substr(code,1,3) f from pred_a where "rank"=1), a as (select p.*, b.f, b.code own from pred_a p join best b using (note)),
 src as (select note, code, 0 s, "rank" o from a where substr(code,1,3)=f union all select note, code, 1, "rank" from a where substr(code,1,3)=f union all select b.note, k.code, 2, row_number() over (partition by b.note order by k.code) from best b join kb k on k.parent=b.f
 union all select note, code, 3, "rank" from pred_b union all select note, code, 4, row_number() over (partition by note order by coalesce(confidence,0) desc, code) from a),
 once as (select note, code, min((s, o)) place from src group by 1, 2) select o.note, o.code, (row_number() over (partition by o.note order by place, o.code))::int pool_rank from once o anti join best b on o.note=b.note and o.code=b.code qualify pool_rank<=8"""))
def pool_of_five(spark, d):
    """All five sources in their order: same parent, same prefix, siblings of the label base, the group's other candidates, best retrieval scores."""
    a, b = fx.predictions(spark, d), fx.predictions(spark, d, "b")
    best = a.where("rank = 1").select("note", "code", F.substring("code", 1, 3).alias("f"))
    kin = fx.knowledge_base(spark, d).select(F.col("parent").alias("f"), F.col("code").alias("sibling"))
    own = a.withColumn("f", F.substring("code", 1, 3))
    sources = [own.join(best.select("note", "f"), ["note", "f"]).withColumnRenamed("rank", "order")] * 2
    sib = best.join(kin, "f").select("note", F.col("sibling").alias("code"), F.row_number().over(Window.partitionBy("note").orderBy("sibling")).alias("order"))
    high = a.select("note", "code", F.row_number().over(Window.partitionBy("note").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "code")).alias("order"))
    return sc.fallback_pool(best, [*sources, sib, b.withColumnRenamed("rank", "order"), high], most=8)


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: length(x) > 2))"


@query("scr_mock_scores", f"""with p as (select b.item_id, d.doc_id, {_WORDS.format('b.text')} h, {_WORDS.format('d.text')} n from benchmark b, documents d where d.doc_id % 20 = 0), o as (select item_id, doc_id, case when len(h)>0 then len(list_intersect(h,n))/len(h) else 0 end o from p)
 select item_id, doc_id, round(least(0.95, 0.35+0.8*o),3) confidence, o>=0.15 supported from o""")
def mock(spark, d):
    """The notes with ids divisible by 20 with every label."""
    return _mock(spark, d, fx.table(spark, d, "documents").where("doc_id % 20 = 0"))


@query("scr_mock_scores_all")
def mock_all(spark, d):
    """Every note with every label; ``scr_mock_scores`` and its SQL take the notes with ids divisible by 20. Words are found once a text, not once a pair."""
    return _mock(spark, d, fx.table(spark, d, "documents"))


def _mock(spark, d, documents):
    """The labels' words are broadcast and met by the notes' words; a note's pairs are counted in its task, and the empty word, which no text has, pairs it with every label."""
    of = lambda t: F.coalesce(words_longer_than(F.col(t)), F.array().cast("array<string>"))
    plus = lambda t: F.explode(F.concat(of(t), F.array(F.lit("")))).alias("word")
    b = fx.table(spark, d, "benchmark").select("item_id", "text", F.monotonically_increasing_id().alias("_i")).select("item_id", "_i", F.size(of("text")).alias("_n"), plus("text"))
    b = F.broadcast(b) if fx.table(spark, d, "benchmark").limit(10_001).count() <= 10_000 else b
    n = rt.dealt(documents.select("doc_id", "text"), "doc_id", tasks=fx.tasks_for(documents, rt.TASK_ROWS)).select("doc_id", "text", F.monotonically_increasing_id().alias("_d")).select("doc_id", "_d", plus("text"))
    met = n.join(b, "word").groupBy("doc_id", "_d", "item_id", "_i", "_n").agg(F.count_if(F.col("word") != "").alias("_h"))  # keeps the dealing by note
    c, s = sc.mock_score_of(F.when(F.col("_n") > 0, F.col("_h") / F.col("_n")).otherwise(0.0))
    return met.select("item_id", "doc_id", c.alias("confidence"), s.alias("supported"))


@query("scr_assemble", with_("pred_a", "select note, string_agg(code, ',' order by \"rank\") codes, max(confidence) confidence, count(*) filter (coalesce(confidence<0.4,false) or not coalesce(supported,false)) flagged, coalesce('because of ' || arg_min(code, \"rank\") filter (\"rank\" % 3 = 0), '') rationale from pred_a group by note"))
def assemble(spark, d):
    p = sc.constrain(fx.predictions(spark, d), 0.4, "flag").withColumn("rationale", F.when(F.col("rank") % 3 == 0, F.concat(F.lit("because of "), "code")).otherwise(" "))
    n = p.groupBy("note").agg(F.count_if(F.col("risk_flag") != "none").alias("flagged"))
    return sc.assemble(p).join(n, "note").select("note", F.array_join("codes", ",").alias("codes"), "confidence", "flagged", "rationale")


@query("rg_guard", with_("counts_a counts_b", "select run, n, f1, n < 1000 too_few, abs(f1-8/19.0::double) <= 1e-9 sentinel, case when n < 1000 or abs(f1-8/19.0::double) <= 1e-9 then 'reject' else 'pass' end verdict from (select 'a' run, count(*) n, round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),9) f1 from counts_a union all select 'small', count(*), round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),9) from counts_b where note % 50 = 1)"))
def guard(spark, d):
    """Provenance: runs of fewer than 1000 notes or with the score of the smoke fixture are rejected."""
    from ..functions.columns import f1

    one = lambda r, c: c.agg(F.count("*").alias("n"), F.round(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), 9).alias("f1")).withColumn("run", F.lit(r))
    t = one("a", counts(spark, d)).unionByName(one("small", counts(spark, d, "b").where("note % 50 = 1")))
    few, sentinel = F.col("n") < 1000, F.abs(F.col("f1") - 8 / 19) <= 1e-9
    return t.select("run", "n", "f1", few.alias("too_few"), sentinel.alias("sentinel"), F.when(few | sentinel, "reject").otherwise("pass").alias("verdict"))


_KEYS = {"subject_id": "note%10<>1", "hadm_id": "true", "experiment_id": "true", "seed": "note%10<>2", "gold_codes": "true", "runtime_sec": "note%10<>3", "config_hash": "note%10<>4"}
_CODE_KEYS = {"code": "true", "confidence": "\"rank\"%5<>1", "supported": "true", "evidence_score": "true", "icd_description": "\"rank\"%5<>2", "rationale": "true", "risk_flag": "\"rank\"%5<>3"}


def stored(spark, d):
    """(run, json): run a as stored records of nine experiments, with keys left out of some."""
    pair = lambda k, v, on: F.when(F.expr(on.replace('"', "`")), F.concat(F.lit(f'"{k}":'), v))
    obj = lambda *p: F.concat(F.lit("{"), F.array_join(F.array(*p), ","), F.lit("}"))
    p = fx.predictions(spark, d)
    values = {"code": F.concat(F.lit('"'), "code", F.lit('"')), "confidence": F.coalesce(F.col("confidence").cast("string"), F.lit("null"))}
    extra = pair("evidence_quote", F.when(F.col("rank") % 4 == 0, F.lit('""')).otherwise(F.lit('"q"')), "true")
    contrast = [pair(k, F.lit("null"), "`rank` % 3 <> 1") for k in reports.CONTRASTIVE_FIELDS]
    one = obj(*(pair(k, values.get(k, F.lit("null")), on) for k, on in _CODE_KEYS.items()), extra, *contrast)
    g = p.groupBy("note").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("o")))), lambda x: x["o"]), ",").alias("codes"))
    codes = F.when(F.col("note") % 10 == 5, F.lit('"none"')).otherwise(F.concat(F.lit("["), "codes", F.lit("]")))
    run = F.concat(F.lit("E"), (F.col("note") % 9 + 9).cast("string"), F.lit("_seed42"))
    return g.select(run.alias("run"), obj(*(pair(k, F.lit("1"), on) for k, on in _KEYS.items()), pair("predicted_codes", codes, "note % 10 <> 6")).alias("json"))


def _violations_sql():
    own = " union all ".join(f"select e, '{k}' field, not ({on}) bad from r" for k, on in _KEYS.items())
    code = " union all ".join(f"select e, '{k}', not ({on}) from c" for k, on in _CODE_KEYS.items())
    contrast = " union all ".join(f"select e, '{k}', \"rank\"%3=1 from c where e in ('E13','E14')" for k in reports.CONTRASTIVE_FIELDS)
    return f"""with r as (select distinct note, 'E' || (note%9+9) e from pred_a), c as (select *, 'E' || (note%9+9) e from pred_a where note%10 not in (5,6)),
 v as ({own} union all select e, 'predicted_codes', note%10=6 from r union all select e, 'predicted_codes is a list', note%10=5 from r union all {code} union all select e, 'evidence_preview/evidence_quote', "rank"%4=0 from c union all {contrast})
 select e experiment, field, count(*) filter (bad) violations, count(*) checked from v group by 1, 2"""


@query("rg_schema_violations", with_("pred_a", _violations_sql()))
def violations(spark, d):
    return reports.schema_violations(stored(spark, d))


_CLAIMS = [("micro_f1", 0.6846, 4), ("micro_f1", 1.0, 0), ("codes_per_note", 9.99, 2), ("notes", 1500.0, 0), ("notes", 1.0, 0), ("absent", 1.0, 1)]
_CLAIMED = ", ".join(f"('{m}', {v}::double, {k})" for m, v, k in _CLAIMS)


@query("rg_number_check", with_("counts_a", f"""with m as (select 'micro_f1' metric, round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),9) v from counts_a union all select 'codes_per_note', round(sum(tp+fp)/count(*),9) from counts_a union all select 'notes', count(*) from counts_a)
 select metric, stated, decimals, coalesce(abs(round(v*pow(10,decimals),0)/pow(10,decimals)-stated) < 0.1/pow(10,decimals) or abs(round_even(v*pow(10,decimals),0)/pow(10,decimals)-stated) < 0.1/pow(10,decimals), false) ok from (values {_CLAIMED}) c(metric, stated, decimals) left join m using (metric)"""))
def number_check(spark, d):
    """Stated numbers against metrics at the stated decimals, however many, rounded half up or half even."""
    c = counts(spark, d)
    tp, fp, fn, n = F.sum("tp"), F.sum("fp"), F.sum("fn"), F.count("*")
    m = c.agg(F.round(2 * tp / (2 * tp + fp + fn), 9).alias("micro_f1"), F.round((tp + fp) / n, 9).alias("codes_per_note"), n.cast("double").alias("notes")).unpivot([], ["micro_f1", "codes_per_note", "notes"], "metric", "v")
    claims = spark.createDataFrame(_CLAIMS, "metric string, stated double, decimals int")
    return claims.join(m, "metric", "left").select("metric", "stated", "decimals", reports.holds(F.col("v"), F.col("stated"), F.col("decimals")).alias("ok"))


@query("rg_mean_std_table", with_("counts_a counts_b", """with v as (select 'a' run, note%3 seed, round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),6) v from counts_a group by all union all select 'b', 0, round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),6) from counts_b union all select 'c', 0, null)
 select run, case when avg(v) is null then '—' when count(v)>1 then printf('%.4f ± %.4f', round(avg(v),6), round(stddev_samp(v),6)) else printf('%.4f', round(avg(v),6)) end cell from v group by run"""))
def mean_std(spark, d):
    """Runs of three seeds, of one, and without a value."""
    from ..operators import evaluation as ev

    a = counts(spark, d).groupBy((F.col("note") % 3).alias("seed")).agg(ev.micro(None)[2].alias("value")).select(F.lit("a").alias("run"), "value")
    b = counts(spark, d, "b").agg(ev.micro(None)[2].alias("value")).select(F.lit("b").alias("run"), "value")
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run string")
    stats = ev.seed_stats(a.unionByName(b).withColumn("metric", F.lit("micro_f1")))
    return runs.join(stats, "run", "left").select("run", reports.cell(F.col("mean"), F.col("std"), F.col("n")).alias("cell"))


@query("rg_pivot_table", with_("counts_a counts_b", "with c as (select 'a' run, * from counts_a union all select 'b', * from counts_b) select note % 5 grp, printf('%.4f', max(f) filter (run='a')) a, printf('%.4f', max(f) filter (run='b')) b from (select note % 5 note, run, round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),4) f from c group by all) group by note"))
def pivot(spark, d):
    from ..functions.columns import f1

    one = lambda r: counts(spark, d, r).withColumn("run", F.lit(r))
    c = one("a").unionByName(one("b"))
    p = c.groupBy((F.col("note") % 5).alias("grp")).pivot("run", ["a", "b"]).agg(F.round(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), 4))
    return p.select("grp", F.format_string("%.4f", "a").alias("a"), F.format_string("%.4f", "b").alias("b"))


@query("rg_job_manifest", "select 'E' || e || '_seed' || s || '_top' || n job, e, s seed, n top_n from range(1,19) t(e), (values (42),(52),(62)) u(s), (values (50),(100),(200)) v(n) where not (e=18 and n=50)")
def manifest(spark, d):
    """Experiments by seeds by label sets; experiment 18 is the one without the smallest set."""
    e = spark.range(1, 19).withColumnRenamed("id", "e").select("e", F.explode(F.array(*map(F.lit, (42, 52, 62)))).alias("seed")).select("e", "seed", F.explode(F.array(*map(F.lit, (50, 100, 200)))).alias("top_n"))
    return e.where(~((F.col("e") == 18) & (F.col("top_n") == 50))).select(F.concat(F.lit("E"), "e", F.lit("_seed"), "seed", F.lit("_top"), "top_n").alias("job"), "e", "seed", "top_n")
