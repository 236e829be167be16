"""Queries of the evaluation layer (run a against gold unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import statistics as st
from ..sources import fixtures as fx
from ..sources.fixtures import with_
from .registry import query


def facts(spark, d, run="a"):
    return fx.facts(spark, d, run)


def counts(spark, d, run="a"):
    return ev.counts(facts(spark, d, run), fx.notes(spark, d))


_PER = "per as (select l.code, count(*) filter (in_gold and in_pred) tp, count(*) filter (in_pred and not in_gold) fp, count(*) filter (in_gold and not in_pred) fn from (select distinct code from labels) l left join facts_a f on f.code = l.code group by l.code)"


@query("ag_micro_macro", with_("labels facts_a", f"""with {_PER}
select round(sum(tp)/sum(tp+fp),6) micro_p, round(sum(tp)/sum(tp+fn),6) micro_r, round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),6) micro_f1,
 round(avg(case when tp+fp>0 then tp/(tp+fp) else 0 end),6) macro_p, round(avg(case when tp+fn>0 then tp/(tp+fn) else 0 end),6) macro_r,
 round(avg(case when tp+fp+fn>0 then 2*tp/(2*tp+fp+fn) else 0 end),6) macro_f1, count(*) labels from per"""))
def micro_macro(spark, d):
    return ev.micro_macro(facts(spark, d), fx.labels(spark, d))


@query("ag_hamming_exact_lrap", with_("labels counts_a", """with m as (select count(distinct code) m from labels)
select round((sum(fp+fn)/(count(*)*max(m)))::double,8) hamming, round(avg((fp=0 and fn=0)::int),6) exact_match,
 round(avg(case when tp+fn=0 or tp+fn=m then 1.0::double else (case when tp>0 then tp*tp/(tp+fp)::double else 0 end + fn*((tp+fn)/m::double))/(tp+fn) end),6) lrap, count(*) notes from counts_a, m"""))
def set_metrics(spark, d):
    m = fx.labels(spark, d).agg(F.countDistinct("code").alias("m"))
    return ev.set_metrics(counts(spark, d).crossJoin(F.broadcast(m)), F.col("m"))


@query("ag_label_coverage", with_("labels pred_a", "select (select count(distinct code) from pred_a)::bigint predicted, count(distinct code) labels, round((select count(distinct code) from pred_a)/count(distinct code),6) coverage from labels"))
def coverage(spark, d):
    p = fx.predictions(spark, d).agg(F.countDistinct("code").alias("predicted"))
    return fx.labels(spark, d).agg(F.countDistinct("code").alias("labels")).crossJoin(p).select("predicted", "labels", F.round(F.col("predicted") / F.col("labels"), 6).alias("coverage"))


_ATK = """select {outs} from (select n.note, count(*) filter (in_gold) g, {aggs} from notes n left join {f} f on f.note = n.note group by n.note)"""


def _atk(f, ks):
    aggs = ", ".join(f'count(*) filter ("rank" <= {k} and in_gold) h{k}, count(*) filter ("rank" <= {k}) e{k}' for k in ks)
    outs = ", ".join(f"round(avg(case when e{k}>0 then h{k}/e{k} else 0 end),6) p_at_{k}, round(avg(case when g>0 then h{k}/g end),6) r_at_{k}" for k in ks)
    return _ATK.format(f=f, aggs=aggs, outs=outs)


@query("ag_p_r_at_k", with_("notes facts_a", _atk("facts_a", [1, 3, 5, 10])))
def p_r_at_k(spark, d):
    return ev.at_k(facts(spark, d), fx.notes(spark, d), [1, 3, 5, 10])


_PARENTS = """pf as (select *, case when in_pred then row_number() over (partition by note order by best nulls last) end "rank" from (select note, upper(substr(replace(code,'.',''),1,3)) code, bool_or(in_gold) in_gold, bool_or(in_pred) in_pred, min("rank") best from facts_a group by 1, 2))"""


def _all(f, labels):
    """SQL of all classification metrics in one row over facts ``f`` and label query ``labels``."""
    return f"""u as ({labels}), un as (select count(*) m from u), inside as (select * from {f} where code in (from u)),
 per as (select u.code, count(*) filter (in_gold and in_pred) tp, count(*) filter (in_pred and not in_gold) fp, count(*) filter (in_gold and not in_pred) fn from u left join {f} f on f.code = u.code group by u.code),
 cn as (select n.note, count(*) filter (in_gold and in_pred) tp, count(*) filter (in_pred and not in_gold) fp, count(*) filter (in_gold and not in_pred) fn from notes n left join inside i on i.note = n.note group by n.note),
 a as (select coalesce(round(sum(tp)/nullif(sum(tp+fp),0),6),0) micro_p, coalesce(round(sum(tp)/nullif(sum(tp+fn),0),6),0) micro_r, coalesce(round(2*sum(tp)/nullif(2*sum(tp)+sum(fp)+sum(fn),0),6),0) micro_f1,
  round(avg(case when tp+fp>0 then tp/(tp+fp) else 0 end),6) macro_p, round(avg(case when tp+fn>0 then tp/(tp+fn) else 0 end),6) macro_r, round(avg(case when tp+fp+fn>0 then 2*tp/(2*tp+fp+fn) else 0 end),6) macro_f1, count(*) labels from per),
 b as (select round((sum(fp+fn)/(count(*)*max(m)))::double,8) hamming, round(avg((fp=0 and fn=0)::int),6) exact_match, round(avg(case when tp+fn=0 or tp+fn=m then 1.0::double else (case when tp>0 then tp*tp/(tp+fp)::double else 0 end + fn*((tp+fn)/m::double))/(tp+fn) end),6) lrap, count(*) notes from cn, un),
 c as ({_atk(f, [5, 10])}), e as (select round(count(distinct code)/(select m from un),6) label_coverage from inside where in_pred)
 select * from a, b, c, e"""


@query("ag_classification", with_("notes labels facts_a", "with " + _all("facts_a", "select distinct code from labels")))
def classification(spark, d):
    return ev.classification(facts(spark, d), fx.notes(spark, d), fx.labels(spark, d))


@query("ag_classification_empty", "select 0.0::double micro_p, 0.0::double micro_r, 0.0::double micro_f1, 0.0::double macro_p, 0.0::double macro_r, 0.0::double macro_f1, 1.0::double hamming, 0.0::double exact_match, 0.0::double lrap, 0.0::double p_at_5, 0.0::double r_at_5, 0.0::double p_at_10, 0.0::double r_at_10, 0.0::double label_coverage, 0::bigint notes, 0::bigint labels")
def classification_empty(spark, d):
    return ev.classification(facts(spark, d).where("false"), fx.notes(spark, d).where("false"))


@query("ag_parent_classification", with_("notes facts_a", f"with {_PARENTS}, " + _all("pf", "select distinct code from pf")))
def parent_classification(spark, d):
    """Every classification metric one level up; the labels are the categories of either side."""
    return ev.classification(ev.to_parents(facts(spark, d)), fx.notes(spark, d))


@query("ag_parent_metrics", with_("facts_a", f"with {_PARENTS} select round(2*tp/(2*tp+fp+fn),6) parent_micro_f1, tp, fp, fn from (select count(*) filter (in_gold and in_pred) tp, count(*) filter (in_pred and not in_gold) fp, count(*) filter (in_gold and not in_pred) fn from pf)"))
def parent_metrics(spark, d):
    p = ev.to_parents(facts(spark, d))
    c = p.agg(F.count_if(F.expr("in_gold and in_pred")).alias("tp"), F.count_if(F.expr("in_pred and not in_gold")).alias("fp"), F.count_if(F.expr("in_gold and not in_pred")).alias("fn"))
    return c.select(F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("parent_micro_f1"), "tp", "fp", "fn")


@query("ag_parent_p_r_at_k", with_("notes facts_a", f"with {_PARENTS} " + _atk("pf", [1, 3])))
def parent_at_k(spark, d):
    return ev.at_k(ev.to_parents(facts(spark, d)), fx.notes(spark, d), [1, 3])


@query("ag_hier_error", with_("facts_a", """with w as (select f.*, bool_or(in_gold) over (partition by note, substr(code,1,3)) near from facts_a f)
select count(*) wrong, count(*) filter (near) near, round(count(*) filter (near)/count(*),6) hierarchical_error_rate from w where in_pred and not in_gold"""))
def hier(spark, d):
    return ev.hierarchical_error(facts(spark, d))


_RISK = {"weak_evidence_rate": "risk_flag='weak_evidence'", "ambiguous_code_rate": "risk_flag='ambiguous'", "hallucination_flag_rate": "risk_flag='possible_hallucination'"}
_SHARES = _RISK | {
    "rationale_coverage_rate": "rationale<>''", "evidence_quote_rate": "evidence_quote<>'' or evidence_preview<>''", "contrastive_rationale_rate": "contrastive_rationale<>''", "rejected_similar_codes_rate": "n_rejected>0",
    "contrastive_fallback_rate": "fallback", "llm_contrastive_rate": "not fallback and (n_rejected>0 or contrastive_rationale<>'')", "schema_invalid_rate": "not schema_valid", "json_parse_error_rate": "json_parse_error", "confidence_missing_rate": "confidence is null",
}
_JUDGED = "count(*) total_predicted_codes, count(supported) evidence_judged_codes, round(count(*) filter (supported)/nullif(count(supported),0),6) evidence_support_rate, round(count(*) filter (not supported)/nullif(count(supported),0),6) unsupported_code_rate"


def _shares(shares):
    return ", ".join(f"round(count(*) filter ({v})/count(*),6) {k}" for k, v in shares.items())


@query("ag_reliability", with_("recs", f"""with v as (select *, case when not mock then coalesce(evidence_quote_verbatim, case when trim(evidence_quote)<>'' and trim(evidence_preview)<>'' then contains(lower(trim(regexp_replace(evidence_preview,'\\s+',' ','g'))), lower(trim(regexp_replace(evidence_quote,'\\s+',' ','g')))) end) end checked from recs)
 select {_JUDGED}, count(checked) evidence_quote_checked_codes, round(count(*) filter (checked)/nullif(count(checked),0),6) evidence_quote_verbatim_rate, {_shares(_SHARES)} from v"""))
def reliability(spark, d):
    return ev.reliability(fx.code_records(spark, d))


@query("ag_reliability_unjudged", with_("pred_c", f"select {_JUDGED}, 0::bigint evidence_quote_checked_codes, null::double evidence_quote_verbatim_rate, {_shares({k: 'confidence is null' if k == 'confidence_missing_rate' else 'false' for k in _SHARES})} from pred_c"))
def reliability_c(spark, d):
    """A run that makes no claim of evidence: only the share without confidence can be told."""
    return ev.reliability(fx.predictions(spark, d, "c"))


@query("ag_confusion_pairs", with_("facts_a", """select w.code pred, g.code gold, count(*) n from facts_a w join facts_a g on w.note=g.note and substr(w.code,1,3)=substr(g.code,1,3)
 where w.in_pred and not w.in_gold and g.in_gold group by 1,2"""))
def confusion(spark, d):
    return ev.confusion_pairs(facts(spark, d))


@query("ag_parent_matrix", with_("facts_a", f"""with {_PARENTS}, head as (select code from pf where in_gold group by code order by count(*) desc, code limit 20)
select g.code gold_parent, p.code pred_parent, count(*) n from pf g join pf p on g.note=p.note where g.in_gold and p.in_pred and g.code<>p.code and g.code in (from head) and p.code in (from head) group by 1,2 order by n desc, 1, 2 limit 20"""))
def parent_matrix(spark, d):
    return ev.parent_matrix(facts(spark, d))


@query("ag_lift", with_("counts_a", "select round(case when sum(st)>0 and sum(ut)>0 and sum(ug)>0 then (sum(sg)/sum(st))/(sum(ug)/sum(ut)) end,6) lift, sum(sg)::bigint sg, sum(st)::bigint st, sum(ug)::bigint ug, sum(ut)::bigint ut from counts_a"))
def lift(spark, d):
    return ev.lift(counts(spark, d))


_BANDS = """ord as (select code, row_number() over (order by count(*) desc, code)-1 pos from gold group by code), b as (select code, least(4, floor(pos/greatest(1, floor((select count(*) from ord)/5))))::int band from ord),
 s as (select band, count(*) filter (in_gold and in_pred) tp, count(*) filter (in_pred and not in_gold) fp, count(*) filter (in_gold and not in_pred) fn from {f} join b using (code) group by band)"""


@query("ag_bands", with_("facts_a", "with " + _BANDS.format(f="facts_a") + " select band, tp, fp, fn, round(case when 2*tp+fp+fn>0 then 2*tp/(2*tp+fp+fn) else 0 end,6) f1 from s"))
def bands(spark, d):
    return ev.bands(facts(spark, d), st.top_labels(fx.gold(spark, d)).select("code", "pos"))


@query("ag_band_gap", with_("facts_a facts_b", "with " + _BANDS.format(f="facts_a") + ", t as (select band, count(*) filter (in_gold and in_pred) tp, count(*) filter (in_pred and not in_gold) fp, count(*) filter (in_gold and not in_pred) fn from facts_b join b using (code) group by band) select s.band, round(2*s.tp/(2*s.tp+s.fp+s.fn),6) f1_a, round(2*t.tp/(2*t.tp+t.fp+t.fn),6) f1_b, round(round(2*s.tp/(2*s.tp+s.fp+s.fn),6)-round(2*t.tp/(2*t.tp+t.fp+t.fn),6),6) gap from s join t on s.band=t.band"))
def band_gap(spark, d):
    order = st.top_labels(fx.gold(spark, d)).select("code", "pos")
    a, b = (ev.bands(facts(spark, d, r), order).select("band", F.col("f1").alias(f"f1_{r}")) for r in "ab")
    return a.join(b, "band").withColumn("gap", F.round(F.col("f1_a") - F.col("f1_b"), 6))


@query("ag_seed_stats", with_("counts_a counts_b", """with v as (select 'a' run, 's'||(note%3) seed, 'classification.micro_f1' metric, round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),6) v from counts_a group by all union all select 'b', 's'||(note%3), 'classification.micro_f1', round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),6) from counts_b group by all)
 select run, metric, round(avg(v),6) mean, round(coalesce(stddev_samp(v),0),6) std, min(v) min, max(v) max, count(v) n from v group by run, metric"""))
def seed_stats(spark, d):
    def one(run):
        return counts(spark, d, run).groupBy(F.concat(F.lit("s"), F.col("note") % 3).alias("seed")).agg(ev.micro(None)[2].alias("value")).select(F.lit(run).alias("run"), F.lit("classification.micro_f1").alias("metric"), "value")

    return ev.seed_stats(one("a").unionByName(one("b")))


@query("ag_set_score", with_("counts_a", "select round(sum(tp)/sum(tp+fp),4) p, round(sum(tp)/sum(tp+fn),4) r, round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),4) f1, count(*) n, round(sum(tp+fp)/count(*),2) codes_per_note from counts_a"))
def set_score(spark, d):
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return counts(spark, d).agg(F.round(tp / (tp + fp), 4).alias("p"), F.round(tp / (tp + fn), 4).alias("r"), F.round(2 * tp / (2 * tp + fp + fn), 4).alias("f1"), F.count("*").alias("n"), F.round((tp + fp) / F.count("*"), 2).alias("codes_per_note"))


@query("ag_stage_recall", with_("counts_a counts_b", "select 'a' run, sum(tp)::bigint retained, sum(tp+fn)::bigint gold, round(sum(tp)/sum(tp+fn),6) retention from counts_a union all select 'b', sum(tp)::bigint, sum(tp+fn)::bigint, round(sum(tp)/sum(tp+fn),6) from counts_b"))
def stage_recall(spark, d):
    one = lambda r: counts(spark, d, r).agg(F.sum("tp").alias("retained"), F.sum(F.col("tp") + F.col("fn")).alias("gold")).select(F.lit(r).alias("run"), "retained", "gold", F.round(F.col("retained") / F.col("gold"), 6).alias("retention"))
    return one("a").unionByName(one("b"))


@query("ag_recall_ceiling", with_("gold", "select round(sum(least(g,3))/sum(g),6) ceiling, round(avg(g),6) gold_per_note, count(*) n from (select note, count(*) g from gold group by note)"))
def ceiling(spark, d):
    g = fx.gold(spark, d).groupBy("note").agg(F.count("*").alias("g"))
    return g.agg(F.round(F.sum(F.least("g", F.lit(3))) / F.sum("g"), 6).alias("ceiling"), F.round(F.avg("g"), 6).alias("gold_per_note"), F.count("*").alias("n"))


@query("ag_total_variation", with_("gold", """with h as (select code, count(*) filter (note%2=0) n, count(*) filter (note%2=1) m from gold group by code)
 select round(sum(abs(n/(select sum(n) from h)-m/(select sum(m) from h)))/2,6) total_variation from h"""))
def tv(spark, d):
    g = fx.gold(spark, d)
    return ev.total_variation(g.where("note % 2 = 0"), g.where("note % 2 = 1"))


@query("ag_representativeness", with_("gold", "select (note%2=0) half, list_sort(list(g))[(count(*)//2)+1] upper_median, round(avg(g),6) mean, count(*) notes from (select note, count(*) g from gold group by note) group by 1"))
def representativeness(spark, d):
    g = fx.gold(spark, d).groupBy("note").agg(F.count("*").alias("g")).withColumn("half", F.col("note") % 2 == 0)
    # The upper median from a histogram: group sizes have few distinct values, so nothing of the notes is gathered.
    h = g.groupBy("half", "g").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.partitionBy("half").orderBy("g"))
    total = F.sum("n").over(Window.partitionBy("half"))
    h = h.withColumn("upto", upto).withColumn("total", total)
    return h.groupBy("half").agg(F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("g"))).alias("upper_median"), F.round(F.sum(F.col("g") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.sum("n").alias("notes"))


@query("ag_label_protocol", with_("gold", """with a as (select code from gold where note%2=0 group by code order by count(*) desc, code limit 50), b as (select code from gold group by code order by count(*) desc, code limit 50)
 select (select count(*) from (from a except from b)) only_a, (select count(*) from (from b except from a)) only_b, case when (select count(*) from (from a except from b))=0 then 'same members' else 'different' end verdict"""))
def protocol(spark, d):
    g = fx.gold(spark, d)
    a, b = (st.top_labels(x).where("pos < 50").select("code") for x in (g.where("note % 2 = 0"), g))
    x = a.exceptAll(b).agg(F.count("*").alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))
    return x.withColumn("verdict", F.when((F.col("only_a") == 0) & (F.col("only_b") == 0), "same members").otherwise("different"))


@query("ag_prevalence", """with s as (select item_id, i, substr(text, i::int, 1) c from benchmark, range(1, 11) t(i)), v as (select i item, case when c in ('a','e') then 'Y' when c in (' ') then 'N' when c in ('t') then '?' else '–' end v from s)
 select item, count(*) filter (v='Y') y, count(*) filter (v='N') n, count(*) filter (v='?') unclear, count(*) filter (v='–') na, round(count(*) filter (v='Y')/nullif(count(*) filter (v in ('Y','N')),0),6) prevalence, round(case when count(*) filter (v='Y')=0 then 3/nullif(count(*) filter (v in ('Y','N')),0) end,6) rule_of_three from v group by item""")
def prevalence(spark, d):
    s = fx.table(spark, d, "benchmark").select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.substr("text", i, F.lit(1)))).alias("p", "c"))
    v = s.select((F.col("p") + 1).cast("long").alias("item"), F.when(F.col("c").isin("a", "e"), "Y").when(F.col("c") == " ", "N").when(F.col("c") == "t", "?").otherwise("–").alias("v"))
    y, n = F.count_if(F.col("v") == "Y"), F.count_if(F.col("v") == "N")
    return v.groupBy("item").agg(y.alias("y"), n.alias("n"), F.count_if(F.col("v") == "?").alias("unclear"), F.count_if(F.col("v") == "–").alias("na"), F.round(F.when(y + n > 0, y / (y + n)), 6).alias("prevalence"), F.round(F.when((y == 0) & (n > 0), 3 / (y + n)), 6).alias("rule_of_three"))


@query("ag_cost_p95", "select event_type, round(avg(value),6) avg_runtime, round(sum(value),4) total_runtime, round(quantile_cont(value,0.95),6) p95_runtime, max(value) peak from events group by event_type")
def cost(spark, d):
    e = fx.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg_runtime"), F.round(F.sum("value"), 4).alias("total_runtime"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95_runtime"), F.max("value").alias("peak"))


@query("ag_cost", with_("samples counts_a", """with s as (select s.*, c.tp correct from samples s join counts_a c using (note)) select count(*) n_samples, round(avg(runtime),6) avg_runtime_sec, round(sum(runtime),4) total_runtime_sec, round(quantile_cont(runtime,0.95),6) p95_runtime_sec,
 round(avg(ti),6) avg_input_tokens, sum(ti)::double total_input_tokens, round(avg(too),6) avg_output_tokens, sum(too)::double total_output_tokens, round(avg(gpu),6) avg_gpu_memory_mb, max(gpu) peak_gpu_memory_mb,
 round(sum(runtime)/sum(correct),6) runtime_per_correct_code, round((sum(ti)+sum(too))/sum(correct),6) tokens_per_correct_code from s"""))
def cost_all(spark, d):
    return ev.cost(fx.sample_records(spark, d).join(counts(spark, d).select("note", F.col("tp").alias("correct")), "note"))


@query("ag_error_rates", with_("samples recs", "select count(*) n, round(count(*) filter (failed)/count(*),6) failed_sample_rate, round(count(*) filter (oom)/count(*),6) cuda_oom_rate, round(count(*) filter (skipped)/count(*),6) skipped_rate, round((count(*)-count(*) filter (failed)-count(*) filter (skipped))/count(*),6) success_rate, round((select count(*) from recs where json_parse_error)/count(*),6) json_parse_error_rate from samples"))
def errors(spark, d):
    bad = fx.code_records(spark, d).agg(F.count_if("json_parse_error").alias("errors"))
    return ev.error_rates(fx.sample_records(spark, d), bad)


_GROUPS = {
    "classification": "with " + _all("facts_a", "select distinct code from labels"),
    "hierarchical": f"with {_PARENTS}, " + _all("pf", "select distinct code from pf"),
    "hierarchical_error": "with w as (select f.*, bool_or(in_gold) over (partition by note, substr(code,1,3)) near from facts_a f) select count(*) wrong, count(*) filter (near) near, round(count(*) filter (near)/count(*),6) hierarchical_error_rate from w where in_pred and not in_gold",
    "lift": "select round(case when sum(st)>0 and sum(ut)>0 and sum(ug)>0 then (sum(sg)/sum(st))/(sum(ug)/sum(ut)) end,6) lift, sum(sg) sg, sum(st) st, sum(ug) ug, sum(ut) ut from counts_a",
}
_LONG = " union all ".join(f"""select '{g}' "group", metric, value::double "value" from (unpivot (select columns(*)::double from ({sql})) on columns(*) into name metric value value)""" for g, sql in _GROUPS.items())


@query("ag_suite", with_("notes labels facts_a counts_a", _LONG))
def suite(spark, d):
    """The metrics of run a in one plan: classification, categories, near misses, lift. ``ag_suite_records`` adds what its records tell."""
    return ev.suite(facts(spark, d), fx.notes(spark, d), fx.labels(spark, d))


@query("ag_suite_records")
def suite_records(spark, d):
    return ev.suite(facts(spark, d), fx.notes(spark, d), fx.labels(spark, d), fx.code_records(spark, d), fx.sample_records(spark, d))


@query("ag_run_summary", "select user_id % 10 run, count(*) records, count(*) filter (event_type='error') failed, round(count(*) filter (event_type='error')/count(*),6) error_rate, round(avg(value) filter (event_type<>'error'),6) mean_runtime, min(event_id) first_id from events group by 1")
def run_summary(spark, d):
    e, bad = fx.table(spark, d, "events"), F.col("event_type") == "error"
    return e.groupBy((F.col("user_id") % 10).alias("run")).agg(F.count("*").alias("records"), F.count_if(bad).alias("failed"), F.round(F.count_if(bad) / F.count("*"), 6).alias("error_rate"), F.round(F.avg(F.when(~bad, F.col("value"))), 6).alias("mean_runtime"), F.min("event_id").alias("first_id"))


@query("ag_chance", "select n labels, k, least(1, k/n::double) chance from (values (50),(100),(200)) t(n), (values (3),(15),(60)) u(k)")
def chance(spark, d):
    n = spark.createDataFrame([(50,), (100,), (200,)], "labels int")
    return n.select("labels", F.explode(F.array(*map(F.lit, (3, 15, 60)))).alias("k")).withColumn("chance", F.least(F.lit(1.0), F.col("k") / F.col("labels")))


@query("ag_split_summary", with_("splits gold", "select split, count(distinct s.note) notes, count(distinct s.subject) subjects, count(distinct g.code) labels from splits s join gold g on s.note=g.note group by split"))
def split_summary(spark, d):
    """Three counts of distinct pairs; those of notes stay where the notes are."""
    x = fx.splits(spark, d).select("note", "split").join(fx.gold(spark, d), "note")
    n = fx.tasks_for(fx.table(spark, d, "orders"))
    one = lambda c, df: df.select("split", c).distinct().groupBy("split").agg(F.count(c).alias(f"{c}s"))
    notes, subjects, codes = one("note", x), one("subject", x.select("split", "subject", "note").dropDuplicates(["note", "split", "subject"]).repartition(n, "subject")), one("code", x)
    return notes.join(subjects, "split").join(codes, "split").select("split", "notes", "subjects", F.col("codes").alias("labels"))
