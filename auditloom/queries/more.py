"""Further queries: stored runs, prompts, verifier answers, decision rules, objectives, diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import evaluation as ev
from ..operators import learners, reports, scoring
from ..sources import fixtures as fx
from ..sources import readers
from ..sources.fixtures import with_
from .evaluation import facts
from .registry import query

_REC = "rec as (select event_id o, case when event_type='error' then 'failed' else 'success' end status, case when user_id%5=0 then null else user_id*3+event_id%3 end gsi, event_type v, value from events)"


def records(spark, d):
    """Stored run records: the user and the event number make an index that repeats and is sometimes missing."""
    e = fx.table(spark, d, "events")
    gsi = F.when(F.col("user_id") % 5 != 0, F.col("user_id") * 3 + F.col("event_id") % 3)
    return e.select(F.col("event_id").alias("o"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), gsi.alias("global_sample_index"), F.col("event_type").alias("v"), "value")


@query("src_last_success", f"with {_REC} select gsi global_sample_index, arg_max(v, o) v from rec where status='success' and gsi is not null group by gsi")
def last_success(spark, d):
    return readers.latest_success(records(spark, d), "o").select("global_sample_index", "v")


@query("src_fallback_index", f"""with recursive {_REC}, ok as (select * from rec where status='success'), f as (select v, gsi k, min(o) first_o from ok where gsi is not null group by 1, 2),
 n as (select v, o, row_number() over (partition by v order by o) i from ok where gsi is null), rc as (select n.v, n.o, n.i, count(f.k) r from n left join f on f.v=n.v and f.first_o<n.o group by all),
 w as (select v, 0::bigint i, null::bigint g, []::struct(k bigint, fo bigint)[] fb from (select distinct v from n)
  union all select x.v, x.i, x.g, case when list_contains(list_transform(x.fb, lambda e: e.k), x.g) then x.fb else list_append(x.fb, {{'k': x.g, 'fo': coalesce(f.first_o, 9223372036854775807)}}) end
  from (select w.v, rc.i, (rc.r + len(list_filter(w.fb, lambda e: e.fo > rc.o)))::bigint g, w.fb from w join rc on rc.v=w.v and rc.i=w.i+1) x left join f on f.v=x.v and f.k=x.g),
 al as (select v, gsi g, o from ok where gsi is not null union all select w.v, w.g, n.o from w join n on n.v=w.v and n.i=w.i)
 select v run, g global_sample_index, max(o) o from al group by 1, 2""")
def fallback_index(spark, d):
    """Runs by event type."""
    return readers.latest_success(records(spark, d), "o", fallback=True, run="v").select(F.col("v").alias("run"), "global_sample_index", "o")


@query("src_shard_merge", f"with {_REC}, a as (select distinct gsi from rec where o%2=0 and gsi is not null), b as (select distinct gsi from rec where gsi is not null) select gsi global_sample_index from b where (select count(*) from b) >= (select count(*) from a)")
def shard_merge(spark, d):
    r = records(spark, d).where("global_sample_index is not null")
    return readers.merge_shards([r.where("o % 2 = 0"), r]).select("global_sample_index")


@query("ag_min_n", f"with {_REC} select v experiment, min(n) min_n, count(*) seeds from (select v, o%3 seed, count(*) n from rec group by 1, 2) group by v")
def min_n(spark, d):
    n = records(spark, d).groupBy("v", (F.col("o") % 3).alias("seed")).agg(F.count("*").alias("n"))
    return n.groupBy(F.col("v").alias("experiment")).agg(F.min("n").alias("min_n"), F.count("*").alias("seeds"))


@query("ag_flatten", f"with {_REC}, m as (select v run, round(avg(value),6) avg_runtime, max(value) peak, count(*)::double n from rec group by v) select run, 'cost.' || name metric, val \"value\" from (unpivot m on avg_runtime, peak, n into name name value val)")
def flatten(spark, d):
    m = records(spark, d).groupBy(F.col("v").alias("run")).agg(F.round(F.avg("value"), 6).alias("avg_runtime"), F.max("value").alias("peak"), F.count("*").cast("double").alias("n"))
    return m.unpivot(["run"], ["avg_runtime", "peak", "n"], "metric", "value").select("run", F.concat(F.lit("cost."), "metric").alias("metric"), "value")


_NEST = """'{"run":{"id":' || event_id || ',"k.v":' || user_id || ',"none":null,"list":[1,{"x":"' || event_type || '"}]},"run.id":' || user_id || ',"flat":' || coalesce(props, 'null') || '}'"""
_TREE = f"t as (select event_id, regexp_replace(replace(replace(t.fullkey, '$.', ''), '\"', ''), '\\[([0-9]+)\\]', '.\\1', 'g') metric, t.type, t.fullkey, coalesce(t.value::varchar, 'null') \"value\" from (select event_id, ({_NEST})::json j from events), json_tree(j) t)"


def nested(spark, d):
    """Events as nested records: keys with dots, lists, nulls, and a dotted key that another way down spells too."""
    e = fx.table(spark, d, "events")
    e = e.select("event_id", "user_id", "event_type", "props").repartition(fx.tasks_for(e))  # many records fit a block of a file
    return e.select("event_id", F.expr(_NEST.replace(" || event_id || ", " || cast(event_id as string) || ").replace(" || user_id || ", " || cast(user_id as string) || ")).alias("json"))


@query("ag_flatten_json", f"""with {_TREE} select event_id, metric, "value" from t where type not in ('OBJECT', 'ARRAY')""")
def flatten_json(spark, d):
    return reports.flatten(nested(spark, d), "event_id", lists=True).select(F.col("key").alias("event_id"), "metric", "value")


PATHS = ["run.id", "run.k.v", "run.none", "run.list.1.x", "flat.k", "run.list.7", "run.k"]


@query("rg_get_path", f"""with {_TREE}, p as (select unnest({PATHS}) path), f as (select event_id, metric, arg_max("value", (fullkey = '$."run.id"')::int) "value" from t group by all) select e.event_id, path, f."value" from events e cross join p left join f on f.event_id = e.event_id and f.metric = path""")
def get_path(spark, d):
    """Paths by the greedy rule: of ``run.id`` the whole key counts before the nested one."""
    return reports.get(nested(spark, d), "event_id", PATHS).select(F.col("key").alias("event_id"), "path", "value")


@query("ag_diagnostics", with_("pred_a", "select note % 4 experiment, count(*) codes, count(*) filter (supported) supported, count(*) filter (confidence is null) without_confidence, count(distinct substr(code,1,3)) families from pred_a group by 1"))
def diagnostics(spark, d):
    return fx.predictions(spark, d).groupBy((F.col("note") % 4).alias("experiment")).agg(F.count("*").alias("codes"), F.count_if("supported").alias("supported"), F.count_if(F.col("confidence").isNull()).alias("without_confidence"), F.countDistinct(F.substring("code", 1, 3)).alias("families"))


@query("ag_similar_confusion", with_("facts_a", "with w as (select note, code, bool_or(in_gold) over (partition by note, substr(code,1,3)) near, in_pred and not in_gold wrong from facts_a) select note, count(*) filter (wrong and near) n_similar, count(*) filter (wrong) wrong from w group by note having count(*) filter (wrong) > 0"))
def similar(spark, d):
    near = F.bool_or("in_gold").over(Window.partitionBy("note", F.substring("code", 1, 3)))
    w = facts(spark, d).select("note", near.alias("near"), F.expr("in_pred and not in_gold").alias("wrong")).where("wrong")
    return w.groupBy("note").agg(F.count_if("near").alias("n_similar"), F.count("*").alias("wrong"))


@query("ag_quote_compliance", with_("recs", "select note % 2 arm, count(distinct note) notes, count(*) codes, count(evidence_quote_verbatim) checked, count(*) filter (evidence_quote_verbatim) verbatim, round(count(*) filter (evidence_quote_verbatim)/nullif(count(evidence_quote_verbatim),0),4) rate from recs where not mock group by 1"))
def compliance(spark, d):
    """Arms by parity of the note."""
    return ev.quote_compliance(fx.code_records(spark, d), F.col("note") % 2)


@query("txt_prompt", with_("kb pred_a", """with c as (select p.note, p."rank" r, p."rank"::varchar || '. ' || p.code || ' - ' || k.title || ': ' || substr(k.title || ' ' || k.parent, 1, 12) line from pred_a p join kb k using (code) where p."rank" <= 4)
 select note, 'Candidates:' || chr(10) || string_agg(line, chr(10) order by r) prompt, least(120+40*count(*), 250) budget from c group by note"""))
def prompt(spark, d):
    k = fx.knowledge_base(spark, d).select("code", "title", "parent")
    c = fx.predictions(spark, d).where("rank <= 4").join(k, "code")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "code", F.lit(" - "), "title", F.lit(": "), F.substring(F.concat("title", F.lit(" "), "parent"), 1, 12))
    g = c.groupBy("note").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"), F.count("*").alias("n"))
    return g.select("note", F.concat(F.lit("Candidates:\n"), F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("prompt"), fc.token_budget(F.col("n"), 250).alias("budget"))


@query("txt_budgeted", "with l as (select conv_id, turn, text p, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) before from conversations), k as (select *, 900-before rest from l) select conv_id, string_agg(case when length(p) <= rest then p else substr(p, 1, rest::int) end, chr(10) order by turn) evidence from k where length(p) <= rest or rest > 100 group by conv_id")
def budgeted(spark, d):
    g = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    return g.select("conv_id", fc.budgeted(F.col("parts"), 900).alias("evidence")).where("evidence <> ''")


@query("txt_sibling_parse", with_("kb", "select code, len(list_filter(string_split_regex(parent || ', ' || code || ';' || title, '[,;\\s]+'), lambda x: x <> ''))::int n from kb"))
def sibling_parse(spark, d):
    return fx.knowledge_base(spark, d).select("code", F.size(fc.sibling_list(F.concat("parent", F.lit(", "), "code", F.lit(";"), "title"))).alias("n"))


@query("scr_rejected_similar", with_("pred_a", """with best as (select note, code, substr(code,1,3) f from pred_a where "rank"=1), r as (select p.note, p.code, row_number() over (partition by p.note order by (substr(p.code,1,3) <> f)::int, confidence desc nulls last, p.code) r from pred_a p join best b on p.note=b.note and p.code<>b.code) select note, string_agg(code, ',' order by r) rejected from r where r <= 3 group by note"""))
def rejected_similar(spark, d):
    p = fx.predictions(spark, d)
    best = p.where("rank = 1").select("note", F.col("code").alias("own"))
    w = Window.partitionBy("note").orderBy(F.substring("code", 1, 3) != F.substring("own", 1, 3), F.desc_nulls_last("confidence"), "code")
    r = p.join(best, "note").where("code <> own").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return r.groupBy("note").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "code"))), lambda x: x["code"]), ",").alias("rejected"))


@query("ml_decision_rule", with_("pred_a", """with s as (select note, code, coalesce(confidence, 0) score, row_number() over (partition by note order by coalesce(confidence,0) desc, code) r from pred_a), t as (select *, bool_or(score >= 0.7) over (partition by note) has from s) select note, code, r::int "rank" from t where (score >= 0.7 and r <= 2) or (not has and r <= 1)"""))
def decision(spark, d):
    s = fx.predictions(spark, d).select("note", "code", F.coalesce("confidence", F.lit(0.0)).alias("score"))
    return learners.decide(s, 0.7, 2, 1).select("note", "code", "rank")


@query("ml_multi_hot", with_("gold", "with top as (select code from gold group by code order by count(*) desc, code limit 10) select n.note, t.code, (g.code is not null)::int y from (select distinct note from gold) n cross join top t left join gold g on g.note=n.note and g.code=t.code"))
def multi_hot(spark, d):
    from ..operators import statistics as st

    g = fx.gold(spark, d)
    top = st.top_labels(g).where("pos < 10").select("code")
    cells = g.select("note").distinct().join(F.broadcast(top))  # ten labels
    return cells.join(g.select("note", "code", F.lit(1).alias("y")), ["note", "code"], "left").select("note", "code", F.coalesce("y", F.lit(0)).alias("y"))


@query("opt_objective_vector", "select c_nationkey k, -coalesce(round(max(c_acctbal)/10000,6),0) o1, coalesce(round(min(c_acctbal)/10000,6),0) o2, case when count(*) < 3 then 1e9 else round(count(*)/1000,6) end o3 from customer group by 1")
def objective(spark, d):
    """Maximised metrics negated, missing ones 0, failed configurations the penalty."""
    c = fx.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k"))
    return c.agg((-F.coalesce(F.round(F.max("c_acctbal") / 10000, 6), F.lit(0.0))).alias("o1"), F.coalesce(F.round(F.min("c_acctbal") / 10000, 6), F.lit(0.0)).alias("o2"), F.when(F.count("*") < 3, F.lit(1e9)).otherwise(F.round(F.count("*") / 1000, 6)).alias("o3"))


@query("scr_verifier_answer", with_("pred_a", "select note, list_sort(list(code) filter (\"rank\" <= 3))::varchar codes, count(*) n from pred_a group by note having count(*) > 2"))
def verifier(spark, d):
    """A verifier's answer, whose items are objects or plain strings, as the list of its codes."""
    p = fx.predictions(spark, d)
    item = F.when(F.col("rank") % 2 == 0, F.concat(F.lit('"'), "code", F.lit('"'))).otherwise(F.concat(F.lit('{"code":"'), "code", F.lit('","reason":"x"}')))
    g = p.groupBy("note").agg(F.array_sort(F.collect_list(F.struct("rank", F.when(F.col("rank") <= 3, item).alias("i")))).alias("x"), F.count("*").alias("n")).where("n > 2")
    text = F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: v["i"]), ","), F.lit("]"))
    codes = F.array_sort(scoring.verifier_codes(text))
    return g.select("note", F.concat(F.lit("["), F.array_join(codes, ", "), F.lit("]")).alias("codes"), "n")


@query("rg_text_scan", r"""with p(name, pattern) as (values ('insult', '(?i)\b(idiot|moron|scum)\b'), ('long_number', '[0-9]{4,}'), ('placeholder', '(?i)\b(todo|tbd|xxx)\b'))
 select name, count(*) filter (regexp_matches(text, pattern)) documents, coalesce(sum(len(regexp_extract_all(text, pattern))), 0)::bigint hits, min(doc_id) filter (regexp_matches(text, pattern)) first_id from documents, p group by name""")
def text_scan(spark, d):
    """Documents and hits of each pattern of a table of patterns."""
    patterns = spark.createDataFrame([("insult", r"(?i)\b(idiot|moron|scum)\b"), ("long_number", "[0-9]{4,}"), ("placeholder", r"(?i)\b(todo|tbd|xxx)\b")], "name string, pattern string")
    return reports.scan(fx.table(spark, d, "documents").select("doc_id", "text"), patterns)
