"""Queries of text preparation and of whole coding plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import label_base as lb
from ..operators import retrieval as rt
from ..plans import coding
from ..sources import fixtures as fx
from ..sources.fixtures import with_
from .registry import query
from .retrieval import _CH, TOK

# The headings of a discharge note's sections.
HEADINGS = ["Chief Complaint", "History of Present Illness", "Past Medical History", "Hospital Course", "Discharge Diagnosis", "Discharge Medications", "Follow-up"]
_NAMED = "list_value(" + ", ".join(f"'{h}'" for h in HEADINGS) + ")"
_ANY = "|".join(sorted(HEADINGS, key=len, reverse=True))


def sectioned(spark, d):
    """Conversations as notes: each turn a section, headings in turn, the first without one."""
    c = fx.table(spark, d, "conversations")
    head = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("turn") % len(HEADINGS) + 1).cast("int"))
    line = F.concat(F.when(F.col("turn") == 0, F.lit("")).otherwise(F.concat(F.when(F.col("turn") % 2 == 0, F.upper(head)).otherwise(head), F.lit(": "))), "text")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return g.select("conv_id", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("text"))


@query("txt_sections", f"""with c as (select conv_id, string_agg(case when turn = 0 then '' else (case when turn % 2 = 0 then upper({_NAMED}[turn % {len(HEADINGS)} + 1]) else {_NAMED}[turn % {len(HEADINGS)} + 1] end) || ': ' end || text, chr(10) order by turn) text from conversations group by conv_id),
 s as (select conv_id, list_prepend('', regexp_extract_all(text, '(?mi)^[ \\t]*({_ANY})[ \\t]*:', 1)) n, string_split_regex(text, '(?mi)^[ \\t]*(?:{_ANY})[ \\t]*:') p from c),
 x as (select conv_id, unnest(n) name, unnest(p) part from s) select conv_id, upper(name) section, count(*) n, sum(length(regexp_replace(part, '^\\s+|\\s+$', '', 'g')))::bigint characters from x where regexp_replace(part, '^\\s+|\\s+$', '', 'g') <> '' group by 1, 2""")
def sections(spark, d):
    s = sectioned(spark, d).select("conv_id", F.explode(fc.sections(F.col("text"), HEADINGS)).alias("s"))
    return s.groupBy("conv_id", F.upper("s.name").alias("section")).agg(F.count("*").alias("n"), F.sum(F.length("s.text")).alias("characters"))


@query("kb_build", with_("labels", """with v as (select code, arg_min(title, p_partkey) title from labels where 9 + p_partkey % 2 = 10 group by code) select code, title, code || ' ' || title searchable_text, substr(code,1,3) parent,
 (select string_agg(w.code, ',' order by w.code) from v w where substr(w.code,1,3) = substr(v.code,1,3) and w.code <> v.code) siblings from v"""))
def kb_build(spark, d):
    """The label base of one version of a code list, with parents and siblings of that version."""
    codes = fx.labels(spark, d).withColumn("version", 9 + F.col("p_partkey") % 2)
    k = coding.knowledge_base(codes, 10, order="p_partkey")
    return k.withColumn("siblings", F.when(F.size("siblings") > 0, F.array_join("siblings", ",")))


_LINE = """string_agg("rank"::varchar || '. ' || code || ' (' || title || ')' || chr(10) || '   Evidence: ' || substr(title || ' seen in ' || note, 1, 25), chr(10) order by "rank")"""
_T = {k: tuple(x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in v) for k, v in fc.TEMPLATES.items()}


@query("txt_batch_prompt", with_("kb pred_a", f"""with b as (select p.note, {_LINE} block, 'note ' || p.note || repeat(' text', 20) n from pred_a p join kb k using (code) group by p.note)
 select note, md5(substr('{_T['default'][0]}' || block || '{_T['default'][1]}', 1, 900)) default_md5, md5('{_T['copy'][0]}' || block || '{_T['copy'][1]}') copy_md5, md5('{_T['note'][0]}' || substr(n, 1, 60) || chr(10) || chr(10) || 'Candidates:' || chr(10) || block || '{_T['note'][1]}') note_md5 from b"""))
def batch_prompt(spark, d):
    """The three templates with their caps: evidence of 25 characters, a note of 60, a prompt of 900."""
    c = fx.predictions(spark, d).join(fx.knowledge_base(spark, d).select("code", "title"), "code")
    seen = F.concat("title", F.lit(" seen in "), F.col("note").cast("string"))
    g = c.groupBy("note").agg(F.array_sort(F.collect_list(F.struct("rank", "code", "title", seen.alias("evidence")))).alias("x"))
    text = F.concat(F.lit("note "), F.col("note").cast("string"), F.repeat(F.lit(" text"), F.lit(20)))
    x = F.col("x")
    return g.select("note", F.md5(fc.prompt(x, snippet_cap=25, cap=900)).alias("default_md5"), F.md5(fc.prompt(x, "copy", snippet_cap=25)).alias("copy_md5"), F.md5(fc.prompt(x, "note", text, snippet_cap=25, note_cap=60)).alias("note_md5"))


def _inputs(spark, d, part="true"):
    notes = fx.table(spark, d, "documents").where(part).select(F.col("doc_id").alias("note"), "text")
    base = fx.table(spark, d, "benchmark").select(F.concat(F.lit("B"), F.lpad(F.col("item_id").cast("string"), 4, "0")).alias("code"), "text")
    return notes, base


_PARTS = "doc_id % 20 = 0"
_BM25 = "list_reduce(list_sort(list(idf*tf*2.5/(tf+1.5*(1-0.75+0.75*dl/avgdl)))), lambda a, b: a + b) score"
_LONG = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: length(x) > 2))"


def _plan_sql(constraint: str, margin: float, supported: str, flag: str) -> str:
    """The whole plan: candidates, note-local evidence, deterministic scores, constraint, verifier, rank."""
    return f"""with {_CH}, b as (select 'B' || lpad(item_id::varchar, 4, '0') code, text from benchmark), n as (select doc_id note, text from documents where {_PARTS}),
 kt as (select code doc, {TOK.format('text')} t from b), kp as (select doc, len(t) dl, token, count(*) tf from (select doc, t, unnest(t) token from kt) group by all), ks as (select count(*) n, avg(len(t)) avgdl from kt),
 ki as (select token, ln(1+(n-count(*)+0.5)/(count(*)+0.5)) idf from kp, ks group by token, n), q as (select note, unnest(list_distinct({TOK.format('text')})) token from n),
 hit as (select note, doc code, {_BM25} from kp join ki using (token) join q using (token), ks where idf >= 1e-4 group by 1, 2),
 m as (select note, max(score) hi, case when count(*) < (select n from ks) then 0 else min(score) end lo from hit group by note),
 al as (select n.note, b.code, coalesce(case when hi > lo then (score-lo)/(hi-lo) else 0 end, 0) mm from n cross join b left join hit h on h.note = n.note and h.code = b.code left join m on m.note = n.note),
 cand as (select note, code, row_number() over (partition by note order by mm desc, code) candidate_rank from al qualify candidate_rank <= 10),
 ct as (select note, chunk doc, {TOK.format('text')} t from ch where note % 20 = 0), cp as (select note, doc, len(t) dl, token, count(*) tf from (select note, doc, t, unnest(t) token from ct) group by all), cs as (select note, count(*) n, avg(len(t)) avgdl from ct group by note),
 ci as (select cp.note, token, ln(1+(n-count(*)+0.5)/(count(*)+0.5)) idf from cp join cs using (note) group by cp.note, token, n),
 eq as (select note, code, unnest(list_distinct({TOK.format("'ICD-10 ' || code || ': ' || text")})) token from cand join b using (code)),
 eh as (select note, code, doc, {_BM25} from cp join ci using (note, token) join cs using (note) join eq using (note, token) where idf >= 1e-4 group by 1, 2, 3),
 ep as (select c.note, c.code, ct.doc, coalesce(score, 0) score from cand c join ct on ct.note = c.note left join eh on eh.note = c.note and eh.code = c.code and eh.doc = ct.doc),
 em as (select *, case when max(score) over w > min(score) over w then (score-min(score) over w)/(max(score) over w-min(score) over w) else 0 end mm from ep window w as (partition by note, code)),
 et as (select *, row_number() over (partition by note, code order by mm desc, doc) r from em qualify r <= 2),
 eg as (select e.note, code, string_agg(ch.text, chr(10) order by r) evidence, arg_min(doc, r) doc, max(mm) es from et e join ch on ch.note = e.note and ch.chunk = e.doc group by 1, 2),
 p as (select c.*, coalesce(evidence, '') evidence, case when doc is null then '' else 'chunk_' || doc end chunk, coalesce(es, 0) es, {_LONG.format('b.text')} h, {_LONG.format("coalesce(evidence, '')")} g from cand c join b using (code) left join eg on eg.note = c.note and eg.code = c.code),
 o as (select *, case when len(h) > 0 then len(list_intersect(h, g))/len(h) else 0 end o from p),
 s as (select *, round(least(0.95, 0.35+0.8*o), 3) confidence, o >= 0.15 ok from o), k as (select *, {supported} supported, {flag} risk_flag from s where {constraint}),
 f as (select note, lead(code) over w runner_up, confidence - lead(confidence) over w gap, row_number() over w r from k window w as (partition by note, substr(code, 1, 3) order by confidence desc, code)),
 r as (select k.* from k anti join (select note, runner_up code from f where r = 1 and runner_up is not null and round(gap, 9) <= {margin}) x using (note, code))
 select note, code, candidate_rank::int candidate_rank, confidence, supported, risk_flag, chunk evidence_chunk_id, round(es, 6) evidence_score, (row_number() over (partition by note order by (not supported)::int, confidence desc, candidate_rank))::int "rank" from r qualify "rank" <= 10"""


def _columns(p):
    return p.select("note", "code", "candidate_rank", "confidence", "supported", "risk_flag", "evidence_chunk_id", F.round("evidence_score", 6).alias("evidence_score"), "rank")


@query("plan_batched", _plan_sql("es >= 0.3 and ok", 0.2, "ok", "case when ok then 'none' else 'weak_evidence' end"))
def plan_batched_part(spark, d):
    """``plan_batched_all`` for the documents with ids divisible by 20."""
    return _columns(coding.coded(*_inputs(spark, d, _PARTS), k=10, contrast=True))


@query("plan_legacy", _plan_sql("true", 1.0, "case when es < 0.3 then false else ok end", "case when es < 0.3 then 'weak_evidence' else 'none' end"))
def plan_legacy_part(spark, d):
    """``plan_legacy_all`` for the documents with ids divisible by 20."""
    return _columns(coding.coded(*_inputs(spark, d, _PARTS), k=10, mode="flag", contrast=True, legacy=True))


@query("plan_batched_all")
def plan_batched(spark, d):
    """The whole batched plan over all documents and the whole label base, with evidence constraint and contrastive step."""
    return coding.coded(*_inputs(spark, d), k=10, contrast=True)


@query("plan_legacy_all")
def plan_legacy(spark, d):
    """The older plan: weak evidence only flagged, every family verified."""
    return coding.coded(*_inputs(spark, d), k=10, mode="flag", contrast=True, legacy=True)


@query("ret_note_local_hybrid_all")
def note_local_hybrid(spark, d):
    """All labels against the chunks of each note by BM25 and the cosine of a stand-in encoder."""
    notes, base = _inputs(spark, d)
    labels, tasks = base.select(F.col("code").alias("query"), "text"), fx.tasks_for(notes, rt.TASK_ROWS)
    out = lb.note_local_of_base(notes, labels, 2, 0.5, rt.hash_embedding, tasks=tasks)
    if out is not None:
        return out
    c = notes.select("note", F.posexplode(fc.chunks(F.col("text"))).alias("doc", "text"))
    return rt.note_local(labels, c, 2, 0.5, rt.hash_embedding, tasks=tasks)
