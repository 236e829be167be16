"""Queries over the written index: evidence of all splits for each label, and how much of a note's evidence comes from elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import chunks, evidence_query
from ..operators import lexical_index as li
from ..scratch import Scratch
from ..sources import fixtures as fx
from ..sources.fixtures import with_
from .registry import query
from .retrieval import _CH, TOK, base


def _sql(corpus: str, asked: str, k: int) -> str:
    """CTE ``top`` (query, doc, score, r): brute force over ``corpus`` (doc, text) for ``asked`` (query, text). Sums are added by size, as the index does."""
    return f"""ct as (select doc, {TOK.format('text')} t from ({corpus})), p as (select doc, len(t) dl, token, count(*) tf from (select doc, t, unnest(t) token from ct) group by all),
 s as (select count(*) n, avg(len(t)) avgdl from ct), idf as (select token, ln(1+(n-count(*)+0.5)/(count(*)+0.5)) idf from p, s group by token, n),
 q as (select distinct query, unnest({TOK.format('text')}) token from ({asked})),
 hit as (select query, doc, list_reduce(list_sort(list(idf*tf*2.5/(tf+1.5*(1-0.75+0.75*dl/avgdl)))), lambda a, b: a + b) score from p join idf using (token) join q using (token), s where idf >= 1e-4 group by 1, 2),
 top as (select query, doc, score, row_number() over (partition by query order by score desc, doc) r from hit qualify r <= {k})"""


_SPLIT = "case when u < 70 then 'train' when u < 85 then 'validation' else 'test' end"
_ID = f"(select *, {_SPLIT} || '_' || note || '_' || chunk doc from (select *, ('0x' || substr(md5('42:split:' || note), 1, 8))::bigint % 100 u from ch))"


def chunk_corpus(spark, d):
    """(doc, note, text): the chunks of the documents of all splits; a chunk's id names its split."""
    c = fx.table(spark, d, "documents").select(F.col("doc_id").alias("note"), F.posexplode(chunks(F.col("text"))).alias("chunk", "text"))
    return c.select(F.concat_ws("_", fx.split_of(F.col("note")), "note", "chunk").alias("doc"), "note", "text")


@query("ret_global_evidence", f"""with {_CH}, {_sql(f'select doc, text from {_ID}', 'select item_id query, text from benchmark', 5)} select query, doc chunk_id, round(score, 6) score, r::int "rank" from top""")
def global_evidence(spark, d):
    """The five best chunks of all notes for each label, from the index."""
    scratch = Scratch(spark, "global-evidence")
    index = li.write(chunk_corpus(spark, d), f"{scratch.root}/index", group="note")
    found, _ = li.search(index, base(spark, d).select(F.col("doc").alias("query"), "text"), 5, scratch=scratch)
    return found.select("query", F.col("doc").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")


_NOTE = "select note doc, string_agg(title, ' ' order by l_linenumber, p_partkey) text from (select note, l_linenumber, p.p_partkey, p.title from lines l join labels p on l.l_partkey = p.p_partkey) group by note"
_ASKED = "asked as (select note, subject, code from (select g.note, g.subject, code, row_number() over (partition by g.note order by code) c from gold g join splits s on g.note = s.note where split = 'test') where c <= 10)"


def order_notes(spark, d):
    """(note, subject, text): the titles of an order's parts in line order stand for its note; the customer is the subject."""
    titles = fx.labels(spark, d).select(F.col("p_partkey").alias("_k"), "title")
    lines = fx.table(spark, d, "lineitem").join(titles, F.col("l_partkey") == F.col("_k")).select(F.col("l_orderkey").alias("note"), "l_linenumber", "l_partkey", "title")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "title"))), lambda x: x["title"]), " ")
    orders = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("note"), F.col("o_custkey").alias("subject"))
    return fx.by_note(spark, d, lines).groupBy("note").agg(text.alias("text")).join(fx.by_note(spark, d, orders), "note")


@query("ret_evidence_leakage", with_("gold splits kb", f"""with {_ASKED}, {_sql(_NOTE, "select code query, 'ICD-10 ' || code || ': ' || title text from kb", 5)},
 e as (select a.note, a.note <> t.doc away, a.subject <> o.o_custkey other from asked a join top t on a.code = t.query join orders o on o.o_orderkey = t.doc), b as (select note, count(*) n, count(*) filter (away) away from e group by note)
 select (select count(distinct note) from asked) notes_evaluated, (select count(*) from asked) code_queries, count(*) retrieved_chunks, round(count(*) filter (away)/count(*), 6) cross_admission_rate, round(count(*) filter (other)/count(*), 6) cross_patient_rate,
 round((select count(*) from b where n > away)/(select count(distinct note) from asked), 6) notes_with_own_evidence_rate from e"""))
def evidence_leakage(spark, d):
    """For each test note and its first ten gold codes the five best notes of all splits for the code: shares of other admissions and other subjects among them."""
    scratch = Scratch(spark, "leakage")
    notes = scratch.save(order_notes(spark, d), "notes")
    index = li.write(notes, f"{scratch.root}/index", doc="note")
    kb = fx.knowledge_base(spark, d).select(F.col("code").alias("query"), evidence_query(F.col("code"), F.col("title")).alias("text"))
    found = li.search(index, kb, 5, scratch=scratch)[0].select("query", F.col("doc").alias("note"))
    found = found.join(notes.select("note", "subject"), "note").select("query", F.col("note").alias("from_note"), F.col("subject").alias("from_subject"))
    gold = fx.gold(spark, d).where(fx.split_of(F.col("subject")) == "test").groupBy("note", "subject").agg(F.slice(F.array_sort(F.collect_list("code")), 1, 10).alias("codes"))
    asked = gold.select("note", "subject", F.explode("codes").alias("query"))
    out = li.leakage(found, asked)
    return out.select(*(F.round(c, 6).alias(c) if c.endswith("rate") else F.col(c) for c in out.columns))
