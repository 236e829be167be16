"""Queries of the retrieval layer: benchmark items as the label base, documents as notes, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import chunks
from ..operators import retrieval as rt
from ..sources import fixtures as fx
from .registry import query

DIGITS = 6  #: of scores, here and in the SQL
TOK = "list_filter(string_split_regex(lower(coalesce({}, '')), '[ \\n\\t\\r\\f\\x0B]+'), lambda x: x <> '')"
_BASE = f"""kb as (select item_id doc, {TOK.format('text')} t from benchmark), p as (select doc, len(t) dl, token, count(*) tf from (select doc, t, unnest(t) token from kb) group by all),
 s as (select count(*) n, avg(len(t)) avgdl from kb), idf as (select token, ln(1+(n-count(*)+0.5)/(count(*)+0.5)) idf from p, s group by token, n),
 q as (select doc_id query, unnest(list_distinct({TOK.format('text')})) token from documents),
 hit as (select query, doc, round(sum(idf*tf*2.5/(tf+1.5*(1-0.75+0.75*dl/avgdl))),6) score from p join idf using (token) join q using (token), s where idf >= 1e-4 group by 1,2)"""
_ALL = _BASE + ", al as (select d.doc_id query, k.doc, coalesce(score,0) score from documents d cross join kb k left join hit h on h.query=d.doc_id and h.doc=k.doc)"
_MM = "mm as (select *, round(case when max(score) over (partition by query) > min(score) over (partition by query) then (score-min(score) over (partition by query))/(max(score) over (partition by query)-min(score) over (partition by query)) else 0 end,6) mm from {})"


def base(spark, d):
    return fx.table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), "text")


def notes(spark, d):
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("query"), "text")


@query("ret_bm25_stats", f"with {_BASE} select token, count(*) df, round(max(idf),6) idf from p join idf using (token) group by token")
def bm25_stats(spark, d):
    b = base(spark, d)
    return rt.postings(b).groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(rt.corpus_stats(b))).select("token", "df", F.round(rt.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@query("ret_bm25_topk", f"with {_ALL} select query, doc, score, (row_number() over (partition by query order by score desc, doc))::int \"rank\" from al qualify \"rank\" <= 5")
def bm25_topk(spark, d):
    q, b = notes(spark, d), base(spark, d)
    return rt.best_of_all(q, b, rt.bm25(q, b, digits=DIGITS), 5)


@query("ret_bm25_masked", f"with {_ALL} select query, doc, score, (row_number() over (partition by query order by score desc, doc))::int \"rank\" from al where doc % 3 = 0 qualify \"rank\" <= 3")
def bm25_masked(spark, d):
    q, b = notes(spark, d), base(spark, d)
    m = b.where("doc % 3 = 0")
    return rt.best_of_all(q, m, rt.bm25(q, b, digits=DIGITS).where("doc % 3 = 0"), 3)


@query("ret_minmax", f"with {_ALL}, {_MM.format('al')} select query, doc, mm from mm")
def minmax(spark, d):
    q, b = notes(spark, d), base(spark, d)
    return rt.min_max(rt.bm25_of_base(q, b, digits=DIGITS, zeros=True), digits=DIGITS).select("query", "doc", "mm")


_DENSE = """nv as (select vec_id, label, list_transform(embedding, lambda x: x::double / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::double*y::double))), 1e-9)) v from embeddings),
 dn as (select a.vec_id query, b.vec_id doc, round(list_dot_product(a.v,b.v),5) score from nv a join nv b on true where a.vec_id % 20 = 0)"""


@query("ret_dense_topk", f"with {_DENSE} select query, doc, score, (row_number() over (partition by query order by score desc, doc))::int \"rank\" from dn qualify \"rank\" <= 10")
def dense_topk(spark, d):
    """The vectors whose id is divisible by 20 against all."""
    return rt.dense_top_k(fx.table(spark, d, "embeddings"), 10, asked="id % 20 = 0")


@query("ret_hybrid_topk", f"""with {_ALL}, {_DENSE}, lex as (select * from al where query % 20 = 0), {_MM.format('lex')}, d2 as (select * from dn where doc in (select doc from kb)), {_MM.format('d2').replace('mm as', 'mn as')}
 select query, doc, round(0.6*mm.mm+(1-0.6)*mn.mm,6) score, (row_number() over (partition by query order by round(0.6*mm.mm+(1-0.6)*mn.mm,6) desc, doc))::int \"rank\" from mm join mn using (query, doc) qualify \"rank\" <= 5""")
def hybrid_topk(spark, d):
    """The documents whose id is divisible by 20 and that have a vector against the whole label base; the vector of the same number stands for a text's embedding."""
    return _hybrid(spark, d, notes(spark, d).where("query % 20 = 0"))


@query("ret_dense_topk_all")
def dense_topk_all(spark, d):
    """Every vector against every vector; ``ret_dense_topk`` and its SQL take those with ids divisible by 20 as queries."""
    return rt.dense_top_k(fx.table(spark, d, "embeddings"), 10)


@query("ret_hybrid_topk_all")
def hybrid_topk_all(spark, d):
    """Every document that has a vector against the whole label base; ``ret_hybrid_topk`` and its SQL take those with ids divisible by 20."""
    return _hybrid(spark, d, notes(spark, d))


def _hybrid(spark, d, q):
    """Texts and vectors meet by one shuffle each, by document; a pair's two scores are worked out in its row."""
    t = fx.table(spark, d, "embeddings")
    b, v, tasks = base(spark, d), rt.normalised(t), fx.tasks_for(t, rt.TASK_ROWS)
    labels = v.join(b.select(F.col("doc").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("q"))
    asked = v.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    q = q.join(t.select(F.col("vec_id").alias("query")), "query", "left_semi")  # the others have no vector
    lexical = rt.bm25_of_base(q, b, digits=DIGITS, zeros=True, tasks=tasks)
    both = lexical.join(rt.dealt(asked, "query", tasks=tasks), "query").join(F.broadcast(labels) if labels.limit(10_001).count() <= 10_000 else labels, "doc")
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = both.select("query", "doc", F.col("score").alias("x"), rt.rounded(dot, 5).alias("y"))
    return rt.top_k(rt.blended(both, 0.6, digits=DIGITS).drop("skipped_dense"), 5)


_CH = f"""w as (select doc_id, list_filter(string_split_regex(coalesce(text,''), '[ \\n\\t\\r\\f\\x0B]+'), lambda x: x <> '') t from documents), ch as (select doc_id note, i::int chunk, array_to_string(t[i*224+1:i*224+256], ' ') text from w, range(100000) r(i) where len(t) > 0 and i < greatest(1, ceil((len(t)-32)/224)))"""


@query("txt_chunks", f"with {_CH} select note, chunk, md5(text) h from ch")
def txt_chunks(spark, d):
    c = fx.table(spark, d, "documents").select(F.col("doc_id").alias("note"), F.posexplode(chunks(F.col("text"))).alias("chunk", "text"))
    return c.select("note", "chunk", F.md5("text").alias("h"))


_LOCAL = f"""{_CH}, ct as (select note, chunk doc, {TOK.format('text')} t from ch where note % 20 = 0), p as (select note, doc, len(t) dl, token, count(*) tf from (select note, doc, t, unnest(t) token from ct) group by all),
 s as (select note, count(*) n, avg(len(t)) avgdl from ct group by note), idf as (select p.note, token, ln(1+(n-count(*)+0.5)/(count(*)+0.5)) idf from p join s using (note) group by p.note, token, n),
 q as (select item_id query, unnest(list_distinct({TOK.format('text')})) token from benchmark),
 hit as (select p.note, query, doc, round(sum(idf*tf*2.5/(tf+1.5*(1-0.75+0.75*dl/avgdl))),6) score from p join idf using (note, token) join s using (note) join q using (token) where idf >= 1e-4 group by 1,2,3)"""


@query("ret_note_local_evidence", f"with {_LOCAL} select note, query, doc, score, (row_number() over (partition by note, query order by score desc, doc))::int \"rank\" from hit qualify \"rank\" <= 2")
def note_local(spark, d):
    """All labels against the chunks of the notes whose id is divisible by 20; every statistic is the note's own."""
    return _note_local(spark, d, fx.table(spark, d, "documents").where("doc_id % 20 = 0"))


@query("ret_note_local_evidence_all")
def note_local_all(spark, d):
    """All labels against the chunks of each note; ``ret_note_local_evidence`` and its SQL take the notes with ids divisible by 20."""
    return _note_local(spark, d, fx.table(spark, d, "documents"))


def _note_local(spark, d, documents):
    c = documents.select(F.col("doc_id").alias("note"), F.posexplode(chunks(F.col("text"))).alias("doc", "text"))
    labels = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return rt.top_k(rt.bm25_of_notes(labels, c, digits=DIGITS, tasks=fx.tasks_for(documents, rt.TASK_ROWS)), 2, by=["note", "query"])


@query("ret_leakage", f"with {_ALL}, t as (select query, doc, row_number() over (partition by query order by score desc, doc) r from al qualify r <= 2) select count(*) n, round(count(*) filter (query=doc)/count(*),6) own, round(count(*) filter (query<>doc)/count(*),6) cross_note, round(count(*) filter (query%7<>doc%7)/count(*),6) cross_subject from t")
def leakage(spark, d):
    q, b = notes(spark, d), base(spark, d)
    t = rt.best_of_all(q, b, rt.bm25_of_base(q, b, digits=DIGITS), 2)
    return rt.leakage(t.select(F.col("query").alias("note"), (F.col("query") % 7).alias("subject"), F.col("doc").alias("from_note"), (F.col("doc") % 7).alias("from_subject")))


@query("ret_squash", f"with {_BASE} select query, doc, round(case when score > 0 then least(1, score/(1+score)) else 0 end,6) squashed from hit")
def squash(spark, d):
    from ..functions.columns import squash as f

    return rt.bm25(notes(spark, d), base(spark, d), digits=DIGITS).select("query", "doc", F.round(f(F.col("score")), 6).alias("squashed"))


@query("ret_squash_all")
def squash_all(spark, d):
    """``ret_squash``, which takes all labels by now."""
    return squash(spark, d)


_W = "('0x'||substr(h,{0}+7,2)||substr(h,{0}+5,2)||substr(h,{0}+3,2)||substr(h,{0}+1,2))::bigint % 10007 / 10007.0::double"
_E = ", ".join("round((" + _W.format(str(8 * i)) + "),9)" for i in range(8))


@query("ret_hash_embedding", f"with s as (select item_id, sha256(text) h from benchmark), e as (select item_id, [{_E}] e from s) select item_id, list_concat(e,e,e,e,e,e,e,e) embedding from e")
def embedding(spark, d):
    e = fx.table(spark, d, "benchmark").select("item_id", rt.hash_embedding(F.col("text")).alias("e"))
    return e.select("item_id", F.transform("e", lambda x: F.round(x, 9)).alias("embedding"))
