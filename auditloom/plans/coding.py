"""Whole plans: from notes and a label base to ranked code records, as one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import chunks, evidence_query, preview
from ..operators import label_base as lb
from ..operators import retrieval as rt
from ..operators import scoring as sc


def knowledge_base(codes: DataFrame, version: int, order: str = "title") -> DataFrame:
    """(code, title, searchable_text, parent, siblings) of one version of a code list (code, title, version): the first title of each code by ``order``, the other codes of its category."""
    one = codes.where(F.col("version") == version).groupBy("code").agg(F.min_by("title", order).alias("title")).withColumn("parent", F.substring("code", 1, 3))
    family = F.array_sort(F.collect_set("code").over(Window.partitionBy("parent")))
    return one.select("code", "title", F.concat_ws(" ", "code", "title").alias("searchable_text"), "parent", F.array_except(family, F.array("code")).alias("siblings"))


def retrieval_only(notes: DataFrame, base: DataFrame, k: int = 15, mask: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(note, code, confidence, rank): the k best labels of each note by BM25. ``notes``: (note, text); ``base``: (code, text)."""
    q, b = notes.select(F.col("note").alias("query"), "text"), base.select(F.col("code").alias("doc"), "text")
    hits = rt.min_max_hits(rt.bm25_of_base(q, b, tasks=tasks), b).select("query", "doc", F.col("mm").alias("score"))
    if mask is not None:
        m = mask.select(F.col("code").alias("doc")).distinct()
        b, hits = b.join(m, "doc", "left_semi"), hits.join(m, "doc", "left_semi")
    t = rt.best_of_all(q, b, hits, k)
    return t.select(F.col("query").alias("note"), F.col("doc").alias("code"), F.col("score").alias("confidence"), "rank")


def evidence(notes: DataFrame, candidates: DataFrame, base: DataFrame, k: int = 2, size: int = 256, overlap: int = 32, alpha: float = 1.0, encode=None, snippet: int = 0, tasks: int | None = None) -> DataFrame:
    """(note, code, evidence, evidence_preview, evidence_chunk_id, evidence_score) and further columns of the candidates: the best chunks of the note itself for each candidate, joined; '' and 0 for a note without text.

    The score is the best chunk's, scaled between the note's own chunks: 1 for the best where they differ (BM25 alone), and 0 where nothing tells them apart: in a note of
    one chunk (up to ``size`` words), and where all chunks tie. So with BM25 alone it says whether the note has a passage of its own for the code, not how good it is.
    """
    tasks = tasks or max(1, -(-notes.count() // rt.TASK_ROWS))
    c = notes.select("note", F.posexplode(chunks(F.col("text"), size, overlap)).alias("doc", "text"))
    q = candidates.select("note", "code").join(base.select("code", "text"), "code").select("note", F.col("code").alias("query"), evidence_query(F.col("code"), F.col("text")).alias("text"))
    best = rt.note_local(q, c, k, alpha, encode, tasks=tasks).groupBy("note").agg(F.array_sort(F.collect_list(F.struct("query", "rank", "doc", "score"))).alias("best"))
    # Candidates, best chunks and text of a note meet once, by the note, and the evidence is cut from the text in place.
    own = candidates.repartition(tasks, "note").groupBy("note").agg(F.collect_list(F.struct(*(x for x in candidates.columns if x != "note"))).alias("own"))
    met = own.join(best, "note", "left").join(notes.select("note", "text").repartition(tasks, "note"), "note", "left")
    met = met.select("note", "best", chunks(F.col("text"), size, overlap).alias("chunks"), "own").select("note", "best", "chunks", F.explode("own").alias("own"))
    got = F.filter(F.coalesce("best", F.array()), lambda x: x["query"] == F.col("own.code"))
    met = met.withColumn("got", got)
    text = F.array_join(F.transform("got", lambda x: F.get("chunks", x["doc"])), "\n")
    text = F.substring(text, 1, snippet) if snippet else text
    doc = F.get("got", F.lit(0))["doc"]
    out = met.select("note", "own.*", text.alias("evidence"), F.coalesce(F.concat(F.lit("chunk_"), doc.cast("string")), F.lit("")).alias("evidence_chunk_id"), F.coalesce(F.array_max(F.transform("got", lambda x: x["score"])), F.lit(0.0)).alias("evidence_score"))
    return out.withColumn("evidence_preview", preview(F.col("evidence"))).select("note", "code", "evidence", "evidence_preview", "evidence_chunk_id", "evidence_score", *(x for x in candidates.columns if x not in ("note", "code")))


def _held(notes: DataFrame, base: DataFrame, k: int) -> DataFrame | None:
    """Candidates with note-local evidence by BM25 and deterministic scores, worked out note by note against a base that every task holds; None for a base that is too large for it. ``notes``: one row a note."""
    of = lb.held(base, "code", evidence_query(F.col("code"), F.col("text"))) if base.schema["code"].dataType.simpleString() == "string" else None
    if of is None:
        return None
    text = F.coalesce("text", F.lit(""))
    n = notes.count()
    tasks = max(2, -(-n // rt.TASK_ROWS), min(2 * notes.sparkSession.sparkContext.defaultParallelism, n // 100))  # few notes are dealt over the cores
    own = notes.select("note", "text").repartition(tasks, "note").select("note", lb.candidates(of, k)(text.cast("binary"), F.lower(text).cast("binary")).alias("own"))
    own = own.repartition(tasks, "note")  # a Python step forgets how its rows were dealt; the windows by note keep this
    conf, ok = sc.mock_score_of(F.col("share"))
    p = own.select("note", F.explode("own").alias("own")).select("note", "own.*").withColumn("confidence", conf).withColumn("supported", ok)
    return p.withColumn("evidence_preview", F.translate("head", "\n", " ")).withColumn("evidence_quote", F.substring("head", 1, 80)).withColumn("evidence_chunk_id", F.coalesce(F.concat(F.lit("chunk_"), F.col("doc").cast("string")), F.lit("")))


def _joined(notes: DataFrame, base: DataFrame, k: int, alpha: float, encode) -> DataFrame:
    """``_held`` by joins, for any base and encoder."""
    tasks = max(1, -(-notes.count() // rt.TASK_ROWS))
    cand = retrieval_only(notes, base, k, tasks=tasks).withColumnRenamed("confidence", "retrieval_score").withColumnRenamed("rank", "candidate_rank")
    e = evidence(notes, cand.join(base.select("code", F.col("text").alias("title")), "code").select("note", "code", "candidate_rank", "retrieval_score", "title"), base, alpha=alpha, encode=encode, tasks=tasks)
    conf, ok = sc.mock_score(F.col("title"), F.col("evidence"))
    return e.withColumn("confidence", conf).withColumn("supported", ok).withColumn("evidence_quote", F.substring("evidence", 1, 80))


def coded(notes: DataFrame, base: DataFrame, k: int = 15, least: float = 0.3, mode: str = "filter", min_final: int = 1, cap: int = 10, contrast: bool = False, legacy: bool = False, threshold: float = 0.0, alpha: float = 1.0, encode=None) -> DataFrame:
    """(note, code, confidence, supported, evidence..., risk_flag, rank): the whole pipeline with the deterministic scorer.

    Candidates, note-local evidence, scores, evidence constraint (mode ``off``, ``flag`` or ``filter``), contrastive step, null-aware rank, threshold with ``min_final`` kept, cap.
    ``contrast``: in families of borderline codes the verifier (here: the better score) rejects the runner-up. ``legacy``: the constraint
    looks at the evidence score alone, and every code of a family but the best is verified against it, borderline or not.
    Evidence of a note of one chunk scores 0 (see ``evidence``), so with ``least`` above 0 ``filter`` drops all its codes and ``flag`` marks them; the
    scorer sees all the evidence either way, without the caps of a prompt.
    """
    p = _held(notes, base, k) if alpha == 1.0 or encode is None else None
    p = _joined(notes, base, k, alpha, encode) if p is None else p
    p = p.select("note", "code", "evidence_preview", "evidence_chunk_id", "evidence_score", "confidence", "supported", "evidence_quote", F.when(F.col("supported"), "none").otherwise("weak_evidence").alias("risk_flag"), "candidate_rank", "retrieval_score", F.col("candidate_rank").alias("rank"))
    if mode != "off":
        p = sc.constrain(p, least, mode, score="evidence_score", judged=not legacy)
    if contrast:
        p = sc.drop_runner_ups(p, margin=1.0 if legacy else 0.2)
    p = p.withColumn("rank", sc.null_aware_rank())
    if threshold:
        p = sc.keep_threshold(p, threshold, min_final)
    return p.where(F.col("rank") <= cap)
