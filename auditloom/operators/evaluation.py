"""Evaluation metrics over two fact tables: one row per note and code of either side, and one row per note.

Metrics that are means over notes take the table of all notes: one with neither gold nor predicted codes has no facts, but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import f1, safe_ratio, verbatim


def facts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(note, code, in_gold, in_pred, rank, supported, confidence): gold and predicted codes side by side, each pair once.

    Both sides meet by one shuffle on the note, which later aggregates by note, category or rank need as well. Of repeated predictions of a code the best rank and confidence count.
    """
    empty = {"in_gold": "boolean", "in_pred": "boolean", "rank": "int", "supported": "boolean", "confidence": "double"}
    fill = lambda df, have: df.select("note", "code", *(have[c] if c in have else F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    g = fill(gold, {"in_gold": F.lit(True).alias("in_gold")})
    p = fill(pred, {"in_pred": F.lit(True).alias("in_pred"), **{c: F.col(c) for c in ("rank", "supported", "confidence")}})
    return _merged(g.unionByName(p))


def _merged(rows: DataFrame) -> DataFrame:
    each = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("in_gold", "in_pred")]
    return rows.repartition("note").groupBy("note", "code").agg(*each, F.min("rank").alias("rank"), F.bool_or("supported").alias("supported"), F.max("confidence").alias("confidence"))


def counts(f: DataFrame, notes: DataFrame) -> DataFrame:
    """Contingency numbers of each note: tp, fp, fn; (un)supported and right sg, ug; (un)supported st, ut. No judgement counts as unsupported."""
    s = F.coalesce("supported", F.lit(False))
    g, p = F.col("in_gold"), F.col("in_pred")
    c = f.groupBy("note").agg(
        F.count_if(g & p).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(g & ~p).alias("fn"),
        F.count_if(p & g & s).alias("sg"), F.count_if(p & s).alias("st"), F.count_if(p & g & ~s).alias("ug"), F.count_if(p & ~s).alias("ut"),
    )
    return notes.select("note").join(c, "note", "left").fillna(0)


def micro(f: DataFrame) -> list[Column]:
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return [F.round(safe_ratio(tp, tp + fp), 6).alias("micro_p"), F.round(safe_ratio(tp, tp + fn), 6).alias("micro_r"), F.round(f1(tp, fp, fn), 6).alias("micro_f1")]


def micro_macro(f: DataFrame, universe: DataFrame) -> DataFrame:
    """Micro and macro precision, recall and F1; macro over all labels of the universe, absent ones as 0."""
    per = f.join(universe.select("code").distinct(), "code", "right").groupBy("code").agg(
        F.count_if(F.expr("in_gold and in_pred")).alias("tp"), F.count_if(F.expr("in_pred and not in_gold")).alias("fp"), F.count_if(F.expr("in_gold and not in_pred")).alias("fn")
    )
    p, r, f_ = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")), f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return per.agg(*micro(per), F.round(F.avg(p), 6).alias("macro_p"), F.round(F.avg(r), 6).alias("macro_r"), F.round(F.avg(f_), 6).alias("macro_f1"), F.count("*").alias("labels"))


def set_metrics(c: DataFrame, n_labels: int | Column) -> DataFrame:
    """Hamming loss, exact match and label-ranking average precision of binary predictions, from note counts."""
    m = F.lit(n_labels)
    h, p, g = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    lrap = F.when((g == 0) | (g == m), 1.0).otherwise((F.when(h > 0, h * h / p).otherwise(0.0) + (g - h) * (g / m)) / g)
    return c.agg(F.round(F.sum(F.col("fp") + F.col("fn")) / (F.count("*") * F.max(m)), 8).alias("hamming"), F.round(F.avg((F.expr("fp = 0 and fn = 0")).cast("int")), 6).alias("exact_match"), F.round(F.avg(lrap), 6).alias("lrap"), F.count("*").alias("notes"))


def at_k(f: DataFrame, notes: DataFrame, ks: list[int]) -> DataFrame:
    """P@k over all notes (hits by what was emitted, 0 where nothing was) and R@k over notes with gold codes."""
    aggs, outs = [], []
    for k in ks:
        aggs += [F.count_if((F.col("rank") <= k) & F.col("in_gold")).alias(f"h{k}"), F.count_if(F.col("rank") <= k).alias(f"e{k}")]
        outs += [F.round(F.avg(safe_ratio(F.col(f"h{k}"), F.col(f"e{k}"))), 6).alias(f"p_at_{k}"), F.round(F.avg(F.when(F.col("g") > 0, F.col(f"h{k}") / F.col("g"))), 6).alias(f"r_at_{k}")]
    return notes.select("note").join(f.groupBy("note").agg(F.count_if("in_gold").alias("g"), *aggs), "note", "left").fillna(0).agg(*outs)


def to_parents(f: DataFrame) -> DataFrame:
    """The facts one level up: categories of three characters; predicted ones are ranked anew by the best rank of their codes."""
    p = f.groupBy("note", F.substring(F.upper(F.replace("code", F.lit("."), F.lit(""))), 1, 3).alias("code")).agg(
        F.bool_or("in_gold").alias("in_gold"), F.bool_or("in_pred").alias("in_pred"), F.min("rank").alias("best"), F.bool_or("supported").alias("supported"), F.max("confidence").alias("confidence")
    )
    rank = F.row_number().over(Window.partitionBy("note").orderBy(F.asc_nulls_last("best")))
    return p.withColumn("rank", F.when(F.col("in_pred"), rank)).drop("best")


def classification(f: DataFrame, notes: DataFrame, universe: DataFrame | None = None, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row of all classification metrics; without a universe the labels are those of either side. Without notes or labels: Hamming loss 1, the rest 0.

    Two aggregates over the facts: by label (micro, macro, coverage) and by note (sets, precision and recall at k); codes outside the universe count at k only.
    """
    hit, extra, lack = F.expr("in_gold and in_pred"), F.expr("in_pred and not in_gold"), F.expr("in_gold and not in_pred")
    sums = [F.count_if(hit).alias("tp"), F.count_if(extra).alias("fp"), F.count_if(lack).alias("fn")]
    per = f.groupBy("code").agg(*sums)
    inside = F.lit(True)
    if universe is not None:
        u = universe.select("code").distinct()
        per = per.join(u, "code", "right").fillna(0, ["tp", "fp", "fn"])
        f, inside = f.join(u.withColumn("_in", F.lit(True)), "code", "left"), F.coalesce("_in", F.lit(False))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    macro = {"macro_p": safe_ratio(tp, tp + fp), "macro_r": safe_ratio(tp, tp + fn), "macro_f1": f1(tp, fp, fn)}
    labels = per.agg(*micro(per), *(F.round(F.avg(v), 6).alias(k) for k, v in macro.items()), F.count("*").alias("labels"), F.count_if(tp + fp > 0).alias("predicted"))
    labels = labels.withColumn("label_coverage", F.round(safe_ratio(F.col("predicted"), F.col("labels")), 6)).drop("predicted")

    rows = f.select("note", "rank", "in_gold", *(F.coalesce(inside & c, F.lit(False)).alias(n) for n, c in (("hit", hit), ("extra", extra), ("lack", lack))))
    none = [F.lit(None).cast("int").alias("rank"), *(F.lit(False).alias(c) for c in ("in_gold", "hit", "extra", "lack"))]
    at = [x for k in ks for x in (F.count_if((F.col("rank") <= k) & F.col("in_gold")).alias(f"h{k}"), F.count_if(F.col("rank") <= k).alias(f"e{k}"))]
    own = rows.unionByName(notes.select("note", *none)).groupBy("note").agg(F.count_if("hit").alias("tp"), F.count_if("extra").alias("fp"), F.count_if("lack").alias("fn"), F.count_if("in_gold").alias("g"), *at)
    m = labels.select(F.col("labels").alias("m"))
    h, p, g = tp, tp + fp, tp + fn
    lrap = F.when((g == 0) | (g == F.col("m")), 1.0).otherwise((F.when(h > 0, h * h / p).otherwise(0.0) + (g - h) * (g / F.col("m"))) / g)
    ratios = [x for k in ks for x in (F.round(F.avg(safe_ratio(F.col(f"h{k}"), F.col(f"e{k}"))), 6).alias(f"p_at_{k}"), F.round(F.avg(F.when(F.col("g") > 0, F.col(f"h{k}") / F.col("g"))), 6).alias(f"r_at_{k}"))]
    sets = own.crossJoin(F.broadcast(m)).agg(  # one row
        F.round(F.when(F.max("m") > 0, F.sum(fp + fn) / (F.count("*") * F.max("m"))), 8).alias("hamming"), F.round(F.avg(F.expr("fp = 0 and fn = 0").cast("int")), 6).alias("exact_match"), F.round(F.avg(lrap), 6).alias("lrap"), *ratios, F.count("*").alias("notes"),
    )
    out = labels.crossJoin(sets)  # one row each
    empty = (F.col("notes") == 0) | (F.col("labels") == 0)
    values = [c for c in out.columns if c not in ("notes", "labels")]
    return out.select(*(F.when(empty, F.lit(1.0 if c == "hamming" else 0.0)).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in values), "notes", "labels")


def melted(row: DataFrame, group: str) -> DataFrame:
    """(group, metric, value) of a row of numbers."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns))).alias("x")
    return row.select(F.lit(group).alias("group"), each).select("group", "x.*")


def suite(f: DataFrame, notes: DataFrame, universe: DataFrame, codes: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """(group, metric, value): the whole evaluation of a run. ``f``: its facts; ``codes``: its code records; ``records``: one record a note.

    All groups read the facts from the same shuffle by note; categories and counts of a note need no other.
    """
    parts = {"classification": classification(f, notes, universe), "hierarchical": classification(to_parents(f), notes), "hierarchical_error": hierarchical_error(f), "lift": lift(counts(f, notes))}
    if codes is not None:
        parts["reliability"] = reliability(codes)
    if records is not None:
        right = f.groupBy("note").agg(F.count_if(F.expr("in_gold and in_pred")).alias("correct"))
        parts["cost"] = cost(records.join(right, "note", "left").fillna(0, ["correct"]))
        if codes is not None:
            parts["errors"] = error_rates(records, codes.agg(F.count_if("json_parse_error").alias("errors")))
    out = None
    for k, v in parts.items():
        out = melted(v, k) if out is None else out.unionByName(melted(v, k))
    return out


def hierarchical_error(f: DataFrame) -> DataFrame:
    """Of the wrong codes, the share whose category is one of the note's gold categories."""
    cat = F.substring("code", 1, 3)
    fam = F.bool_or("in_gold").over(Window.partitionBy("note", cat))
    wrong = f.withColumn("near", fam).where("in_pred and not in_gold")
    return wrong.agg(F.count("*").alias("wrong"), F.count_if("near").alias("near"), F.round(safe_ratio(F.count_if("near"), F.count("*")), 6).alias("hierarchical_error_rate"))


def reliability(codes: DataFrame) -> DataFrame:
    """One row of the reliability ratios of code records; fields that a run hasn't may be absent.

    Support is a share of the judged codes, verbatim quotes of those that were checked (a stored verdict, else the quote against the preview; never for a mock model);
    both are null where the base is empty. The others are shares of all codes, 0 without codes.
    """
    have = set(codes.columns)
    col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    text = lambda c: F.coalesce(col(c, "string"), F.lit(""))
    flag = lambda c, v: F.coalesce(col(c, "boolean") == v, F.lit(False))
    rejected = F.coalesce(F.size(col("rejected_similar_codes", "array<string>")), F.lit(0)) > 0
    fallback, n, judged = flag("contrastive_fallback_used", True), F.count("*"), F.count("supported")
    checked = F.when(~flag("mock_llm", True), F.coalesce(col("evidence_quote_verbatim", "boolean"), verbatim(col("evidence_quote", "string"), col("evidence_preview", "string"))))
    shares = {
        **{name: col("risk_flag", "string") == risk for name, risk in (("weak_evidence_rate", "weak_evidence"), ("ambiguous_code_rate", "ambiguous"), ("hallucination_flag_rate", "possible_hallucination"))},
        "rationale_coverage_rate": text("rationale") != "", "evidence_quote_rate": (text("evidence_quote") != "") | (text("evidence_preview") != ""),
        "contrastive_rationale_rate": text("contrastive_rationale") != "", "rejected_similar_codes_rate": rejected, "contrastive_fallback_rate": fallback,
        "llm_contrastive_rate": ~fallback & (rejected | (text("contrastive_rationale") != "")), "schema_invalid_rate": flag("schema_valid", False), "json_parse_error_rate": flag("json_parse_error", True),
        "confidence_missing_rate": F.col("confidence").isNull(),
    }
    part = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return codes.withColumn("_checked", checked).agg(
        n.alias("total_predicted_codes"), judged.alias("evidence_judged_codes"), part(F.count_if("supported"), judged).alias("evidence_support_rate"), part(F.count_if(~F.col("supported")), judged).alias("unsupported_code_rate"),
        F.count("_checked").alias("evidence_quote_checked_codes"), part(F.count_if("_checked"), F.count("_checked")).alias("evidence_quote_verbatim_rate"),
        *(F.coalesce(part(F.count_if(v), n), F.lit(0.0)).alias(k) for k, v in shares.items()),
    )


def quote_compliance(codes: DataFrame, arm: Column) -> DataFrame:
    """Exact-quote compliance of each arm: of the codes with a stored verdict, the share whose quote is verbatim. Mock codes don't count."""
    real = codes.where(~F.coalesce("mock_llm", F.lit(False)))
    v = F.col("evidence_quote_verbatim")
    return real.groupBy(arm.alias("arm")).agg(F.countDistinct("note").alias("notes"), F.count("*").alias("codes"), F.count(v).alias("checked"), F.count_if(v).alias("verbatim"), F.round(F.when(F.count(v) > 0, F.count_if(v) / F.count(v)), 4).alias("rate"))


def cost(records: DataFrame) -> DataFrame:
    """One row of run times, tokens, memory and cost per right code (column ``correct``); 0 where a field is never given."""
    n, right = F.count("*"), F.sum("correct")
    zero = lambda x, d=6: F.coalesce(F.round(x, d), F.lit(0.0))
    tokens = F.coalesce(F.sum("token_count_input"), F.lit(0)) + F.coalesce(F.sum("token_count_output"), F.lit(0))
    out = [n.alias("n_samples"), zero(F.avg("runtime_sec")).alias("avg_runtime_sec"), zero(F.sum("runtime_sec"), 4).alias("total_runtime_sec"), zero(F.percentile("runtime_sec", F.lit(0.95))).alias("p95_runtime_sec")]
    for k in ("input", "output"):
        out += [zero(F.avg(f"token_count_{k}")).alias(f"avg_{k}_tokens"), zero(F.sum(f"token_count_{k}").cast("double")).alias(f"total_{k}_tokens")]
    out += [zero(F.avg("gpu_memory_mb")).alias("avg_gpu_memory_mb"), zero(F.max("gpu_memory_mb")).alias("peak_gpu_memory_mb")]
    return records.agg(*out, zero(F.when(right > 0, F.sum("runtime_sec") / right)).alias("runtime_per_correct_code"), zero(F.when(right > 0, tokens / right)).alias("tokens_per_correct_code"))


def error_rates(records: DataFrame, json_errors: DataFrame) -> DataFrame:
    """Shares of failed, out-of-memory, skipped and good records, and code records with JSON errors (one row: ``errors``) by sample."""
    n, t = F.count("*"), lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    share = lambda x: F.round(x / n, 6)
    one = records.agg(n.alias("n"), share(t("failed")).alias("failed_sample_rate"), share(t("cuda_oom")).alias("cuda_oom_rate"), share(t("skipped")).alias("skipped_rate"), share(n - t("failed") - t("skipped")).alias("success_rate"))
    return one.crossJoin(json_errors).withColumn("json_parse_error_rate", F.round(F.col("errors") / F.greatest("n", F.lit(1)), 6)).drop("errors")


def confusion_pairs(f: DataFrame) -> DataFrame:
    """(pred, gold, n): wrong codes with gold codes of the same category of the note."""
    wrong = f.where("in_pred and not in_gold").select("note", F.col("code").alias("pred"), F.substring("code", 1, 3).alias("cat"))
    right = f.where("in_gold").select("note", F.col("code").alias("gold"), F.substring("code", 1, 3).alias("cat"))
    return wrong.join(right, ["note", "cat"]).groupBy("pred", "gold").agg(F.count("*").alias("n"))


def parent_matrix(f: DataFrame, top: int = 20) -> DataFrame:
    """(gold_parent, pred_parent, n) among the most frequent gold categories, off the diagonal, the ``top`` largest."""
    p = to_parents(f)
    head = p.where("in_gold").groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(top).select("code")
    g = p.where("in_gold").join(F.broadcast(head), "code").select("note", F.col("code").alias("gold_parent"))  # ``top`` rows
    q = p.where("in_pred").join(F.broadcast(head), "code").select("note", F.col("code").alias("pred_parent"))
    return g.join(q, "note").where("gold_parent <> pred_parent").groupBy("gold_parent", "pred_parent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold_parent", "pred_parent").limit(top)


def lift(c: DataFrame) -> DataFrame:
    """How much likelier a supported code is right than an unsupported one; null where a base is 0."""
    sg, st, ug, ut = (F.sum(x) for x in ("sg", "st", "ug", "ut"))
    return c.agg(F.round(F.when((st > 0) & (ut > 0) & (ug > 0), (sg / st) / (ug / ut)), 6).alias("lift"), sg.alias("sg"), st.alias("st"), ug.alias("ug"), ut.alias("ut"))


def bands(f: DataFrame, order: DataFrame, n_bands: int = 5) -> DataFrame:
    """Scores with both sides restricted to bands of label frequency; the last band takes the rest. ``order``: (code, pos) from 0."""
    size = order.agg(F.floor(F.count("*") / n_bands).alias("size"))
    of = order.crossJoin(F.broadcast(size)).select("code", F.least(F.lit(n_bands - 1), F.floor(F.col("pos") / F.greatest(F.lit(1), F.col("size")))).cast("int").alias("band"))
    b = f.join(of, "code").groupBy("band").agg(F.count_if(F.expr("in_gold and in_pred")).alias("tp"), F.count_if(F.expr("in_pred and not in_gold")).alias("fp"), F.count_if(F.expr("in_gold and not in_pred")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return b.select("band", "tp", "fp", "fn", F.round(f1(tp, fp, fn), 6).alias("f1"))


def seed_stats(long: DataFrame) -> DataFrame:
    """Mean, sample deviation (0 for one seed), least, greatest and number of finite values by run and metric."""
    v = F.col("value")
    ok = long.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return ok.groupBy("run", "metric").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def total_variation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the summed difference of two label distributions."""
    p, q = (x.groupBy("code").agg(F.count("*").alias(k)) for x, k in ((a, "n"), (b, "m")))
    j = p.join(q, "code", "full").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    t = j.agg(F.sum("n").alias("tn"), F.sum("m").alias("tm"))
    return j.crossJoin(F.broadcast(t)).agg(F.round(F.sum(F.abs(F.col("n") / F.col("tn") - F.col("m") / F.col("tm"))) / 2, 6).alias("total_variation"))
