"""Structured scores: parsing, alignment, evidence constraint, families, fallback pools, the deterministic scorer, record assembly."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_bool, as_confidence, has_confidence, overlap

ITEM = "array<struct<code:string,supported:string,confidence:string,q:string,r:string,evidence_quote:string,rationale:string,risk_flag:string>>"
FLAGS = ["none", "weak_evidence", "ambiguous", "unsupported", "similar_code"]  # fixed values


def _stages(text: Column) -> Column:
    """struct(stage, items) of the first parser stage that reads the answer (its fenced block, where it has one): the whole as a list or an object, the outermost list, the outermost object. Null where none does."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)```", 1)
    body = F.regexp_replace(F.when(fenced != "", fenced).otherwise(text), r"^\s+|\s+$", "")
    valid = lambda t: F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1  # one value and nothing behind it
    many = lambda t: F.when(t.startswith("[") & valid(t), F.from_json(t, ITEM))
    one = lambda t: F.when(t.startswith("{") & valid(t), F.array(F.from_json(t, ITEM.removeprefix("array<").removesuffix(">"))))
    cut = lambda open_, close: F.regexp_extract(body, rf"(?s)(\{open_}.*\{close})", 1)
    tries = [("whole", many(body)), ("whole", one(body)), ("list", many(cut("[", "]"))), ("object", one(cut("{", "}")))]
    return F.coalesce(*(F.when(x.isNotNull(), F.struct(F.lit(k).alias("stage"), x.alias("items"))) for k, x in tries))


def parse_items(text: Column) -> Column:
    """The items of a scorer's answer; null where no parser stage reads it."""
    return _stages(text)["items"]


def parse_answers(answers: DataFrame, text: str) -> DataFrame:
    """The rows with ``stage`` and ``items``; only what no native stage reads is searched for complete objects (``salvage``). Without any: stage none and no items."""
    x = answers.withColumn("_x", _stages(F.col(text)))
    read = x.where("_x is not null").select(*answers.columns, "_x.stage", "_x.items")
    rest = x.where("_x is null").drop("_x").withColumn("_o", salvage(text))
    fields = [f.split(":")[0] for f in ITEM.removeprefix("array<struct<").removesuffix(">>").split(",")]
    items = F.transform("_o", lambda o: F.struct(*(o[f].alias(f) for f in fields)))
    return read.unionByName(rest.select(*answers.columns, F.when(F.size("_o") > 0, "salvage").otherwise("none").alias("stage"), items.alias("items")))


def salvage_objects(text: str) -> list[dict]:
    """The complete JSON objects of a damaged answer, found with a string-aware stack of braces."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text or ""):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    got = json.loads(text[start : i + 1])
                except ValueError:
                    continue
                if isinstance(got, dict):
                    out.append(got)
    return out


def salvage(text: Column | str) -> Column:
    """``salvage_objects`` for a column, in Arrow batches; only for answers that no parser stage reads."""

    def each(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [{k: (v if isinstance(v, str) else json.dumps(v)) for k, v in o.items()} for o in salvage_objects(x)])

    return F.pandas_udf(each, "array<map<string,string>>")(text)


def coerce(item: Column) -> Column:
    """An item with typed fields: three-valued support, clamped confidence and whether there was one, allowed flags only."""
    flag = F.lower(F.trim(item["risk_flag"]))
    return F.struct(
        item["code"].alias("code"), as_bool(item["supported"]).alias("supported"), as_confidence(item["confidence"]).alias("confidence"), has_confidence(item["confidence"]).alias("confidence_present"),
        F.coalesce(item["evidence_quote"], item["q"], F.lit("")).alias("evidence_quote"), F.coalesce(item["rationale"], item["r"], F.lit("")).alias("rationale"),
        F.when(flag.isin(*FLAGS), flag).otherwise(F.lit("none")).alias("risk_flag"), (item["code"].isNotNull() & item["supported"].isNotNull() & has_confidence(item["confidence"])).alias("schema_valid"),
    )


def align(candidates: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """Candidates with the last item of each code (``items``: key..., pos, item); defaults where there is none."""
    last = items.groupBy(*key).agg(F.max_by("item", "pos").alias("item"))
    return candidates.join(last, key, "left").select(*candidates.columns, F.col("item.supported").alias("supported"), F.coalesce("item.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("item.confidence_present", F.lit(False)).alias("confidence_present"))


def null_aware_rank(by: str = "note") -> Column:
    """Supported first, then with confidence, then by falling confidence, then by the candidate's rank."""
    order = [F.when(F.coalesce("supported", F.lit(False)), 0).otherwise(1), F.when(F.col("confidence").isNotNull(), 0).otherwise(1), F.coalesce(-F.col("confidence"), F.lit(0.0)), F.col("rank")]
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))


def keep_threshold(pred: DataFrame, least: float, min_final: int, by: str = "note") -> DataFrame:
    """Codes of at least ``least`` confidence or without one; where fewer than ``min_final`` remain, the first ``min_final``."""
    passes = F.col("confidence").isNull() | (F.col("confidence") >= least)
    kept = F.count_if(passes).over(Window.partitionBy(by))
    return pred.withColumn("_p", passes).withColumn("_k", kept).where(F.col("_p") & (F.col("_k") >= min_final) | (F.col("_k") < min_final) & (F.col("rank") <= min_final)).drop("_p", "_k")


def constrain(pred: DataFrame, least: float, mode: str = "filter", score: str = "confidence", judged: bool = True) -> DataFrame:
    """Without ``judged`` only weak evidence counts, not the scorer's judgement. ``score`` is the column of the evidence score. Weak or unsupported codes are dropped (``filter``) or marked unsupported with a risk flag (``flag``)."""
    weak = F.coalesce(F.col(score) < least, F.lit(False))
    bad = weak | ~F.coalesce("supported", F.lit(False)) if judged else weak
    if mode == "filter":
        return pred.where(~bad)
    return pred.withColumn("risk_flag", F.when(weak, "weak_evidence").when(bad, "ambiguous").otherwise("none")).withColumn("supported", F.when(bad, False).otherwise(F.col("supported")))


def borderline(pred: DataFrame, margin: float = 0.2) -> DataFrame:
    """(note, family, best, runner_up): families of two codes or more whose two best both have a confidence, at most ``margin`` apart."""
    fam = pred.withColumn("family", F.substring("code", 1, 3))
    w = Window.partitionBy("note", "family").orderBy(F.desc_nulls_last("confidence"), "code")
    two = fam.select("note", "family", "code", "confidence", F.row_number().over(w).alias("r"), F.lead("code").over(w).alias("runner_up"), F.lead("confidence").over(w).alias("c2")).where("r = 1")
    return two.where(F.col("confidence").isNotNull() & F.col("c2").isNotNull() & (F.round(F.col("confidence") - F.col("c2"), 9) <= margin)).select("note", "family", F.col("code").alias("best"), "runner_up")


def drop_runner_ups(pred: DataFrame, margin: float = 0.2) -> DataFrame:
    """``drop_rejected`` of the runners-up of ``borderline``, by one window of a note's families."""
    w = Window.partitionBy("note", F.substring("code", 1, 3)).orderBy(F.desc_nulls_last("confidence"), "code")
    ranked = pred.withColumn("_r", F.row_number().over(w)).withColumn("_best", F.lag("confidence").over(w))
    close = (F.col("_r") == 2) & F.col("_best").isNotNull() & F.col("confidence").isNotNull() & (F.round(F.col("_best") - F.col("confidence"), 9) <= margin)
    return ranked.where(~F.coalesce(close, F.lit(False))).drop("_r", "_best")


def drop_rejected(pred: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Predictions without the codes that a verifier rejected. ``verdicts``: (note, rejected)."""
    return pred.join(verdicts.select("note", F.col("rejected").alias("code")).distinct(), ["note", "code"], "left_anti")


def fallback_pool(preferred: DataFrame, sources: list[DataFrame], most: int = 3) -> DataFrame:
    """(note, code, pool_rank): the codes of several sources (note, code, order), earlier sources first, each code once, without the preferred."""
    all_ = None
    for i, s in enumerate(sources):
        s = s.select("note", "code", F.lit(i).alias("src"), "order")
        all_ = s if all_ is None else all_.unionByName(s)
    once = all_.groupBy("note", "code").agg(F.min(F.struct("src", "order")).alias("at")).join(preferred.select("note", "code"), ["note", "code"], "left_anti")
    r = F.row_number().over(Window.partitionBy("note").orderBy("at", "code"))
    return once.withColumn("pool_rank", r).where(F.col("pool_rank") <= most).select("note", "code", "pool_rank")


def mock_score(title: Column, evidence: Column) -> tuple[Column, Column]:
    """(confidence, supported) of the deterministic stand-in scorer: word overlap of the title with the evidence."""
    return mock_score_of(overlap(title, evidence))


def mock_score_of(o: Column) -> tuple[Column, Column]:
    """(confidence, supported) from the share of the title's words that the evidence has."""
    return F.round(F.least(F.lit(0.95), 0.35 + 0.8 * o), 3), o >= 0.15


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The slot for a model: ``scorer`` maps Arrow batches; a batch that fails yields its rows with ``error_type`` set, if the schema has it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield scorer(b)
            except Exception as e:  # the model's failure is a result of the row, not of the job
                if "error_type" not in schema:
                    raise
                yield b.assign(error_type=type(e).__name__)

    return df.mapInPandas(run, schema)


def assemble(pred: DataFrame) -> DataFrame:
    """(note, codes, confidence, risk_flags, rationale): codes in rank order, the highest confidence, the sorted distinct flags, the first rationale that isn't blank ('' where there is none)."""
    said = F.coalesce(F.col("rationale"), F.lit("")) if "rationale" in pred.columns else F.lit("")
    return pred.groupBy("note").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("codes"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(F.when(F.col("risk_flag") != "none", F.col("risk_flag")))).alias("risk_flags"),
        F.coalesce(F.min_by(said, F.when(F.trim(said) != "", F.col("rank"))), F.lit("")).alias("rationale"),
    )


def zero_shot(answers: DataFrame, text: str, labels: DataFrame | None = None, confidence: float = 0.8) -> DataFrame:
    """(note, code, confidence, supported, rank): a model's list of codes as predictions of constant confidence, each code once in the order of its first mention; with ``labels`` (code) only those of the closed set."""
    codes = answers.select("note", F.posexplode(verifier_codes(F.col(text))).alias("pos", "code")).groupBy("note", "code").agg(F.min("pos").alias("pos"))
    if labels is not None:
        codes = codes.join(labels.select("code").distinct(), "code", "left_semi")
    return codes.select("note", "code", F.lit(confidence).alias("confidence"), F.lit(True).alias("supported"), F.row_number().over(Window.partitionBy("note").orderBy("pos")).alias("rank"))


def verifier_codes(text: Column) -> Column:
    """The codes of a verifier's list, whose items are objects with a code or plain strings."""
    raw = F.from_json(text, "array<string>")
    return F.filter(F.transform(raw, lambda i: F.coalesce(F.get_json_object(i, "$.code"), i)), lambda c: c.isNotNull() & (c != ""))
