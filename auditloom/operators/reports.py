"""Guards and tables of reports: schema checks, cells, stated numbers, text scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

# The fields that a stored record, each of its codes, and each code of a contrastive run must have.
RECORD_FIELDS = ["subject_id", "hadm_id", "experiment_id", "seed", "gold_codes", "predicted_codes", "runtime_sec", "config_hash"]
CODE_FIELDS = ["code", "confidence", "supported", "evidence_score", "icd_description", "rationale", "risk_flag"]
CONTRASTIVE_FIELDS = ["contrastive_rationale", "rejected_similar_codes", "contrastive_confidence", "contrastive_fallback_used"]
CONTRASTIVE_RUNS = ["E13", "E14"]


def schema_violations(records: DataFrame) -> DataFrame:
    """(experiment, field, violations, checked) of stored records (run, json): a field counts as missing where the record's JSON has no such key.

    Records are read as JSON text, since a typed reader can't tell a missing key from a null.
    """
    experiment = F.split_part("run", F.lit("_seed"), F.lit(1))
    rows = records.select(experiment.alias("experiment"), F.json_object_keys("json").alias("keys"), F.get_json_object("json", "$.predicted_codes").alias("codes"))
    own = rows.select("experiment", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (~F.array_contains("keys", f)).alias("bad")) for f in RECORD_FIELDS))).alias("x"))
    listed = rows.select("experiment", F.struct(F.lit("predicted_codes is a list").alias("field"), (F.array_contains("keys", "predicted_codes") & F.from_json("codes", "array<string>").isNull()).alias("bad")).alias("x"))
    codes = rows.select("experiment", F.explode(F.from_json("codes", "array<string>")).alias("code")).withColumn("keys", F.json_object_keys("code"))
    shown = lambda f: F.coalesce(F.get_json_object("code", f"$.{f}"), F.lit("")) != ""
    checks = [F.struct(F.lit(f).alias("field"), (~F.array_contains("keys", f)).alias("bad")) for f in CODE_FIELDS]
    checks.append(F.struct(F.lit("evidence_preview/evidence_quote").alias("field"), (~(shown("evidence_preview") | shown("evidence_quote"))).alias("bad")))
    each = codes.select("experiment", F.explode(F.array(*checks)).alias("x"))
    contrast = codes.where(F.col("experiment").isin(CONTRASTIVE_RUNS)).select("experiment", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (~F.array_contains("keys", f)).alias("bad")) for f in CONTRASTIVE_FIELDS))).alias("x"))
    out = own.unionByName(listed).unionByName(each).unionByName(contrast)
    return out.groupBy("experiment", "x.field").agg(F.count_if(F.coalesce("x.bad", F.lit(True))).alias("violations"), F.count("*").alias("checked"))


def cell(mean: Column, std: Column, n: Column) -> Column:
    """A table cell: mean and deviation, the mean alone for one seed, a dash where there is none."""
    return F.when(mean.isNull(), "—").when(n > 1, F.format_string("%.4f ± %.4f", mean, F.coalesce(std, F.lit(0.0)))).otherwise(F.format_string("%.4f", mean))


def holds(value: Column, stated: Column, decimals: Column) -> Column:
    """Does the value, rounded half up or half even to as many decimals, give the stated number?"""
    scale = F.pow(F.lit(10.0), decimals)
    near = lambda x: F.abs(x / scale - stated) < 0.1 / scale
    return F.coalesce(near(F.round(value * scale, 0)) | near(F.bround(value * scale, 0)), F.lit(False))


def nodes(records: DataFrame, key: str, json: str = "json") -> DataFrame:
    """(key, parts, value, leaf): every object, list and scalar of each record's JSON, by the keys (and list places) that lead to it.

    One step a level of nesting, as many as the deepest record has; each level is written once. ``value`` is the JSON text. A record that isn't JSON has no rows.
    """
    scratch = Scratch(records.sparkSession, "json")
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    is_object, is_list = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    entry = lambda k, x: F.struct(k.alias("k"), F.to_json(x).alias("value"))
    of_object = F.transform(F.map_entries(F.when(is_object, v).cast("map<string,variant>")), lambda e: entry(e["key"], e["value"]))
    of_list = F.transform(F.when(is_list, v).cast("array<variant>"), lambda x, i: entry(i.cast("string"), x))
    level = records.select(F.col(key).alias("key"), F.array().cast("array<string>").alias("parts"), F.col(json).alias("value")).where(v.isNotNull())
    out = None
    while True:
        level = scratch.save(level.withColumn("leaf", ~(is_object | is_list)), "level")
        out = level if out is None else out.unionByName(level)
        inner = level.where("not leaf")
        if not inner.limit(1).count():
            return out
        level = inner.select("key", "parts", F.explode(F.coalesce(of_object, of_list)).alias("e")).select("key", F.concat("parts", F.array("e.k")).alias("parts"), F.col("e.value").alias("value"))


def flatten(records: DataFrame, key: str, json: str = "json", lists: bool = False) -> DataFrame:
    """(key, metric, value): the scalars of nested records by dotted key, values as JSON text. ``lists``: go into lists too, by place from 0; else they are left out.

    Keys that hold dots stay as they are, so a dotted key may stand for several ways down; each is a row.
    """
    every = nodes(records, key, json)
    n = every.where("leaf and size(parts) > 0")
    if not lists:
        inside = every.where("not leaf").where(F.col("value").startswith("[")).select("key", F.col("parts").alias("_list"))
        n = n.alias("n").join(inside.alias("l"), (F.col("n.key") == F.col("l.key")) & (F.slice("n.parts", 1, F.size("l._list")) == F.col("l._list")), "left_anti")
    return n.select("key", F.array_join("parts", ".").alias("metric"), "value")


def get(records: DataFrame, key: str, paths: list[str], json: str = "json") -> DataFrame:
    """(key, path, value): dotted paths looked up in each record by the greedy rule, null where it finds nothing.

    Among the keys of an object that the rest of the path begins with, the longest is taken, whether or not the way ends there; list places are numbers.
    """
    v, rest = F.col("_v"), F.col("_rest")
    kind = F.schema_of_variant(v)
    entry = lambda k, x: F.struct(k.alias("k"), x.alias("v"))
    of_object = F.transform(F.map_entries(F.when(kind.startswith("OBJECT"), v).cast("map<string,variant>")), lambda e: entry(e["key"], e["value"]))
    of_list = F.transform(F.when(kind.startswith("ARRAY"), v).cast("array<variant>"), lambda x, i: entry(i.cast("string"), x))
    on_way = F.filter("_e", lambda e: (e["k"] == rest) | rest.startswith(F.concat(e["k"], F.lit("."))))
    # One step a level down, as many as the longest path has parts; each record is parsed once and stays in its row.
    at = records.select(F.col(key).alias("key"), F.try_parse_json(json).alias("_v")).withColumn("_e", F.coalesce(of_object, of_list))
    at = at.select("key", "_e", F.explode(F.array(*map(F.lit, paths))).alias("path")).withColumn("_rest", F.col("path")).withColumn("value", F.lit(None).cast("string"))
    for level in range(max((p.count(".") for p in paths), default=0) + 1):
        if level:
            at = at.withColumn("_e", F.when(rest.isNotNull(), F.coalesce(of_object, of_list)))
        most = F.array_max(F.transform("_w", lambda e: F.length(e["k"])))
        at = at.withColumn("_w", on_way).withColumn("_t", F.get(F.filter("_w", lambda e: F.length(e["k"]) == most), F.lit(0)))
        at = at.select("key", "path", F.col("_t.v").alias("_v"), F.when(F.col("_t.k") == rest, F.to_json("_t.v")).otherwise(F.col("value")).alias("value"), F.when(F.col("_t.k") != rest, F.substring(rest, F.length("_t.k") + 2, F.length(rest))).alias("_rest"))
    return at.select("key", "path", "value")


def by_path(metrics: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, value): dotted paths looked up in flattened metrics (metric, value); of a path with dots in its keys the whole key counts. Null where there is none."""
    return paths.select("path").join(metrics.select(F.col("metric").alias("path"), "value"), "path", "left")


def scan(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(name, documents, hits, first_id) of each pattern (name, pattern) over texts (doc_id, text). The patterns are a small table, collected to build one pass over the texts; more than 1,000 are refused."""
    rows = patterns.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a scan takes at most 1000 patterns")
    found = [F.struct(F.lit(r.name).alias("name"), F.size(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias("k")) for r in rows]
    x = texts.select("doc_id", F.explode(F.array(*found)).alias("x")).select("doc_id", "x.name", F.greatest("x.k", F.lit(0)).alias("k"))
    return x.groupBy("name").agg(F.count_if(F.col("k") > 0).alias("documents"), F.sum("k").cast("long").alias("hits"), F.min(F.when(F.col("k") > 0, F.col("doc_id"))).alias("first_id"))
