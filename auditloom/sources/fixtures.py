"""Coding fixtures derived from the driver's star schema: labels, gold codes, predictions, splits.

``SQL`` states the same derivations for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import u32

KINDS = {"ECONOMY": "0", "LARGE": "1", "MEDIUM": "2", "PROMO": "3", "SMALL": "4", "STANDARD": "5"}
TASK_ROWS = 250_000  #: lines that a task sorts, aggregates and ranks by note


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, rows: int | None = None) -> int:
    """Partitions of ``rows`` rows of a stored table (its count comes from the files' footers), so that a task's memory doesn't follow the table; small tables are dealt over the cores."""
    n, rows = df.count(), rows or TASK_ROWS
    return max(1, -(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-n * 10 // rows)))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, code, title) of each part."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.split_part("p_type", F.lit(" "), F.lit(1))]
    letter = F.substr(F.lit("ABCDE"), (F.col("p_size") % 5 + 1).cast("int"), F.lit(1))
    code = F.concat(letter, F.lpad(F.regexp_replace("p_brand", "[^0-9]", ""), 2, "0"), F.lit("."), kind)
    return table(spark, d, "part").select("p_partkey", code.alias("code"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("title"))


def knowledge_base(spark: SparkSession, d: str) -> DataFrame:
    """(code, title, parent, siblings): one row a code, the title of its smallest part."""
    one = labels(spark, d).groupBy("code").agg(F.min_by("title", "p_partkey").alias("title")).withColumn("parent", F.substring("code", 1, 3))
    family = F.array_sort(F.collect_set("code").over(Window.partitionBy("parent")))
    return one.select("code", "title", "parent", F.array_except(family, F.array("code")).alias("siblings"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    part = labels(spark, d).select("p_partkey", "code")
    return table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_orderkey", "note")


def by_note(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    """``df`` dealt by note to as many tasks as the lines need; joins, windows and aggregates by note keep that."""
    return df.repartition(tasks_for(table(spark, d, "lineitem")), "note")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (note, subject, code), dealt by note."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("note"), F.col("o_custkey").alias("subject"))
    codes = by_note(spark, d, lines(spark, d).where("l_discount <= 0.06").select("note", "code"))
    return codes.join(by_note(spark, d, orders), "note").select("note", "subject", "code").distinct()


KEEP = {"a": "l_quantity >= 15", "b": "l_tax <= 0.05", "c": "l_quantity < 30", "d": "l_tax >= 0.02", "e": "l_quantity >= 8", "f": "l_extendedprice >= 20000"}


def notes(spark: SparkSession, d: str) -> DataFrame:
    """All notes of which a run has a record, also those without gold or predicted codes."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("note"))


def predictions(spark: SparkSession, d: str, run: str = "a") -> DataFrame:
    """(note, code, confidence, supported, rank) of run a to f; c has no judgements."""
    keep = KEEP[run]
    rows = by_note(spark, d, lines(spark, d).where(keep).select("note", "code", "l_extendedprice", "l_returnflag", "l_linenumber")).groupBy("note", "code").agg((F.max("l_extendedprice") / 110000).alias("confidence"), F.bool_or(F.col("l_returnflag") != "N").alias("supported"), F.min("l_linenumber").alias("line"))
    rows = rows.select("note", "code", F.when(F.col("line") % 7 != 0, F.col("confidence")).alias("confidence"), (F.lit(None).cast("boolean") if run == "c" else F.col("supported")).alias("supported"))
    rank = F.row_number().over(Window.partitionBy("note").orderBy(F.desc_nulls_last("confidence"), "code"))
    return rows.withColumn("rank", rank)


def facts(spark: SparkSession, d: str, run: str = "a") -> DataFrame:
    """What ``gold`` and ``predictions`` of a run give as facts, in one pass over the lines and one shuffle by note."""
    keep = F.expr(KEEP[run])
    f = by_note(spark, d, lines(spark, d).select("note", "code", "l_discount", "l_extendedprice", "l_returnflag", "l_linenumber", keep.alias("k"))).groupBy("note", "code").agg(
        F.bool_or(F.col("l_discount") <= 0.06).alias("in_gold"), F.bool_or("k").alias("in_pred"), (F.max(F.when(F.col("k"), F.col("l_extendedprice"))) / 110000).alias("c"),
        F.bool_or(F.when(F.col("k"), F.col("l_returnflag") != "N")).alias("s"), F.min(F.when(F.col("k"), F.col("l_linenumber"))).alias("line"),
    ).where("in_gold or in_pred")
    f = f.select("note", "code", "in_gold", "in_pred", F.when(F.col("line") % 7 != 0, F.col("c")).alias("confidence"), (F.lit(None).cast("boolean") if run == "c" else F.col("s")).alias("supported"))
    rank = F.row_number().over(Window.partitionBy("note").orderBy(F.desc("in_pred"), F.desc_nulls_last("confidence"), "code"))
    return f.select("note", "code", "in_gold", "in_pred", F.when(F.col("in_pred"), rank).alias("rank"), "supported", "confidence")


def run_masks(spark: SparkSession, d: str, runs: dict[str, str]) -> DataFrame:
    """(note, code, mask) of the gold codes (bit 0) and of the runs a to f that ``runs`` names (bits 1 and on), and a row without code for each note."""
    keep = ["l_discount <= 0.06", *(KEEP[r] for r in runs.values())]
    mask = F.expr(" + ".join(f"if({k}, {1 << i}, 0)" for i, k in enumerate(keep)))
    none = notes(spark, d).select("note", F.lit(None).cast("string").alias("code"), F.lit(0).alias("mask"))
    return lines(spark, d).select("note", "code", mask.alias("mask")).unionByName(none)


def code_records(spark: SparkSession, d: str) -> DataFrame:
    """The codes of run a with the fields of stored records; ``x`` deals them to kinds."""
    r = predictions(spark, d).join(knowledge_base(spark, d).select("code", "title"), "code").withColumn("x", (F.col("note") * 7 + F.col("rank") * 3) % 20)
    x = F.col("x")
    return r.select(
        "note", "code", "supported", "confidence", "rank",
        F.when(x == 0, "weak_evidence").when(x == 1, "ambiguous").when(x == 2, "possible_hallucination").otherwise("none").alias("risk_flag"),
        F.col("title").alias("evidence_preview"),
        F.when(x % 4 == 0, "").when(x % 4 == 1, F.substring("title", 1, 8)).when(x % 4 == 2, F.upper(F.substring("title", 3, 9))).otherwise("not in the text").alias("evidence_quote"),
        F.when(x % 5 == 0, True).when(x % 5 == 1, False).alias("evidence_quote_verbatim"),
        F.when(x % 3 != 0, "r").otherwise("").alias("rationale"), F.when(x % 7 == 0, "c").otherwise("").alias("contrastive_rationale"),
        F.when(x % 6 > 0, F.array_repeat(F.col("code"), (x % 6).cast("int"))).alias("rejected_similar_codes"), (x % 10 == 3).alias("contrastive_fallback_used"),
        (x != 11).alias("schema_valid"), (x == 12).alias("json_parse_error"), (x == 13).alias("mock_llm"),
    )


def sample_records(spark: SparkSession, d: str) -> DataFrame:
    """One record a note with its costs and failures; some fields are missing."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("note"), F.round(F.col("o_totalprice") / 100000, 6).alias("runtime_sec"), F.when(F.col("o_orderstatus") != "P", k % 900 + 100).alias("token_count_input"),
        F.when(k % 11 != 0, k % 50).alias("token_count_output"), F.when(F.col("o_orderpriority").startswith("1"), (k % 100 + 1000).cast("double")).alias("gpu_memory_mb"),
        (k % 17 == 0).alias("failed"), (k % 34 == 0).alias("cuda_oom"), (k % 23 == 1).alias("skipped"),
    )


def split_of(subject: Column) -> Column:
    u = u32("42:split", subject) % 100
    return F.when(u < 70, "train").when(u < 85, "validation").otherwise("test")


def splits(spark: SparkSession, d: str) -> DataFrame:
    """(note, subject, split) of the notes with gold codes; subjects don't cross splits."""
    return gold(spark, d).select("note", "subject").distinct().withColumn("split", split_of(F.col("subject")))


_KIND = " ".join(f"when '{k}' then '{v}'" for k, v in KINDS.items())
_PRED = """select note, code, case when line % 7 <> 0 then confidence end confidence, {supported} supported,
  (row_number() over (partition by note order by case when line % 7 <> 0 then confidence end desc nulls last, code))::int "rank"
  from (select note, code, max(l_extendedprice) / 110000 confidence, bool_or(l_returnflag <> 'N') s, min(l_linenumber) line from lines where {keep} group by note, code)"""
_PARTS = {
    "labels": f"select p_partkey, substr('ABCDE', (p_size % 5 + 1)::int, 1) || lpad(regexp_replace(p_brand, '[^0-9]', '', 'g'), 2, '0') || '.' || case split_part(p_type, ' ', 1) {_KIND} end code, p_name || ' ' || lower(p_type) title from part",
    "kb": "select code, arg_min(title, p_partkey) title, substr(code, 1, 3) parent from labels group by code",
    "lines": "select l.*, l.l_orderkey note, b.code from lineitem l join labels b on l.l_partkey = b.p_partkey",
    "gold": "select distinct note, o_custkey subject, code from lines join orders on note = o_orderkey where l_discount <= 0.06",
    "notes": "select o_orderkey note from orders",
    **{f"pred_{r}": _PRED.format(supported="null::boolean" if r == "c" else "s", keep=k) for r, k in KEEP.items()},
    "recs": """select note, code, supported, confidence, "rank", case x when 0 then 'weak_evidence' when 1 then 'ambiguous' when 2 then 'possible_hallucination' else 'none' end risk_flag, title evidence_preview,
  case x % 4 when 0 then '' when 1 then substr(title,1,8) when 2 then upper(substr(title,3,9)) else 'not in the text' end evidence_quote, case x % 5 when 0 then true when 1 then false end evidence_quote_verbatim,
  case when x % 3 <> 0 then 'r' else '' end rationale, case when x % 7 = 0 then 'c' else '' end contrastive_rationale, x % 6 n_rejected, x % 10 = 3 fallback, x <> 11 schema_valid, x = 12 json_parse_error, x = 13 mock
  from (select p.*, k.title, (p.note * 7 + p."rank" * 3) % 20 x from pred_a p join kb k using (code))""",
    "samples": """select o_orderkey note, round(o_totalprice/100000,6) runtime, case when o_orderstatus<>'P' then o_orderkey%900+100 end ti, case when o_orderkey%11<>0 then o_orderkey%50 end too,
  case when o_orderpriority like '1%' then (o_orderkey%100+1000)::double end gpu, o_orderkey%17=0 failed, o_orderkey%34=0 oom, o_orderkey%23=1 skipped from orders""",
    "splits": "select *, case when u < 70 then 'train' when u < 85 then 'validation' else 'test' end split from (select distinct note, subject, ('0x' || substr(md5('42:split:' || subject), 1, 8))::bigint % 100 u from gold)",
    # Facts: one row per note and code of either side; counts: one row per note.
    **{f"facts_{r}": f'select coalesce(g.note, p.note) note, coalesce(g.code, p.code) code, g.code is not null in_gold, p.code is not null in_pred, p."rank", p.supported, p.confidence from gold g full join pred_{r} p on g.note = p.note and g.code = p.code' for r in KEEP},
}
_COUNTS = """select n.note, count(*) filter (in_gold and in_pred) tp, count(*) filter (in_pred and not in_gold) fp, count(*) filter (in_gold and not in_pred) fn,
  count(*) filter (in_pred and in_gold and coalesce(supported, false)) sg, count(*) filter (in_pred and coalesce(supported, false)) st,
  count(*) filter (in_pred and in_gold and not coalesce(supported, false)) ug, count(*) filter (in_pred and not coalesce(supported, false)) ut from notes n left join {f} f on f.note = n.note group by n.note"""
_PARTS |= {f"counts_{r}": _COUNTS.format(f=f"facts_{r}") for r in KEEP}
_NEEDS = {"kb": ["labels"], "lines": ["labels"], "gold": ["lines"], "splits": ["gold"], "recs": ["pred_a", "kb"]}
for _r in KEEP:
    _NEEDS |= {f"pred_{_r}": ["lines"], f"facts_{_r}": ["gold", f"pred_{_r}"], f"counts_{_r}": ["notes", f"facts_{_r}"]}


def with_(names: str, body: str) -> str:
    """``body`` after the derivations that it names."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    parts = ",\n".join(f"{n} as ({_PARTS[n]})" for n in order)
    body = body.strip()
    return f"with {parts}, {body[5:]}" if body.lower().startswith("with ") else f"with {parts} {body}"
