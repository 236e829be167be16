"""Sources of notes, labels and stored runs: CSV, JSON lines (strict, tolerant), Parquet, run catalogues, score matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTES = T.StructType([T.StructField(c, T.StringType()) for c in ("subject_id", "hadm_id", "text")])
DIAGNOSES = T.StructType([T.StructField(c, T.StringType()) for c in ("subject_id", "hadm_id", "seq_num", "icd_code", "icd_version")])
PREDICTION = "code string, confidence double, confidence_present boolean, supported boolean, evidence_quote string, evidence_chunk_id string, evidence_score double, rationale string, risk_flag string, schema_valid boolean, json_parse_error boolean, candidate_rank int, retrieval_score double"
RECORD = f"status string, subject_id string, hadm_id string, split string, experiment_id string, seed int, global_sample_index bigint, gold_codes array<string>, predicted_codes array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in PREDICTION.split(','))}>>, confidence double, risk_flags array<string>, runtime_sec double, timestamp string, failed boolean, error_type string"


class MissingColumns(ValueError):
    """A source lacks required columns."""


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or MissingColumns before any job runs."""
    if lack := sorted(set(columns) - set(df.columns)):
        raise MissingColumns(", ".join(lack))
    return df


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None, rows: int | None = None) -> DataFrame:
    """A CSV (also compressed) with a header; quoted fields may hold line breaks. ``rows``: read only so many (a dry run)."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = r.csv(path)
    if schema is not None:
        df = require(df, schema.fieldNames()).select(*[F.col(f.name).cast(f.dataType) for f in schema])
    return df if rows is None else df.limit(rows)


def diagnoses(spark: SparkSession, path: str, version: int = 10, rows: int | None = None) -> DataFrame:
    """Codes of one version with numbers where they parse."""
    df = csv(spark, path, DIAGNOSES, rows)
    num = lambda c: F.col(c).try_cast("double")
    return df.select("subject_id", "hadm_id", num("seq_num").alias("seq_num"), "icd_code", num("icd_version").alias("icd_version")).where(F.col("icd_version") == version)


def corpus(notes: DataFrame, codes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(subject_id, hadm_id, text, gold_codes): notes with their codes in sequence order, numbers last where they are missing; notes without codes go. ``tasks``: deal both by note to so many."""
    if tasks:
        notes, codes = (x.repartition(tasks, "subject_id", "hadm_id") for x in (notes, codes))
    order = F.struct(F.col("seq_num").isNull().alias("n"), "seq_num", "icd_code")
    lists = codes.where(F.col("icd_code").isNotNull()).groupBy("subject_id", "hadm_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["icd_code"]).alias("gold_codes"))
    return notes.join(lists, ["subject_id", "hadm_id"]).select("subject_id", "hadm_id", "text", "gold_codes")


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Strict: a malformed line fails the job; blank lines are skipped."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def json_lines_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("x"))
    bad = F.col("x._corrupt_record").isNotNull()
    return parsed.where(~bad).select("x.*").drop("_corrupt_record"), parsed.where(bad).select(F.col("value").alias("_corrupt_record"))


def probe(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet where the path or its .parquet sibling exists as such, else JSON lines."""
    jvm = spark._jvm
    there = lambda p: (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(q)
    for p in (path, f"{path.removesuffix('.jsonl')}.parquet"):
        if p.endswith(".parquet") and there(p):
            return spark.read.parquet(p)
    return json_lines(spark, path if there(path) else f"{path}.jsonl", schema)


def with_fallback_index(records: DataFrame, order: str, index: str = "global_sample_index", run: str | None = None) -> DataFrame:
    """The records with a missing index replaced by the number of distinct indices that the run has had so far, given or replaced.

    Each index depends on all before it, so a run is read in its order by one task, row by row; it holds the run's distinct indices. Runs go to tasks of their own.
    """
    import pyarrow as pa

    names, at, place = records.columns, records.columns.index(index), None if run is None else records.columns.index(run)

    def number(batches):
        now, seen = object(), set()
        for b in batches:
            runs = [None] * b.num_rows if place is None else b.column(place).to_pylist()
            out = []
            for r, i in zip(runs, b.column(at).to_pylist(), strict=True):
                if r != now:
                    now, seen = r, set()
                i = len(seen) if i is None else i
                seen.add(i)
                out.append(i)
            yield b.set_column(at, names[at], pa.array(out, b.schema.field(at).type))

    dealt = records.coalesce(1).sortWithinPartitions(order) if run is None else records.repartition(run).sortWithinPartitions(run, order)
    return dealt.mapInArrow(number, records.schema)


def latest_success(records: DataFrame, order: str, index: str = "global_sample_index", fallback: bool = False, run: str | None = None) -> DataFrame:
    """Successful records, the last of each index (of each run) by the column ``order``. ``fallback``: a missing index is replaced, see above, else the record goes."""
    ok = records.where(F.col("status") == "success")
    ok = with_fallback_index(ok, order, index, run) if fallback else ok.where(F.col(index).isNotNull())
    last = F.row_number().over(Window.partitionBy(*([run] if run else []), index).orderBy(F.desc(order)))
    return ok.withColumn("_r", last).where("_r = 1").drop("_r")


def merge_shards(sources: list[DataFrame], index: str = "global_sample_index") -> DataFrame:
    """The largest of several copies of a run, each index once."""
    sizes = [s.select(index).distinct().count() for s in sources]
    return sources[sizes.index(max(sizes))].dropDuplicates([index])


def run_catalogue(spark: SparkSession, root: str, split: str, schema: str = RECORD) -> DataFrame:
    """All records of ``*/{split}_predictions.jsonl`` below ``root``, with the run's folder name as ``run``."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"{split}_predictions.jsonl").json(root)
    return df.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def gold_sets(records: DataFrame) -> DataFrame:
    """(hadm_id, codes): distinct normalised codes of ``gold_codes`` or, where there are none, ``labels``."""
    from ..functions.columns import norm_audit

    src = F.coalesce("gold_codes", "labels") if "labels" in records.columns else F.col("gold_codes")
    return records.select("hadm_id", F.array_distinct(F.transform(src, norm_audit)).alias("codes"))


def score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(study, source, scores): the rows of a Markdown table with twelve cells, the last ten of which are Y, N, ?, – or -."""
    t = spark.read.text(path).select(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|").alias("c"))
    t = t.where(F.size("c") == 12).select(F.transform("c", lambda x: F.trim(x)).alias("c"))
    return t.where(F.forall(F.slice("c", 3, 10), lambda x: x.isin("Y", "N", "?", "–", "-"))).select(F.col("c")[0].alias("study"), F.col("c")[1].alias("source"), F.slice("c", 3, 10).alias("scores"))
