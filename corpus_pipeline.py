"""A corpus pipeline of five operators: language ID, near duplicates, PII, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes every stage's
result to the shared folder and reads it again for the next. No SQL states it as a whole: language ID and BPE are
checked against brute force in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import byte_bpe, language_id, ngram_jaccard, pfair_mix, pii_surrogates
from auditloom.llm.common import Scratch

PII_KEY = "surrogate key of this corpus"
POSITION = ["slot", "place", "exact"]  #: the mix's columns that later stages keep


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document the language of the shortest code as its ``lang``, and drops those without one (null text, or no letter in it).

    Repeated rows, null ids and texts of any length are judged like others; an empty table stays empty.
    """
    return language_id.keep_identified(docs, language_id.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents; rows without an id all stay.

    Of several rows of that id the one with the least text stays, then the least other columns (those that can be ordered).
    """
    kept = ngram_jaccard.jaccard_components(docs, count=False).where("doc_id = component_id").select("doc_id").distinct()
    alone = docs.where(F.col("doc_id").isNull())
    order = ["text", *(c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "variant")))]
    least = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("row"))
    return least.select("row.*").unionByName(alone)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the text. Null texts stay null, repeated rows stay equal, an empty table stays empty."""
    out = pii_surrogates.replace(docs, PII_KEY).drop("n_entities")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their position in the mix: blocks of the sources by their target weights.

    The order of rows doesn't outlive a stage's files, so ``slot``, ``place`` and ``exact`` stay as columns; columns of these names that the
    input has give way to them. Null sources are one source, every row (repeated ones too) has a place of its own, an empty table stays empty.
    """
    mixed = pfair_mix.mix(docs)
    own = [c for c in docs.columns if c not in POSITION]
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*own, *POSITION)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes that they decode to, with its language and its position in the mix.

    Null texts are empty, each repeated row gives a row, an empty table gives none.
    """
    import public_tokenizers

    keep = [c for c in ("lang", *POSITION) if c in docs.columns]
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii", replace_pii),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Language ID has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, before = scratch.save(stage(spark, docs, sf_dir), name), docs
        scratch.drop(before)
        scratch.release()
    return docs
