"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, language_id, mtree, ngram_jaccard, pfair_mix, pii_surrogates, prefix_hash, source_divergence, toxicity, unigram_lm, url_automaton, walsh_audit, warc_zstd
from .common import held_out
from .oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"), count=False)
    return out.select("doc_id", "n_shingles", "component_id")


def links_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op1 with class and number of links, which op1's SQL has no columns for."""
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_unigram_lm(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, reestimate: int = 2) -> DataFrame:
    """The query is to learn from the training fold, so the vocabulary's scores are re-estimated there; the operator's default is not to."""
    import public_tokenizers

    return unigram_lm.score(_table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("piece_bpe_32k.model"), reestimate=reestimate)


def op3_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def op4_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs)).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "release", "deadline", "slot", "place", "exact")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str, key: str = "surrogate key of this corpus") -> DataFrame:
    return pii_surrogates.replace(_table(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_entities")


def op7_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.neighbours(_table(spark, sf_dir, "documents"))


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", F.expr("int(score >= 0.3)").alias("predicted"))


def op11_walsh_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walsh_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_automaton.judge(_table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith(("op", "links_")) and callable(f)}
