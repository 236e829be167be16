"""Queries of the trained baselines: documents as notes; their language and the marks that their labels give are the codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.multilabel import MultiLabelLinear
from ..sources import fixtures as fx
from .registry import query


def notes(spark, d):
    t = fx.table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("note"), "text", fx.split_of(F.col("doc_id")).alias("split"))


def codes(spark, d):
    """(note, code): the language, and the marks of the notes that have labels."""
    lang = fx.table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").alias("note"), F.concat(F.lit("lang "), "lang").alias("code"))
    marks = fx.table(spark, d, "labels").select(F.col("doc_id").alias("note"), F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))).alias("code"))
    return lang.unionByName(marks).distinct()


def predicted(spark, d, kind, top=10):
    """The best codes of the test notes by models of the training notes."""
    n, c = notes(spark, d), codes(spark, d)
    train = n.where("split = 'train'")
    model = MultiLabelLinear(kind).fit(train, c.join(train.select("note"), "note", "left_semi"))
    return model.scores(n.where("split = 'test'"), top).select("note", "code", F.round("score", 6).alias("score"), "rank")


@query("ml_tfidf_lr")
def tfidf_lr(spark, d):
    return predicted(spark, d, "logistic")


@query("ml_tfidf_svm")
def tfidf_svm(spark, d):
    return predicted(spark, d, "squared_hinge")
