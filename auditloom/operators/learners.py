"""Trained baselines: TF-IDF with one binary linear model per label, and decision rules over label scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class TfidfLinear:
    """TF-IDF features (words of two characters or more, idf = ln((1 + n) / (1 + df)), unit length) and a logistic or
    margin model for each label. Features are computed once; labels are fitted one after the other over the same table."""

    def __init__(self, kind: str = "logistic", features: int = 10_000, regularisation: float = 1e-3):
        self.kind, self.features, self.regularisation = kind, features, regularisation

    def fit(self, docs: DataFrame, labels: DataFrame) -> TfidfLinear:
        """``docs``: (note, text); ``labels``: (note, code)."""
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LinearSVC, LogisticRegression
        from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, StopWordsRemover

        words = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\b\w\w+\b", gaps=False)
        kept = StopWordsRemover(inputCol="w", outputCol="k")
        self.pipeline = Pipeline(stages=[words, kept, CountVectorizer(inputCol="k", outputCol="tf", vocabSize=self.features), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="x")]).fit(docs.na.fill("", ["text"]))
        x = self.pipeline.transform(docs.na.fill("", ["text"])).select("note", "x").persist()
        self.codes = [r.code for r in labels.select("code").distinct().orderBy("code").collect()]  # the label set
        self.models = {}
        for c in self.codes:
            y = x.join(labels.where(F.col("code") == c).select("note", F.lit(1.0).alias("y")).distinct(), "note", "left").na.fill(0.0, ["y"])
            est = LogisticRegression(labelCol="y", featuresCol="x", regParam=self.regularisation, maxIter=30) if self.kind == "logistic" else LinearSVC(labelCol="y", featuresCol="x", regParam=self.regularisation, maxIter=30)
            self.models[c] = est.fit(y)
        x.unpersist()
        return self

    def scores(self, docs: DataFrame) -> DataFrame:
        """(note, code, score): probabilities, or margins scaled to 0..1 within each note."""
        from pyspark.ml.functions import vector_to_array

        x = self.pipeline.transform(docs.na.fill("", ["text"])).select("note", "x")
        col = "probability" if self.kind == "logistic" else "rawPrediction"
        out = None
        for c, m in self.models.items():
            s = m.transform(x).select("note", F.lit(c).alias("code"), vector_to_array(col)[1].alias("score"))
            out = s if out is None else out.unionByName(s)
        if self.kind == "logistic":
            return out
        w = Window.partitionBy("note")
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        return out.withColumn("score", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0))


def decide(scores: DataFrame, threshold: float = 0.5, most: int = 15, fallback: int = 1, at: Column | None = None) -> DataFrame:
    """Codes over the threshold, at most ``most`` by score; where none passes, the ``fallback`` best. ``at``: a threshold column per label."""
    r = F.row_number().over(Window.partitionBy("note").orderBy(F.desc("score"), "code"))
    ok = F.col("score") >= (F.lit(threshold) if at is None else at)
    s = scores.withColumn("rank", r).withColumn("ok", ok)
    some = F.bool_or("ok").over(Window.partitionBy("note"))
    return s.withColumn("some", some).where(F.expr(f"(ok and rank <= {most}) or (not some and rank <= {fallback})")).drop("ok", "some")
