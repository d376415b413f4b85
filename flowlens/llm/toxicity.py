"""Operator 10: toxicity by a classifier chain.

Categories are predicted one after the other. Each has a logistic regression over the counts of
words and word stems and the probabilities of the categories before it. For training, those probabilities are
out-of-fold: each fold's rows are scored by models fitted on the other folds, so that later models
see the errors that they will meet. Scoring feeds the probabilities of the final models.

Training uses a bounded sample: at most ``sample`` labelled rows, by hash of the id, and words of at
least ``min_docs`` and ``min_share`` of these rows; an L1 penalty keeps few weights. Scoring
covers every row and its whole text, by MLlib's transformers inside the JVM.

Defined results: null text counts as empty and, like any text without a word, is never toxic. Labels null in a category, or of unknown ids, are left
out. A category with a single class in the sample gets that class as its probability. Repeated rows
are scored each; repeated labels of an id count as often. Columns of ``df`` pass through, whatever their names; those
named like an output column, in any letter case, are replaced (``non_toxic`` adds none and keeps all). An empty
table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import materialise, text_or_empty

#: Lengths of stems.
STEMS = (4, 6)

def words_of(column: str) -> Column:
    """Lower-case words, runs of letters, digits and apostrophes, and the stems of long ones.

    A stem is a word's first characters after a mark; inflected and compound forms share it.
    """
    words = F.split(F.lower(text_or_empty(column)), r"[^\p{L}\p{N}']+")
    stem = lambda n: F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.lit("^"), F.substring(w, 1, n)))
    return F.concat(words, *map(stem, STEMS))


class Chain:
    """A fitted chain: the word table and one model, or a constant, for each category in order."""

    def __init__(self, vocabulary: CountVectorizerModel | None, models: list[tuple[str, LogisticRegressionModel | float]]):
        self.vocabulary, self.models = vocabulary, models

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add one probability column for each category."""
        names = {n.lower() for n, _ in self.models}
        kept = [c for c in df.columns if c.lower() not in names]
        row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row") if kept else F.lit(0).alias("_row")
        out = df.select(row, words_of(f"`{text}`").alias("_words"))  # work columns stand beside the packed row only
        if self.vocabulary is None:
            out = out.select("_row", *(F.lit(float(m)).alias(n) for n, m in self.models))
        else:
            out = self.vocabulary.transform(out).drop("_words")
            for i, (name, model) in enumerate(self.models):
                out = _scored(_assembled(out, [n for n, _ in self.models[:i]]), model, name)
        return out.select(*(F.col("_row").getField(c).alias(c) for c in kept), *(n for n, _ in self.models))


def _assembled(df: DataFrame, earlier: list[str]) -> DataFrame:
    if not earlier:
        return df.withColumn("_features", F.col("_x"))
    return VectorAssembler(inputCols=["_x", *earlier], outputCol="_features").transform(df)


def _scored(df: DataFrame, model: LogisticRegressionModel | float, name: str) -> DataFrame:
    if isinstance(model, float):
        return df.withColumn(name, F.lit(model)).drop("_features")
    model.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_c")
    return model.transform(df).withColumn(name, vector_to_array("_p")[1]).drop("_features", "_p", "_r", "_c")


def _fitted(df: DataFrame, label: str, rounds: int, penalty: float) -> LogisticRegressionModel | float:
    rows = df.where(F.col(label).isNotNull())
    low, high, mean = rows.agg(F.min(label), F.max(label), F.avg(label)).first()
    if low is None or low == high:
        return float(mean or 0)
    return LogisticRegression(featuresCol="_features", labelCol=label, maxIter=rounds, regParam=penalty, elasticNetParam=1.0, standardization=True, family="binomial").fit(rows)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, id_col: str = "doc_id", text: str = "text", sample: int = 8000, min_docs: int = 10, min_share: float = 0.005, folds: int = 2, rounds: int = 25, penalty: float = 2e-3) -> Chain:
    """Fit a chain. ``categories``: output column to 0/1 label expression over ``labels``, in order."""
    categories = categories or {"p_low_quality": 1 - F.col("quality"), "p_toxic": F.col("toxic")}
    wanted = labels.select(F.col(id_col).alias("_id"), *(e.cast("double").alias(f"_y_{n}") for n, e in categories.items()))
    chosen = wanted.where("_id IS NOT NULL").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_id")  # at most ``sample`` rows
    rows = materialise(rows.withColumn("_words", words_of("_text")).drop("_text"), "labelled")
    least = max(min_docs, math.ceil(min_share * rows.count()))
    known = rows.select(F.explode(F.array_distinct("_words")).alias("w")).groupBy("w").count().where(F.col("count") >= least)
    table = [r["w"] for r in known.orderBy(F.desc("count"), "w").collect()]  # no more than 1 / min_share times the words of a row
    if not table:
        means = rows.agg(*(F.avg(f"_y_{n}") for n in categories)).first()
        return Chain(None, [(n, float(m or 0)) for n, m in zip(categories, means, strict=True)])
    vocabulary = CountVectorizerModel.from_vocabulary(table, inputCol="_words", outputCol="_x", minTF=1.0)
    data = vocabulary.transform(rows).drop("_words").withColumn("_fold", F.pmod(F.xxhash64("_id"), F.lit(folds)))
    data = materialise(data.repartition(spark_cores(data)), "features")
    models: list[tuple[str, LogisticRegressionModel | float]] = []
    for i, name in enumerate(categories):
        label, earlier = f"_y_{name}", [n for n, _ in models]
        ready = _assembled(data, earlier)
        models.append((name, _fitted(ready, label, rounds, penalty)))
        if i + 1 < len(categories):
            parts = [_scored(ready.where(F.col("_fold") == f), _fitted(ready.where(F.col("_fold") != f), label, rounds, penalty), name) for f in range(folds)]
            data = materialise(_union(parts), "out-of-fold")
    return Chain(vocabulary, models)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spark_cores(df: DataFrame) -> int:
    """Partitions for the bounded sample: as many as tasks run at once."""
    return max(2, df.sparkSession.sparkContext.defaultParallelism)


def toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.35, text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` with p_low_quality, p_toxic and toxic (p_toxic at least the threshold).

    A text without a word is never toxic, whatever the models say without evidence.
    """
    chain = train(docs, labels, text=text, **settings)
    said = text_or_empty(f"`{text}`").rlike(r"[\p{L}\p{N}]")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "toxic"]
    return chain.transform(docs.select(*kept), text).withColumn("toxic", said & (F.col("p_toxic") >= threshold))


def non_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their own columns and no others."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kept = toxic(packed, labels, **settings).where("NOT toxic")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
