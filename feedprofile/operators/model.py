"""Trait classifiers over TF-IDF features: fit, predict, save and load."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedprofile.functions import text, traits
from feedprofile.operators.features import MAX_FEATURES, MIN_DF, vectors, vocabulary, word_table
from feedprofile.operators.linear import Linear, fit_linear, margins, sparse
from feedprofile.sources.shared import kept

#: What is done to a document before its terms are taken, by name; a model keeps the name, so that training and
#: prediction cannot differ.
PREPROCESSORS: dict[str, Callable[[Column], Column]] = {"none": lambda document: document, "normalise": text.normalise}
TRAITS = ("gender", "occupation", "birthyear")


def register_preprocessor(name: str, preprocessor: Callable[[Column], Column]) -> None:
    """Make a preprocessor known; a saved model needs it under the same name where it is loaded."""
    PREPROCESSORS[name] = preprocessor


def prepared(documents: DataFrame, preprocessor: str = "none") -> DataFrame:
    """Documents with ``words`` in place of ``document``, ready for ``fit_profiler`` and ``Profiler.predict``; the text work is done here, once."""
    if preprocessor not in PREPROCESSORS:
        raise ValueError(f"unknown preprocessor {preprocessor!r}")
    return documents if "words" in documents.columns else word_table(documents, PREPROCESSORS[preprocessor](F.col("document")))


@dataclass
class Profiler:
    """Fitted features and one classifier for each trait, with its class names."""

    features: PipelineModel
    traits: dict[str, tuple[Linear, list[str]]]
    preprocessor: str = "none"

    def predict(self, documents: DataFrame, key: str = "id") -> DataFrame:
        """Rows ``(id, trait...)`` with predicted class names, for documents or what ``prepared`` made of them."""
        if "words" not in documents.columns:
            documents = documents.select(key, text.long_words(PREPROCESSORS[self.preprocessor](F.col("document"))).alias("words"))
        rows = vectors(documents, self.features.stages[0].vocabulary, self.features.stages[1].getScalingVec(), [key])
        kinds = [(names, np.ascontiguousarray(model.weights.T), model.intercepts) for model, names in self.traits.values()]

        def task(batches):
            for batch in batches:
                counts, terms, values = sparse(batch)
                best = [(margins(counts, terms, values, w) + b).argmax(axis=1) for _, w, b in kinds]
                named = [pa.array([names[k] for k in at], pa.string()) for at, (names, _, _) in zip(best, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *named], [key, *self_traits])

        self_traits = list(self.traits)
        return rows.mapInArrow(task, StructType([rows.schema[key], *[StructField(t, StringType()) for t in self_traits]]))

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        rows = [(t, json.dumps(names), self.preprocessor, bytearray(m.weights.tobytes()), bytearray(m.intercepts.tobytes())) for t, (m, names) in self.traits.items()]
        schema = "trait string, names string, preprocessor string, weights binary, intercepts binary"
        SparkSession.getActiveSession().createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/traits")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Profiler:
        rows = spark.read.parquet(f"{path}/traits").collect()  # a row for each trait
        models = {}
        for r in rows:
            names = json.loads(r["names"])
            models[r["trait"]] = (Linear(np.frombuffer(r["weights"]).reshape(len(names), -1), np.frombuffer(r["intercepts"])), names)
        return Profiler(PipelineModel.load(f"{path}/features"), models, rows[0]["preprocessor"] if rows else "none")


def fit_features(documents: DataFrame, min_df: int = MIN_DF, most: int = MAX_FEATURES, preprocessor: str = "none") -> PipelineModel:
    """Counts over the vocabulary, times smoothed idf, scaled to length one."""
    words = prepared(documents, preprocessor)
    n = words.count()
    terms = vocabulary(words, min_df, most).collect()  # at most MAX_FEATURES rows
    names = [r["term"] for r in terms] or [""]
    idf = [math.log((1 + n) / (1 + r["df"])) + 1 for r in terms] or [1.0]
    counts = CountVectorizerModel.from_vocabulary(names, inputCol="terms", outputCol="counts", minTF=1)
    scaled = ElementwiseProduct(scalingVec=DenseVector(idf), inputCol="counts", outputCol="scaled")
    return PipelineModel([counts, scaled, Normalizer(p=2.0, inputCol="scaled", outputCol="features")])


def fit_profiler(documents: DataFrame, traits: Sequence[str], min_df: int = MIN_DF, most: int = MAX_FEATURES, max_iter: int = 100, preprocessor: str = "none", tol: float = 3e-3) -> Profiler:
    """Fit a multinomial logistic regression for each trait of ``documents(id, document, trait...)``, all of them in the same jobs.

    Rows whose trait is null are left out of that trait's training only. The penalty is half the sum of squared weights
    over the number of rows; ``optimality`` tells how near the fit came to its optimum.
    """
    documents = prepared(documents.select("id", *[c for c in ("document", "words") if c in documents.columns], *traits), preprocessor)
    features = fit_features(documents, min_df, most, preprocessor)
    known = documents.select(*[F.col(t).cast("string").alias(t) for t in traits])
    sizes = known.select(F.inline(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).alias("name")) for t in traits]))).where("name IS NOT NULL").groupBy("trait", "name").agg(F.count("*").alias("n")).collect()
    named = {t: sorted((r["name"], r["n"]) for r in sizes if r["trait"] == t) for t in traits}
    code = [F.coalesce(F.array_position(F.array(*[F.lit(n) for n, _ in named[t]]).cast("array<string>"), F.col(t).cast("string")) - 1, F.lit(-1)).cast("int").alias(f"y{k}") for k, t in enumerate(traits)]
    # memory and disk, and made anew from the documents where an executor is lost
    rows = vectors(documents.select(*code, "words"), features.stages[0].vocabulary, features.stages[1].getScalingVec(), [f"y{k}" for k in range(len(traits))]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = fit_linear(rows, [[n for _, n in named[t]] for t in traits], len(features.stages[0].vocabulary), tol, max_iter)
    finally:
        rows.unpersist()
    return Profiler(features, {t: (m, [n for n, _ in named[t]]) for t, m in zip(traits, fitted, strict=True)}, preprocessor)


def model_weights(profiler: Profiler) -> tuple[DataFrame, list[tuple[str, str, float]]]:
    """The fitted weights as rows ``(term, df, w)``, with one weight for each class of each trait, and these classes with their intercepts."""
    classes = [(trait, name, float(model.intercepts[k])) for trait, (model, names) in profiler.traits.items() for k, name in enumerate(names)]
    matrix = np.concatenate([model.weights for model, _ in profiler.traits.values()])
    counts, scaled = profiler.features.stages[0], profiler.features.stages[1]
    rows = [(t, float(i), [float(x) for x in matrix[:, k]]) for k, (t, i) in enumerate(zip(counts.vocabulary, scaled.getScalingVec(), strict=True))]
    return SparkSession.getActiveSession().createDataFrame(rows, "term string, idf double, w array<double>"), classes


def optimality(profiler: Profiler, documents: DataFrame, features: DataFrame) -> DataFrame:
    """Certificate of a fit: rows ``(trait, class, documents, expected, gradient)``.

    ``documents(id, trait...)`` are the rows that taught and ``features(id, term, weight)`` their TF-IDF rows. The loss is
    convex, and strictly so in the weights, so that weights are the optimum exactly if the gradient is zero. ``gradient``
    is the length of its part for the class, intercept included, over that at zero weights and best intercepts; ``expected`` is the sum of
    predicted probabilities, which at the optimum equals ``documents``, the number of rows of the class. Both are sums
    over documents and terms and take nothing from the fit but the weights.
    """
    table, classes = model_weights(profiler)
    every = range(len(classes))
    some = features.join(F.broadcast(table.select("term", "w")), "term")  # at most MAX_FEATURES rows
    margins = some.groupBy("id").agg(*[F.sum(F.col("weight") * F.col("w")[k]).alias(f"m{k}") for k in every])
    rows = documents.select("id", *profiler.traits).join(margins, "id", "left")
    counted = documents.agg(*[F.count_if(F.col(t).cast("string") == name).alias(f"c{k}") for k, (t, name, _) in enumerate(classes)]).first()
    total = {t: sum(counted[f"c{k}"] for k in every if classes[k][0] == t) for t in profiler.traits}
    margin = [F.coalesce(F.col(f"m{k}"), F.lit(0.0)) + F.lit(b) for k, (_, _, b) in enumerate(classes)]
    peak = {t: F.greatest(*[margin[k] for k in every if classes[k][0] == t], F.lit(-1e300)) for t in profiler.traits}
    powers = [F.exp(margin[k] - peak[classes[k][0]]) for k in every]
    p, known = [], []
    for k, (t, name, _) in enumerate(classes):
        below = sum((powers[j] for j in every if classes[j][0] == t), F.lit(0.0))
        p.append(F.when(F.col(t).isNotNull(), powers[k] / below).otherwise(F.lit(0.0)).alias(f"p{k}"))
        known.append(F.when(F.col(t).cast("string") == name, 1.0).otherwise(0.0).alias(f"y{k}"))
    zero = [F.when(F.col(t).isNotNull(), F.lit(counted[f"c{k}"] / max(total[t], 1))).otherwise(0.0).alias(f"z{k}") for k, (t, _, _) in enumerate(classes)]
    judged = kept(rows.select("id", *p, *known, *zero))
    sums = judged.agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in every]).first()
    parts = [F.sum(F.col("weight") * (F.col(f"p{k}") - F.col(f"y{k}"))).alias(f"g{k}") for k in every]
    first = [F.sum(F.col("weight") * (F.col(f"z{k}") - F.col(f"y{k}"))).alias(f"f{k}") for k in every]
    slopes = features.join(judged, "id").groupBy("term").agg(*parts, *first).join(F.broadcast(table), "term")
    # the penalty of the mean loss is half the squared weights over the rows, so in sums its gradient is the weight itself
    ends = slopes.agg(
        *[F.sum((F.col(f"g{k}") + F.col("w")[k]) ** 2).alias(f"g{k}") for k in every], *[F.sum(F.col(f"f{k}") ** 2).alias(f"f{k}") for k in every]
    ).first()
    out = []
    for k, (t, name, _) in enumerate(classes):
        gap = sums[f"p{k}"] - counted[f"c{k}"]
        out.append((t, name, counted[f"c{k}"], float(sums[f"p{k}"]), math.sqrt((ends[f"g{k}"] or 0.0) + gap * gap) / max(math.sqrt(ends[f"f{k}"] or 0.0), 1e-300)))
    return documents.sparkSession.createDataFrame(out, "trait string, class string, documents long, expected double, gradient double")


def profile(labels: DataFrame, feeds: DataFrame, targets: DataFrame, preprocessor: str = "normalise", min_df: int = MIN_DF, max_iter: int = 100) -> tuple[Profiler, DataFrame]:
    """Learn gender, occupation and birth year from ``feeds(id, text)`` and their ``labels``, and predict them for ``targets``.

    Nested posts become one document each; birth years are learned as centres of their classes. Feeds without a label are
    not learned from. Predictions have one row for each target: ``(id, gender, occupation, birthyear)``.
    """
    document = text.assemble(F.col("text")).alias("document")
    known = labels.select("id", "gender", "occupation", traits.birthyear_class(F.col("birthyear")).alias("birthyear"))
    learned = fit_profiler(feeds.select("id", document).join(known, "id"), TRAITS, min_df=min_df, max_iter=max_iter, preprocessor=preprocessor)
    predicted = learned.predict(targets.select("id", document))
    return learned, predicted.select("id", "gender", "occupation", F.col("birthyear").cast("int").alias("birthyear"))
