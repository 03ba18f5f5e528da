"""Sentiment: TF-IDF with multinomial logistic regression, or a supplied scorer.

Training runs Spark ML on a feature table in shared storage.  Scoring is
row-local and stays in the JVM; only a supplied scorer runs in Python workers.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from voicegrid import fixed_values as fixed
from voicegrid.functions.labels import label_order
from voicegrid.functions.lookup import constant, count_terms, let
from voicegrid.functions.text import clean_for_classical_model, clean_for_transformer, strip_accents
from voicegrid.operators.labelled import class_distribution, prepare_labelled, split_labelled
from voicegrid.operators.metrics import evaluate_predictions
from voicegrid.operators.statistics import period_of
from voicegrid.operators.tfidf import (
    Vocabulary,
    fit_vocabulary,
    load_vocabulary,
    save_vocabulary,
    sparse_vectors,
    terms_of,
    tokens_of,
)
from voicegrid.schema import FeedbackError, SentimentConfig, SplitConfig, require_columns
from voicegrid.session import cut_lineage, discard, write_scratch_table

SCORE_TYPE = "struct<label:string,score:double>"


def classical_tokens(text: str | Column) -> Column:
    """Tokens of the logistic model: cleaned, lower case, accents removed."""
    return tokens_of(strip_accents(clean_for_classical_model(text)))


@dataclass(frozen=True)
class SentimentModel:
    """Fitted vocabulary and class weights (classes x terms)."""

    vocabulary: Vocabulary
    coefficients: np.ndarray
    intercepts: np.ndarray
    config: SentimentConfig = SentimentConfig()

    kind = "logistic_regression"
    text_column = "clean_text"

    def with_scores(self, df: DataFrame, text: str, name: str = "_scored") -> DataFrame:
        """Add a struct of the predicted label and its probability, computed in the JVM.

        Known terms come with their counts; sublinear weights, the text's norm
        and the margins are summed in one pass over them.
        """
        idf = constant(self.vocabulary.idf, "array<double>")
        weights = [constant(row, "array<double>") for row in self.coefficients]
        size = range(len(weights))
        tokens = let(classical_tokens(text), lambda words: terms_of(words, self.vocabulary.ngram_max))

        def scored(indices: Column, counts: Column) -> Column:
            cells = F.zip_with(
                indices, counts, lambda i, n: F.struct(i.alias("i"), ((1.0 + F.log(n)) * F.get(idf, i)).alias("w"))
            )
            zero = F.struct(F.lit(0.0).alias("norm"), *(F.lit(0.0).alias(f"m{k}") for k in size))

            def add(total: Column, cell: Column) -> Column:
                w = cell["w"]
                sums = [(total[f"m{k}"] + w * F.get(weights[k], cell["i"])).alias(f"m{k}") for k in size]
                return F.struct((total["norm"] + w * w).alias("norm"), *sums)

            def choose(total: Column) -> Column:
                norm = F.when(total["norm"] > 0, F.sqrt(total["norm"])).otherwise(1.0)
                return F.array(*(total[f"m{k}"] / norm + F.lit(float(self.intercepts[k])) for k in size))

            def best(margins: Column) -> Column:
                top = F.array_max(margins)
                odds = F.aggregate(margins, F.lit(0.0), lambda total, m: total + F.exp(m - top))
                place = F.array_position(margins, top).cast("int")
                labels = F.array(*map(F.lit, fixed.SENTIMENT_LABELS))
                return F.struct(F.element_at(labels, place).alias("label"), (1.0 / odds).alias("score"))

            return let(let(F.aggregate(cells, zero, add), choose), best)

        return count_terms(df, tokens, self.vocabulary.terms, scored, name)

    def predict(self, df: DataFrame, text_column: str = "clean_text") -> DataFrame:
        """Add ``sentiment_label`` and ``sentiment_score``."""
        return _spread(self.with_scores(df, text_column))

    def save(self, spark: SparkSession, path: str) -> None:
        """Vocabulary, coefficients and metadata below ``path``."""
        save_vocabulary(self.vocabulary, spark, f"{path}/vocabulary")
        rows = [(i, [float(v) for v in column]) for i, column in enumerate(self.coefficients.T)]
        spark.createDataFrame(rows, "position int, weights array<double>").write.parquet(f"{path}/coefficients")
        meta = {
            "labels": list(fixed.SENTIMENT_LABELS),
            "intercepts": [float(v) for v in self.intercepts],
            "documents": self.vocabulary.documents,
            "config": asdict(self.config),
        }
        spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SentimentModel:
        """Inverse of :meth:`save`."""
        meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        config = SentimentConfig(**meta["config"])
        vocabulary = load_vocabulary(spark, f"{path}/vocabulary", meta["documents"], config.ngram_max)
        rows = spark.read.parquet(f"{path}/coefficients").orderBy("position").collect()
        weights = np.array([row["weights"] for row in rows], dtype=float).T
        return cls(vocabulary, weights, np.array(meta["intercepts"], dtype=float), config)


def _best(probabilities: np.ndarray, labels: Sequence[str] = fixed.SENTIMENT_LABELS) -> pa.StructArray:
    choice = probabilities.argmax(axis=1) if len(probabilities) else np.zeros(0, int)
    names = pa.array(labels, type=pa.string()).take(pa.array(choice, type=pa.int64()))
    scores = probabilities[np.arange(len(choice)), choice] if len(choice) else np.zeros(0)
    return pa.StructArray.from_arrays([names, pa.array(scores, type=pa.float64())], names=["label", "score"])


def _spread(df: DataFrame) -> DataFrame:
    kept = [name for name in df.columns if name not in ("sentiment_label", "sentiment_score", "_scored")]
    return df.select(
        *kept, F.col("_scored.label").alias("sentiment_label"), F.col("_scored.score").alias("sentiment_score")
    )


# ---------------------------------------------------------------- training --
def fit_sentiment(
    df: DataFrame,
    config: SentimentConfig = SentimentConfig(),
    *,
    text_column: str = "review_text",
    label_column: str = "sentiment_label",
) -> SentimentModel:
    """Fit vocabulary and balanced multinomial logistic regression.

    The solver passes over the data many times, so features are written once
    to shared storage and read back as ML vectors; they go when it is done.  Balanced class weights sum
    to the row count, hence ``regParam = 1 / (C n)``.
    """
    counts = {row[label_column]: row["row_count"] for row in class_distribution(df, label_column).collect()}
    rows = sum(counts.values())
    tokens = classical_tokens(text_column)
    vocabulary = fit_vocabulary(df, tokens, rows, max_features=config.max_features, ngram_max=config.ngram_max)
    if not len(vocabulary):
        raise FeedbackError("No usable terms remain for the sentiment model.")
    vectors = sparse_vectors(df, tokens, vocabulary)
    weight = F.lit(None).cast("double")
    for name, count in counts.items():
        weight = F.when(F.col(label_column) == name, F.lit(rows / (len(counts) * count))).otherwise(weight)
    features = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(len(vocabulary)).alias("size"),
        F.col("vector.indices").alias("indices"),
        F.col("vector.weights").alias("values"),
    )
    table = vectors.select(
        features.alias("features"), label_order(F.col(label_column)).cast("double").alias("label"), weight.alias("weight")
    )
    schema = T.StructType(
        [
            T.StructField("features", VectorUDT()),
            T.StructField("label", T.DoubleType()),
            T.StructField("weight", T.DoubleType()),
        ]
    )
    solver = LogisticRegression(
        family="multinomial",
        weightCol="weight",
        regParam=1.0 / (config.c * rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=config.max_iter,
        tol=config.tol,
    )
    path = write_scratch_table(table, "features")
    fitted = solver.fit(df.sparkSession.read.schema(schema).parquet(path))
    discard(df.sparkSession, path)
    return SentimentModel(vocabulary, fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray(), config)


def train_sentiment(
    df: DataFrame,
    config: SentimentConfig = SentimentConfig(),
    split: SplitConfig = SplitConfig(),
    *,
    text_column: str = "review_text",
    label_column: str = "sentiment_label",
    mapping: Mapping[str, str] | None = None,
    keep_conflicts: bool = False,
) -> tuple[SentimentModel, dict[str, object], DataFrame]:
    """Prepare, split, fit and evaluate; returns model, report and test predictions."""
    prepared = prepare_labelled(
        df, text_column=text_column, label_column=label_column, mapping=mapping, keep_conflicts=keep_conflicts
    )
    parts = cut_lineage(split_labelled(prepared, split, text_column=text_column, label_column=label_column))
    started = time.perf_counter()
    model = fit_sentiment(parts.where("split = 'train'"), config, text_column=text_column, label_column=label_column)
    training_seconds = time.perf_counter() - started

    def predictions(part: str) -> DataFrame:
        held_out = parts.where(F.col("split") == part)
        scored = model.with_scores(held_out, text_column)
        return scored.select(
            text_column,
            F.col(label_column).alias("actual"),
            F.col("_scored.label").alias("predicted"),
            F.col("_scored.score").alias("confidence"),
        )

    started = time.perf_counter()
    tested = cut_lineage(predictions("test"))
    inference_seconds = time.perf_counter() - started
    sizes = {row["split"]: row["n"] for row in parts.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    report = {
        "model_name": SentimentModel.kind,
        **evaluate_predictions(tested),
        "validation_metrics": evaluate_predictions(predictions("validation")),
        "training_seconds": training_seconds,
        "inference_seconds": inference_seconds,
        "samples_per_second": sizes["test"] / inference_seconds if inference_seconds > 0 else 0.0,
        "mean_confidence": tested.agg(F.avg("confidence")).first()[0],
        "train_rows": sizes["train"],
        "validation_rows": sizes["validation"],
        "test_rows": sizes["test"],
        "class_distribution": {
            row[label_column]: row["row_count"] for row in class_distribution(parts, label_column).collect()
        },
    }
    return model, report, tested


# ---------------------------------------------------------- supplied scorer --
class BatchScorer(Protocol):
    """Model supplied by the caller.

    ``labels`` names the probability columns; ``score`` maps texts to rows of
    probabilities.
    """

    labels: Sequence[str]

    def score(self, texts: Sequence[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class SuppliedModel:
    """Runs a caller's scorer, created once per Python worker and task."""

    factory: Callable[[], BatchScorer]
    batch_size: int = 16

    kind = "supplied"
    text_column = "review_text"

    def scored(self, text: str | Column) -> Column:
        """Struct of predicted label and its probability."""
        if self.batch_size <= 0:
            raise ValueError(f"batch_size must be at least 1, not {self.batch_size}.")
        factory, step = self.factory, self.batch_size

        @arrow_udf(SCORE_TYPE)
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scorer = factory()
            labels = [str(name).strip().title() for name in scorer.labels]
            if sorted(labels) != sorted(fixed.SENTIMENT_LABELS):
                raise ValueError("The scorer must use exactly the labels Negative, Neutral and Positive.")
            for batch in batches:
                texts = batch.to_pylist()
                parts = [np.asarray(scorer.score(texts[at : at + step]), dtype=float) for at in range(0, len(texts), step)]
                found = np.concatenate(parts) if parts else np.zeros((0, len(labels)))
                if len(found) != len(texts):
                    raise ValueError("The scorer returned an unexpected number of predictions.")
                yield _best(found, labels)

        return score.asNondeterministic()(clean_for_transformer(text))

    def predict(self, df: DataFrame, text_column: str = "review_text") -> DataFrame:
        """Add ``sentiment_label`` and ``sentiment_score``."""
        return _spread(df.withColumn("_scored", self.scored(text_column)))


def predict_sentiment(df: DataFrame, model: SentimentModel | SuppliedModel) -> DataFrame:
    """Score a canonical table; each model kind reads its own text column."""
    require_columns(df, ["review_text", "clean_text"], FeedbackError, "Sentiment scoring")
    return model.predict(df, model.text_column)


def mean_confidence(df: DataFrame) -> DataFrame:
    """Average sentiment score, one row."""
    return df.agg(F.avg("sentiment_score").alias("mean_confidence"))


# ------------------------------------------------------------- view tables --
def sentiment_by_month(df: DataFrame) -> DataFrame:
    """Reviews per month and label."""
    return (
        df.where(F.col("date").isNotNull())
        .groupBy(period_of(F.col("date"), "M").alias("period"), "sentiment_label")
        .agg(F.count(F.lit(1)).alias("review_count"))
    )


def label_representatives(df: DataFrame, per_label: int = 3) -> DataFrame:
    """Most confident reviews of each label; map tasks forward only their own best rows."""
    ranked = Window.partitionBy("sentiment_label").orderBy(F.desc("sentiment_score"), "review_id")
    narrow = df.select("sentiment_label", "review_id", "sentiment_score", "review_text")
    return narrow.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= per_label)


def sentiment_headline(df: DataFrame) -> DataFrame:
    """Rows, mean confidence, negative share and number of topics, one row."""
    topics = F.count_distinct("topic_label") if "topic_label" in df.columns else F.lit(None).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg("sentiment_score").alias("average_confidence"),
        F.avg((F.col("sentiment_label") == "Negative").cast("double")).alias("negative_share"),
        topics.alias("topic_count"),
    )
