"""Registered queries on files, reports, gates and fixed models: what users reach outside the tables.

Each writes what the given tables hold to a fresh folder of the shared space,
reads it back and shows the rows.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrid import fixed_values as fixed
from voicegrid.functions.text import strip_accents, vector_tokens
from voicegrid.operators import aspects, filters, metrics, naming, profiling, sentiment, text_index, topics, trends, validation
from voicegrid.operators.tfidf import Vocabulary
from voicegrid.operators.topic_quality import keyword_similarity
from voicegrid.plans.catalog import EXPLORATION, WEEK, _fitted, _insights, predictions, query, raw_reviews
from voicegrid.schema import ColumnMapping, FeedbackError, IngestConfig
from voicegrid.session import cut_lineage, rows_frame, scratch_dir, scratch_table
from voicegrid.sources import sinks
from voicegrid.sources.csv import load_csv
from voicegrid.sources.driver_tables import feedback, labelled_feedback, review_texts, table

# Fixed arguments that the queries and their SQL share.
FIXED_TERMS = ("and", "de la", "from", "from the", "les", "license", "que", "the", "und", "with")
FIXED_IDF = (1.25, 2.5, 1.5, 2.25, 1.75, 3.0, 1.5, 1.125, 1.75, 1.375)
FIXED_WEIGHTS = (
    (0.5, -1.0, 0.25, 0.75, -0.5, 1.5, -0.25, 0.125, 1.0, -0.75),
    (-0.25, 0.5, 0.75, -0.5, 0.25, -1.0, 0.5, 0.0, -0.5, 0.25),
    (0.25, 1.0, -0.5, 0.5, 1.25, -0.25, 0.75, -0.125, 0.5, 1.0),
)
FIXED_INTERCEPTS = (0.125, -0.25, 0.0625)
SEARCHED = ("License", "heit", "ción de", "a", "@mail", "no such words")
#: A mapping with an absent column and one that is named twice.
LOOSE_MAPPING = ColumnMapping("message", date="created_at", rating="created_at", product="absent")


def folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/voicegrid/{name}-{uuid.uuid4().hex}"


@query
def csv_round_trip(spark, sf_dir):
    """Reviews written as CSV files of two column orders into one folder, and loaded by name."""
    rows = feedback(spark, sf_dir).select("doc_id", "review_text", "product", "rating")
    path = f"{folder(spark, 'csv')}.csv"
    sinks.write_reviews_csv(rows.where("doc_id % 2 = 0"), path)
    sinks.write_reviews_csv(rows.where("doc_id % 2 = 1").select("rating", "review_text", "doc_id", "product"), path, mode="append")
    read = load_csv(spark, path).dataframe
    return read.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("review_text").alias("text_md5"), "product", F.col("rating").cast("double").alias("rating"))


@query
def csv_failures(spark, sf_dir):
    """Which error each faulty file made of the reviews raises."""
    rows = feedback(spark, sf_dir).select("doc_id", "product")
    base = folder(spark, "faulty")
    sinks.write_reviews_csv(rows, f"{base}/all.csv")
    rows.select(F.lit("doc_id,product").alias("value")).limit(1).write.text(f"{base}/header.csv")
    # A line with its header as the name: each task writes a file of its own, headed alike, and quotes nothing.
    longer = rows.select(F.concat_ws(",", "doc_id", "product", "doc_id").alias("doc_id,product"))
    longer.write.csv(f"{base}/long.csv", header=True, sep="\x01", quote="", escape="")
    cases = {
        "too_many_rows": ("all.csv", IngestConfig(max_rows=max(1, rows.count() - 1))), "header_only": ("header.csv", IngestConfig()),
        "surplus_fields": ("long.csv", IngestConfig()), "other_suffix": ("all.txt", IngestConfig()), "absent": ("none.csv", IngestConfig()),
    }
    found = []
    for name, (file, config) in cases.items():
        try:
            load_csv(spark, f"{base}/{file}", config)
            found.append((name, "none"))
        except FeedbackError as problem:
            found.append((name, type(problem).__name__))
    return rows_frame(spark, found, "fault string, error string")


@query
def recommendations_csv(spark, sf_dir):
    path = f"{folder(spark, 'advice')}.csv"
    sinks.write_recommendations_csv(_insights(spark, sf_dir).recommendations, path)
    return load_csv(spark, path).dataframe.select(
        "priority", "title", F.col("supporting_count").cast("bigint").alias("supporting_count"), F.coalesce("representative_review_ids", F.lit("")).alias("review_ids")
    )


@query
def markdown_report(spark, sf_dir):
    """Headings and evidence lines of the written report."""
    path = folder(spark, "report")
    sinks.write_markdown(_insights(spark, sf_dir), path)
    lines = spark.read.text(path)
    return lines.agg(
        F.count_if(F.col("value").startswith("### ") & ~F.col("value").startswith("### [")).alias("findings"),
        F.count_if(F.col("value").startswith("### [")).alias("recommendations"),
        F.count_if(F.col("value").startswith("**Evidence:**")).alias("evidence_lines"),
    )


@query
def metrics_round_trip(spark, sf_dir):
    cells = metrics.confusion_matrix(predictions(spark, sf_dir))
    row = metrics.overall_metrics(metrics.class_report(cells)).first().asDict()
    path = folder(spark, "metrics")
    sinks.write_metrics(spark, row, path)
    found = sinks.read_metrics(spark, path)
    return rows_frame(spark, [tuple(float(found[name]) for name in row)], ", ".join(f"{name} double" for name in row))


@query
def prediction_round_trip(spark, sf_dir):
    path = folder(spark, "predictions")
    rows = predictions(spark, sf_dir).select("review_text", "actual", "predicted", F.lit(1.0).alias("confidence"))
    sinks.write_predictions(rows, path)
    return metrics.confusion_matrix(spark.read.parquet(path))


@query
def saved_sentiment(spark, sf_dir):
    """Reviews that a saved and loaded model scores otherwise than the model itself; scores out of range.

    Both models score a review in one pass; the scores alone are stored and meet by review id.
    """
    model, path = _fitted(spark, sf_dir), folder(spark, "sentiment")
    model.save(spark, path)
    rows = feedback(spark, sf_dir).select("review_id", "review_text", "clean_text")
    first = sentiment.predict_sentiment(rows, model).withColumnsRenamed({"sentiment_label": "a", "sentiment_score": "b"})
    second = sentiment.predict_sentiment(first, sentiment.SentimentModel.load(spark, path))
    scored = cut_lineage(second.select("review_id", "a", "b", "sentiment_label", "sentiment_score"))
    own, other = scored.select("review_id", "a", "b"), scored.select("review_id", "sentiment_label", "sentiment_score")
    same = (F.col("a") == F.col("sentiment_label")) & (F.abs(F.col("b") - F.col("sentiment_score")) < 1e-12)
    return own.join(other, "review_id").agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if(~F.coalesce(same, F.lit(False))).alias("changed"),
        F.count_if((F.col("b") < 1 / 3 - 1e-9) | (F.col("b") > 1) | ~F.col("a").isin(*fixed.SENTIMENT_LABELS)).alias("out_of_range"),
    )


@query
def saved_topics(spark, sf_dir):
    """Texts that a saved and loaded topic model assigns otherwise; texts without an assignment.

    The model's own topics are stored first: both models have the same plan, which Spark would run only once.
    """
    fit = topics.fit_topics(review_texts(spark, sf_dir), topics.TopicConfig())
    path = folder(spark, "topics")
    fit.model.save(spark, path)
    rows = fit.texts.withColumn("text_key", F.md5("topic_text"))
    own = cut_lineage(fit.model.assign(rows, strict=False).select("text_key", F.col("topic_id").alias("a")))
    other = topics.TopicModel.load(spark, path).assign(rows, strict=False).select("text_key", "topic_id")
    return own.join(other, "text_key").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("a") != F.col("topic_id")).alias("changed"),
        F.count_if(~F.col("a").between(-1, topics.TopicConfig().n_topics - 1)).alias("out_of_range"),
    )


@query
def fixed_sentiment(spark, sf_dir):
    """Scores of all reviews under a model with stated weights."""
    vocabulary = Vocabulary(FIXED_TERMS, np.array(FIXED_IDF), 1, 2)
    model = sentiment.SentimentModel(vocabulary, np.array(FIXED_WEIGHTS), np.array(FIXED_INTERCEPTS))
    scored = sentiment.predict_sentiment(feedback(spark, sf_dir), model)
    return scored.select("review_id", "sentiment_label", "sentiment_score")


@query
def validation_report(spark, sf_dir):
    """Codes and severities for the untidy source under a faulty mapping, and whether the gate lets it pass.

    The source is stored once, as the rules pass over it several times.
    """
    report = validation.validate_dataset(scratch_table(raw_reviews(spark, sf_dir), "raw"), LOOSE_MAPPING)
    try:
        validation.require_valid(report)
        passed = True
    except FeedbackError:
        passed = False
    return report.to_df(spark).select("code", "severity", F.lit(passed).alias("passed"))


@query
def header_names(spark, sf_dir):
    """Identifiers and text scores of headers made from the sources' names."""
    sources = [row["source"] for row in table(spark, sf_dir, "documents").select("source").distinct().where("source is not null").collect()]
    headers = [f" Kundén-Review {source}!" for source in sorted(sources)] + [f"{source} Amount" for source in sorted(sources)]
    rows = [(header, naming.normalize_name(header), profiling.keyword_score(header)) for header in headers]
    return rows_frame(spark, rows, "header string, name string, score double")


@query
def loose_filters(spark, sf_dir):
    """All filters on a table that lacks two of their columns: those are skipped, the others hold together."""
    rows = feedback(spark, sf_dir).drop("category", "rating")
    return filters.apply_filters(rows, EXPLORATION).select("review_id", "product")


@query
def topic_names(spark, sf_dir):
    """Readable names from each language's commonest words."""
    words = review_texts(spark, sf_dir).select("product", F.explode_outer(vector_tokens("clean_text")).alias("term")).where("term is not null")
    weights = words.groupBy(F.col("product").alias("topic_id"), "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    found: dict[str, list[str]] = {}
    for row in topics.topic_keywords(weights, 8).orderBy("topic_id", "rank").collect():
        found.setdefault(row["topic_id"], []).append(row["term"])
    return rows_frame(spark, [(k, topics.topic_label(v)) for k, v in sorted(found.items())], "language string, label string")


@query
def keyword_overlap(spark, sf_dir):
    """Overlap of the commonest words of each two languages."""
    words = review_texts(spark, sf_dir).select("product", F.explode_outer(vector_tokens(F.lower("clean_text"))).alias("term")).where("term is not null")
    weights = words.groupBy(F.col("product").alias("topic_id"), "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    found: dict[str, list[str]] = {}
    for row in topics.topic_keywords(weights, 20).orderBy("topic_id", "rank").collect():
        found.setdefault(row["topic_id"], []).append(row["term"])
    pairs = [(a, b, keyword_similarity({0: found[a]}, {0: found[b]}, top_n=20)) for a, b in combinations(sorted(found), 2)]
    return rows_frame(spark, pairs, "a string, b string, overlap double")


@query
def indexed_search(spark, sf_dir):
    """Reviews that hold each of some keywords, by way of the stored index."""
    path = folder(spark, "index")
    text_index.write_index(feedback(spark, sf_dir).select("review_id", "review_text", "product"), path, cluster_by=["product"], block_rows=200)
    parts = [text_index.search(spark, path, word).select(F.lit(word).alias("keyword"), "review_id") for word in SEARCHED]
    return reduce(DataFrame.unionAll, parts)


@query
def trend_gate(spark, sf_dir):
    """Whether trends are available, and in which unit, for the reviews as they are and with fewer dates."""
    rows = cut_lineage(labelled_feedback(spark, sf_dir).select("date", "sentiment_label"))
    first = rows.agg(F.min("date")).first()[0]
    cases = {
        "all": rows, "no_column": rows.drop("date"), "no_dates": rows.withColumn("date", F.lit(None).cast("timestamp_ntz")),
        "one_date": rows.where(F.col("date") == F.lit(first)), "one_week": rows.where(F.col("date") < F.lit(first) + F.expr("interval 20 hours")),
    }
    reasons = {text: name for name, text in fixed.TREND_REASONS.items()}
    found = []
    for name, part in cases.items():
        status = trends.trend_status(part, WEEK)
        found.append((name, status.available, reasons.get(status.reason, "")))
    return rows_frame(spark, found, "dates string, available boolean, reason string")


@query
def default_aspects(spark, sf_dir):
    """The default vocabulary on all reviews, each followed by a default phrase chosen by its number."""
    phrases = [term for terms in fixed.DEFAULT_ASPECTS.values() for term in terms]
    phrase = F.element_at(F.array(*map(F.lit, phrases)), (F.col("doc_id") % len(phrases) + 1).cast("int"))
    rows = labelled_feedback(spark, sf_dir).withColumn("clean_text", F.concat("clean_text", F.lit(". The "), F.upper(phrase), F.lit("!")))
    found = aspects.associate_aspect_sentiment(rows)
    return aspects.aspect_sentiment_counts(aspects.explode_mentions(found))


def _unaccented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_texts(spark, sf_dir).select("doc_id", F.md5(strip_accents(F.lower("review_text"))).alias("text_md5"))


_unaccented.__name__ = "unaccented_text"
query(_unaccented)
