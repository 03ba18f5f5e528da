"""Registered queries: one per operator, each over the whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voicegrid.functions import text as text_functions
from voicegrid.functions.labels import label_score, normalize_label
from voicegrid.operators import aspects, canonical, filters, insights, labelled, metrics, profiling
from voicegrid.operators import sentiment, statistics, tfidf, topic_quality, topics, trends, validation
from voicegrid.operators.fact_store import FactStore
from voicegrid.plans import pipeline
from voicegrid.schema import ColumnMapping, SentimentConfig, SplitConfig, TopicConfig
from voicegrid.session import compact_table, cut_lineage, release, rows_frame, scratch_dir
from voicegrid.sources.driver_tables import (
    CORPUS_ASPECTS,
    feedback,
    gold_feedback,
    labelled_feedback,
    review_texts,
    star_label,
    table,
)
from voicegrid.sources.fingerprint import add_parts, fingerprint_of, fingerprint_parts
from voicegrid.streaming import reviews as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed arguments that queries and their SQL share.
STOP_WORDS = ("the", "of", "and", "de", "la", "der", "die", "en", "es", "le")
KEYWORDS = {
    0: ("on", "er", "th", "license", "from"),
    1: ("le", "les", "des", "et", "du"),
    2: ("und", "das", "von", "den", "zu"),
    3: ("el", "los", "que", "las", "del"),
}
WEEK = "W"


def query(build: Query) -> Query:
    """Register a query under its function name; its result is tidied for comparison."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def tidy(df: DataFrame) -> DataFrame:
    """Wide integers, doubles at six digits, lists and maps as text, zone-less times."""

    def cell(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            column = F.round(column, 6)
        elif isinstance(kind, T.ArrayType):
            column = F.concat_ws("|", column)
        elif isinstance(kind, T.MapType):
            pairs = F.transform(F.map_entries(column), lambda e: F.concat_ws(":", e["key"], _flat(e["value"], kind.valueType)))
            column = F.concat_ws(";", F.array_sort(pairs))
        elif isinstance(kind, T.TimestampType):
            column = column.cast("timestamp_ntz")
        return column.alias(field.name)

    return df.select(*map(cell, df.schema))


def _flat(value: Column, kind: T.DataType) -> Column:
    return F.concat_ws(",", value) if isinstance(kind, T.ArrayType) else value.cast("string")


# ------------------------------------------------------------------ inputs --
RAW_MAPPING = ColumnMapping("message", date="created_at", rating="stars", product="product_name")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback as an untidy source: blank and null texts, unreadable dates and ratings."""
    rows = feedback(spark, sf_dir)
    number = F.col("doc_id")
    stamp = F.date_format("date", "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        "doc_id",
        F.when(number % 97 == 0, F.lit("  \t ")).when(number % 89 != 0, F.col("review_text")).alias("message"),
        F.when(number % 53 == 0, F.lit("not a date")).otherwise(stamp).alias("created_at"),
        F.when(number % 41 == 0, F.lit("n.a.")).otherwise(F.col("rating").cast("int").cast("string")).alias("stars"),
        F.when(number % 31 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "product", F.lit(" "))).alias("product_name"),
    )


def with_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feedback; the product's rank is the topic id."""
    names = F.array(*map(F.lit, ("de", "en", "es", "fr")))
    topic = (F.array_position(names, F.col("product")) - 1).cast("int")
    return labelled_feedback(spark, sf_dir).withColumn("topic_id", topic)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feedback with topics and aspects."""
    return aspects.associate_aspect_sentiment(with_topics(spark, sf_dir), CORPUS_ASPECTS)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aspects.explode_mentions(enriched(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = aspects.total_reviews(labelled_feedback(spark, sf_dir))
    return aspects.summarize_mentions(mentions(spark, sf_dir), total)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold label against a star-rating rule; rows without a rating count as bad."""
    rating = F.col("rating")
    rule = F.when(rating >= 4, "Positive").when(rating == 3, "Neutral").otherwise("Negative")
    return gold_feedback(spark, sf_dir).select(
        "review_text", "rating", F.col("sentiment_label").alias("actual"), rule.alias("predicted")
    )


def review_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.store_facts(trends.review_facts(labelled_feedback(spark, sf_dir), WEEK))


def mention_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.store_facts(trends.mention_facts(mentions(spark, sf_dir), WEEK))


def _digest(column: str | Column) -> Column:
    return F.md5(column)


# --------------------------------------------------------------- ingestion --
@query
def canonical_reviews(spark, sf_dir):
    rows = canonical.canonicalize(raw_reviews(spark, sf_dir), RAW_MAPPING, order_by="doc_id").dataframe
    return rows.select(
        "review_id", _digest("review_text").alias("review_md5"), _digest("clean_text").alias("clean_md5"),
        "date", "rating", "product",
    )


@query
def canonical_source_ids(spark, sf_dir):
    source = feedback(spark, sf_dir).select("review_id", "doc_id", "review_text", "rating")
    rows = canonical.canonicalize(source, ColumnMapping("review_text", rating="rating"), order_by="doc_id").dataframe
    return rows.select("review_id", _digest("clean_text").alias("clean_md5"), "rating")


@query
def ingestion_stats(spark, sf_dir):
    return canonical.ingestion_statistics(raw_reviews(spark, sf_dir), "message")


@query
def optional_casts(spark, sf_dir):
    return canonical.canonicalize(raw_reviews(spark, sf_dir), RAW_MAPPING, order_by="doc_id").casts


@query
def detected_columns(spark, sf_dir):
    """Text column and metadata columns of the untidy source, from all of its rows."""
    rows = raw_reviews(spark, sf_dir).drop("doc_id")
    text = profiling.detect_text_column(rows)
    found = {"text": text, **profiling.detect_metadata_columns(rows, text)}
    return rows_frame(spark, sorted(found.items()), "role string, column_name string")


@query
def text_column_scores(spark, sf_dir):
    columns = ["review_text", "clean_text", "product", "category", "version"]
    return profiling.score_text_columns(feedback(spark, sf_dir), columns, sample_rows=None)


@query
def validation_counts(spark, sf_dir):
    return validation.text_measures(raw_reviews(spark, sf_dir), "message")


@query
def filled_cells(spark, sf_dir):
    return validation.table_measures(raw_reviews(spark, sf_dir))


# -------------------------------------------------------------------- text --
def _text_query(name: str, expression: Callable[[str], Column]) -> None:
    def build(spark, sf_dir):
        return review_texts(spark, sf_dir).select("doc_id", _digest(expression("review_text")).alias("text_md5"))

    build.__name__ = name
    query(build)


_text_query("clean_classical", text_functions.clean_for_classical_model)
_text_query("clean_transformer", text_functions.clean_for_transformer)
_text_query("clean_topic", text_functions.clean_topic_text)
_text_query("clean_aspect", text_functions.normalize_aspect_text)
_text_query("folded_text", lambda c: text_functions.fold(text_functions.normalize_whitespace(c)))
_text_query("topic_tokens", lambda c: F.array_join(text_functions.tokenize_topic_text(c), " "))
_text_query("plain_tokens", lambda c: F.array_join(text_functions.plain_tokens(c), " "))


@query
def review_lengths(spark, sf_dir):
    return statistics.with_lengths(review_texts(spark, sf_dir)).select("doc_id", "review_word_count", "review_character_count")


@query
def normalized_labels(spark, sf_dir):
    rows = labelled_feedback(spark, sf_dir)
    messy = F.concat(F.lit("  "), F.upper("sentiment_label"), F.lit("\n"))
    clean = normalize_label(messy)
    return rows.select(clean.alias("label"), label_score(clean).alias("score")).groupBy("label", "score").agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query
def mapped_labels(spark, sf_dir):
    label = normalize_label(F.col("quality"), {"1": "Positive", "0": "negative"})
    return table(spark, sf_dir, "labels").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("row_count"))


# ----------------------------------------------------------------- filters --
EXPLORATION = filters.DatasetFilters(
    start_date=date(2024, 1, 4), end_date="2024-01-25", products=("EN", "Fr"), categories=("CLICK", "view", "error"),
    rating_min=1, rating_max=4, keyword=" THE ",
)
DASHBOARD = filters.DashboardFilters(
    start_date="2024-01-03", end_date="2024-01-27", products=("en", "fr", "de"), rating_min=1, rating_max=4,
    sentiments=("Positive", "Negative"), topics=("en", "fr"), aspects=("Origin", "Manner", "Pronoun"), search_text="A",
)


@query
def filter_options(spark, sf_dir):
    return filters.filter_options(feedback(spark, sf_dir))


@query
def option_ranges(spark, sf_dir):
    return filters.option_ranges(feedback(spark, sf_dir))


@query
def filtered_reviews(spark, sf_dir):
    return filters.apply_filters(feedback(spark, sf_dir), EXPLORATION).select("review_id", "date", "rating", "product", "category")


@query
def dashboard_options(spark, sf_dir):
    return filters.dashboard_filter_options(enriched(spark, sf_dir))


@query
def dashboard_filtered(spark, sf_dir):
    kept = filters.apply_dashboard_filters(enriched(spark, sf_dir), DASHBOARD)
    return kept.select("review_id", "sentiment_label", "topic_label", "rating")


@query
def aspect_filtered(spark, sf_dir):
    chosen = filters.DashboardFilters(aspects=("Noise", "Licensing"))
    return filters.apply_dashboard_filters(mentions(spark, sf_dir), chosen).select("review_id", "aspect", "aspect_sentiment_label")


@query
def confident_reviews(spark, sf_dir):
    return filters.minimum_confidence(labelled_feedback(spark, sf_dir), 0.8).select("review_id", "sentiment_score")


@query
def filter_status(spark, sf_dir):
    rows = enriched(spark, sf_dir)
    return filters.filter_status(rows, filters.apply_dashboard_filters(rows, DASHBOARD))


@query
def column_subset(spark, sf_dir):
    wanted = ("review_id", "date", "rating", "region", "product", "sentiment_label")
    return filters.select_existing(labelled_feedback(spark, sf_dir), wanted)


# -------------------------------------------------------------- statistics --
@query
def length_stats(spark, sf_dir):
    return statistics.length_statistics(review_texts(spark, sf_dir))


@query
def rating_stats(spark, sf_dir):
    return statistics.rating_statistics(feedback(spark, sf_dir))


@query
def text_rating_stats(spark, sf_dir):
    return statistics.rating_statistics(raw_reviews(spark, sf_dir), "stars")


@query
def timeline(spark, sf_dir):
    return statistics.reviews_over_time(feedback(spark, sf_dir), "D")


@query
def timeline_weekly(spark, sf_dir):
    return statistics.reviews_over_time(feedback(spark, sf_dir), WEEK)


def ordered_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback dated by the order of the same number, a span of several years."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"))
    return table(spark, sf_dir, "documents").join(orders, F.col("o_orderkey") == F.col("doc_id") * 10)


@query
def timeline_inferred(spark, sf_dir):
    return statistics.reviews_over_time(ordered_reviews(spark, sf_dir), None)


@query
def time_frequency(spark, sf_dir):
    short = statistics.time_frequency(feedback(spark, sf_dir)).select(F.lit("events").alias("source"), "frequency")
    long = statistics.time_frequency(ordered_reviews(spark, sf_dir)).select(F.lit("orders").alias("source"), "frequency")
    return short.unionAll(long)


@query
def common_words(spark, sf_dir):
    return statistics.common_words(review_texts(spark, sf_dir), top_n=50)


@query
def missing_summary(spark, sf_dir):
    return statistics.missing_values(raw_reviews(spark, sf_dir))


@query
def missing_ordered(spark, sf_dir):
    return statistics.ordered_missing_values(labelled_feedback(spark, sf_dir).select("review_id", "date", "rating", "product"))


@query
def empty_reviews(spark, sf_dir):
    return statistics.count_empty_reviews(raw_reviews(spark, sf_dir), "message")


@query
def duplicate_reviews(spark, sf_dir):
    return statistics.count_duplicate_reviews(raw_reviews(spark, sf_dir), "message")


@query
def quality_summary(spark, sf_dir):
    return statistics.quality_summary(raw_reviews(spark, sf_dir), "message")


@query
def dataset_summary(spark, sf_dir):
    return statistics.dataset_summary(feedback(spark, sf_dir))


@query
def category_distribution(spark, sf_dir):
    return statistics.group_distribution(feedback(spark, sf_dir), "category")


@query
def length_histogram(spark, sf_dir):
    return statistics.length_histogram(review_texts(spark, sf_dir))


@query
def rating_histogram(spark, sf_dir):
    return statistics.rating_histogram(feedback(spark, sf_dir))


@query
def confidence_histogram(spark, sf_dir):
    return statistics.confidence_histogram(labelled_feedback(spark, sf_dir))


# --------------------------------------------------------------- sentiment --
@query
def labeled_clean(spark, sf_dir):
    rows = labelled.prepare_labelled(gold_feedback(spark, sf_dir), keep_conflicts=True)
    return rows.select(_digest("review_text").alias("text_md5"), "sentiment_label")


@query
def label_conflicts(spark, sf_dir):
    # Labels by document number make copies of a text disagree.
    label = F.element_at(F.array(*map(F.lit, ("Negative", "Neutral", "Positive"))), (F.col("doc_id") % 3 + 1).cast("int"))
    pairs = labelled.labelled_pairs(feedback(spark, sf_dir).withColumn("sentiment_label", label))
    return labelled.label_conflicts(pairs).select(_digest("review_text").alias("text_md5"), "label_count")


@query
def class_distribution(spark, sf_dir):
    return labelled.class_distribution(gold_feedback(spark, sf_dir))


@query
def stratified_split(spark, sf_dir):
    rows = labelled.prepare_labelled(gold_feedback(spark, sf_dir), keep_conflicts=True)
    return labelled.split_labelled(rows, SplitConfig()).select(
        _digest("review_text").alias("text_md5"), "sentiment_label", "split"
    )


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(predictions(spark, sf_dir))


@query
def class_report(spark, sf_dir):
    return metrics.class_report(metrics.confusion_matrix(predictions(spark, sf_dir)))


@query
def overall_metrics(spark, sf_dir):
    return metrics.overall_metrics(metrics.class_report(metrics.confusion_matrix(predictions(spark, sf_dir))))


@query
def model_comparison(spark, sf_dir):
    rows = predictions(spark, sf_dir)

    def report(df: DataFrame) -> DataFrame:
        return metrics.overall_metrics(metrics.class_report(metrics.confusion_matrix(df)))

    constant = rows.withColumn("predicted", F.lit("Positive"))
    return metrics.model_comparison(report(rows), report(constant), names=("rating_rule", "always_positive"))


@query
def dataset_comparison(spark, sf_dir):
    first = predictions(spark, sf_dir).select(F.lit("documents").alias("dataset"), "actual", "predicted")
    names = F.array(*map(F.lit, ("Negative", "Neutral", "Positive")))
    second = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("dataset"),
        F.element_at(names, (F.col("conv_id") % 3 + 1).cast("int")).alias("actual"),
        F.element_at(names, (F.col("turn") % 3 + 1).cast("int")).alias("predicted"),
    )
    by = ["dataset"]
    cells = metrics.confusion_matrix(first.unionAll(second), by=by)
    return metrics.overall_metrics(metrics.class_report(cells, by=by), by=by)


@query
def error_slices(spark, sf_dir):
    return metrics.error_slices(predictions(spark, sf_dir), short_words=200)


@query
def sentiment_distribution(spark, sf_dir):
    return metrics.sentiment_distribution(labelled_feedback(spark, sf_dir))


@query
def sentiment_by_month(spark, sf_dir):
    return sentiment.sentiment_by_month(labelled_feedback(spark, sf_dir))


@query
def label_representatives(spark, sf_dir):
    top = sentiment.label_representatives(labelled_feedback(spark, sf_dir))
    return top.select("sentiment_label", "rank", "review_id", "sentiment_score")


@query
def sentiment_headline(spark, sf_dir):
    return sentiment.sentiment_headline(labelled_feedback(spark, sf_dir))


@query
def mean_confidence(spark, sf_dir):
    return sentiment.mean_confidence(labelled_feedback(spark, sf_dir))


# ------------------------------------------------------------------ topics --
@query
def topic_corpus(spark, sf_dir):
    rows = topics.topic_corpus(review_texts(spark, sf_dir), order_by="doc_id")
    return rows.select("doc_id", _digest("topic_text").alias("topic_md5"))


@query
def corpus_stats(spark, sf_dir):
    return topics.corpus_statistics(review_texts(spark, sf_dir))


def _topic_tokens() -> Column:
    return tfidf.tokens_of(F.col("topic_text"), STOP_WORDS)


def _stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.stored_corpus(review_texts(spark, sf_dir).select("doc_id", "clean_text"), ["doc_id"], order_by="doc_id")


@query
def term_statistics(spark, sf_dir):
    corpus = _stored_corpus(spark, sf_dir)
    counts = tfidf.term_statistics(corpus, _topic_tokens(), 2)
    documents = corpus.count()
    chosen = tfidf.select_terms(counts, documents, max_features=None, min_df=2, max_df=0.95)
    return chosen.select("term", "corpus_count", "document_count", "idf")


@query
def tfidf_weights(spark, sf_dir):
    """Weights of all terms within the document limits."""
    corpus = _stored_corpus(spark, sf_dir)
    counts = tfidf.term_statistics(corpus, _topic_tokens(), 2)
    chosen = tfidf.select_terms(counts, corpus.count(), max_features=None, min_df=2, max_df=0.95)
    chosen = compact_table(chosen.select("term", "idf"), "chosen")
    return tfidf.term_weights(corpus, "doc_id", _topic_tokens(), chosen)


@query
def term_numbers(spark, sf_dir):
    """Each term's place in the alphabet of all terms."""
    corpus = _stored_corpus(spark, sf_dir)
    counts = tfidf.term_statistics(corpus, _topic_tokens(), 2)
    chosen = tfidf.select_terms(counts, corpus.count(), max_features=None, min_df=2, max_df=0.95)
    return tfidf.number_terms(chosen).select("term", "number")


@query
def topic_keywords(spark, sf_dir):
    rows = review_texts(spark, sf_dir).select("product", F.explode_outer(text_functions.vector_tokens("clean_text")).alias("term"))
    weights = rows.where(F.col("term").isNotNull()).groupBy(F.col("product").alias("topic_id"), "term").agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    return topics.topic_keywords(weights, 8)


def _keyword_rows(spark: SparkSession) -> DataFrame:
    rows = [(t, name, ", ".join(KEYWORDS[t])) for t, name in enumerate(("de", "en", "es", "fr"))]
    return rows_frame(spark, rows, "topic_id int, topic_label string, top_keywords string")


@query
def topic_summary(spark, sf_dir):
    return topics.topic_summary(with_topics(spark, sf_dir), _keyword_rows(spark))


@query
def topic_filtered_summary(spark, sf_dir):
    kept = filters.apply_dashboard_filters(enriched(spark, sf_dir), DASHBOARD)
    return topics.topic_summary(kept, _keyword_rows(spark))


@query
def topic_size_extremes(spark, sf_dir):
    return topics.topic_size_extremes(topics.topic_summary(with_topics(spark, sf_dir), _keyword_rows(spark)))


@query
def topic_keyword_table(spark, sf_dir):
    return topics.keyword_table(topics.topic_summary(with_topics(spark, sf_dir), _keyword_rows(spark)))


@query
def topic_sentiment(spark, sf_dir):
    return topics.topic_sentiment_counts(labelled_feedback(spark, sf_dir))


@query
def topic_representatives(spark, sf_dir):
    return topics.topic_representatives(with_topics(spark, sf_dir).withColumn("topic_strength", F.col("sentiment_score")))


@query
def topic_profile(spark, sf_dir):
    return topics.topic_profile(labelled_feedback(spark, sf_dir), "fr")


@query
def topic_examples(spark, sf_dir):
    """Examples by the stored representatives of the topics."""
    rows = with_topics(spark, sf_dir)
    strongest = topics.topic_representatives(rows.withColumn("topic_strength", F.col("sentiment_score")))
    stored = {row["topic_id"]: row["representative_review_ids"] for row in strongest.collect()}
    return topics.topic_examples(rows, "de", stored).select("review_id", "topic_label", "sentiment_label")


@query
def assignment_coverage(spark, sf_dir):
    rows = feedback(spark, sf_dir).select(F.when(F.col("rating") > 1, F.lit(0)).otherwise(F.lit(-1)).alias("topic_id"))
    return topics.assignment_coverage(rows)


@query
def topic_npmi(spark, sf_dir):
    texts = review_texts(spark, sf_dir).select("clean_text")
    tokens = text_functions.vector_tokens(F.lower("clean_text"))
    presence = topic_quality.keyword_presence(texts, tokens, KEYWORDS)
    return topic_quality.npmi_pairs(presence, KEYWORDS, texts.count())


@query
def topic_coherence(spark, sf_dir):
    texts = review_texts(spark, sf_dir).select("clean_text")
    tokens = text_functions.vector_tokens(F.lower("clean_text"))
    return topic_quality.topic_coherence(texts, tokens, KEYWORDS, texts.count())


@query
def topic_diversity(spark, sf_dir):
    rows = review_texts(spark, sf_dir).select("product", F.explode_outer(text_functions.vector_tokens("clean_text")).alias("term"))
    weights = rows.where(F.col("term").isNotNull()).groupBy(F.col("product").alias("topic_id"), "term").agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    return topic_quality.topic_diversity(topics.topic_keywords(weights, 8), 8)


@query
def topic_coverage(spark, sf_dir):
    texts = review_texts(spark, sf_dir).select("clean_text")
    terms = [word for listed in KEYWORDS.values() for word in listed]
    return topic_quality.term_coverage(texts, text_functions.vector_tokens(F.lower("clean_text")), terms)


# ----------------------------------------------------------------- aspects --
@query
def aspect_reviews(spark, sf_dir):
    rows = aspects.associate_aspect_sentiment(labelled_feedback(spark, sf_dir), CORPUS_ASPECTS, with_terms=True)
    return rows.select("review_id", "detected_aspects", "aspect_sentiment", "matched_terms")


@query
def aspect_mentions(spark, sf_dir):
    return mentions(spark, sf_dir).select(
        "review_id", "aspect", "aspect_sentiment_label", "aspect_sentiment_numeric", "aspect_confidence", "product", "rating"
    )


@query
def aspect_summary(spark, sf_dir):
    return summary(spark, sf_dir)


@query
def aspect_evaluation(spark, sf_dir):
    return aspects.evaluate_aspects(enriched(spark, sf_dir))


@query
def aspect_sentiment_counts(spark, sf_dir):
    return aspects.aspect_sentiment_counts(mentions(spark, sf_dir))


@query
def aspect_posneg(spark, sf_dir):
    return aspects.positive_negative(summary(spark, sf_dir))


@query
def aspect_ratings(spark, sf_dir):
    return aspects.aspects_by_rating(summary(spark, sf_dir))


@query
def aspect_rating_extremes(spark, sf_dir):
    return aspects.rating_extremes(summary(spark, sf_dir))


@query
def aspect_leaders(spark, sf_dir):
    return aspects.aspect_leaders(summary(spark, sf_dir))


@query
def aspect_topics(spark, sf_dir):
    return aspects.aspect_topics(mentions(spark, sf_dir), "Manner")


@query
def aspect_examples(spark, sf_dir):
    shown = ("review_id", "aspect_sentiment_label", "topic_label")
    return aspects.aspect_examples(mentions(spark, sf_dir).select("aspect", *shown), "Noise").select(*shown)


@query
def aspect_filtered_summary(spark, sf_dir):
    kept = filters.apply_dashboard_filters(enriched(spark, sf_dir), DASHBOARD)
    chosen = filters.DashboardFilters(aspects=DASHBOARD.aspects)
    spoken = filters.apply_dashboard_filters(aspects.explode_mentions(kept), chosen)
    return aspects.summarize_mentions(spoken, aspects.total_reviews(kept))


# ------------------------------------------------------------------ trends --
@query
def trend_bounds(spark, sf_dir):
    return trends.date_bounds(labelled_feedback(spark, sf_dir))


@query
def review_volume(spark, sf_dir):
    return trends.review_volume(review_facts(spark, sf_dir))


@query
def sentiment_trend(spark, sf_dir):
    return trends.sentiment_trend(review_facts(spark, sf_dir))


@query
def topic_trend(spark, sf_dir):
    return trends.topic_trend(review_facts(spark, sf_dir))


@query
def aspect_trend(spark, sf_dir):
    return trends.aspect_trend(mention_facts(spark, sf_dir))


@query
def fastest_topic(spark, sf_dir):
    facts = review_facts(spark, sf_dir)
    return trends.fastest_growing_topic(trends.topic_trend(facts), trends.evidence_floor(trends.total_of(facts)))


@query
def worsening_aspect(spark, sf_dir):
    return trends.worsening_aspect(trends.aspect_trend(mention_facts(spark, sf_dir)), 1)


@query
def sentiment_change(spark, sf_dir):
    return trends.sentiment_change(trends.sentiment_trend(review_facts(spark, sf_dir)))


def _fact_store(spark: SparkSession, sf_dir: str) -> FactStore:
    """Facts of all reviews, stored as three sources one after the other, the first of them twice."""
    store = FactStore(spark, f"{scratch_dir(spark)}/voicegrid/facts-{uuid.uuid4().hex}")
    rows = cut_lineage(enriched(spark, sf_dir).drop("review_text", "clean_text"))
    first = F.coalesce(F.col("version") == "src0", F.lit(False))
    german = F.coalesce(F.col("product") == "de", F.lit(False))
    for name, part in (("a", first), ("b", ~first & german), ("a", first), ("c", ~first & ~german)):
        store.put(name, rows.where(part))
    return store


@query
def incremental_volume(spark, sf_dir):
    return trends.review_volume(_fact_store(spark, sf_dir).review_facts(WEEK))


@query
def incremental_topic_trend(spark, sf_dir):
    return trends.topic_trend(_fact_store(spark, sf_dir).review_facts(WEEK))


@query
def incremental_aspect_trend(spark, sf_dir):
    return trends.aspect_trend(_fact_store(spark, sf_dir).mention_facts(WEEK))


@query
def incremental_summary(spark, sf_dir):
    store = _fact_store(spark, sf_dir)
    return insights.summary_of_facts(store.mention_facts(None), trends.total_of(store.review_facts(None)))


@query
def evidence_floor(spark, sf_dir):
    total = labelled_feedback(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_reviews"))
    return total.select("total_reviews", trends.evidence_floor(F.col("total_reviews")).alias("evidence_floor"))


# ---------------------------------------------------------------- insights --
@query
def overall_sentiment(spark, sf_dir):
    return insights.overall_sentiment(review_facts(spark, sf_dir))


@query
def topic_ranking(spark, sf_dir):
    return insights.topic_ranking(review_facts(spark, sf_dir))


@query
def aspect_extremes(spark, sf_dir):
    reviews = review_facts(spark, sf_dir)
    total = trends.total_of(reviews)
    found = insights.summary_of_facts(mention_facts(spark, sf_dir), total)
    floor = trends.evidence_floor(total)
    sides = [insights.aspect_extreme(found, side, floor).withColumn("side", F.lit(side)) for side in ("positive", "negative")]
    return reduce(DataFrame.unionAll, sides)


@query
def product_comparison(spark, sf_dir):
    return insights.product_comparison(labelled_feedback(spark, sf_dir))


@query
def category_comparison(spark, sf_dir):
    return insights.product_comparison(labelled_feedback(spark, sf_dir), "category")


@query
def evidence_ids(spark, sf_dir):
    rows = enriched(spark, sf_dir)
    tests = {name: F.array_contains("detected_aspects", name) for name in ("Noise", "Pronoun")}
    tests["topic de"] = F.col("topic_label") == "de"
    found = insights.evidence_ids(rows, tests, order_by="doc_id")
    return rows_frame(spark, list(found.items()), "tag string, review_ids array<string>")


@query
def insight_metrics(spark, sf_dir):
    reviews = trends.store_facts(trends.review_facts(enriched(spark, sf_dir), WEEK))
    bundle = insights.metrics_bundle(reviews, mention_facts(spark, sf_dir), trends=True)
    return bundle.select(
        "total_reviews", "positive_count", "neutral_count", "negative_count", "dominant_sentiment", "topic_count",
        "aspect_count", "aspect_coverage", "topic_summary_rows", "aspect_summary_rows",
        F.col("most_discussed_topic.topic_label").alias("most_discussed_topic"),
        F.col("key_strength.aspect").alias("key_strength"),
        F.col("priority_improvement.aspect").alias("priority_improvement"),
    )


def _insights(spark: SparkSession, sf_dir: str) -> insights.Insights:
    return insights.generate_insights(enriched(spark, sf_dir), frequency=WEEK, order_by="doc_id")


@query
def findings(spark, sf_dir):
    return _insights(spark, sf_dir).findings


@query
def recommendations(spark, sf_dir):
    return _insights(spark, sf_dir).recommendations


@query
def executive_summary(spark, sf_dir):
    return rows_frame(spark, [(_insights(spark, sf_dir).executive_summary,)], "executive_summary string")


@query
def filtered_insights(spark, sf_dir):
    kept = filters.apply_dashboard_filters(enriched(spark, sf_dir), filters.DashboardFilters(products=("fr", "de", "es")))
    found = insights.generate_insights(kept, frequency=WEEK, order_by="doc_id")
    return found.findings.select("category", "evidence", "metric_value", "supporting_count", "affected_item", "representative_review_ids")


# ----------------------------------------------------------------- streams --
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a file stream, dated and labelled by static left joins."""
    schema = table(spark, sf_dir, "documents").schema
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("date"), "value")
    gold = table(spark, sf_dir, "labels")
    own = F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "Positive").when(F.col("quality") == 0, "Neutral")
    # The pattern matches the table as one file and as a folder of part files.
    stream = streams.read_reviews(spark, f"{sf_dir}/documents.parquet*", schema)
    joined = stream.join(events, F.col("event_id") == F.col("doc_id") * 10, "left").join(gold, "doc_id", "left")
    stars = F.least(F.lit(5), F.lit(1) + F.floor(F.col("value") / 25)).cast("double")
    rated = joined.withColumn("rating", F.when(F.col("value").isNotNull(), stars))
    return rated.select("doc_id", F.col("text").alias("review_text"), "date", F.coalesce(own, star_label()).alias("sentiment_label"))


def _latest_state(stream: DataFrame, name: str) -> DataFrame:
    """Result table of a windowed stream after all input; it is as small as the windows."""
    spark = stream.sparkSession
    folder = _fresh(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state")

    started = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/state")


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/voicegrid/stream-{name}-{uuid.uuid4().hex}"


def _written(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    folder = _fresh(spark, name)
    streams.write_stream(stream, f"{folder}/data", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/data")


@query
def stream_enriched(spark, sf_dir):
    rows = _written(streams.enrich_stream(_stream(spark, sf_dir), vocabulary=CORPUS_ASPECTS), "enriched")
    return aspects.aspect_sentiment_counts(aspects.explode_mentions(rows))


@query
def stream_sentiment_windows(spark, sf_dir):
    return _latest_state(streams.sentiment_windows(_stream(spark, sf_dir), frequency=WEEK), "sentiment")


@query
def stream_aspect_windows(spark, sf_dir):
    rows = streams.enrich_stream(_stream(spark, sf_dir), vocabulary=CORPUS_ASPECTS)
    return _latest_state(streams.aspect_windows(rows, frequency=WEEK), "aspects")


@query
def stream_distinct(spark, sf_dir):
    stream = _stream(spark, sf_dir)
    kept = streams.drop_repeats(stream, text_column="review_text", late_by="60 days")
    return _written(kept, "distinct").agg(F.count(F.lit(1)).alias("distinct_reviews"))


@query
def stream_closed_windows(spark, sf_dir):
    """Weeks that the watermark has closed, appended once, in batches by number."""
    stream = streams.sentiment_windows(_stream(spark, sf_dir), frequency=WEEK, late_by="2 days")
    folder = _fresh(spark, "closed")
    streams.write_batches(stream, f"{folder}/data", f"{folder}/checkpoint").awaitTermination()
    return streams.read_batches(spark, f"{folder}/data", stream.schema)


@query
def stream_earliest(spark, sf_dir):
    """The earliest review of each text by event time, of those the watermark has passed."""
    streams.needs_column_families(spark)
    stream = _stream(spark, sf_dir).withColumn("review_id", F.format_string("review_%06d", "doc_id"))
    kept = streams.earliest_of_repeats(stream, ["review_id"], text_column="review_text", late_by="2 days")
    folder = _fresh(spark, "earliest")
    streams.write_batches(kept, f"{folder}/data", f"{folder}/checkpoint").awaitTermination()
    return streams.read_batches(spark, f"{folder}/data", kept.schema).select("review_id", "date")


@query
def dataset_fingerprint(spark, sf_dir):
    """Fingerprint of all reviews, added up from the parts of two halves."""
    rows, names = labelled_feedback(spark, sf_dir), ["review_text", "sentiment_label"]
    first = F.coalesce(F.col("version") == "src0", F.lit(False))
    parts = add_parts(fingerprint_parts(rows.where(first), names), fingerprint_parts(rows.where(~first), names))
    return fingerprint_of(parts, names)


# --------------------------------------------------- models, without an SQL --
class _KeywordScorer:
    """Stand-in for an external model: counts a few corpus words."""

    labels = ("Negative", "Neutral", "Positive")

    def score(self, texts):
        import numpy as np

        counts = np.array([[t.count("elle"), 1.0 + t.count("from"), t.count("with")] for t in texts], dtype=float)
        return counts / counts.sum(axis=1, keepdims=True)


def _fitted(spark: SparkSession, sf_dir: str) -> sentiment.SentimentModel:
    return _fitted_on(gold_feedback(spark, sf_dir))


def _fitted_on(gold: DataFrame) -> sentiment.SentimentModel:
    """The model of labelled reviews; their distinct texts are stored, as several passes read them."""
    pairs = labelled.prepare_labelled(gold, keep_conflicts=True, store=True)
    release(gold.sparkSession)
    model = sentiment.fit_sentiment(pairs, SentimentConfig())
    del pairs
    release(gold.sparkSession)
    return model


@query
def sentiment_scored(spark, sf_dir):
    scored = sentiment.predict_sentiment(feedback(spark, sf_dir), _fitted(spark, sf_dir))
    return scored.select("review_id", "sentiment_label", "sentiment_score")


@query
def sentiment_supplied(spark, sf_dir):
    scored = sentiment.predict_sentiment(feedback(spark, sf_dir), sentiment.SuppliedModel(_KeywordScorer))
    return scored.select("review_id", "sentiment_label", "sentiment_score")


@query
def sentiment_training(spark, sf_dir):
    _, report, _ = sentiment.train_sentiment(gold_feedback(spark, sf_dir), SentimentConfig(), keep_conflicts=True)
    shown = ("accuracy", "precision_macro", "recall_macro", "macro_f1", "weighted_f1", "mean_confidence")
    return rows_frame(spark, [(name, float(report[name])) for name in shown], "metric string, value double")


TOPICS = TopicConfig()


@query
def topic_assignments(spark, sf_dir):
    _, rows = topics.model_topics(feedback(spark, sf_dir), TOPICS, order_by="doc_id", strict=False)
    return rows.select("review_id", "topic_id", "topic_label", "topic_strength", "topic_confidence")


@query
def topic_quality_report(spark, sf_dir):
    fit = topics.fit_topics(feedback(spark, sf_dir), TOPICS)
    found = topic_quality.evaluate_topics(fit)
    return rows_frame(spark, [(name, float(value)) for name, value in found.items()], "metric string, value double")


def _analysed(reviews: DataFrame) -> tuple[DataFrame, sentiment.SentimentModel]:
    """Canonical table of stored reviews, and the model of those with a gold label."""
    release(reviews.sparkSession)
    mapping = ColumnMapping("review_text", "date", "rating", "product", "category", "version")
    rows = canonical.canonicalize(reviews.drop("sentiment_label"), mapping, order_by="doc_id").dataframe
    return rows, _fitted_on(reviews.where(F.col("sentiment_label").isNotNull()))


@query
def full_analysis(spark, sf_dir):
    """Reviews are joined and stored once, for the model and for the table, and given up when they are scored."""
    done = pipeline.run_pipeline(
        *_analysed(cut_lineage(feedback(spark, sf_dir).drop("sentiment_score", "clean_text"))),
        topic_config=TOPICS, vocabulary=CORPUS_ASPECTS, strict=False,
    )
    return done.dataframe.select(
        "review_id", "sentiment_label", "sentiment_score", "topic_id", "topic_label", "detected_aspects"
    )


# Queries on files and reports register themselves in the same table.
from voicegrid.plans import surface  # noqa: E402, F401
