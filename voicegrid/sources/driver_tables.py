"""The driver's ``documents``, ``events`` and ``labels`` tables seen as customer feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voicegrid.functions.text import normalize_whitespace

# Terms that occur in the driver's invented prose.
CORPUS_ASPECTS = {
    "Licensing": ("license",),
    "Origin": ("from", "from the"),
    "Pointer": ("this", "of this"),
    "Manner": ("with", "by the"),
    "Suffix": ("keit", "mente", "ado"),
    "Pronoun": ("elle",),
    "Noise": ("rewh",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names a number of partitions to deal the documents into after reading; unset, they stay as read.
#: It serves tables written as one row group, which a single task reads.
INPUT_PARTITIONS = "spark.voicegrid.inputPartitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals rows out anew where the session asks for it."""
    wanted = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(wanted), key) if wanted else df


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews without dates, ratings and labels: queries on texts alone need no join."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.format_string("review_%06d", "doc_id").alias("review_id"),
        "doc_id",
        F.col("text").alias("review_text"),
        normalize_whitespace("text").alias("clean_text"),
        F.col("lang").alias("product"),
        F.col("source").alias("version"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review row per document, with a date, rating and gold label where one exists."""
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    # Both joins are on doc_id, so that texts are shuffled once.
    events = table(spark, sf_dir, "events").where(F.col("event_id") % 10 == 0).select(
        F.expr("event_id div 10").alias("doc_id"), F.col("ts").alias("date"), "value", "event_type"
    )
    labels = table(spark, sf_dir, "labels")
    joined = documents.join(events, "doc_id", "left").join(labels, "doc_id", "left")
    stars = F.least(F.lit(5), F.lit(1) + F.floor(F.col("value") / 25)).cast("double")
    label = (
        F.when(F.col("toxic") == 1, "Negative")
        .when(F.col("quality") == 1, "Positive")
        .when(F.col("quality") == 0, "Neutral")
    )
    return joined.select(
        F.format_string("review_%06d", "doc_id").alias("review_id"),
        "doc_id",
        F.col("text").alias("review_text"),
        normalize_whitespace("text").alias("clean_text"),
        "date",
        F.when(F.col("value").isNotNull(), stars).alias("rating"),
        F.col("lang").alias("product"),
        F.col("event_type").alias("category"),
        F.col("source").alias("version"),
        label.alias("sentiment_label"),
        ((F.lit(50) + F.col("doc_id") % 50) / F.lit(100.0)).cast("double").alias("sentiment_score"),
    )


def star_label(rating: str = "rating") -> Column:
    """The label that a star rating stands for; Neutral without one."""
    stars = F.col(rating)
    return F.when(stars >= 4, "Positive").when(stars < 3, "Negative").otherwise("Neutral")


def gold_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback rows with a gold label, for training and evaluation."""
    return feedback(spark, sf_dir).where(F.col("sentiment_label").isNotNull())


def labelled_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feedback rows, labelled by gold or else by stars; the product stands in for the topic."""
    label = F.coalesce("sentiment_label", star_label())
    return feedback(spark, sf_dir).withColumns({"sentiment_label": label, "topic_label": F.col("product")})
