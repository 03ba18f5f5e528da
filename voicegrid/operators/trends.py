"""Date trends.

Reviews and mentions are each reduced to one small fact table (period x topic
x label, period x aspect x label) in a single scan.  All trend tables and
change signals are arithmetic on those facts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from voicegrid import fixed_values as fixed
from voicegrid.functions.casts import finite, to_time
from voicegrid.functions.labels import canonical_label
from voicegrid.operators.statistics import period_of, span_frequency
from voicegrid.schema import InsightError, require_columns
from voicegrid.session import cut_lineage


@dataclass(frozen=True)
class TrendStatus:
    """Whether trends can be computed, why not, and the bucket size."""

    available: bool
    reason: str | None
    frequency: str | None


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last date with the suggested frequency, one row."""
    when = to_time(df, "date")
    bounds = df.agg(F.min(when).alias("first_date"), F.max(when).alias("last_date"))
    return bounds.withColumn("frequency", span_frequency(F.col("first_date"), F.col("last_date")))


def trend_status(df: DataFrame, frequency: str | None = None) -> TrendStatus:
    """Availability gate; reads nothing but the date column, once."""
    if "date" not in df.columns:
        return TrendStatus(False, fixed.TREND_REASONS["no_column"], None)
    periods = [
        F.struct(period_of(F.col("first_date"), unit), period_of(F.col("last_date"), unit)).alias(unit)
        for unit in ("D", "W", "M")
    ]
    row = date_bounds(df).select("*", *periods).first()
    if row["first_date"] is None:
        return TrendStatus(False, fixed.TREND_REASONS["no_dates"], None)
    if row["first_date"] == row["last_date"]:
        return TrendStatus(False, fixed.TREND_REASONS["one_date"], None)
    unit = frequency or row["frequency"]
    first, last = row[unit]
    if first == last:
        return TrendStatus(False, fixed.TREND_REASONS["one_period"], unit)
    return TrendStatus(True, None, unit)


# ------------------------------------------------------------------- facts --
def _period(df: DataFrame, frequency: str | None) -> Column:
    if frequency is None or "date" not in df.columns:
        return F.lit(None).cast("timestamp_ntz")
    return period_of(to_time(df, "date"), frequency)


def review_facts(df: DataFrame, frequency: str | None) -> DataFrame:
    """Reviews per (period, topic, label); undated rows keep a null period."""
    topic = F.col("topic_label") if "topic_label" in df.columns else F.lit(None).cast("string")
    aspects = F.size("detected_aspects") > 0 if "detected_aspects" in df.columns else F.lit(False)
    return df.groupBy(
        _period(df, frequency).alias("period"),
        topic.alias("topic_label"),
        canonical_label(F.col("sentiment_label")).alias("sentiment_label"),
    ).agg(F.count(F.lit(1)).alias("review_count"), F.count_if(aspects).alias("with_aspects"))


def mention_facts(mentions: DataFrame, frequency: str | None) -> DataFrame:
    """Mentions per (period, aspect, label) with the sums that averages need."""
    rating = finite(F.col("rating")) if "rating" in mentions.columns else F.lit(None).cast("double")
    confidence = finite(F.col("aspect_confidence"))
    return mentions.groupBy(
        _period(mentions, frequency).alias("period"), "aspect", F.initcap("aspect_sentiment_label").alias("sentiment_label")
    ).agg(
        F.count(F.lit(1)).alias("mention_count"),
        F.sum("aspect_sentiment_numeric").alias("sentiment_sum"),
        F.sum(confidence).alias("confidence_sum"),
        F.count(confidence).alias("confidence_count"),
        F.sum(rating).alias("rating_sum"),
        F.count(rating).alias("rating_count"),
    )


def store_facts(facts: DataFrame) -> DataFrame:
    """Facts stored as they were grouped: one row per period, topic or aspect, and label.

    The many aggregates over them need no second scan of the reviews, and
    adaptive execution joins small partitions by their measured size.
    """
    return cut_lineage(facts)


# ------------------------------------------------------------------ tables --
def review_volume(facts: DataFrame) -> DataFrame:
    """Reviews per period."""
    dated = facts.where(F.col("period").isNotNull())
    return dated.groupBy("period").agg(F.sum("review_count").alias("review_count")).orderBy("period")


def _share_trend(facts: DataFrame, column: str) -> DataFrame:
    counts = (
        facts.where(F.col("period").isNotNull() & F.col(column).isNotNull())
        .groupBy("period", column)
        .agg(F.sum("review_count").alias("review_count"))
    )
    in_period = F.sum("review_count").over(Window.partitionBy("period"))
    return counts.withColumn("share", F.col("review_count") / in_period).orderBy("period", column)


def sentiment_trend(facts: DataFrame) -> DataFrame:
    """Count and share of each label within its period."""
    return _share_trend(facts, "sentiment_label")


def topic_trend(facts: DataFrame) -> DataFrame:
    """Count and share of each topic within its period; rows without topic take no part."""
    return _share_trend(facts, "topic_label")


def aspect_trend(facts: DataFrame) -> DataFrame:
    """Mentions, negative mentions and negative share per (period, aspect)."""
    negative = F.when(F.col("sentiment_label") == "Negative", F.col("mention_count")).otherwise(F.lit(0))
    return (
        facts.where(F.col("period").isNotNull() & F.col("aspect").isNotNull())
        .groupBy("period", "aspect")
        .agg(F.sum("mention_count").alias("mention_count"), F.sum(negative).alias("negative_count"))
        .withColumn("negative_share", F.col("negative_count") / F.col("mention_count"))
        .orderBy("period", "aspect")
    )


# ----------------------------------------------------------------- signals --
def evidence_floor(total: Column | int) -> Column:
    """Least count a ranked claim needs: 2% of all reviews, at least 2; 1 for none."""
    size = total if isinstance(total, Column) else F.lit(total)
    return F.when(size <= 0, F.lit(1)).otherwise(F.greatest(F.lit(2), F.ceil(size * F.lit(0.02)))).cast("bigint")


def total_of(facts: DataFrame) -> Column:
    """All reviews behind a review fact table, dated or not."""
    return facts.agg(F.coalesce(F.sum("review_count"), F.lit(0))).scalar()


def latest_two(trend: DataFrame) -> DataFrame:
    """Rows of the two latest periods present, marked with ``recent`` and both dates."""
    periods = trend.agg(F.slice(F.sort_array(F.collect_set("period"), asc=False), 1, 2)).scalar()
    marked = trend.withColumn("_two", periods).where(F.size("_two") == 2)
    return marked.where(F.array_contains("_two", F.col("period"))).select(
        "*",
        F.col("_two")[1].alias("previous_period"),
        F.col("_two")[0].alias("recent_period"),
        (F.col("period") == F.col("_two")[0]).alias("recent"),
    )


def _side(recent: bool, value: str) -> Column:
    return F.max(F.when(F.col("recent") == recent, F.col(value)))


def fastest_growing_topic(trend: DataFrame, support: Column | int) -> DataFrame:
    """Topic with the largest gain in share, at most one row.

    A topic absent from a period has share 0 there.
    """
    least = support if isinstance(support, Column) else F.lit(support)
    per_topic = (
        latest_two(trend)
        .groupBy("topic_label", "previous_period", "recent_period")
        .agg(
            F.coalesce(_side(False, "share"), F.lit(0.0)).alias("previous_share"),
            F.coalesce(_side(True, "share"), F.lit(0.0)).alias("recent_share"),
            F.coalesce(_side(True, "review_count"), F.lit(0)).alias("supporting_count"),
        )
        .withColumn("share_change", F.col("recent_share") - F.col("previous_share"))
    )
    return (
        per_topic.where((F.col("supporting_count") >= least) & (F.col("share_change") > 0))
        .orderBy(F.desc("share_change"), F.desc("supporting_count"), "topic_label")
        .limit(1)
    )


def worsening_aspect(trend: DataFrame, support: Column | int) -> DataFrame:
    """Aspect of both periods with the largest rise in negative share, at most one row."""
    least = support if isinstance(support, Column) else F.lit(support)
    per_aspect = (
        latest_two(trend)
        .groupBy("aspect", "previous_period", "recent_period")
        .agg(
            _side(False, "negative_share").alias("previous_negative_share"),
            _side(True, "negative_share").alias("recent_negative_share"),
            _side(True, "mention_count").alias("supporting_count"),
        )
        .withColumn("negative_share_change", F.col("recent_negative_share") - F.col("previous_negative_share"))
    )
    return (
        per_aspect.where((F.col("supporting_count") >= least) & (F.col("negative_share_change") > 0))
        .orderBy(F.desc("negative_share_change"), F.desc("supporting_count"), "aspect")
        .limit(1)
    )


def sentiment_change(trend: DataFrame) -> DataFrame:
    """Negative share in the two latest periods, at most one row."""
    negative = F.when(F.col("sentiment_label") == "Negative", F.col("share")).otherwise(F.lit(0.0))
    return (
        latest_two(trend)
        .withColumn("share", negative)
        .groupBy("previous_period", "recent_period")
        .agg(
            _side(False, "share").alias("previous_negative_share"),
            _side(True, "share").alias("recent_negative_share"),
        )
        .withColumn("negative_share_change", F.col("recent_negative_share") - F.col("previous_negative_share"))
    )


def analyze_trends(
    df: DataFrame, mentions: DataFrame | None = None, *, frequency: str | None = None
) -> tuple[TrendStatus, dict[str, DataFrame]]:
    """Status and, where dates allow, all trend tables and signals."""
    require_columns(df, ["sentiment_label"], InsightError, "Trend analysis")
    status = trend_status(df, frequency)
    if status.frequency is None:
        return status, {}
    facts = store_facts(review_facts(df, status.frequency))
    tables = {
        "review_volume": review_volume(facts),
        "sentiment": sentiment_trend(facts),
        "topics": topic_trend(facts),
    }
    if mentions is not None:
        tables["aspects"] = aspect_trend(store_facts(mention_facts(mentions, status.frequency)))
    if status.available:
        support = evidence_floor(total_of(facts))
        tables["fastest_growing_topic"] = fastest_growing_topic(tables["topics"], support)
        tables["sentiment_change"] = sentiment_change(tables["sentiment"])
        if mentions is not None:
            tables["worsening_aspect"] = worsening_aspect(tables["aspects"], support)
    return status, tables
