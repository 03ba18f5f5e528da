"""Business insights: metrics, findings, recommendations, executive summary.

The review table is reduced to two stored fact tables; every ranked claim is
picked from them in one query.  Only the picks, a single row, and the few
evidence ids reach the driver, where the report wording is filled in.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from voicegrid import fixed_values as fixed
from voicegrid.functions.labels import dominant_label, label_score
from voicegrid.operators.aspects import explode_mentions, shape_summary
from voicegrid.operators.trends import (
    TrendStatus,
    aspect_trend,
    evidence_floor,
    fastest_growing_topic,
    mention_facts,
    review_facts,
    review_volume,
    sentiment_change,
    sentiment_trend,
    store_facts,
    topic_trend,
    total_of,
    trend_status,
    worsening_aspect,
)
from voicegrid.schema import InsightError, require_columns
from voicegrid.session import cut_lineage, rows_frame

REQUIRED = (
    "review_id", "review_text", "sentiment_label", "topic_id", "topic_label", "detected_aspects", "aspect_sentiment",
)
STAGE_COLUMNS = (
    "review_id", "date", "rating", "sentiment_label", "sentiment_score", "topic_label", "detected_aspects",
    "aspect_sentiment", "aspect_confidence",
)
FINDING_SCHEMA = (
    "category string, title string, evidence string, business_interpretation string, metric_name string, "
    "metric_value double, supporting_count bigint, affected_item string, representative_review_ids array<string>"
)
RECOMMENDATION_SCHEMA = (
    "priority string, title string, affected_type string, affected_item string, supporting_metric string, "
    "supporting_value double, supporting_count bigint, explanation string, representative_review_ids array<string>"
)


# ------------------------------------------------------------------- picks --
def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def overall_sentiment(facts: DataFrame) -> DataFrame:
    """Counts, shares and dominant label of all reviews, one row."""
    label, n = F.col("sentiment_label"), F.col("review_count")
    counts = facts.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_reviews"),
        *(
            F.coalesce(F.sum(F.when(label == name, n)), F.lit(0)).alias(f"{name.lower()}_count")
            for name in fixed.OVERALL_TIE_ORDER
        ),
    )
    named = [F.col(f"{name.lower()}_count") for name in fixed.OVERALL_TIE_ORDER]
    dominant = dominant_label(*named, order=fixed.OVERALL_TIE_ORDER)
    return counts.select(
        "*",
        *(
            _ratio(F.col(f"{name.lower()}_count"), F.col("total_reviews")).alias(f"{name.lower()}_share")
            for name in fixed.OVERALL_TIE_ORDER
        ),
        F.when(F.col("total_reviews") > 0, dominant).alias("dominant_sentiment"),
    )


def topic_ranking(facts: DataFrame) -> DataFrame:
    """Topics by size with their share of all reviews and their sentiment."""
    label, n = F.col("sentiment_label"), F.col("review_count")

    def of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(label == name, n)), F.lit(0))

    score = label_score(label)
    grouped = (
        facts.where(F.col("topic_label").isNotNull())
        .groupBy("topic_label")
        .agg(
            F.sum(n).alias("review_count"),
            *(of(name).alias(f"_{name}") for name in fixed.SENTIMENT_LABELS),
            (F.sum(score * n) / F.sum(F.when(score.isNotNull(), n))).alias("average_sentiment"),
        )
    )
    return grouped.select(
        "topic_label",
        "review_count",
        _ratio(F.col("review_count"), total_of(facts)).alias("share"),
        "average_sentiment",
        dominant_label(F.col("_Positive"), F.col("_Neutral"), F.col("_Negative")).alias("dominant_sentiment"),
        (F.col("_Negative") / F.col("review_count")).alias("negative_share"),
        (F.col("_Positive") / F.col("review_count")).alias("positive_share"),
    ).orderBy(F.desc("review_count"), "topic_label")


def summary_of_facts(facts: DataFrame, total: Column | int) -> DataFrame:
    """Aspect summary from mention facts; review ids count as unique."""
    label, n = F.col("sentiment_label"), F.col("mention_count")
    grouped = facts.groupBy("aspect").agg(
        F.sum(n).alias("mention_count"),
        F.sum(n).alias("unique_review_count"),
        (F.sum("sentiment_sum") / F.sum(F.when(F.col("sentiment_sum").isNotNull(), n))).alias("average_sentiment"),
        *(
            F.coalesce(F.sum(F.when(label == name, n)), F.lit(0)).alias(f"{name.lower()}_count")
            for name in fixed.SENTIMENT_LABELS
        ),
        (F.sum("confidence_sum") / F.nullif(F.sum("confidence_count"), F.lit(0))).alias("average_confidence"),
        (F.sum("rating_sum") / F.nullif(F.sum("rating_count"), F.lit(0))).alias("average_rating"),
    )
    return shape_summary(grouped, total)


def aspect_extreme(summary: DataFrame, side: str, support: Column) -> DataFrame:
    """Strongest positive or negative aspect, at most one row.

    Aspects with enough evidence come first; without any, all compete.
    """
    return (
        summary.withColumn("_enough", F.col("mention_count") >= support)
        .orderBy(
            F.desc("_enough"), F.desc(f"{side}_share"), F.desc(f"{side}_count"), F.desc("mention_count"), "aspect"
        )
        .limit(1)
        .select("aspect", "mention_count", "positive_share", "negative_share", "average_sentiment")
    )


def _one(row: DataFrame) -> Column:
    """A table of at most one row as a struct, null when empty."""
    return row.select(F.struct(*row.columns)).scalar()


def metrics_bundle(
    reviews: DataFrame, mentions: DataFrame, *, trends: bool, summary: DataFrame | None = None
) -> DataFrame:
    """All picks of the report in one row."""
    total = total_of(reviews)
    support = evidence_floor(total)
    aspects = summary_of_facts(mentions, total) if summary is None else summary
    picks = {
        "most_discussed_topic": _one(topic_ranking(reviews).limit(1)),
        "key_strength": _one(aspect_extreme(aspects, "positive", support)),
        "priority_improvement": _one(aspect_extreme(aspects, "negative", support)),
        "topic_count": reviews.agg(F.count_distinct("topic_label")).scalar(),
        "aspect_count": mentions.agg(F.count_distinct("aspect")).scalar(),
        "aspect_coverage": reviews.agg(_ratio(F.sum("with_aspects"), F.sum("review_count"))).scalar(),
        "topic_summary_rows": reviews.agg(F.count_distinct("topic_label")).scalar(),
        "aspect_summary_rows": aspects.agg(F.count(F.lit(1))).scalar(),
    }
    if trends:
        picks["fastest_growing_topic"] = _one(fastest_growing_topic(topic_trend(reviews), support))
        picks["worsening_aspect"] = _one(worsening_aspect(aspect_trend(mentions), support))
        picks["sentiment_change"] = _one(sentiment_change(sentiment_trend(reviews)))
    return overall_sentiment(reviews).select("*", *(column.alias(name) for name, column in picks.items()))


def evidence_ids(
    df: DataFrame, tests: Mapping[str, Column], *, order_by: str = "review_id", limit: int = 3, unique_ids: bool = False
) -> dict[str, list[str]]:
    """First distinct review ids that pass each test, in row order; one job for all tests."""
    if not tests:
        return {}
    tags = F.array_compact(F.array(*(F.when(test, F.lit(tag)) for tag, test in tests.items())))
    rows = df.select("review_id", F.col(order_by).alias("_order"), tags.alias("_tags"))
    rows = rows.select("review_id", "_order", F.explode_outer("_tags").alias("tag")).where(F.col("tag").isNotNull())
    if not unique_ids:
        rows = rows.groupBy("tag", "review_id").agg(F.min("_order").alias("_order"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy("_order", "review_id"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= limit).collect()
    return {tag: [row["review_id"] for row in sorted(first, key=lambda r: r["rank"]) if row["tag"] == tag] for tag in tests}


def product_comparison(df: DataFrame, by: str = "product") -> DataFrame:
    """Size, sentiment shares and mean rating per product or category."""
    label = F.col("sentiment_label")
    rating = F.avg(F.when(~F.isnan("rating"), F.col("rating"))) if "rating" in df.columns else F.lit(None).cast("double")
    return (
        df.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("review_count"),
            *(
                F.avg((label == name).cast("double")).alias(f"{name.lower()}_share")
                for name in fixed.OVERALL_TIE_ORDER
            ),
            rating.alias("average_rating"),
        )
        .orderBy(F.desc("review_count"), by)
    )


# ----------------------------------------------------------------- wording --
def _finding(kind: str, value: float, count: int, item: str | None, ids: list[str], **words: object) -> tuple:
    text = fixed.FINDING_TEXTS[kind]
    filled = {key: form.format(item=item, share=value, count=count, **words) for key, form in text.items()}
    return (*(filled[key] for key in text), float(value), int(count), item, ids)


def write_findings(metrics: Row, ids: Mapping[str, list[str]]) -> list[tuple]:
    """Up to five findings, most general first."""
    label = metrics["dominant_sentiment"]
    name = label.lower()
    rows = [
        _finding(
            "overall", metrics[f"{name}_share"], metrics[f"{name}_count"], None, [],
            total=metrics["total_reviews"], word=name, label=label,
        )
    ]
    topic = metrics["most_discussed_topic"]
    if topic:
        rows.append(
            _finding("topic", topic["share"], topic["review_count"], topic["topic_label"], ids.get("topic", []))
        )
    for kind, pick, side in (("pain", "priority_improvement", "negative"), ("strength", "key_strength", "positive")):
        aspect = metrics[pick]
        if aspect:
            rows.append(
                _finding(kind, aspect[f"{side}_share"], aspect["mention_count"], aspect["aspect"], ids.get(kind, []))
            )
    growing = metrics["fastest_growing_topic"] if "fastest_growing_topic" in metrics else None
    if growing:
        change = growing["share_change"]
        rows.append(
            _finding(
                "trend", change, growing["supporting_count"], growing["topic_label"], ids.get("trend", []),
                points=change * 100,
            )
        )
    return rows


def priority_of(negative_share: float, count: int) -> str:
    """High from 60% and three mentions, Medium from 40%, else Low."""
    if negative_share >= 0.60 and count >= 3:
        return "High"
    return "Medium" if negative_share >= 0.40 else "Low"


def write_recommendations(metrics: Row, ids: Mapping[str, list[str]]) -> list[tuple]:
    """Up to three recommendations by priority, support and title."""
    rows = []

    def add(kind: str, priority: str, aspect: str, value: float, count: int, evidence: list[str]) -> None:
        text = fixed.RECOMMENDATION_TEXTS[kind]
        words = {"item": aspect, "share": value, "count": count, "points": value * 100}
        rows.append(
            (
                priority, text["title"].format(**words), "Aspect", aspect, text["supporting_metric"], float(value),
                int(count), text["explanation"].format(**words), evidence,
            )
        )

    pain, strength = metrics["priority_improvement"], metrics["key_strength"]
    if pain:
        share, count = pain["negative_share"], pain["mention_count"]
        add("pain", priority_of(share, count), pain["aspect"], share, count, ids.get("pain", []))
    if strength:
        add("strength", "Low", strength["aspect"], strength["positive_share"], strength["mention_count"], ids.get("strength", []))
    worse = metrics["worsening_aspect"] if "worsening_aspect" in metrics else None
    urgent = {row[3] for row in rows if row[0] == "High"}
    if worse and worse["aspect"] not in urgent:
        change, count = worse["negative_share_change"], worse["supporting_count"]
        add("worsening", "High" if change >= 0.20 and count >= 3 else "Medium", worse["aspect"], change, count, [])
    return sorted(rows, key=lambda row: (fixed.PRIORITIES.index(row[0]), -row[6], row[1]))


def write_summary(metrics: Row) -> str:
    """Executive summary from the measured picks."""
    form = fixed.SUMMARY_SENTENCES
    sentences = [
        form["overall"].format(
            total=metrics["total_reviews"],
            label=metrics["dominant_sentiment"] or "Unavailable",
            positive=metrics["positive_share"],
            neutral=metrics["neutral_share"],
            negative=metrics["negative_share"],
        )
    ]
    topic, pain, strength = (metrics[k] for k in ("most_discussed_topic", "priority_improvement", "key_strength"))
    if topic:
        sentences.append(form["topic"].format(item=topic["topic_label"], count=topic["review_count"], share=topic["share"]))
    if pain:
        sentences.append(form["pain"].format(item=pain["aspect"], count=pain["mention_count"], share=pain["negative_share"]))
    if strength:
        sentences.append(
            form["strength"].format(item=strength["aspect"], count=strength["mention_count"], share=strength["positive_share"])
        )
    worse = metrics["worsening_aspect"] if "worsening_aspect" in metrics else None
    if worse:
        sentences.append(form["worsening"].format(item=worse["aspect"], points=worse["negative_share_change"] * 100))
    return " ".join(sentences)


# ------------------------------------------------------------------- stage --
@dataclass(frozen=True)
class Insights:
    """Everything the insight stage derives from an enriched review table."""

    dataframe: DataFrame
    metrics: Row
    findings: DataFrame
    recommendations: DataFrame
    status: TrendStatus
    trends: dict[str, DataFrame]
    executive_summary: str


def generate_insights(
    df: DataFrame,
    *,
    mentions: DataFrame | None = None,
    frequency: str | None = None,
    order_by: str = "review_id",
    unique_ids: bool = False,
    stored: bool = False,
) -> Insights:
    """Run the insight stage on an aspect-enriched table.

    The stage reads its input three times.  Unless ``stored`` states that
    reading is cheap, the columns it needs, which exclude the texts, are
    written out first.
    """
    require_columns(df, REQUIRED, InsightError, "Business insights")
    enriched = df
    if not stored:
        used = dict.fromkeys([*(c for c in STAGE_COLUMNS if c in df.columns), order_by])
        df = cut_lineage(df.select(*used))
    status = trend_status(df, frequency)
    reviews = store_facts(review_facts(df, status.frequency))
    spoken = store_facts(mention_facts(explode_mentions(df) if mentions is None else mentions, status.frequency))
    metrics = metrics_bundle(reviews, spoken, trends=status.available).first()
    if not metrics["total_reviews"]:
        raise InsightError("Business insights require at least one analyzed review.")
    tests: dict[str, Column] = {}
    for tag, pick in (("topic", "most_discussed_topic"), ("trend", "fastest_growing_topic")):
        if pick in metrics and metrics[pick]:
            tests[tag] = F.col("topic_label") == metrics[pick]["topic_label"]
    for tag, pick in (("pain", "priority_improvement"), ("strength", "key_strength")):
        if metrics[pick]:
            tests[tag] = F.array_contains("detected_aspects", metrics[pick]["aspect"])
    ids = evidence_ids(df, tests, order_by=order_by, unique_ids=unique_ids)
    spark = df.sparkSession
    trends = {}
    if status.frequency:
        trends = {
            "review_volume": review_volume(reviews),
            "sentiment": sentiment_trend(reviews),
            "topics": topic_trend(reviews),
            "aspects": aspect_trend(spoken),
        }
    return Insights(
        enriched,
        metrics,
        rows_frame(spark, write_findings(metrics, ids), FINDING_SCHEMA),
        rows_frame(spark, write_recommendations(metrics, ids), RECOMMENDATION_SCHEMA),
        status,
        trends,
        write_summary(metrics),
    )
