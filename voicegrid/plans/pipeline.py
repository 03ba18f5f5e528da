"""The full analysis: sentiment, topics, aspects, insights."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from voicegrid.operators.aspects import Vocabulary, analyze_aspects
from voicegrid.operators.insights import REQUIRED, Insights, generate_insights
from voicegrid.operators.sentiment import SentimentModel, SuppliedModel, predict_sentiment
from voicegrid.operators.topic_quality import evaluate_topics
from voicegrid.operators.topics import TopicFit, model_topics, topic_summary
from voicegrid.schema import FeedbackError, TopicConfig, require_columns
from voicegrid.session import compact_table, release
from voicegrid.sources.sinks import write_topic_run

AFTER_SENTIMENT = ("review_id", "review_text", "clean_text", "sentiment_label", "sentiment_score")
AFTER_TOPICS = (*AFTER_SENTIMENT, "topic_id", "topic_label")
TEXTS = ("review_text", "clean_text")


@dataclass(frozen=True)
class TopicStage:
    """Topic-enriched reviews with the fit and its evaluation."""

    dataframe: DataFrame
    fit: TopicFit
    summary: DataFrame
    evaluation: dict[str, object]


def sentiment_stage(df: DataFrame, model: SentimentModel | SuppliedModel, *, kind: str | None = None) -> DataFrame:
    """Score a canonical table; ``kind`` guards against a model of another kind."""
    if kind is not None and model.kind != kind:
        raise FeedbackError(f"The provided model is of kind '{model.kind}', not '{kind}'.")
    return predict_sentiment(df, model)


def topic_stage(
    df: DataFrame,
    config: TopicConfig = TopicConfig(),
    *,
    order_by: str = "review_id",
    strict: bool = True,
    stability_runs: int = 3,
) -> TopicStage:
    """Fit topics, assign every review, evaluate."""
    require_columns(df, AFTER_SENTIMENT, FeedbackError, "Topic modelling")
    fit, rows = model_topics(df, config, order_by=order_by, strict=strict)
    keywords = fit.model.keyword_table(df.sparkSession)
    return TopicStage(rows, fit, topic_summary(rows, keywords), evaluate_topics(fit, stability_runs=stability_runs))


def aspect_stage(df: DataFrame, vocabulary: Vocabulary | None = None) -> dict[str, DataFrame]:
    """Aspects of topic-enriched reviews; canonical ids are unique."""
    require_columns(df, AFTER_TOPICS, FeedbackError, "Aspect analysis")
    return analyze_aspects(df, vocabulary, unique_ids=True)


def insight_stage(df: DataFrame, *, order_by: str = "review_id", frequency: str | None = None) -> Insights:
    """Insights of a stored table of aspect-enriched reviews."""
    require_columns(df, REQUIRED, FeedbackError, "Business insights")
    return generate_insights(df, order_by=order_by, frequency=frequency, unique_ids=True, stored=True)


@dataclass(frozen=True)
class Stages:
    """Stage functions of a run; callers may replace any of them."""

    sentiment: Callable[..., DataFrame] = sentiment_stage
    topics: Callable[..., TopicStage] = topic_stage
    aspects: Callable[..., dict[str, DataFrame]] = aspect_stage
    insights: Callable[..., Insights] = insight_stage


@dataclass(frozen=True)
class Analysis:
    """All outputs of one run with its stage timings."""

    dataframe: DataFrame
    topics: TopicStage
    aspects: dict[str, DataFrame]
    insights: Insights
    seconds: dict[str, float] = field(default_factory=dict)


def run_pipeline(
    df: DataFrame,
    model: SentimentModel | SuppliedModel,
    *,
    topic_config: TopicConfig = TopicConfig(),
    vocabulary: Vocabulary | None = None,
    order_by: str = "review_id",
    strict: bool = True,
    stability_runs: int = 3,
    stages: Stages = Stages(),
) -> Analysis:
    """Run all stages on a canonical table.

    Scored reviews and aspect-enriched reviews are stored in shared space:
    each is read several times by what follows, and neither should be scored
    again when an executor is lost.  The canonical table is given up once it
    is scored.
    """
    if df.isEmpty():
        raise FeedbackError("Full analysis requires a non-empty canonical table.")
    seconds: dict[str, float] = {}

    def timed(name: str, work: Callable[[], object]) -> object:
        started = time.perf_counter()
        result = work()
        seconds[f"{name}_seconds"] = time.perf_counter() - started
        return result

    scored = timed("sentiment", lambda: compact_table(stages.sentiment(df, model), "scored", beside=TEXTS))
    del df
    release(scored.sparkSession)
    topics = timed(
        "topic",
        lambda: stages.topics(scored, topic_config, order_by=order_by, strict=strict, stability_runs=stability_runs),
    )

    def find_aspects() -> dict[str, DataFrame]:
        found = stages.aspects(topics.dataframe, vocabulary)
        return {**found, "reviews": compact_table(found["reviews"], "enriched", beside=TEXTS)}

    aspects = timed("aspect", find_aspects)
    insights = timed("insight", lambda: stages.insights(aspects["reviews"], order_by=order_by))
    seconds["total_seconds"] = sum(seconds.values())
    return Analysis(aspects["reviews"], topics, aspects, insights, seconds)


def run_topic_job(df: DataFrame, path: str, config: TopicConfig = TopicConfig(), *, order_by: str = "review_id", stability_runs: int = 3) -> TopicStage:
    """Stand-alone topic run: fit, evaluate, save model and outputs below ``path``."""
    fit, rows = model_topics(df, config, order_by=order_by)
    summary = topic_summary(rows, fit.model.keyword_table(df.sparkSession))
    evaluation = evaluate_topics(fit, stability_runs=stability_runs)
    fit.model.save(df.sparkSession, f"{path}/model")
    write_topic_run(rows, summary, evaluation, path)
    return TopicStage(rows, fit, summary, evaluation)
