"""Aspects, trends, insights and the report."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voicegrid import fixed_values as fixed
from voicegrid.operators import aspects, insights, trends
from voicegrid.schema import AspectError, InsightError
from voicegrid.sources.sinks import report_lines
from tests.conftest import EARLY, LATE

SAMPLE = {
    "R001": "The setup was quick and the interface is easy to understand.",
    "R002": "The latest update made the app slower on my phone.",
    "R003": "Customer support answered my question within an hour.",
    "R004": "The subscription price feels too high for the available features.",
    "R005": "It works as expected, but I would like better filtering options.",
    "R006": "My order arrived earlier than expected and was packaged well.",
    "R007": "I was charged twice and the refund process was confusing.",
    "R008": "Performance improved after the recent patch.",
    "R009": "The instructions were clear, although installation took a while.",
    "R010": "The product quality is excellent and I would recommend it.",
}
SAMPLE_ASPECTS = {
    "R001": ["User Interface", "Ease of Use"], "R002": ["Performance"], "R003": ["Customer Support"],
    "R004": ["Billing", "Price", "Features"], "R005": [], "R006": ["Packaging"], "R007": ["Billing", "Ease of Use"],
    "R008": ["Performance"], "R009": ["Ease of Use"], "R010": ["Quality"],
}


def test_default_vocabulary(spark):
    rows = spark.createDataFrame(list(SAMPLE.items()), "review_id string, clean_text string")
    assert {r.review_id: r.detected_aspects for r in aspects.detect_aspects(rows).collect()} == SAMPLE_ASPECTS
    assert len(fixed.DEFAULT_ASPECTS) == 12 and sum(map(len, fixed.DEFAULT_ASPECTS.values())) == 84


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("battery life", True), ("Battery,  LIFE!", True), ("the battery's fine", True), ("battery' life", False),
        ("batterylife", False), ("my battery-life", True), ("battery l", False), ("", False), (None, False),
    ],
)
def test_phrase_boundaries(spark, text, hit):
    frame = spark.createDataFrame([(text,)], "clean_text string")
    words = {"A": ["battery life" if text and "l" in text.lower().replace("battery", "") else "battery"]}
    assert (aspects.detect_aspects(frame, words).first().detected_aspects == ["A"]) == hit


def test_only_runs_that_begin_like_a_phrase_are_looked_up(spark):
    texts = ["my battery life is good, not life of a battery", "BATTERY", "", None, "' value' for  money for"]
    rows = spark.createDataFrame([(t,) for t in texts], "clean_text string")
    tokens = F.split(F.trim(aspects.aspect_match_text("clean_text")), " ")
    found = [r[0] for r in rows.select(aspects._phrase_runs(tokens, ["battery life", "life", "value ' for"])).collect()]
    assert [sorted(set(runs)) for runs in found] == [
        ["battery", "battery life", "battery life is", "life", "life is", "life is good", "life of", "life of a"],
        ["battery"], [], [], ["value", "value '", "value ' for"],
    ]
    words = {"A": ["battery life", "life"], "B": ["value' for", "for"], "C": ["battery"], "D": [f"word{k}" for k in range(20)]}
    assert [r.detected_aspects for r in aspects.detect_aspects(rows, words).collect()] == [["A", "C"], ["C"], [], [], ["B"]]


def test_examples_are_matched_once(spark):
    rows = [("b", "a fine price"), ("a", "price, price"), ("a", "the price"), (None, "price"), ("c", None), ("d", "fine")]
    reviews = spark.createDataFrame(rows, "review_id string, clean_text string").withColumn("sentiment_label", F.lit("Positive"))
    mentions = aspects.explode_mentions(aspects.associate_aspect_sentiment(reviews, {"Price": ["price"], "Tone": ["fine"]}))
    found = aspects.aspect_examples(mentions, "Price")
    # What the sort reads, twice, is stored: no text is matched below it.
    assert "Generate" in mentions._jdf.queryExecution().toString() and "Generate" not in found._jdf.queryExecution().toString()
    assert [(r.review_id, r.aspect_sentiment_label) for r in found.collect()] == [(k, "Positive") for k in (None, "a", "a", "b")]
    assert [r.review_id for r in aspects.aspect_examples(mentions, "Price", 2).collect()] == [None, "a"]
    assert aspects.aspect_examples(mentions, "None").isEmpty()


def test_vocabulary_checks(spark):
    assert aspects.validate_vocabulary({" A ": ["Life!", "life", "  "]}) == {"A": ("life",)}
    for bad in ({}, {" ": ["x"]}, {"A": ["!"]}):
        with pytest.raises(AspectError):
            aspects.validate_vocabulary(bad)
    with pytest.raises(AspectError, match="clean_text"):
        aspects.detect_aspects(spark.range(1))
    with pytest.raises(AspectError, match="sentiment_label"):
        aspects.associate_aspect_sentiment(spark.createDataFrame([("x",)], "clean_text string"))


def test_association(aspect_reviews):
    rows = {r.review_id: r for r in aspects.associate_aspect_sentiment(aspect_reviews, with_terms=True).collect()}
    assert rows["r1"].matched_terms["Battery"] == ["battery life", "charging", "battery"]
    assert rows["r1"].aspect_sentiment["Battery"] == "Positive" and rows["r1"].aspect_confidence["Battery"] == 0.9
    assert rows["r2"].detected_aspects == ["Shipping", "Packaging"]
    assert rows["r3"].detected_aspects == ["Customer Support", "User Interface", "Ease of Use"]
    assert rows["r4"].matched_terms == {"Price": ["expensive", "price"], "Quality": ["build quality", "quality"]}
    assert rows["r5"].detected_aspects == [] and rows["r5"].aspect_sentiment == {}
    unscored = aspects.associate_aspect_sentiment(aspect_reviews.withColumn("sentiment_score", F.lit(float("nan"))))
    assert unscored.where(F.size("aspect_confidence") > 0).isEmpty()
    with pytest.raises(PySparkException, match="Unsupported"):
        aspects.associate_aspect_sentiment(aspect_reviews.withColumn("sentiment_label", F.lit("bad"))).collect()


def test_evaluation(aspect_reviews):
    row = aspects.analyze_aspects(aspect_reviews)["evaluation"].first()
    # r1 also mentions Performance ("slow").
    assert (row.total_reviews, row.reviews_with_aspects, row.aspect_coverage) == (5, 4, 0.8)
    assert (row.total_aspect_mentions, row.multi_aspect_reviews, row.unique_aspects) == (9, 4, 9)
    empty = aspects.evaluate_aspects(aspects.associate_aspect_sentiment(aspect_reviews.limit(0))).first()
    assert (empty.total_reviews, empty.aspect_coverage, empty.sentiment_association_complete) == (0, 0.0, True)


def test_filter_on_aspects_matches_text_once(aspect_reviews):
    enriched = aspects.associate_aspect_sentiment(aspect_reviews)
    plan = enriched.where(F.array_contains("detected_aspects", "Battery"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("{10FFFF}") == 1
    spoken = aspects.explode_mentions(enriched).groupBy("aspect").count()._jdf.queryExecution().executedPlan().toString()
    assert spoken.count("{10FFFF}") == 1


EXPECTED = {
    "Billing": (5, 0, 1, 4, "Negative", 1.6), "Battery": (4, 3, 1, 0, "Positive", 4.25),
    "Customer Support": (3, 3, 0, 0, "Positive", 13 / 3),
}


@pytest.fixture(scope="module")
def enriched(insight_reviews):
    return aspects.associate_aspect_sentiment(insight_reviews)


@pytest.fixture(scope="module")
def result(enriched):
    return insights.generate_insights(enriched)


def test_aspect_summary(enriched):
    summary = aspects.summarize_mentions(aspects.explode_mentions(enriched), aspects.total_reviews(enriched))
    rows = summary.collect()
    assert [r.aspect for r in rows] == ["Billing", "Battery", "Customer Support"]
    for r in rows:
        counts = (r.mention_count, r.positive_count, r.neutral_count, r.negative_count, r.dominant_sentiment)
        assert counts == EXPECTED[r.aspect][:5] and r.average_rating == pytest.approx(EXPECTED[r.aspect][5])
        assert r.review_coverage == pytest.approx(r.unique_review_count / 12)
    facts = insights.summary_of_facts(trends.mention_facts(aspects.explode_mentions(enriched), "D"), 12)
    for fast, slow in zip(facts.collect(), rows):
        assert fast.asDict() == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in slow.asDict().items()}
    leaders = aspects.aspect_leaders(summary).first()
    assert tuple(leaders) == ("Billing", "Customer Support", "Billing")
    assert tuple(aspects.rating_extremes(summary).first())[0::2] == ("Customer Support", "Billing")
    assert aspects.positive_negative(summary).count() == 6


def test_repeated_review_ids_count_once(enriched):
    twice = aspects.explode_mentions(enriched.unionAll(enriched))
    row = aspects.summarize_mentions(twice, 24).where("aspect = 'Billing'").first()
    assert (row.mention_count, row.unique_review_count) == (10, 5)


def test_trend_gates(spark, insight_reviews):
    status = trends.trend_status(insight_reviews)
    assert (status.available, status.frequency) == (True, "D")
    assert trends.trend_status(insight_reviews.drop("date")).reason == fixed.TREND_REASONS["no_column"]
    nothing = insight_reviews.withColumn("date", F.lit(None).cast("timestamp"))
    assert trends.trend_status(nothing).reason == fixed.TREND_REASONS["no_dates"]
    same = insight_reviews.withColumn("date", F.lit(EARLY))
    assert trends.trend_status(same).reason == fixed.TREND_REASONS["one_date"]
    close = insight_reviews.withColumn("date", F.col("date") - F.expr("interval 31 days") * (F.col("date") > "2026-01-10").cast("int") + F.expr("interval 1 hour") * (F.col("topic_id")))
    status, tables = trends.analyze_trends(close)
    assert status.reason == fixed.TREND_REASONS["one_period"] and tables["review_volume"].count() == 1
    with pytest.raises(InsightError):
        trends.analyze_trends(spark.range(1))


def test_signals(enriched):
    status, tables = trends.analyze_trends(enriched, aspects.explode_mentions(enriched))
    growing = tables["fastest_growing_topic"].first()
    assert (growing.topic_label, growing.supporting_count) == ("Billing / Payment", 4)
    assert (growing.previous_share, growing.recent_share) == (pytest.approx(1 / 6), pytest.approx(4 / 6))
    assert (growing.previous_period, growing.recent_period) == (EARLY, LATE)
    worse = tables["worsening_aspect"].first()
    assert (worse.aspect, worse.previous_negative_share, worse.recent_negative_share, worse.supporting_count) == ("Billing", 0.0, 1.0, 4)
    change = tables["sentiment_change"].first()
    assert (change.previous_negative_share, change.recent_negative_share) == (0.0, pytest.approx(4 / 6))
    assert {(r.period, r.review_count) for r in tables["review_volume"].collect()} == {(EARLY, 6), (LATE, 6)}


@pytest.mark.parametrize(("total", "least"), [(0, 1), (1, 2), (100, 2), (101, 3), (1000, 20)])
def test_evidence_floor(spark, total, least):
    assert spark.range(1).select(trends.evidence_floor(total)).first()[0] == least


def test_metrics(result):
    m = result.metrics
    assert (m.total_reviews, m.positive_count, m.neutral_count, m.negative_count) == (12, 6, 2, 4)
    assert m.dominant_sentiment == "Positive" and m.aspect_coverage == 1.0
    assert (m.most_discussed_topic.topic_label, m.most_discussed_topic.review_count) == ("Billing / Payment", 5)
    assert (m.key_strength.aspect, m.priority_improvement.aspect) == ("Customer Support", "Billing")
    assert (m.topic_count, m.aspect_count, m.aspect_summary_rows) == (3, 3, 3)


def test_findings(result):
    rows = result.findings.collect()
    assert [r.category for r in rows] == ["Overall sentiment", "Topic", "Pain point", "Strength", "Trend"]
    assert rows[0].evidence == "6 of 12 reviews (50.0%) are positive."
    assert rows[1].representative_review_ids == ["i06", "i07", "i08"]
    assert rows[2].evidence == "80.0% of 5 observed aspect mentions are negative."
    assert rows[2].representative_review_ids == ["i06", "i07", "i08"]
    assert rows[3].representative_review_ids == ["i04", "i05", "i12"]
    assert rows[4].evidence.startswith("Topic share changed by 50.0 percentage points, with 4 reviews")


def test_recommendations(result):
    rows = [(r.priority, r.affected_item, r.supporting_count) for r in result.recommendations.collect()]
    assert rows == [("High", "Billing", 5), ("Low", "Customer Support", 3)]
    assert [insights.priority_of(*case) for case in ((0.6, 3), (0.6, 2), (0.4, 9), (0.39, 9))] == ["High", "Medium", "Medium", "Low"]


def test_summary_and_report(result):
    assert result.executive_summary.startswith("Analyzed 12 reviews. Overall sentiment is Positive, with 50.0% positive")
    assert 'negative share for "Billing" increased by 100.0 percentage points' in result.executive_summary
    lines = report_lines(result)
    assert lines[0] == "# Customer Feedback Business Insights" and "### [High] Investigate Billing feedback" in lines
    assert "**Supporting metric:** Negative mention share = 80.0%" in lines
    assert "**Supporting review IDs:** i06, i07, i08" in lines


def test_report_without_dates(enriched):
    found = insights.generate_insights(enriched.drop("date"))
    assert not found.status.available and found.trends == {} and found.findings.count() == 4
    assert report_lines(found)[-1].endswith(fixed.TREND_REASONS["no_column"])


def test_worsening_recommendation(spark):
    base = {"priority_improvement": None, "key_strength": None, "worsening_aspect": {"aspect": "Price", "negative_share_change": 0.25, "supporting_count": 3}}
    assert [r[:2] for r in insights.write_recommendations(base, {})] == [("High", "Monitor worsening Price feedback")]
    base["worsening_aspect"]["supporting_count"] = 2
    assert insights.write_recommendations(base, {})[0][0] == "Medium"


def test_ties_and_thin_evidence(spark):
    rows = [("A", 4, 0.5, 2), ("B", 4, 0.5, 2), ("C", 1, 1.0, 1)]
    frame = spark.createDataFrame(rows, "aspect string, mention_count bigint, positive_share double, positive_count bigint").withColumns(
        {"negative_share": F.lit(0.0), "negative_count": F.lit(0), "average_sentiment": F.lit(0.0)}
    )
    assert insights.aspect_extreme(frame, "positive", F.lit(2)).first().aspect == "A"
    assert insights.aspect_extreme(frame, "positive", F.lit(9)).first().aspect == "C"


def test_insight_guards(enriched):
    with pytest.raises(InsightError, match="lacks"):
        insights.generate_insights(enriched.drop("topic_id"))
    with pytest.raises(InsightError, match="at least one"):
        insights.generate_insights(enriched.limit(0))


def test_comparison(insight_reviews):
    row = insights.product_comparison(insight_reviews).first()
    assert (row["product"], row.review_count, row.positive_share, row.average_rating) == ("App", 12, 0.5, pytest.approx(38 / 12))


def test_ten_thousand_phrases(spark):
    words = {f"A{k}": [f"word{k}", f"word{k} tail", f"don't {k}"] for k in range(10_000)}
    rows = spark.createDataFrame([("x word77 tail, DON'T 9999 word5x",), ("",), (None,), (" ".join(f"word{k}" for k in range(400)),)], "clean_text string")
    found = aspects.detect_aspects(rows, words, with_terms=True).collect()
    assert found[0].detected_aspects == ["A77", "A9999"]
    assert found[0].matched_terms == {"A77": ["word77 tail", "word77"], "A9999": ["don't 9999"]}
    assert found[1].detected_aspects == found[2].detected_aspects == [] and found[1].matched_terms == {}
    assert found[3].detected_aspects == [f"A{k}" for k in range(400)]


def test_phrases_shared_by_aspects(spark):
    rows = spark.createDataFrame([("good value for money",)], "clean_text string")
    found = aspects.detect_aspects(rows, {"B": ["value", "good value"], "A": ["Value", "money"]}, with_terms=True).first()
    assert found.detected_aspects == ["B", "A"] and found.matched_terms == {"B": ["good value", "value"], "A": ["value", "money"]}
