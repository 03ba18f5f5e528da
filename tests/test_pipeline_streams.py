"""Sinks, fingerprints, the pipeline and streams."""

import pytest
from pyspark.sql import functions as F

from voicegrid.functions.text import fold_key, normalize_whitespace
from voicegrid.operators import aspects, canonical, insights, sentiment, trends
from voicegrid.operators.fact_store import FactStore
from voicegrid.plans import pipeline
from voicegrid.schema import FeedbackError, TopicConfig
from voicegrid.session import cut_lineage, join_small
from voicegrid.sources import sinks
from voicegrid.sources.fingerprint import add_parts, fingerprint, fingerprint_of, fingerprint_parts, source_signature
from voicegrid.streaming import reviews as streams
from tests.test_sentiment import Scorer


def test_table_sinks(spark, aspect_reviews, tmp_path):
    enriched = aspects.associate_aspect_sentiment(aspect_reviews)
    sinks.write_reviews(enriched, str(tmp_path / "p"), partition_by="topic_id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5
    sinks.write_reviews_csv(enriched, str(tmp_path / "c"))
    back = {r.review_id: r for r in spark.read.csv(str(tmp_path / "c"), header=True, escape='"').collect()}
    assert back["r2"].detected_aspects == '["Shipping","Packaging"]'
    assert back["r4"].aspect_sentiment == '{"Price":"Negative","Quality":"Negative"}'
    sinks.write_predictions(aspect_reviews.select("review_text"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 5


def test_report_sinks(spark, insight_reviews, tmp_path):
    found = insights.generate_insights(aspects.associate_aspect_sentiment(insight_reviews))
    sinks.write_recommendations_csv(found.recommendations, str(tmp_path / "r"))
    rows = spark.read.csv(str(tmp_path / "r"), header=True, escape='"').collect()
    assert rows[0].representative_review_ids == "i06, i07, i08"
    sinks.write_markdown(found, str(tmp_path / "m"))
    text = next((tmp_path / "m").glob("part-*")).read_text()
    assert text.splitlines() == sinks.report_lines(found)


def test_metrics_json(spark, tmp_path):
    sinks.write_metrics(spark, {"b": 1, "a": [1, 2]}, str(tmp_path / "j"))
    assert next((tmp_path / "j").glob("part-*")).read_text() == '{"a": [1, 2], "b": 1}\n'
    assert sinks.read_metrics(spark, str(tmp_path / "j")) == {"a": [1, 2], "b": 1}
    spark.createDataFrame([("[1]",)], "value string").coalesce(1).write.text(str(tmp_path / "k"))
    with pytest.raises(FeedbackError, match="JSON object"):
        sinks.read_metrics(spark, str(tmp_path / "k"))


def test_fingerprint(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", None), ("b", None)], "t string, l string")
    mark = fingerprint(rows).first().fingerprint
    assert fingerprint(rows.repartition(3).orderBy(F.desc("t"))).first().fingerprint == mark
    assert fingerprint(rows.distinct()).first().fingerprint != mark
    assert fingerprint(rows.withColumnRenamed("l", "m")).first().fingerprint != mark
    assert fingerprint(rows.withColumn("l", F.coalesce("l", F.lit("")))).first().fingerprint != mark
    assert source_signature(rows, "one.csv") != source_signature(rows, "two.csv")


def test_joins_broadcast_only_known_sizes(spark):
    left, small = spark.range(10), spark.range(3)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(join_small(left, small, "id", "inner", rows=3))
    assert "strategy=broadcast" not in plan(join_small(left, small, "id", "inner", rows=3, limit=2))


def test_pipeline(themed_reviews):
    canonical = themed_reviews.drop("sentiment_label", "sentiment_score")
    done = pipeline.run_pipeline(
        canonical, sentiment.SuppliedModel(Scorer, batch_size=4), topic_config=TopicConfig(n_topics=3), stability_runs=2
    )
    assert done.dataframe.count() == 30
    assert {"sentiment_label", "topic_label", "topic_confidence", "detected_aspects", "aspect_confidence"} <= set(done.dataframe.columns)
    assert done.topics.evaluation["topic_stability"] is not None and done.insights.metrics.total_reviews == 30
    assert set(done.seconds) == {"sentiment_seconds", "topic_seconds", "aspect_seconds", "insight_seconds", "total_seconds"}
    with pytest.raises(FeedbackError, match="non-empty"):
        pipeline.run_pipeline(canonical.limit(0), sentiment.SuppliedModel(Scorer))
    with pytest.raises(FeedbackError, match="sentiment_label"):
        pipeline.topic_stage(canonical)
    with pytest.raises(FeedbackError, match="topic_id"):
        pipeline.aspect_stage(canonical)


def test_replaced_stages(themed_reviews):
    seen = []

    def stage(name, value):
        def run(*_, **__):
            seen.append(name)
            return value
        return run

    class Stub:
        dataframe = themed_reviews

    stages = pipeline.Stages(
        stage("sentiment", themed_reviews), stage("topics", Stub), stage("aspects", {"reviews": themed_reviews}), stage("insights", None)
    )
    pipeline.run_pipeline(themed_reviews, None, stages=stages)
    assert seen == ["sentiment", "topics", "aspects", "insights"]


def test_topic_job(spark, themed_reviews, tmp_path):
    pipeline.run_topic_job(themed_reviews, str(tmp_path / "run"), TopicConfig(n_topics=3), stability_runs=1)
    assert spark.read.parquet(str(tmp_path / "run/assignments")).count() == 30
    assert sinks.read_metrics(spark, str(tmp_path / "run/evaluation"))["number_of_topics"] == 3


@pytest.fixture
def arrivals(spark, insight_reviews, tmp_path):
    folder = str(tmp_path / "in")
    insight_reviews.coalesce(1).write.parquet(folder)
    insight_reviews.where("review_id in ('i01', 'i07')").coalesce(1).write.mode("append").parquet(folder)
    return streams.read_reviews(spark, folder, insight_reviews.schema, files_per_trigger=1)


def test_stream_enrichment_equals_batch(spark, arrivals, insight_reviews, tmp_path):
    out = str(tmp_path / "out")
    stream = streams.enrich_stream(arrivals.drop("sentiment_label", "sentiment_score", "clean_text"), model=sentiment.SuppliedModel(Scorer, batch_size=4))
    streams.write_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(out)
    batch = aspects.detect_aspects(insight_reviews)
    pairs = lambda df: {(r.review_id, tuple(r.detected_aspects)) for r in df.select("review_id", "detected_aspects").collect()}
    assert found.count() == 14 and pairs(found) == pairs(batch)
    assert [r.review_id for r in found.where("sentiment_label = 'Positive'").collect()] == ["i01", "i01"]


def test_stream_dedup(spark, arrivals, tmp_path):
    out = str(tmp_path / "out")
    streams.write_stream(streams.drop_repeats(arrivals, late_by="60 days"), out, str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == 12 and found.select("review_id").distinct().count() == 12


def test_windows_close_behind_the_watermark(spark, arrivals, tmp_path):
    out = str(tmp_path / "out")
    streams.write_stream(streams.sentiment_windows(arrivals, frequency="W"), out, str(tmp_path / "cp")).awaitTermination()
    closed = {(str(r.period)[:10], r.sentiment_label): r.review_count for r in spark.read.parquet(out).collect()}
    # Monday week of 5 January is complete; the latest week stays open.
    assert closed[("2026-01-05", "Neutral")] == 2 and {day for day, _ in closed} == {"2026-01-05"}


REPEATS = [
    ("a", "Good  phone", "2026-01-05 10:00:00"), ("b", "good phone", "2026-01-05 09:00:00"), ("c", "Bad", "2026-01-06 08:00:00"),
    ("d", "GOOD PHONE", "2026-01-05 09:00:00"), ("e", "bad", "2026-01-06 07:00:00.250"), ("f", "late", "2026-01-07 00:00:00"),
]


@pytest.mark.parametrize("order", ["abcdef", "fedcba", "cafdbe"])
def test_earliest_repeat_wins_in_any_order(spark, tmp_path, order):
    streams.needs_column_families(spark)
    schema = "review_id string, review_text string, date timestamp"
    folder = str(tmp_path / "in")
    end = [("z", "end", "2026-03-01 00:00:00")]
    for row in [*sorted(REPEATS, key=lambda row: order.index(row[0])), *end]:
        one = spark.createDataFrame([row], "review_id string, review_text string, date string").withColumn("date", F.col("date").cast("timestamp"))
        one.coalesce(1).write.mode("append").parquet(folder)
    stream = streams.read_reviews(spark, folder, spark.createDataFrame([], schema).schema, files_per_trigger=1)
    kept = streams.earliest_of_repeats(stream, ["review_id"], text_column="review_text", late_by="10 days")
    out = str(tmp_path / "out")
    streams.write_batches(kept, out, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(folder).where("review_id <> 'z'")
    first = canonical.keep_first(rows.withColumn("_pos", F.struct("date", "review_id")), fold_key(normalize_whitespace("review_text")), ["review_id"])
    found = [row["review_id"] for row in streams.read_batches(spark, out, kept.schema).collect()]
    assert sorted(found) == sorted(row["review_id"] for row in first.collect()) == ["b", "e", "f"]


def test_late_rows_and_repeated_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "date timestamp, sentiment_label string"
    for day in ("2026-01-05", "2026-01-20", "2026-01-25", "2026-01-06", "2026-02-20"):
        spark.sql(f"select timestamp'{day} 12:00' as date, 'Positive' as sentiment_label").write.mode("append").parquet(folder)
    stream = streams.read_reviews(spark, folder, spark.createDataFrame([], schema).schema, files_per_trigger=1)
    windows = streams.sentiment_windows(stream, frequency="W")
    streams.write_batches(windows, out, str(tmp_path / "cp")).awaitTermination()
    found = lambda: sorted((str(r.period)[:10], r.review_count) for r in streams.read_batches(spark, out, windows.schema).collect())
    # The row of 6 January came when its week had been closed, so it is late.
    assert found() == [("2026-01-05", 1), ("2026-01-19", 2)]
    again = spark.read.parquet(out).groupBy("batch").count().collect()
    for row in again:
        streams.put_batch(cut_lineage(spark.read.parquet(f"{out}/batch={row['batch']}")), out, row["batch"])
    assert found() == [("2026-01-05", 1), ("2026-01-19", 2)]


def test_facts_by_source(spark, insight_reviews, tmp_path):
    enriched = aspects.associate_aspect_sentiment(insight_reviews, {"Power": ["battery"], "Money": ["invoice", "payment"]})
    store = FactStore(spark, str(tmp_path / "facts"))
    assert store.review_facts("W").count() == 0
    early = F.col("date") < "2026-01-20"
    for source, part in (("x", early), ("y", ~early), ("x", early)):
        store.put(source, enriched.where(part))
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for frequency in ("D", "W", "M", None):
        assert rows(store.review_facts(frequency)) == rows(trends.review_facts(enriched, frequency))
        assert rows(store.mention_facts(frequency)) == rows(trends.mention_facts(aspects.explode_mentions(enriched), frequency))
    assert {row["source"]: row["review_count"] for row in store.sources().collect()} == {"x": 6, "y": 6}


def test_fingerprints_add_up(spark):
    frame = spark.createDataFrame([(k % 7, "x" * (k % 5) if k % 3 else None) for k in range(200)], "a int, b string")
    parts = [fingerprint_parts(frame.where(f"a % 3 = {k}")) for k in range(3)]
    assert fingerprint_of(add_parts(*parts), ["a", "b"]).first() == fingerprint(frame.repartition(5)).first()
    swapped = spark.createDataFrame([("1", "23"), ("12", "3")], "a string, b string")
    first, second = (fingerprint(swapped.where(f"a = '{a}'")).first().fingerprint for a in ("1", "12"))
    assert first != second
    empty = fingerprint(frame.limit(0)).first()
    assert empty.row_count == 0 and empty != fingerprint(frame.limit(1)).first()
