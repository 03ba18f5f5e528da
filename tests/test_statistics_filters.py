"""Filters and descriptive statistics."""

import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voicegrid.operators.order_statistics import percentiles
from voicegrid.operators import filters, statistics as stats


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [
        ("A", "It [WORKS] well", datetime(2026, 1, 1, 23, 59), 5.0, " Phone ", "Apps", "Positive", "T1", ["Battery", "Price"]),
        ("B", "it works", datetime(2026, 1, 2), 3.0, "phone", "apps", "Neutral", "T2", ["Price"]),
        ("C", None, None, float("nan"), None, "", "Negative", "T1", []),
        ("D", "Other", datetime(2026, 1, 9), 1.0, "Tablet", "Games", "Negative", "T2", None),
    ]
    return spark.createDataFrame(
        rows,
        "review_id string, review_text string, date timestamp, rating double, product string, category string, "
        "sentiment_label string, topic_label string, detected_aspects array<string>",
    )


def ids(df):
    return [r.review_id for r in df.orderBy("review_id").collect()]


def test_exploration_filters(reviews):
    f = filters.DatasetFilters
    assert ids(filters.apply_filters(reviews, f(start_date="2026-01-01", end_date="2026-01-01"))) == ["A"]
    assert ids(filters.apply_filters(reviews, f(end_date=datetime(2026, 1, 1, 12)))) == []
    assert ids(filters.apply_filters(reviews, f(products=("PHONE",)))) == ["B"]
    assert ids(filters.apply_filters(reviews, f(categories=("APPS",)))) == ["A", "B"]
    assert ids(filters.apply_filters(reviews, f(rating_min=3))) == ["A", "B"]
    assert ids(filters.apply_filters(reviews, f(keyword=" [works] "))) == ["A"]
    assert ids(filters.apply_filters(reviews.drop("product", "rating"), f(products=("x",), rating_min=9))) == list("ABCD")
    with pytest.raises(ValueError, match="Invalid date"):
        filters.apply_filters(reviews, f(start_date="soon"))


def test_dashboard_filters(reviews):
    f = filters.DashboardFilters
    apply = filters.apply_dashboard_filters
    assert ids(apply(reviews, f(end_date=datetime(2026, 1, 1, 12)))) == ["A", "B"]
    assert ids(apply(reviews, f(products=("phone",)))) == ["B"]
    assert ids(apply(reviews, f(sentiments=("Negative",), topics=("T1",)))) == ["C"]
    assert ids(apply(reviews, f(aspects=("Price", "Other")))) == ["A", "B"]
    assert ids(apply(reviews, f(search_text="WORKS"))) == ["A", "B"]
    mentions = reviews.select("review_id", F.explode("detected_aspects").alias("aspect"))
    assert ids(apply(mentions, f(aspects=("Battery",)))) == ["A"]
    assert not f().is_active() and not f(search_text="  ").is_active() and f(topics=("T1",)).is_active()


def test_long_selection_becomes_a_semi_join(reviews):
    many = tuple(f"p{i}" for i in range(filters.IN_LIST_LIMIT)) + ("Tablet",)
    assert ids(filters.apply_dashboard_filters(reviews, filters.DashboardFilters(products=many))) == ["D"]
    assert ids(filters.apply_filters(reviews, filters.DatasetFilters(products=tuple(map(str.upper, many))))) == ["D"]


def test_options_and_status(reviews):
    options = [tuple(r) for r in filters.filter_options(reviews).collect()]
    assert options == [("category", "Apps"), ("category", "apps"), ("category", "Games"), ("product", "Phone"), ("product", "phone"), ("product", "Tablet")]
    bounds = filters.option_ranges(reviews).first()
    assert (bounds.minimum_rating, bounds.maximum_rating) == (1.0, 5.0)
    board = [tuple(r)[:2] for r in filters.dashboard_filter_options(reviews).collect()]
    assert [v for k, v in board if k == "sentiment_label"] == ["Positive", "Neutral", "Negative"]
    assert [v for k, v in board if k == "aspect"] == ["Battery", "Price"]
    assert tuple(filters.filter_status(reviews, reviews.where("rating > 2 and rating < 9")).first()) == (2, 4, 0.5)


def test_filters_reach_the_scan(spark, reviews, tmp_path):
    reviews.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    kept = filters.apply_dashboard_filters(stored, filters.DashboardFilters(products=("phone",), rating_min=2)).select("review_id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(product,phone)" in plan and "GreaterThanOrEqual(rating,2.0)" in plan
    assert "review_text" not in plan.split("ReadSchema")[1]


def test_lengths(spark):
    frame = spark.createDataFrame([("one two",), ("one two three four",), ("single",)], "review_text string")
    row = stats.length_statistics(frame).first()
    assert (row.average_words, row.median_words, row.minimum_words, row.maximum_words) == (pytest.approx(7 / 3), 2.0, 1, 4)
    assert row.percentile_90_words == pytest.approx(3.6)
    assert tuple(stats.length_statistics(frame.limit(0)).first()) == (0.0, 0.0, 0, 0, 0.0, 0.0)
    assert stats.length_statistics(frame, "absent").first().maximum_words == 0


def test_ratings(spark):
    frame = spark.createDataFrame([("5",), (" 4 ",), ("invalid",), (None,), ("5d",)], "rating string")
    assert tuple(stats.rating_statistics(frame).first()) == (2, 4.5, 4.5, 4.0, 5.0)
    assert stats.rating_statistics(frame.where("rating = 'invalid'")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1001])
def test_median_of_many_values(spark, size):
    frame = spark.range(size).select((F.pmod(F.col("id") * 7919, F.lit(size)) * F.lit(0.5)).alias("rating"))
    heavy = frame.unionAll(frame.where("rating < 1").crossJoin(spark.range(size // 2)).select("rating"))
    values = [r.rating for r in heavy.collect()]
    row = stats.rating_statistics(heavy).first()
    assert row["count"] == len(values) and row.median == pytest.approx(statistics.median(values))


@pytest.mark.parametrize(("days", "unit"), [(31, "D"), (90, "D"), (91, "W"), (365, "W"), (731, "M"), (2190, "M")])
def test_frequency(spark, days, unit):
    frame = spark.sql(f"select timestamp'2020-01-01 10:00' as date union all select timestamp'2020-01-01 10:00' + interval {days} days")
    assert stats.infer_frequency(frame) == unit
    assert stats.infer_frequency(frame.drop("date").withColumn("x", F.lit(1))) == "D"


def test_weeks_start_on_monday(spark):
    frame = spark.sql("select explode(array('2026-01-04', '2026-01-05', '2026-01-11', 'bad', null)) as date")
    rows = [(str(r.period)[:10], r.review_count) for r in stats.reviews_over_time(frame, "W").collect()]
    assert rows == [("2025-12-29", 1), ("2026-01-05", 2)]


def test_common_words(spark):
    frame = spark.createDataFrame([("The app is fast, app!",), ("Helpful and fast; helpful's",), (None,)], "clean_text string")
    rows = [(r.term, r["count"], r.percentage) for r in stats.common_words(frame, top_n=2).collect()]
    assert rows == [("app", 2, pytest.approx(100 / 3)), ("fast", 2, pytest.approx(100 / 3))]
    for bad in ({"top_n": 0}, {"min_length": 0}):
        with pytest.raises(ValueError, match="greater than zero"):
            stats.common_words(frame, **bad)


def test_quality(spark):
    frame = spark.createDataFrame([("Good", 5.0), ("  ", None), (None, 3.0)], "review_text string, rating double")
    missing = {r.column: (r.missing_count, round(r.missing_percentage, 2)) for r in stats.missing_values(frame).collect()}
    assert missing == {"review_text": (2, 66.67), "rating": (1, 33.33)}
    assert stats.ordered_missing_values(frame).first().column == "rating"
    cells = spark.createDataFrame([("Good", "a"), ("Fine", "")], "clean_text string, product string")
    assert stats.quality_summary(cells).first().completeness_percentage == 75.0
    repeats = spark.createDataFrame([("Good app",), ("good   APP",), ("",), ("other",)], "clean_text string")
    assert stats.count_duplicate_reviews(repeats).first()[0] == 1
    assert stats.count_empty_reviews(repeats, "clean_text").first()[0] == 1
    assert stats.count_empty_reviews(repeats, "absent").first()[0] == 0
    summary = stats.dataset_summary(repeats.withColumn("review_text", F.col("clean_text"))).first()
    assert (summary.total_reviews, summary.duplicate_reviews, summary.missing_reviews, summary.product_count) == (4, 1, 1, None)


def test_histograms(spark):
    frame = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 5, 5, 5)], "rating double")
    rows = [(r.bin, r.review_count) for r in stats.rating_histogram(frame).collect()]
    assert rows == [(0, 2), (1, 1), (4, 3)]
    same = spark.createDataFrame([(2.0,), (2.0,)], "rating double")
    assert [(r.bin, r.review_count) for r in stats.rating_histogram(same).collect()] == [(0, 2)]


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [-1e308, 0.0, 1e308], [1e-300, 2e-300, 5.0, 1e12], list(range(1000)), [7.0] * 50 + [8.0]])
def test_percentiles_by_narrowing(spark, values):
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n")).cache()
    found = percentiles(frame, "v", [0.0, 0.25, 0.5, 0.9, 1.0])
    for share, value in found.items():
        place = share * (len(values) - 1)
        low, high = sorted(values)[int(place)], sorted(values)[min(int(place) + 1, len(values) - 1)]
        assert value == pytest.approx(low + (high - low) * (place - int(place)), rel=1e-12)
    assert percentiles(frame.limit(0), "v", [0.5]) == {0.5: None}
