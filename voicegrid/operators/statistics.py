"""Descriptive statistics: lengths, ratings, time buckets, words, histograms.

Wide aggregates are first reduced to counts per distinct value (word count,
rating, day, word), which map tasks combine, so medians and percentiles work
on a small table and one frequent value never forms a large group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid import fixed_values as fixed
from voicegrid.functions.casts import to_number, to_time
from voicegrid.functions.text import (
    character_count,
    fold_key,
    is_blank,
    normalize_whitespace,
    raw_plain_tokens,
    strip,
    trim_apostrophes,
    word_count,
)
from voicegrid.operators.order_statistics import percentiles
from voicegrid.schema import FeedbackError
from voicegrid.session import compute_once, cut_lineage, rows_frame


TRUNC_UNITS = {"D": "day", "W": "week", "M": "month"}


# ----------------------------------------------------------------- lengths --
def with_lengths(df: DataFrame, text_column: str = "review_text") -> DataFrame:
    """Add word and character counts; zero when the text column is absent."""
    if text_column not in df.columns:
        zero = F.lit(0).cast("bigint")
        return df.withColumns({"review_word_count": zero, "review_character_count": zero})
    return df.withColumns(
        {"review_word_count": word_count(text_column), "review_character_count": character_count(text_column)}
    )


def length_statistics(df: DataFrame, text_column: str = "review_text") -> DataFrame:
    """Mean, median, extremes and 90th percentile of word counts; mean characters."""
    per_length = cut_lineage(
        with_lengths(df, text_column)
        .groupBy("review_word_count")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("review_character_count").alias("characters"))
    )
    words, n = F.col("review_word_count"), F.col("n")
    ranks = percentiles(per_length, "review_word_count", [0.5, 0.9])
    return per_length.agg(
        F.coalesce(F.sum(words * n) / F.sum(n), F.lit(0.0)).alias("average_words"),
        F.lit(ranks[0.5] or 0.0).alias("median_words"),
        F.coalesce(F.min(words), F.lit(0)).alias("minimum_words"),
        F.coalesce(F.max(words), F.lit(0)).alias("maximum_words"),
        F.lit(ranks[0.9] or 0.0).alias("percentile_90_words"),
        F.coalesce(F.sum("characters") / F.sum(n), F.lit(0.0)).alias("average_characters"),
    )


# ----------------------------------------------------------------- ratings --
def _per_rating(df: DataFrame, rating_column: str) -> DataFrame:
    rating = to_number(df, rating_column) if rating_column in df.columns else F.lit(None).cast("double")
    return (
        df.select(rating.alias("rating"))
        .where(F.col("rating").isNotNull())
        .groupBy("rating")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rating_statistics(df: DataFrame, rating_column: str = "rating") -> DataFrame:
    """Count, mean, median and extremes; no row when nothing is numeric.

    The median comes from counts per value by narrowing value ranges, however
    many values there are.
    """
    rating, n = F.col("rating"), F.col("n")
    counts = cut_lineage(_per_rating(df, rating_column))
    median = F.lit(percentiles(counts, "rating", [0.5])[0.5]).cast("double")
    return (
        counts.agg(
            F.sum(n).alias("count"),
            (F.sum(rating * n) / F.sum(n)).alias("average"),
            median.alias("median"),
            F.min(rating).alias("minimum"),
            F.max(rating).alias("maximum"),
        )
        .where(F.col("count") > 0)
    )


# -------------------------------------------------------------------- time --
def period_of(when: Column, frequency: str) -> Column:
    """Start of the day, Monday week or month."""
    return F.date_trunc(TRUNC_UNITS[frequency], when).cast("timestamp_ntz")


def span_frequency(first: Column, last: Column) -> Column:
    """D up to 90 whole days, W up to 730, else M; D when there is no span."""
    micros = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    days = F.floor(micros / F.lit(86_400_000_000))
    return F.when(days > 730, "M").when(days > 90, "W").otherwise("D")


def time_frequency(df: DataFrame, date_column: str = "date") -> DataFrame:
    """Suggested bucket size, one row."""
    if date_column not in df.columns:
        return rows_frame(df.sparkSession, [("D",)], "frequency string")
    when = to_time(df, date_column)
    bounds = df.agg(F.min(when).alias("first"), F.max(when).alias("last"))
    return bounds.select(span_frequency(F.col("first"), F.col("last")).alias("frequency"))


def infer_frequency(df: DataFrame, date_column: str = "date") -> str:
    """Suggested bucket size as a value; reads the date column only."""
    return time_frequency(df, date_column).first()["frequency"]


def reviews_over_time(df: DataFrame, frequency: str | None = "D", date_column: str = "date") -> DataFrame:
    """Reviews per period, sorted; ``None`` infers the frequency first."""
    if date_column not in df.columns:
        return rows_frame(df.sparkSession, [], "period timestamp_ntz, review_count bigint")
    unit = infer_frequency(df, date_column) if frequency is None else frequency
    return (
        df.select(period_of(to_time(df, date_column), unit).alias("period"))
        .where(F.col("period").isNotNull())
        .groupBy("period")
        .agg(F.count(F.lit(1)).alias("review_count"))
        .orderBy("period")
    )


# ------------------------------------------------------------------- words --
def common_words(
    df: DataFrame,
    *,
    text_column: str = "clean_text",
    top_n: int = 20,
    min_length: int = 2,
    stop_words: Iterable[str] = fixed.COMMON_WORD_STOP_LIST,
) -> DataFrame:
    """Most frequent words with their share (0-100) of all kept words."""
    if top_n <= 0:
        raise ValueError("top_n must be greater than zero.")
    if min_length <= 0:
        raise ValueError("min_length must be greater than zero.")
    if text_column not in df.columns:
        return rows_frame(df.sparkSession, [], "term string, count bigint, percentage double")
    skipped = list(stop_words)
    raw = df.select(F.explode_outer(raw_plain_tokens(text_column)).alias("word"))
    words = raw.select(trim_apostrophes("word").alias("term"))
    kept = words.where((F.length("term") >= min_length) & ~F.col("term").isin(skipped))
    counts = kept.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return (
        counts.orderBy(F.desc("count"), "term")
        .limit(top_n)
        .select("term", "count", (F.col("count") / total * 100.0).alias("percentage"))
    )


# ----------------------------------------------------------------- quality --
def _missing(df: DataFrame, column: str) -> Column:
    cell = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() == "string":
        return is_blank(cell)
    if df.schema[column].dataType.typeName() in ("double", "float"):
        return cell.isNull() | F.isnan(cell)
    return cell.isNull()


def missing_values(df: DataFrame) -> DataFrame:
    """Missing cells per column (blank text counts), share 0-100, one scan."""
    names = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count_if(_missing(df, name)).alias(f"_m{i}") for i, name in enumerate(names)),
    )
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
            F.col(f"_m{i}").alias("missing_count"),
            F.coalesce(F.col(f"_m{i}") / F.nullif(F.col("_rows"), F.lit(0)) * 100.0, F.lit(0.0)).alias(
                "missing_percentage"
            ),
        )
        for i, name in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*cells)))


def ordered_missing_values(df: DataFrame) -> DataFrame:
    """Missing-value table, least missing first."""
    return missing_values(df).orderBy("missing_percentage", "column")


def count_empty_reviews(df: DataFrame, text_column: str = "review_text") -> DataFrame:
    """Null and blank texts, one row."""
    test = is_blank(text_column) if text_column in df.columns else F.lit(False)
    return df.agg(F.count_if(test).alias("empty_reviews"))


def count_duplicate_reviews(df: DataFrame, text_column: str = "clean_text") -> DataFrame:
    """Repeats among non-blank texts after space and case folding, one row."""
    if text_column not in df.columns:
        return rows_frame(df.sparkSession, [(0,)], "duplicate_reviews bigint")
    clean = compute_once(df.select(text_column), "_clean", normalize_whitespace(text_column))
    per_key = clean.where(F.col("_clean") != "").groupBy(fold_key("_clean").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_reviews"))


def quality_summary(df: DataFrame, text_column: str = "clean_text") -> DataFrame:
    """Rows, duplicates, blanks, missing cells and completeness, one row.

    All measures ride on the count per text key, so the table is read once.
    """
    has_text = text_column in df.columns
    placed = compute_once(df, "_clean", normalize_whitespace(text_column) if has_text else F.lit(""))
    missing_cells = F.lit(0)
    for name in df.columns:
        missing_cells = missing_cells + _missing(df, name).cast("bigint")
    key = F.when(F.col("_clean") != "", fold_key("_clean"))
    per_key = (
        placed.select(key.alias("key"), missing_cells.alias("missing"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing"))
    )
    filled = F.col("key").isNotNull()
    blank = F.sum(F.when(~filled, F.col("n"))) if has_text else F.lit(0)
    totals = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(filled, F.col("n") - 1)), F.lit(0)).alias("duplicate_reviews"),
        F.coalesce(blank, F.lit(0)).alias("empty_reviews"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"),
    ).withColumn("total_cells", F.col("total_rows") * len(df.columns))
    gaps = F.col("missing_cells") / F.nullif(F.col("total_cells"), F.lit(0))
    return totals.withColumn("completeness_percentage", F.coalesce(100.0 * (1.0 - gaps), F.lit(100.0)))


def dataset_summary(df: DataFrame, *, text_column: str = "review_text") -> DataFrame:
    """Headline measures of a review table, one row; absent columns give nulls."""
    duplicate_column = "clean_text" if "clean_text" in df.columns else text_column
    none = F.lit(None)
    has_text = duplicate_column in df.columns
    placed = compute_once(df, "_clean", normalize_whitespace(duplicate_column) if has_text else F.lit(""))
    key = F.when(F.col("_clean") != "", fold_key("_clean"))
    blank = is_blank(text_column) if text_column in df.columns else F.lit(False)
    rating = to_number(df, "rating") if "rating" in df.columns else none.cast("double")
    when = to_time(df, "date") if "date" in df.columns else none.cast("timestamp_ntz")
    per_key = (
        placed.select(key.alias("key"), blank.alias("blank"), rating.alias("rating"), when.alias("when"))
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("blank").alias("blanks"),
            F.sum("rating").alias("rating_sum"),
            F.count("rating").alias("rated"),
            F.min("when").alias("first"),
            F.max("when").alias("last"),
        )
    )
    repeats = F.when(F.col("key").isNotNull(), F.col("n") - 1)
    base = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_reviews"),
        F.coalesce(F.sum(repeats), F.lit(0)).alias("duplicate_reviews"),
        F.coalesce(F.sum("blanks"), F.lit(0)).alias("missing_reviews"),
        (F.sum("rating_sum") / F.nullif(F.sum("rated"), F.lit(0))).alias("average_rating"),
        F.min("first").alias("minimum_date"),
        F.max("last").alias("maximum_date"),
    )
    lengths = length_statistics(df, text_column)

    def distinct(column: str) -> Column:
        if column not in df.columns:
            return none.cast("bigint")
        return df.agg(F.count_distinct(column)).scalar()

    return base.select(
        "total_reviews",
        "duplicate_reviews",
        "missing_reviews",
        lengths.select("average_words").scalar().alias("average_review_length"),
        lengths.select("median_words").scalar().alias("median_review_length"),
        "average_rating",
        "minimum_date",
        "maximum_date",
        distinct("product").alias("product_count"),
        distinct("category").alias("category_count"),
    )


# ----------------------------------------------------------- distributions --
def group_distribution(df: DataFrame, column: str, top_n: int = 15) -> DataFrame:
    """Most frequent trimmed values of a metadata column."""
    if column not in df.columns:
        return rows_frame(df.sparkSession, [], f"`{column}` string, review_count bigint")
    return (
        df.select(strip(column).alias(column))
        .where(F.col(column) != "")
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("review_count"))
        .orderBy(F.desc("review_count"), column)
        .limit(top_n)
    )


def histogram(df: DataFrame, value: Column, bins: int | Column) -> DataFrame:
    """Counts in equal-width bins between the smallest and largest value; empty bins are absent."""
    values = df.select(value.cast("double").alias("value")).where(F.col("value").isNotNull())
    low = values.agg(F.min("value")).scalar()
    high = values.agg(F.max("value")).scalar()
    size = bins if isinstance(bins, Column) else F.lit(bins)
    placed = values.select("value", low.alias("low"), high.alias("high"), size.alias("bins"))
    width = (F.col("high") - F.col("low")) / F.col("bins")
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("low")) / F.nullif(width, F.lit(0.0))), F.col("bins") - 1)
    )
    return (
        placed.select(slot.cast("int").alias("bin"), "low", width.alias("width"))
        .groupBy("bin", "low", "width")
        .agg(F.count(F.lit(1)).alias("review_count"))
        .select(
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("lower_bound"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper_bound"),
            "review_count",
        )
        .orderBy("bin")
    )


def length_histogram(df: DataFrame, text_column: str = "review_text", bins: int = 30) -> DataFrame:
    """Histogram of word counts."""
    if text_column not in df.columns:
        raise FeedbackError(f"Text column '{text_column}' does not exist.")
    return histogram(df, word_count(text_column), bins)


def rating_histogram(df: DataFrame, rating_column: str = "rating") -> DataFrame:
    """Histogram of ratings with 5 to 20 bins, by number of distinct ratings."""
    rating = to_number(df, rating_column)
    distinct = df.agg(F.count_distinct(rating)).scalar()
    return histogram(df, rating, F.least(F.lit(20), F.greatest(F.lit(5), distinct)).cast("int"))


def confidence_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram of sentiment scores."""
    return histogram(df, to_number(df, "sentiment_score"), bins)
