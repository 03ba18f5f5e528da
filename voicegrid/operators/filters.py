"""Row filters and filter options of the exploration and dashboard views.

The two families differ on purpose: exploration matches products without case
and widens only a midnight end date; the dashboard matches exactly and always
includes the whole end day.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F, types as T

from voicegrid import fixed_values as fixed
from voicegrid.functions.casts import to_number, to_time
from voicegrid.functions.text import contains_ignoring_case, fold, strip
from voicegrid.session import join_small, rows_frame

DateLike = date | datetime | str

# Longer lists become a semi join instead of an IN expression.
IN_LIST_LIMIT = 1_000


@dataclass(frozen=True)
class DatasetFilters:
    """Selections of the exploration view."""

    start_date: DateLike | None = None
    end_date: DateLike | None = None
    products: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    rating_min: float | None = None
    rating_max: float | None = None
    keyword: str = ""


@dataclass(frozen=True)
class DashboardFilters:
    """Selections of the dashboard."""

    start_date: DateLike | None = None
    end_date: DateLike | None = None
    products: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    rating_min: float | None = None
    rating_max: float | None = None
    sentiments: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    aspects: tuple[str, ...] = ()
    search_text: str = ""

    def is_active(self) -> bool:
        """True when any selection differs from the default."""
        return replace(self, search_text=self.search_text.strip()) != DashboardFilters()


def _moment(value: DateLike | None) -> datetime | None:
    if value is None or isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    try:
        return datetime.fromisoformat(str(value))
    except ValueError:
        raise ValueError(f"Invalid date filter value: {value!r}") from None


def _time_literal(df: DataFrame, column: str, value: datetime) -> Column:
    text = F.lit(value.isoformat(sep=" "))
    zoneless = isinstance(df.schema[column].dataType, T.TimestampNTZType)
    return text.cast("timestamp_ntz" if zoneless else "timestamp")


def _date_tests(df: DataFrame, start: datetime | None, before: datetime | None) -> list[Column]:
    if "date" not in df.columns or (start is None and before is None):
        return []
    when = to_time(df, "date")
    tests = [] if start is None else [when >= _time_literal(df, "date", start)]
    return tests if before is None else [*tests, when < _time_literal(df, "date", before)]


def _rating_tests(df: DataFrame, low: float | None, high: float | None) -> list[Column]:
    if "rating" not in df.columns or (low is None and high is None):
        return []
    kind = df.schema["rating"].dataType
    # Numeric columns are compared as they are, so that the scan can use the bounds.
    rating = F.col("rating") if isinstance(kind, T.NumericType) else to_number(df, "rating")
    tests = [] if low is None else [rating >= low]
    if high is not None:
        tests.append(rating <= high)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        # NaN sorts above every number; an upper bound would have dropped it.
        tests.append(~F.isnan(rating))
    return tests


def _keep_members(df: DataFrame, column: str, values: Sequence[str], *, ignore_case: bool = False) -> DataFrame:
    if not values or column not in df.columns:
        return df
    source = F.col(column).cast("string")
    key = fold(F.coalesce(source, F.lit(""))) if ignore_case else source
    if len(values) <= IN_LIST_LIMIT:
        wanted = [fold(F.lit(value)) for value in values] if ignore_case else [F.lit(value) for value in values]
        return df.where(key.isin(*wanted))
    listed = rows_frame(df.sparkSession, [(value,) for value in values], "_wanted string")
    wanted_key = fold("_wanted") if ignore_case else F.col("_wanted")
    return join_small(
        df.withColumn("_member", key), listed.select(wanted_key.alias("_member")).distinct(), "_member", "left_semi",
        rows=len(values),
    ).drop("_member")


def _where_all(df: DataFrame, tests: list[Column]) -> DataFrame:
    for test in tests:
        df = df.where(test)
    return df


def apply_filters(df: DataFrame, filters: DatasetFilters, *, text_column: str = "review_text") -> DataFrame:
    """Exploration filters; selections on absent columns are skipped."""
    end = _moment(filters.end_date)
    before = None
    if end is not None:
        whole_day = end == end.replace(hour=0, minute=0, second=0, microsecond=0)
        before = end + (timedelta(days=1) if whole_day else timedelta(microseconds=1))
    tests = _date_tests(df, _moment(filters.start_date), before)
    tests += _rating_tests(df, filters.rating_min, filters.rating_max)
    keyword = filters.keyword.strip()
    if keyword and text_column in df.columns:
        tests.append(contains_ignoring_case(text_column, keyword))
    kept = _where_all(df, tests)
    kept = _keep_members(kept, "product", filters.products, ignore_case=True)
    return _keep_members(kept, "category", filters.categories, ignore_case=True)


def apply_dashboard_filters(df: DataFrame, filters: DashboardFilters = DashboardFilters()) -> DataFrame:
    """Dashboard filters on reviews or on an aspect-mention table."""
    end = _moment(filters.end_date)
    before = None if end is None else end + timedelta(days=1)
    tests = _date_tests(df, _moment(filters.start_date), before)
    tests += _rating_tests(df, filters.rating_min, filters.rating_max)
    if filters.aspects and "aspect" not in df.columns and "detected_aspects" in df.columns:
        tests.append(F.arrays_overlap("detected_aspects", F.array(*map(F.lit, filters.aspects))))
    search = filters.search_text.strip()
    if search and "review_text" in df.columns:
        tests.append(contains_ignoring_case("review_text", search))
    kept = _where_all(df, tests)
    members = {
        "product": filters.products,
        "category": filters.categories,
        "sentiment_label": filters.sentiments,
        "topic_label": filters.topics,
        "aspect": filters.aspects,
    }
    for column, values in members.items():
        kept = _keep_members(kept, column, values)
    return kept


def minimum_confidence(df: DataFrame, least: float) -> DataFrame:
    """Rows scored at least this confidently."""
    return df.where(F.col("sentiment_score") >= least)


def filter_status(total: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept rows, all rows and the share kept; two counts, one row."""
    return kept.agg(F.count(F.lit(1)).alias("kept_rows")).select(
        "kept_rows", total.agg(F.count(F.lit(1))).scalar().alias("total_rows")
    ).select(
        "kept_rows",
        "total_rows",
        F.coalesce(F.col("kept_rows") / F.nullif(F.col("total_rows"), F.lit(0)), F.lit(0.0)).alias("retention_share"),
    )


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Projection on those of the wanted columns that exist."""
    return df.select(*(name for name in columns if name in df.columns))


# ---------------------------------------------------------------- options --
def _range(df: DataFrame) -> list[Column]:
    parts = []
    if "date" in df.columns:
        when = to_time(df, "date")
        parts += [F.min(when).alias("minimum_date"), F.max(when).alias("maximum_date")]
    if "rating" in df.columns:
        rating = to_number(df, "rating")
        parts += [F.min(rating).alias("minimum_rating"), F.max(rating).alias("maximum_rating")]
    return parts


def option_ranges(df: DataFrame) -> DataFrame:
    """Date and rating bounds, one row; bounds of absent columns are absent."""
    parts = _range(df)
    return df.agg(*(parts or [F.count(F.lit(1)).alias("rows")]))


def option_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed non-blank values of one column, one per row.

    A table rather than a collected set: a product list may be long.
    """
    value = strip(column)
    return df.select(value.alias("value")).where(F.col("value") != "").distinct()


def filter_options(df: DataFrame) -> DataFrame:
    """Products and categories to choose from, in case-insensitive order."""
    return _option_table(df, ("product", "category")).orderBy("field", fold("value"), "value")


def dashboard_filter_options(df: DataFrame) -> DataFrame:
    """All choices of the dashboard; sentiments keep their display order."""
    table = _option_table(df, ("product", "category", "sentiment_label", "topic_label"))
    aspects = None
    if "aspect" in df.columns:
        aspects = option_values(df, "aspect")
    elif "detected_aspects" in df.columns:
        exploded = df.select(F.explode_outer("detected_aspects").alias("value"))
        aspects = exploded.where(strip("value") != "").distinct()
    if aspects is not None:
        table = table.unionAll(aspects.select(F.lit("aspect").alias("field"), "value"))
    rank = F.when(F.col("field") == "sentiment_label", _display_rank(F.col("value"))).otherwise(F.lit(0))
    return table.withColumn("display_rank", rank).orderBy("field", "display_rank", "value")


def _display_rank(label: Column) -> Column:
    rank = F.lit(len(fixed.OVERALL_TIE_ORDER))
    for position, name in enumerate(fixed.OVERALL_TIE_ORDER):
        rank = F.when(label == name, F.lit(position)).otherwise(rank)
    return rank


def _option_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value) pairs of several columns from one scan and one shuffle."""
    present = [name for name in columns if name in df.columns]
    if not present:
        return rows_frame(df.sparkSession, [], "field string, value string")
    wide = df.select(*(strip(name).alias(name) for name in present))
    return wide.unpivot([], present, "field", "value").where(F.col("value") != "").distinct()
