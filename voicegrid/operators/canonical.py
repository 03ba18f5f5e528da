"""Canonical review table: blank removal, keep-first dedup, ids, safe casts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid import fixed_values as fixed
from voicegrid.functions.casts import date_formats_of, to_number, to_time
from voicegrid.functions.text import fold_key, normalize_whitespace, strip
from voicegrid.operators.validation import ValidationReport, require_valid, text_measures, validate_dataset
from voicegrid.schema import ColumnMapping, FeedbackError, IngestConfig
from voicegrid.session import compute_once, cut_lineage, join_small, rows_frame


@dataclass(frozen=True)
class CanonicalResult:
    """Canonical rows, row-change counts and coercion warnings."""

    dataframe: DataFrame
    statistics: DataFrame
    casts: DataFrame
    mapping: ColumnMapping

    def warnings(self) -> ValidationReport:
        """Counted coercion warnings (runs one aggregate)."""
        report = ValidationReport()
        counts = self.casts.first()
        sources = self.mapping.optional()
        if counts["invalid_dates"]:
            report.add("invalid_dates_coerced", count=counts["invalid_dates"], column=sources["date"])
        if counts["invalid_ratings"]:
            report.add("invalid_ratings_coerced", count=counts["invalid_ratings"], column=sources["rating"])
        return report


def with_position(df: DataFrame, order_by: str | Sequence[str] | None) -> DataFrame:
    """Add ``_pos``, the row order that "first" refers to.

    Name unique ordering columns when the table has them.  Without them the
    read order is used; it is written out once, because a second read may be
    split differently and would then number rows differently.
    """
    if order_by is None:
        return cut_lineage(df.withColumn("_pos", F.monotonically_increasing_id()))
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.withColumn("_pos", F.col(names[0]) if len(names) == 1 else F.struct(*names))


def keep_first(df: DataFrame, key: Column, columns: Sequence[str], *, keep_key: bool = False) -> DataFrame:
    """First row by ``_pos`` of every key, as one partially combined aggregate.

    A key that covers a third of the table leaves each task as one row, so
    there is no hot group and no window over it.
    """
    first = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*columns), F.col("_pos")).alias("_row"))
    return first.select(*(["_key"] if keep_key else []), "_row.*")


def number_rows(positions: DataFrame) -> DataFrame:
    """Add ``_number``, the 1-based rank of the unique ``_pos``.

    Positions are range-partitioned and sorted, frozen by a checkpoint, then
    each partition starts at the sum of the partitions before it.  No step has
    a global window.
    """
    slot = F.monotonically_increasing_id()
    sorted_once = cut_lineage(
        positions.select("_pos").repartitionByRange("_pos").sortWithinPartitions("_pos").withColumn("_slot", slot)
    )
    part = F.shiftright("_slot", 33)
    sizes = sorted(
        (row["part"], row["n"]) for row in sorted_once.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    starts, before = [], 0
    for partition, size in sizes:
        starts.append((partition, before))
        before += size
    offsets = rows_frame(positions.sparkSession, starts, "_part bigint, _start bigint")
    inside = F.col("_slot") - F.shiftleft("_part", 33)
    numbered = join_small(
        sorted_once.withColumn("_part", part), offsets, "_part", "inner", rows=len(starts)
    )
    return numbered.select("_pos", (F.col("_start") + inside + 1).alias("_number"))


def _usable_alias(kept: DataFrame, aliases: list[str]) -> str | None:
    for alias in aliases:
        value = strip(alias)
        row = kept.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(F.when(value != "", F.lit(1))).alias("filled"),
            F.count_distinct(value).alias("distinct"),
        ).first()
        if row["rows"] == row["filled"] == row["distinct"]:
            return alias
    return None


def optional_columns(df: DataFrame, mapping: ColumnMapping, config: IngestConfig = IngestConfig()) -> dict[str, Column]:
    """Safely converted optional columns; unreadable or blank cells become null."""
    converted: dict[str, Column] = {}
    for role, source in mapping.optional().items():
        if role == "date":
            converted[role] = to_time(df, source, config.date_formats or date_formats_of(df, source))
        elif role == "rating":
            converted[role] = to_number(df, source)
        else:
            text = strip(source)
            converted[role] = F.when(text != "", text)
    return converted


def cast_measures(df: DataFrame, mapping: ColumnMapping, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Cells that were filled but could not be read as date or number, one row."""
    converted = optional_columns(df, mapping, config)
    sources = mapping.optional()

    def lost(role: str) -> Column:
        if role not in converted:
            return F.lit(0).cast("bigint")
        return F.count_if(F.col(sources[role]).isNotNull() & converted[role].isNull())

    return df.agg(lost("date").alias("invalid_dates"), lost("rating").alias("invalid_ratings"))


def ingestion_statistics(df: DataFrame, text_column: str) -> DataFrame:
    """Input, output, blank and duplicate row counts, one row."""
    counts = text_measures(df, text_column)
    return counts.select(
        F.col("total_rows").alias("input_rows"),
        (F.col("usable_rows") - F.col("duplicate_rows")).alias("output_rows"),
        F.col("empty_rows").alias("empty_reviews_removed"),
        F.col("duplicate_rows").alias("duplicate_reviews_removed"),
    )


def canonicalize(
    df: DataFrame,
    mapping: ColumnMapping,
    *,
    order_by: str | Sequence[str] | None = None,
    config: IngestConfig = IngestConfig(),
) -> CanonicalResult:
    """Build the canonical table.

    With a usable source id the rows are shuffled once, on the text key.
    Without one, narrow (key, position) pairs decide which rows stay and what
    number they get, and the wide rows are shuffled once by that join.  Either
    way only the source text travels, and is cleaned anew.  Text keys, positions
    and optional cells are stored once: all that needs no text reads them there.
    """
    if mapping.text not in df.columns:
        raise FeedbackError(f"Text column '{mapping.text}' does not exist.")
    placed = with_position(df, order_by)

    def cleaned(rows: DataFrame) -> DataFrame:
        return compute_once(rows, "_clean", normalize_whitespace(mapping.text)).where(F.col("_clean") != "")

    filled = cleaned(placed)
    key = fold_key("_clean")
    aliases = [name for name in fixed.REVIEW_ID_ALIASES if name in df.columns]
    sources = list(dict.fromkeys(mapping.optional().values()))
    narrow = list(dict.fromkeys([*aliases, *sources]))
    keyed = cut_lineage(filled.select(key.alias("_text_key"), "_pos", *narrow))
    text_key = F.col("_text_key")
    alias = _usable_alias(keep_first(keyed, text_key, aliases), aliases) if aliases else None
    if alias is not None:
        kept = keep_first(filled, key, df.columns).withColumn("_clean", normalize_whitespace(mapping.text))
        review_id = strip(alias)
    else:
        winners = keyed.groupBy("_text_key").agg(F.min("_pos").alias("_pos"))
        kept = cleaned(placed.join(number_rows(winners), "_pos"))
        review_id = F.format_string("review_%06d", "_number")
    optional = optional_columns(df, mapping, config)
    rows = kept.select(
        review_id.alias("review_id"),
        F.col(mapping.text).cast("string").alias("review_text"),
        F.col("_clean").alias("clean_text"),
        *(optional[name].alias(name) for name in fixed.OPTIONAL_COLUMNS if name in optional),
    )
    first_rows = keep_first(keyed, text_key, sources) if sources else keyed
    return CanonicalResult(rows, ingestion_statistics(df, mapping.text), cast_measures(first_rows, mapping, config), mapping)


def prepare_dataset(
    df: DataFrame,
    mapping: ColumnMapping,
    *,
    order_by: str | Sequence[str] | None = None,
    config: IngestConfig = IngestConfig(),
) -> CanonicalResult:
    """Validate, then canonicalize."""
    require_valid(validate_dataset(df, mapping, config))
    return canonicalize(df, mapping, order_by=order_by, config=config)
