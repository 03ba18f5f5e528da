"""Detection of the review-text column and of optional metadata columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from voicegrid import fixed_values as fixed
from voicegrid.functions.casts import date_formats_of, to_number, to_time
from voicegrid.functions.text import is_blank, strip
from voicegrid.operators.naming import match_name
from voicegrid.schema import IngestConfig


def keyword_score(column: str) -> float:
    """How much a header looks like a text column: 1.0, 0.9, 0.7 or 0."""
    name = match_name(column)
    words = name.split("_")
    if name in fixed.TEXT_KEYWORDS:
        return 1.0
    if set(words) & set(fixed.TEXT_KEYWORDS):
        return 0.9
    return 0.7 if any(key in name for key in fixed.TEXT_KEYWORDS) else 0.0


def alias_score(column: str, aliases: tuple[str, ...]) -> int:
    """How well a header fits an alias list: 3, 2, 1 or 0."""
    name = match_name(column)
    if name in aliases:
        return 3
    if set(name.split("_")) & set(aliases):
        return 2
    return int(any(alias in name for alias in aliases if len(alias) >= 4))


def score_text_columns(
    df: DataFrame, columns: list[str] | None = None, *, sample_rows: int | None = None
) -> DataFrame:
    """Evidence and score per viable text column, best first.

    The table is turned into (column, value) rows and counted per distinct
    value first: one shuffle on fixed-size keys serves all columns, and a value
    that fills a third of the rows is combined before it moves.
    The whole table is scored unless ``sample_rows`` asks for a quick look.
    """
    names = columns if columns is not None else df.columns
    source = df.select(*names)
    if sample_rows is not None:
        source = source.limit(sample_rows)
    text = source.select(*(F.col(f"`{name}`").cast("string").alias(name) for name in names))
    long = text.unpivot([], [f"`{name}`" for name in names], "column", "value")
    value = strip("value")
    filled = value.isNotNull() & (value != "")
    distinct = (
        long.select(
            "column",
            filled.alias("filled"),
            F.when(filled, F.length(value)).alias("length"),
            F.when(filled, value.rlike("[A-Za-z]")).alias("alphabetic"),
            F.when(filled, F.unhex(F.sha2(value, 256))).alias("key"),
        )
        .groupBy("column", "filled", "length", "alphabetic", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n = F.col("n")
    used = F.sum(F.when(F.col("filled"), n))
    measures = distinct.groupBy("column").agg(
        (F.sum(F.when(F.col("filled"), n * F.col("length"))) / used).alias("average_length"),
        (used / F.sum(n)).alias("non_empty_ratio"),
        (F.sum(F.when(F.col("alphabetic"), n).otherwise(F.lit(0))) / used).alias("alphabetic_ratio"),
        (F.count_if(F.col("filled")) / used).alias("unique_ratio"),
    )
    keyword = F.create_map(
        *(F.lit(item) for name in names for item in (name, keyword_score(name)))
    )[F.col("column")]
    scored = measures.where(F.col("average_length").isNotNull()).withColumn("keyword_score", keyword)
    # Unnamed columns need longer text; named ones may hold short feedback.
    least_length = F.when(F.col("keyword_score") > 0, F.lit(2.0)).otherwise(F.lit(15.0))
    score = (
        0.40 * F.col("keyword_score")
        + 0.25 * F.least(F.col("average_length") / 80.0, F.lit(1.0))
        + 0.15 * F.col("non_empty_ratio")
        + 0.10 * F.col("alphabetic_ratio")
        + 0.10 * F.col("unique_ratio")
    )
    return (
        scored.where((F.col("alphabetic_ratio") >= 0.30) & (F.col("average_length") >= least_length))
        .withColumn("score", F.round(score, 6))
        .orderBy(F.desc("score"), F.desc("keyword_score"), F.desc("average_length"))
    )


def detect_text_column(df: DataFrame, config: IngestConfig = IngestConfig()) -> str | None:
    """Best text column when its score reaches the configured minimum."""
    best = score_text_columns(df).head(1)
    if best and best[0]["score"] >= config.min_text_score:
        return best[0]["column"]
    return None


def _fit(df: DataFrame, role: str, column: str, config: IngestConfig) -> Column:
    if role == "date":
        return to_time(df, column, config.date_formats or date_formats_of(df, column)).isNotNull()
    if role == "rating":
        if isinstance(df.schema[column].dataType, T.NumericType):
            return F.lit(True)
        return to_number(df, column).isNotNull()
    return ~is_blank(column)


def detect_metadata_columns(
    df: DataFrame, text_column: str | None = None, config: IngestConfig = IngestConfig()
) -> dict[str, str]:
    """Source column per role; every source is used at most once.

    Name scores need no data.  The content test of all candidates is one
    aggregate over the whole table, on the filled cells of each.
    """
    candidates = [
        (role, column, score)
        for role, aliases in fixed.METADATA_ALIASES.items()
        for column in df.columns
        if column != text_column and (score := alias_score(column, aliases)) > 0
    ]
    if not candidates:
        return {}
    shares = df.agg(
        *[
            F.avg(F.when(F.col(column).isNotNull(), _fit(df, role, column, config).cast("double"))).alias(f"share_{k}")
            for k, (role, column, _) in enumerate(candidates)
        ]
    ).first()
    needed = {"date": 0.60, "rating": 0.60}
    fitting = {
        (role, column)
        for k, (role, column, _) in enumerate(candidates)
        if shares[k] is not None and shares[k] >= needed.get(role, 0.50)
    }
    chosen: dict[str, str] = {}
    for role in fixed.METADATA_ALIASES:
        options = [
            (-score, len(column), position, column)
            for position, (owner, column, score) in enumerate(candidates)
            if owner == role and (role, column) in fitting and column not in chosen.values()
        ]
        if options:
            chosen[role] = min(options)[-1]
    return chosen
