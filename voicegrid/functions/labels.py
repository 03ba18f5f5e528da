"""Sentiment-label expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid import fixed_values as fixed
from voicegrid.functions.text import fold, strip


def label_score(label: Column) -> Column:
    """-1, 0 or +1; null for anything else."""
    expr = F.lit(None).cast("double")
    for name, score in fixed.SENTIMENT_SCORES.items():
        expr = F.when(label == name, F.lit(score)).otherwise(expr)
    return expr


def label_order(label: Column, order: tuple[str, ...] = fixed.SENTIMENT_LABELS) -> Column:
    """Position of a label in ``order``; unknown labels come last."""
    expr = F.lit(len(order))
    for position, name in enumerate(order):
        expr = F.when(label == name, F.lit(position)).otherwise(expr)
    return expr


def match_label(value: Column, mapping: Mapping[str, str] | None = None) -> Column:
    """Canonical label or null: explicit mapping first, then case-insensitive names.

    Values that already are canonical skip the string work.
    """
    text = value.cast("string")
    raw = strip(text)
    for source, target in (mapping or {}).items():
        wanted = fold(F.lit(str(source).strip()))
        raw = F.when(fold(strip(text)) == wanted, F.lit(str(target).strip())).otherwise(raw)
    found = F.lit(None).cast("string")
    for name in fixed.SENTIMENT_LABELS:
        found = F.when(fold(raw) == name.lower(), F.lit(name)).otherwise(found)
    return found if mapping else F.when(text.isin(*fixed.SENTIMENT_LABELS), text).otherwise(found)


def normalize_label(value: Column, mapping: Mapping[str, str] | None = None) -> Column:
    """Canonical label; missing and unknown values stop the job."""
    found = match_label(value, mapping)
    problem = F.concat(
        F.lit("Unsupported sentiment label: "), F.coalesce(value.cast("string"), F.lit("missing"))
    )
    return F.coalesce(found, F.raise_error(problem).cast("string"))


def canonical_label(value: Column) -> Column:
    """Canonical label; null stays null, unknown values stop the job."""
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(normalize_label(value))


def unsupported_labels(df: DataFrame, column: str = "sentiment_label") -> DataFrame:
    """Distinct values that are neither null nor one of the three labels."""
    value = F.col(column)
    return (
        df.where(value.isNotNull() & match_label(value).isNull())
        .select(strip(value).alias("label"))
        .distinct()
    )


def dominant_label(
    positive: Column, neutral: Column, negative: Column, order: tuple[str, ...] = fixed.SENTIMENT_LABELS
) -> Column:
    """Label with the largest count; ties go to the earlier one in ``order``."""
    counts = {"Positive": positive, "Neutral": neutral, "Negative": negative}
    top = F.greatest(positive, neutral, negative)
    expr = F.lit(None).cast("string")
    for name in reversed(order):
        expr = F.when(counts[name] == top, F.lit(name)).otherwise(expr)
    return expr
