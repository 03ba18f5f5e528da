"""Classification metrics.

Predictions are counted into the nine (actual, predicted) cells in one pass;
every metric is arithmetic on those cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid import fixed_values as fixed
from voicegrid.functions.text import word_count
from voicegrid.schema import FeedbackError
from voicegrid.session import rows_frame


def confusion_matrix(
    df: DataFrame,
    *,
    actual: str = "actual",
    predicted: str = "predicted",
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Cell counts in label order, zero cells kept; ``weight`` reads pre-counted rows."""
    amount = F.lit(1) if weight is None else F.col(weight)
    pairs = [(a, p) for a in fixed.SENTIMENT_LABELS for p in fixed.SENTIMENT_LABELS]
    cells = df.groupBy(*by).agg(
        *(
            F.coalesce(F.sum(F.when((F.col(actual) == a) & (F.col(predicted) == p), amount)), F.lit(0)).alias(f"_c{i}")
            for i, (a, p) in enumerate(pairs)
        )
    )
    rows = [
        F.struct(
            F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"_c{i}").cast("bigint").alias("row_count")
        )
        for i, (a, p) in enumerate(pairs)
    ]
    return cells.select(*by, F.inline(F.array(*rows)))


def _safe_ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def class_report(confusion: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; division by zero gives 0."""
    n, zero = F.col("row_count"), F.lit(0).cast("bigint")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("actual").alias("label"), n.alias("support"), zero.alias("claimed"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), n.alias("claimed"), zero.alias("hits")),
    )
    totals = (
        confusion.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*(F.sum(name).alias(name) for name in ("support", "claimed", "hits")))
    )
    scored = totals.select(
        *by,
        "label",
        _safe_ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        _safe_ratio(F.col("hits"), F.col("support")).alias("recall"),
        "support",
        "hits",
    )
    both = F.col("precision") + F.col("recall")
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0))
    return scored.withColumn("f1_score", f1)


def overall_metrics(report: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted scores, one row (or one per group)."""
    support = F.sum("support")
    return report.groupBy(*by).agg(
        (F.sum("hits") / support).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1_score").alias("macro_f1"),
        (F.sum(F.col("f1_score") * F.col("support")) / support).alias("weighted_f1"),
    )


def evaluate_predictions(
    df: DataFrame, *, actual: str = "actual", predicted: str = "predicted"
) -> dict[str, object]:
    """Metrics and confusion cells as plain values; fails without predictions."""
    cells = confusion_matrix(df, actual=actual, predicted=predicted).collect()
    if not sum(row["row_count"] for row in cells):
        raise FeedbackError("At least one prediction is required for evaluation.")
    spark = df.sparkSession
    confusion = rows_frame(spark, [tuple(row) for row in cells], "actual string, predicted string, row_count bigint")
    scores = overall_metrics(class_report(confusion)).first().asDict()
    size = len(fixed.SENTIMENT_LABELS)
    flat = [row["row_count"] for row in cells]
    scores["confusion_matrix"] = [flat[i * size : (i + 1) * size] for i in range(size)]
    return scores


def model_comparison(
    left: DataFrame | None,
    right: DataFrame | None,
    *,
    names: tuple[str, str] = ("first_model", "second_model"),
) -> DataFrame | None:
    """Metric table with one column per model; absent metrics are null.

    Each report is a one-row table.
    """
    present = [report for report in (left, right) if report is not None]
    if not present:
        return None

    def long(report: DataFrame | None, name: str) -> DataFrame:
        rows = [
            F.struct(
                F.lit(position).alias("position"),
                F.lit(title).alias("metric"),
                (F.col(key).cast("double") if report is not None and key in report.columns else F.lit(None).cast("double")).alias(name),
            )
            for position, (key, title) in enumerate(fixed.COMPARED_METRICS)
        ]
        return (report if report is not None else present[0]).select(F.inline(F.array(*rows)))

    joined = long(left, names[0]).join(long(right, names[1]), ["position", "metric"], "full_outer")
    return joined.orderBy("position").drop("position")


def sentiment_distribution(df: DataFrame, label_column: str = "sentiment_label") -> DataFrame:
    """Rows per label; all three labels present."""
    label = F.col(label_column)
    counts = df.agg(*(F.count_if(label == name).alias(name) for name in fixed.SENTIMENT_LABELS))
    return counts.unpivot([], list(fixed.SENTIMENT_LABELS), "sentiment_label", "review_count")


def error_slices(
    df: DataFrame,
    *,
    actual: str = "actual",
    predicted: str = "predicted",
    text_column: str = "review_text",
    rating_column: str = "rating",
    short_words: int = 20,
) -> DataFrame:
    """Accuracy by text length, and by whether the star rating disagrees with the predicted label."""
    length = F.when(word_count(text_column) <= short_words, "short text").otherwise("long text")
    rating = F.col(rating_column)
    implied = F.when(rating >= 4, "Positive").when(rating >= 3, "Neutral").when(rating.isNotNull(), "Negative")
    agreement = (
        F.when(implied.isNull(), "no rating")
        .when(implied == F.col(predicted), "rating agrees")
        .otherwise("rating disagrees")
    )
    correct = (F.col(actual) == F.col(predicted)).cast("int")
    sliced = df.select(
        correct.alias("correct"), F.explode_outer(F.array(length, agreement)).alias("slice")
    )
    return sliced.groupBy("slice").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("correct").alias("correct_count"),
        F.avg("correct").alias("accuracy"),
    )
