"""Writers for enriched tables, reports and run outputs."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from voicegrid import fixed_values as fixed
from voicegrid.operators.insights import Insights
from voicegrid.schema import FeedbackError
from voicegrid.session import rows_frame


def flatten_nested(df: DataFrame) -> DataFrame:
    """Array, map and struct columns as JSON text, so that any row format can hold them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema)
    )


def write_reviews(df: DataFrame, path: str, *, partition_by: str | None = None) -> None:
    """Enriched reviews as Parquet, the native form."""
    writer = df.write.mode("error")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_reviews_csv(df: DataFrame, path: str, *, mode: str = "error") -> None:
    """Enriched reviews as UTF-8 CSV with header; white space at a cell's ends stays."""
    flatten_nested(df).write.mode(mode).csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_recommendations_csv(recommendations: DataFrame, path: str) -> None:
    """Recommendations with their evidence ids in one cell; at most three rows."""
    flat = recommendations.withColumn(
        "representative_review_ids", F.concat_ws(", ", "representative_review_ids")
    )
    flat.coalesce(1).write.mode("error").csv(path, header=True, quote='"', escape='"')


def report_lines(insights: Insights) -> list[str]:
    """Markdown lines of the insight report; findings and recommendations are a few rows."""
    words = fixed.REPORT_HEADINGS
    blocks = [words["title"], words["summary"], insights.executive_summary, words["findings"]]
    for row in insights.findings.collect():
        blocks += [
            f"### {row['title']}",
            f"**Evidence:** {row['evidence']}",
            f"**Business interpretation:** {row['business_interpretation']}",
        ]
        if row["representative_review_ids"]:
            blocks.append(f"**Supporting review IDs:** {', '.join(row['representative_review_ids'])}")
    blocks.append(words["recommendations"])
    advice = insights.recommendations.collect()
    if not advice:
        blocks.append(words["none"])
    for row in advice:
        metric = f"**Supporting metric:** {row['supporting_metric']} = {row['supporting_value']:.1%}"
        support = f"**Supporting count:** {row['supporting_count']:,}"
        blocks += [f"### [{row['priority']}] {row['title']}", row["explanation"], f"{metric}\n{support}"]
    limits = list(fixed.REPORT_LIMITATIONS)
    if not insights.status.available:
        limits.append(words["trend_gap"].format(reason=insights.status.reason))
    blocks += [words["limitations"], "\n".join(limits)]
    return "\n\n".join(blocks).split("\n")


def write_markdown(insights: Insights, path: str) -> None:
    """Insight report as one Markdown text file below ``path``."""
    spark = insights.dataframe.sparkSession
    lines = [(i, line) for i, line in enumerate(report_lines(insights))]
    ordered = rows_frame(spark, lines, "position int, value string").coalesce(1).sortWithinPartitions("position")
    ordered.select("value").write.mode("error").text(path)


def write_metrics(spark: SparkSession, metrics: Mapping[str, object], path: str) -> None:
    """One JSON object with sorted keys."""
    line = json.dumps(metrics, sort_keys=True)
    rows_frame(spark, [(line,)], "value string").coalesce(1).write.mode("error").text(path)


def read_metrics(spark: SparkSession, path: str) -> dict[str, object]:
    """Inverse of :func:`write_metrics`; anything but one object is an error."""
    value = json.loads("\n".join(row["value"] for row in spark.read.text(path).collect()))
    if not isinstance(value, dict):
        raise FeedbackError(f"Expected a JSON object in {path}.")
    return value


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Text, actual label, predicted label and confidence of the test part."""
    predictions.write.mode("error").parquet(path)


def write_topic_run(
    assignments: DataFrame, summary: DataFrame, evaluation: Mapping[str, object], path: str
) -> None:
    """Assignments, summary and evaluation of one topic run below ``path``."""
    assignments.write.mode("error").parquet(f"{path}/assignments")
    summary.coalesce(1).write.mode("error").csv(f"{path}/summary", header=True, quote='"', escape='"')
    write_metrics(assignments.sparkSession, evaluation, f"{path}/evaluation")
