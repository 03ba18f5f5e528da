"""Validation rules over one aggregate pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrid import fixed_values as fixed
from voicegrid.functions.text import fold_key, normalize_whitespace
from voicegrid.operators.profiling import score_text_columns
from voicegrid.schema import ColumnMapping, DatasetInvalidError, IngestConfig
from voicegrid.session import compute_once, rows_frame

REPORT_SCHEMA = "code string, severity string, message string, remediation string"


@dataclass
class ValidationReport:
    """Messages of one dataset; a few rows at most."""

    rows: list[dict[str, str | None]] = field(default_factory=list)

    def add(self, code: str, **values: object) -> None:
        severity, message, remediation = fixed.VALIDATION_TEXTS[code]
        self.rows.append(
            {"code": code, "severity": severity, "message": message.format(**values), "remediation": remediation}
        )

    def extend(self, other: ValidationReport) -> None:
        self.rows.extend(other.rows)

    def of_severity(self, severity: str) -> list[dict[str, str | None]]:
        return [row for row in self.rows if row["severity"] == severity]

    @property
    def errors(self) -> list[dict[str, str | None]]:
        return self.of_severity("error")

    @property
    def warnings(self) -> list[dict[str, str | None]]:
        return self.of_severity("warning")

    @property
    def is_valid(self) -> bool:
        return not self.errors

    def to_df(self, spark: SparkSession) -> DataFrame:
        names = ("code", "severity", "message", "remediation")
        return rows_frame(spark, [tuple(row[name] for name in names) for row in self.rows], REPORT_SCHEMA)


def table_measures(df: DataFrame) -> DataFrame:
    """Row count and filled cells per column, one row."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), *(F.count(F.col(f"`{c}`")).alias(f"filled_{c}") for c in df.columns)
    )


def text_measures(df: DataFrame, text_column: str) -> DataFrame:
    """Usable, missing and repeated texts, one row.

    Texts are counted per folded key first, so a text repeated millions of
    times is one row per task before the shuffle.
    """
    clean = compute_once(df.select(text_column), "_clean", normalize_whitespace(text_column))
    key = F.when(F.col("_clean") != "", fold_key("_clean"))
    counted = clean.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    filled = F.col("key").isNotNull()
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("usable_rows"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("empty_rows"),
        F.coalesce(F.sum(F.when(filled, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
    )


def validate_table(df: DataFrame, config: IngestConfig = IngestConfig()) -> ValidationReport:
    """Dataset-level rules."""
    report = ValidationReport()
    if not df.columns:
        report.add("missing_columns" if not df.isEmpty() else "empty_dataset")
        return report
    measures = table_measures(df).first()
    total = measures["total_rows"]
    if total == 0:
        report.add("empty_dataset")
        return report
    if config.max_rows is not None and total > config.max_rows:
        report.add("row_limit_exceeded", limit=config.max_rows)
    unfilled = [c for c in df.columns if measures[f"filled_{c}"] == 0]
    if unfilled:
        report.add("empty_columns", count=len(unfilled), names=", ".join(unfilled))
    return report


def validate_text_column(
    df: DataFrame, text_column: str, config: IngestConfig = IngestConfig()
) -> ValidationReport:
    """Rules on the chosen text column."""
    report = ValidationReport()
    if text_column not in df.columns:
        report.add("text_column_missing", column=text_column)
        return report
    measures = text_measures(df, text_column).first()
    if measures["usable_rows"] == 0:
        report.add("text_column_empty", column=text_column)
        return report
    if not score_text_columns(df, [text_column]).head(1):
        report.add("text_column_not_text_like", column=text_column)
        return report
    if measures["empty_rows"]:
        report.add("empty_reviews_removed", count=measures["empty_rows"], column=text_column)
    if measures["duplicate_rows"]:
        report.add("duplicate_reviews_removed", count=measures["duplicate_rows"])
    coverage = measures["usable_rows"] / measures["total_rows"]
    if coverage < config.min_text_coverage:
        report.add("low_text_coverage", share=coverage, column=text_column)
    return report


def validate_mapping(df: DataFrame, mapping: ColumnMapping) -> ValidationReport:
    """Mapped columns must exist and must not be shared."""
    report = ValidationReport()
    owners = {mapping.text: "text"}
    for role, column in mapping.optional().items():
        if column not in df.columns:
            report.add("mapped_column_missing", role=role, column=column)
        elif column in owners:
            report.add("duplicate_column_mapping", column=column, first=owners[column], role=role)
        else:
            owners[column] = role
    return report


def validate_dataset(
    df: DataFrame, mapping: ColumnMapping, config: IngestConfig = IngestConfig()
) -> ValidationReport:
    """All rules; text and mapping rules only run on a usable table."""
    report = validate_table(df, config)
    if report.is_valid:
        report.extend(validate_text_column(df, mapping.text, config))
        report.extend(validate_mapping(df, mapping))
    return report


def require_valid(report: ValidationReport) -> None:
    """Stop with the joined messages when the report holds errors."""
    if not report.is_valid:
        raise DatasetInvalidError(report)
