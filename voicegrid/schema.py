"""Types, configuration objects and errors shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

from voicegrid import fixed_values as fixed


class FeedbackError(ValueError):
    """Base class of every error a caller can correct."""


class CsvLoadError(FeedbackError):
    """A CSV source cannot be read."""


class UnsupportedFileError(CsvLoadError):
    """The source is not named as a CSV file."""


class EmptyCsvError(CsvLoadError):
    """The source has no columns or no data rows."""


class RowLimitError(CsvLoadError):
    """The source holds more rows than the caller allowed."""


class CsvEncodingError(CsvLoadError):
    """No configured encoding decodes the source."""


class CsvParseError(CsvLoadError):
    """A record has more fields than the header."""


class DatasetInvalidError(FeedbackError):
    """Validation found at least one blocking problem."""

    def __init__(self, report) -> None:
        self.report = report
        text = "; ".join(row["message"] for row in report.errors)
        super().__init__(text or "Dataset validation failed.")


class LabelledDataError(FeedbackError):
    """Training data breaks the three-class contract."""


class TopicError(FeedbackError):
    """Topics cannot be fitted or applied."""


class AspectError(FeedbackError):
    """Aspects cannot be extracted or aggregated."""


class InsightError(FeedbackError):
    """Insights cannot be derived from the given table."""


@dataclass(frozen=True)
class ColumnMapping:
    """Names of the source columns that feed the canonical table."""

    text: str
    date: str | None = None
    rating: str | None = None
    product: str | None = None
    category: str | None = None
    version: str | None = None

    def optional(self) -> dict[str, str]:
        """Mapped optional columns, canonical name to source name."""
        pairs = ((name, getattr(self, name)) for name in fixed.OPTIONAL_COLUMNS)
        return {name: source for name, source in pairs if source is not None}


@dataclass(frozen=True)
class IngestConfig:
    """Limits and thresholds of reading, detection and validation.

    ``max_rows`` is off by default: a cluster has no reason to refuse a large
    table.  Set it to get the bounded-read guard.  Quoted line breaks need
    ``multi_line_csv``, which reads every file in one piece; switch it off for
    large files without them, so that they are split.
    """

    max_rows: int | None = None
    min_text_score: float = 0.35
    min_text_coverage: float = 0.05
    encodings: tuple[str, ...] = fixed.CSV_ENCODINGS
    date_formats: tuple[str, ...] = ()
    multi_line_csv: bool = True


@dataclass(frozen=True)
class SplitConfig:
    """Shares of the train, validation and test parts."""

    train: float = 0.70
    validation: float = 0.15
    test: float = 0.15
    seed: int = 42

    def __post_init__(self) -> None:
        parts = (self.train, self.validation, self.test)
        if abs(sum(parts) - 1.0) > 1e-9:
            raise ValueError("Split proportions must sum to 1.0.")
        if min(parts) <= 0:
            raise ValueError("Split proportions must be greater than zero.")


@dataclass(frozen=True)
class SentimentConfig:
    """TF-IDF and logistic-regression settings.

    ``tol`` bounds the norm of the whole gradient relative to the loss, which
    is stricter than the same bound on its largest entry.
    """

    max_features: int = 20_000
    ngram_max: int = 2
    c: float = 1.0
    max_iter: int = 1_000
    tol: float = 1e-3
    seed: int = 42


@dataclass(frozen=True)
class TopicConfig:
    """TF-IDF and factorization settings of the topic model."""

    n_topics: int = 8
    max_features: int = 5_000
    min_df: int = 2
    max_df: float = 0.95
    ngram_max: int = 2
    top_n_words: int = 8
    seed: int = 42
    max_iter: int = 400
    tol: float = 1e-4
    stop_words: tuple[str, ...] | None = None
    #: Below this many texts ``min_df`` counts as 1 and a contradicted ``max_df`` as 1.0; 0 keeps both as they stand.
    small_corpus: int = 20

    def __post_init__(self) -> None:
        checks = (
            (self.n_topics >= 2, "n_topics must be at least 2."),
            (self.max_features >= self.n_topics, "max_features must be at least n_topics."),
            (self.min_df >= 1, "min_df must be at least 1."),
            (0 < self.max_df <= 1, "max_df must be in the interval (0, 1]."),
            (self.ngram_max in (1, 2), "ngram_max must be 1 or 2."),
            (self.top_n_words >= 1, "top_n_words must be positive."),
            (self.max_iter >= 1, "max_iter must be positive."),
        )
        for passed, message in checks:
            if not passed:
                raise ValueError(message)


CANONICAL_TYPES = {
    "review_id": T.StringType(),
    "review_text": T.StringType(),
    "clean_text": T.StringType(),
    "date": T.TimestampType(),
    "rating": T.DoubleType(),
    "product": T.StringType(),
    "category": T.StringType(),
    "version": T.StringType(),
}


def require_columns(
    df: DataFrame, names: Iterable[str], error: type[Exception] = FeedbackError, what: str = "Input"
) -> None:
    """Fail while the plan is built when a needed column is absent."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise error(f"{what} lacks required columns: {', '.join(missing)}")


def pick_text_column(df: DataFrame, error: type[Exception] = FeedbackError) -> str:
    """``clean_text`` when present, else ``review_text``."""
    for name in ("clean_text", "review_text"):
        if name in df.columns:
            return name
    raise error("A 'clean_text' or 'review_text' column is required.")
