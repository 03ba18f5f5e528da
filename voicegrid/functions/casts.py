"""Safe conversions of raw metadata columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from voicegrid.functions.text import strip

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(value: Column) -> Column:
    """Double with NaN turned into null."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def to_number(df: DataFrame, column: str) -> Column:
    """Numeric value of a column of any type; unreadable cells become null."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return finite(F.col(column))
    text = strip(F.col(column).cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


#: Ways to write dates besides ISO text, in the order in which ties are decided.
DATE_FORMATS = (
    "M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss]]", "d MMMM yyyy[ H:mm[:ss]]", "MMM d, yyyy[ H:mm[:ss]]", "MMMM d, yyyy[ H:mm[:ss]]", "d-MMM-yyyy[ H:mm[:ss]]",
)


def date_formats_of(df: DataFrame, column: str, formats: Sequence[str] = DATE_FORMATS) -> tuple[str, ...]:
    """The format that reads most cells of the whole text column; none when ISO text reads as many."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return ()
    text = strip(F.col(column))
    reads = [text.try_cast("timestamp"), *(F.try_to_timestamp(text, F.lit(pattern)) for pattern in formats)]
    counts = df.agg(*[F.count(read).alias(f"n_{k}") for k, read in enumerate(reads)]).first()
    best = max(range(len(reads)), key=lambda k: (counts[k], -k))
    return (formats[best - 1],) if best else ()


def to_time(df: DataFrame, column: str, formats: Sequence[str] = ()) -> Column:
    """Timestamp of a column of any type: ISO text first, then each given format.

    Zone-less timestamps are kept as they are.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(column)
    if isinstance(kind, T.DateType):
        return F.col(column).cast("timestamp")
    text = strip(F.col(column).cast("string"))
    tries = [text.try_cast("timestamp")]
    tries += [F.try_to_timestamp(text, F.lit(pattern)) for pattern in formats]
    return F.coalesce(*tries)
