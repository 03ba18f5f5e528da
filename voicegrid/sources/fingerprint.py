"""Content fingerprints that do not depend on row order or partitioning, and can be added up.

Every row has a SHA-256; its eight 32-bit parts are summed over all rows.  The
sums of two tables' rows are the sums of their union's, so a table that grows
needs only its new rows hashed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

LANES = 8
PARTS = ("row_count", *(f"lane_{k}" for k in range(LANES)))


def _cell(name: str) -> Column:
    """A cell that no other cells can be cut into: its length stands before it."""
    text = F.col(f"`{name}`").cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def fingerprint_parts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and the eight sums, one row."""
    names = list(columns) if columns is not None else df.columns
    digest = F.sha2(F.concat(*map(_cell, names)), 256) if names else F.sha2(F.lit(""), 256)
    lanes = df.select(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)").alias(f"lane_{k}") for k in range(LANES)))
    sums = [F.coalesce(F.sum(f"lane_{k}"), F.lit(0)).cast("decimal(38,0)").alias(f"lane_{k}") for k in range(LANES)]
    return lanes.agg(F.count(F.lit(1)).alias("row_count"), *sums)


def add_parts(*parts: DataFrame) -> DataFrame:
    """Parts of the union of several tables, one row."""
    stacked = reduce(DataFrame.unionAll, (part.select(*PARTS) for part in parts))
    sums = [F.sum(name).cast("bigint" if name == "row_count" else "decimal(38,0)").alias(name) for name in PARTS]
    return stacked.agg(*sums)


def fingerprint_of(parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """SHA-256 over the column names and the parts, and the row count; one row."""
    listed = F.concat_ws("|", F.lit(",".join(names)), *(F.col(name).cast("string") for name in PARTS))
    return parts.select(F.sha2(listed, 256).alias("fingerprint"), "row_count")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """SHA-256 of a table's content, one row.

    Column names take part, so renamed tables differ.
    """
    names = list(columns) if columns is not None else df.columns
    return fingerprint_of(fingerprint_parts(df, names), names)


def source_signature(df: DataFrame, name: str) -> str:
    """Version key of a named source, for output paths."""
    found = fingerprint(df).select(F.sha2(F.concat_ws("|", F.lit(name), "fingerprint"), 256).alias("key"))
    return found.first()["key"]
