"""CSV reading with encoding fallback and typed failures."""

from __future__ import annotations

import codecs
from dataclasses import dataclass
from functools import reduce
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from voicegrid import fixed_values as fixed
from voicegrid.schema import (
    CsvEncodingError,
    CsvLoadError,
    CsvParseError,
    EmptyCsvError,
    IngestConfig,
    RowLimitError,
    UnsupportedFileError,
)

_EXTRA = "_extra_field"
_JVM_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}
# Bytes that cp1252 leaves undefined, as they look when read byte for byte.
_CP1252_GAPS = "[\x81\x8d\x8f\x90\x9d]"


@dataclass(frozen=True)
class LoadedCsv:
    """Raw all-text table and how it was decoded."""

    dataframe: DataFrame
    path: str
    encoding: str


def check_name(path: str) -> None:
    """Only ``.csv`` names are read; globs and folders are judged by their last part."""
    if PurePosixPath(path).suffix.lower() != ".csv":
        raise UnsupportedFileError("Only CSV files are supported. Save the dataset with a .csv extension.")


def pick_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...]) -> str:
    """First configured encoding that decodes every line.

    Spark's CSV reader replaces undecodable bytes without failing, so the raw
    lines are tested, split by split, in one job.
    """
    raw = spark.read.text(path)
    gaps = F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike(_CP1252_GAPS)
    row = raw.agg(
        F.coalesce(F.every(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
        F.coalesce(F.some(gaps), F.lit(False)).alias("gaps"),
    ).first()
    decodes = {"utf-8-sig": row["utf8"], "utf-8": row["utf8"], "cp1252": not row["gaps"], "latin-1": True}
    for name in encodings:
        if decodes.get(name):
            return name
    raise CsvEncodingError(f"The CSV encoding is not supported. Attempted encodings: {', '.join(encodings)}.")


def _reader(spark: SparkSession, encoding: str, config: IngestConfig):
    jvm_name = _JVM_NAMES[encoding]
    if jvm_name == "windows-1252":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.options(header="true", encoding=jvm_name, multiLine=config.multi_line_csv, mode="PERMISSIVE", escape='"')


def header_census(spark: SparkSession, path: str, encoding: str) -> list[tuple[str, list[str]]]:
    """First lines of the files of a path or glob, each with its files, in the order of their first file.

    One row a file reaches the driver.  Only the first split of a file is
    looked into for its first line, whose place is its offset.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    heads = lines.where(F.col("file_block_start") == 0).withColumn("place", F.monotonically_increasing_id())
    first = heads.groupBy("file_path").agg(F.min_by("value", "place").alias("head"))
    found: dict[str, list[str]] = {}
    for row in sorted(first.collect(), key=lambda row: row["file_path"]):
        found.setdefault(row["head"].removeprefix("\ufeff").rstrip("\r"), []).append(row["file_path"])
    return list(found.items())


def _read_alike(spark: SparkSession, paths: str | list[str], encoding: str, config: IngestConfig) -> DataFrame:
    """Files of one header as text columns, with a last column for surplus fields."""
    header = _reader(spark, encoding, config).csv(paths if isinstance(paths, str) else paths[0])
    if not header.columns:
        raise EmptyCsvError("The CSV does not contain readable columns or rows.")
    names = [name.lstrip(codecs.BOM_UTF8.decode("utf-8")) for name in header.columns]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*_unique(names), _EXTRA]])
    return _reader(spark, encoding, config).option("enforceSchema", "true").schema(schema).csv(paths)


def load_csv(spark: SparkSession, path: str, config: IngestConfig = IngestConfig()) -> LoadedCsv:
    """Read a CSV path or glob as text columns.

    Files with different headers are read by name, each by its own header:
    columns keep the order in which files bring them, and a file without a
    column has nulls there.  Short records are padded with nulls; a record with
    more fields than its header is an error.  The usual markers for missing
    cells become null.
    """
    check_name(path)
    try:
        encoding = pick_encoding(spark, path, config.encodings)
        census = header_census(spark, path, encoding)
        if len(census) > 1:
            parts = [_read_alike(spark, paths, encoding, config) for head, paths in census if head.strip()]
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        else:
            rows = _read_alike(spark, path, encoding, config)
    except AnalysisException as problem:
        raise CsvLoadError(f"The CSV file could not be read: {problem}") from problem
    names = [name for name in rows.columns if name != _EXTRA]
    counts = rows.select(F.col(_EXTRA).isNotNull().alias("long"))
    if config.max_rows is not None:
        counts = counts.limit(config.max_rows + 1)
    checked = counts.agg(F.count(F.lit(1)).alias("rows"), F.count_if("long").alias("long")).first()
    if checked["long"]:
        raise CsvParseError("The CSV structure could not be parsed. A row has more fields than the header.")
    if config.max_rows is not None and checked["rows"] > config.max_rows:
        raise RowLimitError(f"The dataset exceeds the supported {config.max_rows:,}-row limit.")
    if not checked["rows"]:
        raise EmptyCsvError("The CSV contains headers but no data rows.")
    missing = list(fixed.CSV_MISSING_MARKERS)
    cells = [F.when(~F.col(f"`{name}`").isin(missing), F.col(f"`{name}`")).alias(name) for name in names]
    return LoadedCsv(rows.select(*cells), path, encoding)


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
    return out


def load_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled training rows from CSV, or from Parquet for any other name."""
    if PurePosixPath(path).suffix.lower() == ".csv":
        return load_csv(spark, path).dataframe
    return spark.read.parquet(path)
