"""Labelled data: contract checks, exact dedup, stratified split."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from voicegrid import fixed_values as fixed
from voicegrid.functions.labels import label_order, normalize_label
from voicegrid.functions.text import normalize_whitespace
from voicegrid.schema import LabelledDataError, SplitConfig, require_columns
from voicegrid.session import compute_once, cut_lineage, join_small

# Rows one ranking task should handle.
RANK_BUCKET_ROWS = 200_000


def labelled_pairs(
    df: DataFrame,
    *,
    text_column: str = "review_text",
    label_column: str = "sentiment_label",
    mapping: Mapping[str, str] | None = None,
) -> DataFrame:
    """Normalized non-empty text with its canonical label; bad labels stop the job."""
    require_columns(df, [text_column, label_column], LabelledDataError, "Labelled data")
    raw = df.select(text_column, F.col(label_column).alias("_raw"))
    filled = compute_once(raw, text_column, normalize_whitespace(text_column)).where(F.col(text_column) != "")
    return filled.select(text_column, normalize_label(F.col("_raw"), mapping).alias(label_column))


def _label_set(label: Column) -> Column:
    """Labels of a group as a bit set, a fixed-size aggregation buffer."""
    return F.bit_or(F.pow(F.lit(2), label_order(label)).cast("int"))


def label_conflicts(
    pairs: DataFrame, *, text_column: str = "review_text", label_column: str = "sentiment_label"
) -> DataFrame:
    """Texts that carry more than one label."""
    counted = pairs.groupBy(text_column).agg(F.bit_count(_label_set(F.col(label_column))).alias("label_count"))
    return counted.where(F.col("label_count") > 1).select(text_column, F.col("label_count").cast("bigint"))


def class_distribution(df: DataFrame, label_column: str = "sentiment_label") -> DataFrame:
    """Rows per label."""
    return df.groupBy(label_column).agg(F.count(F.lit(1)).alias("row_count"))


def prepare_labelled(
    df: DataFrame,
    *,
    text_column: str = "review_text",
    label_column: str = "sentiment_label",
    mapping: Mapping[str, str] | None = None,
    min_per_class: int = 7,
    keep_conflicts: bool = False,
    store: bool = False,
) -> DataFrame:
    """Distinct labelled texts after the contract checks.

    Equal texts have equal labels once conflicts are ruled out, so keeping the
    first is the same as a distinct.  With ``keep_conflicts`` a text that
    carries several labels does not stop the job: it stays once with each.
    ``store=True`` stores the distinct pairs before the checks, which then
    read them there, so that ``df`` is read once.
    """
    pairs = labelled_pairs(df, text_column=text_column, label_column=label_column, mapping=mapping)
    if store:
        pairs = cut_lineage(pairs.distinct())
    # Labels meet by a digest of the text, so that no text is shuffled for the checks.
    per_text = pairs.groupBy(F.unhex(F.sha2(text_column, 256)).alias("key")).agg(_label_set(F.col(label_column)).alias("labels"))
    groups = {row["labels"]: row["n"] for row in per_text.groupBy("labels").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not groups:
        raise LabelledDataError("No usable review text remains after removing empty rows.")
    conflicts = sum(n for labels, n in groups.items() if labels.bit_count() > 1)
    if conflicts and not keep_conflicts:
        raise LabelledDataError(f"{conflicts} review text(s) carry conflicting sentiment labels; resolve them first.")
    counts = {
        name: sum(n for labels, n in groups.items() if labels >> position & 1)
        for position, name in enumerate(fixed.SENTIMENT_LABELS)
    }
    absent = sorted(name for name, n in counts.items() if n == 0)
    if absent:
        raise LabelledDataError(f"All three classes are required. Missing labels: {', '.join(absent)}.")
    if min(counts.values()) < min_per_class:
        raise LabelledDataError(f"Each sentiment class needs at least {min_per_class} examples.")
    return pairs if store else pairs.distinct()


def split_labelled(
    df: DataFrame,
    config: SplitConfig = SplitConfig(),
    *,
    text_column: str = "review_text",
    label_column: str = "sentiment_label",
) -> DataFrame:
    """Add ``split`` with exact shares per class, repeatable for a seed.

    Rows are ranked within their class by a digest of seed and text.  A class
    may hold nearly all rows, so ranks are computed inside digest-prefix
    buckets and shifted by the sizes of the earlier buckets.
    """
    digest = F.md5(F.concat(F.lit(f"{config.seed}:"), F.col(text_column)))
    stored = cut_lineage(df.withColumn("_digest", digest))
    width = max(1, math.ceil(math.log(max(stored.count() / RANK_BUCKET_ROWS, 1), 16)))
    keyed = stored.withColumn("_bucket", F.substring("_digest", 1, width))
    sizes = keyed.groupBy(label_column, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    in_class = Window.partitionBy(label_column)
    before = F.sum("_size").over(in_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(
        label_column,
        "_bucket",
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_size").over(in_class).alias("_total"),
    )
    in_bucket = Window.partitionBy(label_column, "_bucket").orderBy("_digest")
    ranked = join_small(
        keyed.withColumn("_rank", F.row_number().over(in_bucket)),
        offsets,
        [label_column, "_bucket"],
        "inner",
        rows=len(fixed.SENTIMENT_LABELS) * 16**width,
    )
    place = F.col("_before") + F.col("_rank")

    def up_to(share: float) -> Column:
        return F.floor(F.col("_total") * F.lit(round(share, 9)) + 0.5)

    split = (
        F.when(place <= up_to(config.train), "train")
        .when(place <= up_to(config.train + config.validation), "validation")
        .otherwise("test")
    )
    return ranked.select(*df.columns, split.alias("split"))
