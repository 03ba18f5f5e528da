"""Keyword search that reads only the blocks which can hold the keyword.

Reviews are stored in blocks (folders that a reader can leave out); for each
three-letter run of the lower-cased text the index lists the blocks that hold
it, sorted, so that Parquet's statistics skip most of the index too.  A search
takes the blocks that hold every run of the keyword and looks for the keyword
itself there.  Blocks are made of rows alike in ``cluster_by`` (language,
product), for then rare words are in few of them.  Values of ``equal_columns``
get Bloom filters, with which equality tests skip row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voicegrid.functions.text import contains_ignoring_case

SIZE = 3
BLOCK_ROWS = 20_000
#: Rows of the postings in one row group.
POSTINGS_BYTES = 1 << 20


def _grams(text: Column) -> Column:
    """Distinct runs of ``SIZE`` characters; none for shorter text.

    The text is cut into ``SIZE`` characters after ``SIZE`` characters, once from each of its first places:
    a substring at every place would count characters from the start each time.
    """
    cuts = [F.regexp_extract_all(F.substring(text, at + 1, 1 << 30), F.lit(f"(?s).{{{SIZE}}}"), F.lit(0)) for at in range(SIZE)]
    return F.array_distinct(F.concat(*cuts))


def write_index(
    df: DataFrame, folder: str, *, key: str = "review_id", text_column: str = "review_text",
    cluster_by: Sequence[str] = (), equal_columns: Sequence[str] = (), block_rows: int = BLOCK_ROWS,
    postings_files: int | None = None,
) -> None:
    """Store rows and postings below ``folder``; blocks have about ``block_rows`` rows, a crowded cluster many blocks."""
    cluster = F.xxhash64(*cluster_by) if cluster_by else F.lit(0).cast("bigint")
    sizes = df.groupBy(cluster.alias("cluster")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    placed = df.withColumn("cluster", cluster).join(sizes, "cluster")
    block = F.pmod(F.xxhash64(F.col("cluster"), F.pmod(F.xxhash64(key), F.col("parts"))), F.lit(1 << 40))
    rows = placed.withColumn("block", block).drop("cluster", "parts")
    writer = rows.repartition("block").write.partitionBy("block")
    for name in equal_columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(f"{folder}/rows")
    stored = df.sparkSession.read.parquet(f"{folder}/rows").select("block", F.lower(text_column).alias("text"))
    pairs = stored.select("block", F.explode(_grams(F.col("text"))).alias("gram")).distinct()
    dealt = pairs.repartitionByRange("gram") if postings_files is None else pairs.repartitionByRange(postings_files, "gram")
    dealt.sortWithinPartitions("gram", "block").write.option(
        "parquet.block.size", POSTINGS_BYTES
    ).parquet(f"{folder}/postings")


def blocks_with(spark: SparkSession, folder: str, keyword: str) -> DataFrame | None:
    """Blocks that hold every run of a keyword; None if it is too short to tell."""
    lowered = keyword.lower()
    grams = sorted({lowered[at : at + SIZE] for at in range(len(lowered) - SIZE + 1)})
    if not grams:
        return None
    postings = spark.read.parquet(f"{folder}/postings").where(F.col("gram").isin(grams))
    return postings.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("block")


def search(spark: SparkSession, folder: str, keyword: str, *, text_column: str = "review_text") -> DataFrame:
    """Stored rows whose text contains the keyword in any case.

    The blocks' numbers, one for each ``BLOCK_ROWS`` reviews at most, go to the
    reader as a partition filter.
    """
    rows = spark.read.parquet(f"{folder}/rows")
    held = blocks_with(spark, folder, keyword)
    if held is not None:
        rows = rows.where(F.col("block").isin([row["block"] for row in held.collect()]))
    return rows.where(contains_ignoring_case(text_column, keyword)).drop("block")
