"""Keyword search by stored postings: the same rows as a scan, from fewer blocks."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voicegrid.functions.text import contains_ignoring_case
from voicegrid.operators import text_index


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = [(f"r{k}", f"{'blue' if k % 2 else 'red'} Thing number {k} é漢字" + (" rareword" if k == 77 else ""), "xy"[k % 2]) for k in range(400)]
    rows += [("n", None, "x"), ("e", "", None), ("s", "ab", "y")]
    frame = spark.createDataFrame(rows, "review_id string, review_text string, product string")
    folder = str(tmp_path_factory.mktemp("index") / "i")
    text_index.write_index(frame, folder, cluster_by=["product"], equal_columns=["review_id"], block_rows=20, postings_files=4)
    return frame, folder


@pytest.mark.parametrize("keyword", ["RAREWORD", "blue", "number 1", "é漢", "ab", "r", "absent", "e thing n", "%_"])
def test_same_rows_as_a_scan(spark, indexed, keyword):
    frame, folder = indexed
    found = sorted(row["review_id"] for row in text_index.search(spark, folder, keyword).collect())
    assert found == sorted(row["review_id"] for row in frame.where(contains_ignoring_case("review_text", keyword)).collect())


def test_blocks_and_row_groups_are_left_out(spark, indexed):
    frame, folder = indexed
    rows = spark.read.parquet(f"{folder}/rows")
    assert rows.select("block").distinct().count() > 15
    files = lambda df: len(df.inputFiles())
    assert text_index.blocks_with(spark, folder, "rareword").count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = text_index.search(spark, folder, "rareword")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^]]*block#", plan)
    assert text_index.blocks_with(spark, folder, "blue").count() < rows.select("block").distinct().count() < files(rows) + 1
    # Postings are sorted: the statistics of most files exclude a run of letters.
    spans = []
    for path in (spark.read.parquet(f"{folder}/postings")).inputFiles():
        meta = pq.ParquetFile(path.removeprefix("file://")).metadata
        spans += [(meta.row_group(k).column(1).statistics.min, meta.row_group(k).column(1).statistics.max) for k in range(meta.num_row_groups)]
    holding = [span for span in spans if span[0] <= "rar" <= span[1]]
    assert len(spans) > 1 and len(holding) == 1


def test_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([("a", "b", "c")], "review_id string, review_text string, product string")
    text_index.write_index(frame, str(tmp_path / "one"))
    assert text_index.search(spark, str(tmp_path / "one"), "bcd").count() == 0 and text_index.search(spark, str(tmp_path / "one"), "B").count() == 1
