"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrid.llm.adaptive_quality import judge
from voicegrid.llm.bpe_transducer import round_trip
from voicegrid.llm.circulant_minhash import near_duplicates
from voicegrid.llm.collocations import collocations
from voicegrid.llm.hard_negatives import mine
from voicegrid.llm.html_region import extract, learn_weights
from voicegrid.llm.license_votes import scan_licenses
from voicegrid.llm.positional_index import decontaminate
from voicegrid.llm.private_data import BASE as PRIVATE_BASE, find_private
from voicegrid.llm.secret_ledger import BASE, Ledger, scan_history
from voicegrid.llm.token_shards import read_shards, write_shards
from voicegrid.llm.toxic_compression import fit, held_out, score
from voicegrid.llm.warc import read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_history(table(spark, sf_dir, "documents"), Ledger(spark))
    joined = lambda spans: F.array_join(F.transform(spans, _span), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )


def _span(x):
    return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))


def op2_diagonal_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({name: F.array_join(name, ",") for name in ("base_labels", "labels")})


def op3_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn_weights(pages))


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), path, end_id=1))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.withColumn("failed", F.array_join("failed", ","))


def op9_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages"), min_bytes=0))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op11_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=30, longest=4, top=2000)


def op12_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, _span), ",")
    count = lambda held, name: F.size(F.filter("found", held)).cast("long").alias(name)
    of = lambda kind: lambda x: x["kind"] == kind
    base = lambda x: x["kind"].isin(*PRIVATE_BASE)
    return found.select(
        "doc_id", *(count(of(kind), f"n_{kind}") for kind in PRIVATE_BASE),
        F.sha2(joined(F.filter("found", base)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        count(lambda x: ~base(x), "n_added"), count(lambda x: x["score"] >= 0.8, "n_confident"),
    )


def op13_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_blob_ledger": op1_blob_ledger,
    "op2_diagonal_votes": op2_diagonal_votes,
    "op3_html_region": op3_html_region,
    "op4_wavelet_shards": op4_wavelet_shards,
    "op5_circulant_minhash": op5_circulant_minhash,
    "op6_bpe_transducer": op6_bpe_transducer,
    "op7_compression_toxicity": op7_compression_toxicity,
    "op8_adaptive_quality": op8_adaptive_quality,
    "op9_warc_ranges": op9_warc_ranges,
    "op10_positional_decontamination": op10_positional_decontamination,
    "op11_tiled_collocations": op11_tiled_collocations,
    "op12_private_spans": op12_private_spans,
    "op13_cover_tree_negatives": op13_cover_tree_negatives,
}
