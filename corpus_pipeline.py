"""From raw documents to token ids: five stages, each stored before the next one reads it.

1. toxicity – documents whose score is 0.3 or more go;
2. near_dedup – of each group of near duplicates (five-word shingles, similarity
   0.8 or more) the document with the smallest id stays;
3. decontamination – documents with a ten-word passage of a benchmark item go;
4. secrets – findings are replaced by their kind in brackets;
5. tokens – ids, their number and digests of the ids and of the decoded bytes.

All stages but the last return the columns of their input, whatever these are
named.  Rows that share an id share a verdict: they stay if one of them stays.
Null texts count as empty and stay null; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrid.llm.bpe_transducer import round_trip
from voicegrid.llm.circulant_minhash import near_duplicates
from voicegrid.llm.positional_index import decontaminate
from voicegrid.llm.secret_ledger import Ledger, redact
from voicegrid.llm.toxic_compression import fit, keep_below
from voicegrid.session import scratch_table

TOXIC_FROM = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``docs`` without the ids whose rows all have a true ``goes``."""
    gone = verdicts.groupBy("doc_id").agg(F.min("goes").alias("goes")).where("goes").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of documents that are still there; scores all of them."""
    return keep_below(docs, fit(docs, _table(spark, sf_dir, "labels")), TOXIC_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs, shingle=5, percent=80)
    return _without(docs, found.select("doc_id", (~F.col("kept")).alias("goes")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id", F.col("contaminated").alias("goes")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stored length follows the text where there is one."""
    clean = redact(docs, Ledger(spark))
    if "n_chars" not in docs.columns:
        return clean
    length = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True, small=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return docs


# Compression, MinHash and byte-pair merges have no SQL form.
ORACLE_SQL = None
