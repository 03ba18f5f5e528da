"""Licence scans by diagonal voting.

Every window of ``GRAM`` words of every document, as a hash, is joined with the
positions of equal windows in the templates.  A match votes for its diagonal
(document position minus template position).  Votes are aggregated by diagonal;
neighbouring diagonals of a document and template, which words put in or left
out have parted, merge into one candidate; a candidate whose windows cover
enough of the template within a short enough span is verified.

The templates are a fixed list of some hundred windows, so their side of the
join is broadcast (``join_small`` checks the row count); documents aren't
shuffled, only matching windows are.

Defined results: null and empty texts have no words and score 0; repeated rows
(same id and text) get the same findings and vote once; other rows of one id
are told apart by their text; extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voicegrid.llm.license_texts import PHRASES, TEMPLATES
from voicegrid.llm.text_arrays import ALPHANUMERIC, column_of, grams, hash_phrase, in_chunks, split_words
from voicegrid.session import join_small

GRAM = 3
#: Verified spans cover this share of the template's words and are at most this many times as long.
COVERED, STRETCH = 0.8, 1.5


def template_grams(spark: SparkSession, templates: tuple = TEMPLATES, gram: int = GRAM) -> tuple[DataFrame, int]:
    """``hash``, ``template``, ``label``, ``n_template`` (words) and ``at`` of each template window, and their number."""
    rows = []
    for name, label, text in templates:
        words = hash_phrase(text, ALPHANUMERIC)
        rows += [(h, name, label, len(words), k) for k, h in enumerate(grams(words, gram).view(np.int64).tolist())]
    return spark.createDataFrame(rows, "hash long, template string, label string, n_template int, at int"), len(rows)


def document_grams(docs: DataFrame, id_col: str, text_col: str, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``grams`` (one hash for each word position that begins a window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            words = split_words(column_of(batch, "text"), ALPHANUMERIC)
            counts = np.maximum(np.diff(words.first) - gram + 1, 0)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            place = np.arange(offsets[-1]) + np.repeat(words.first[:-1] - offsets[:-1], counts)
            values = grams(words.hashes, gram)[place] if len(place) else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), column_of(batch, "text_hash"), lists], ["doc_id", "text_hash", "grams"]
            )

    rows = _keyed(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, grams array<long>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def phrase_counts(docs: DataFrame, id_col: str, text_col: str, phrases: tuple = PHRASES) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_words``, ``n_base``, ``first_word``, ``last_word`` and ``base_labels``."""
    wanted = [(hash_phrase(text, ALPHANUMERIC), label) for text, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            words = split_words(column_of(batch, "text"), ALPHANUMERIC)
            places, labels = [], []
            for k, (phrase, _) in enumerate(wanted):
                size = len(phrase)
                at = np.flatnonzero(words.hashes[: max(0, len(words.hashes) - size + 1)] == phrase[0])
                for i in range(1, size):
                    at = at[words.hashes[at + i] == phrase[i]]
                doc = np.searchsorted(words.first, at, "right") - 1
                at = at[at + size <= words.first[doc + 1]]
                places.append(at)
                labels.append(np.full(len(at), k))
            places, labels = np.concatenate(places), np.concatenate(labels)
            docs_of = np.searchsorted(words.first, places, "right") - 1
            starts = places - words.first[docs_of]
            size = batch.num_rows
            found: list[dict] = [{} for _ in range(size)]
            for doc, start, label in zip(docs_of.tolist(), starts.tolist(), labels.tolist()):
                own = found[doc]
                own["n"] = own.get("n", 0) + 1
                own["first"], own["last"] = min(own.get("first", start), start), max(own.get("last", start), start)
                own.setdefault("labels", set()).add(wanted[label][1])
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id"), column_of(batch, "text_hash"), pa.array(np.diff(words.first), pa.int64()),
                    pa.array([x.get("n", 0) for x in found], pa.int64()), pa.array([x.get("first") for x in found], pa.int64()),
                    pa.array([x.get("last") for x in found], pa.int64()),
                    pa.array([sorted(x.get("labels", ())) for x in found], pa.list_(pa.string())),
                ],
                ["doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base_labels"],
            )

    rows = _keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, text_hash long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>"
    )


def license_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """Candidates: ``doc_id``, ``text_hash``, ``template``, ``label``, ``start``, ``end`` (words), ``coverage``, ``verified``."""
    known, count = template_grams(docs.sparkSession, templates)
    windows = document_grams(docs, id_col, text_col).select("doc_id", "text_hash", F.posexplode("grams").alias("pos", "hash"))
    votes = join_small(windows, known, "hash", "inner", rows=count)
    document = ["doc_id", "text_hash"]
    diagonals = votes.groupBy(*document, "template", "label", "n_template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("at"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    # A diagonal merges with the one before it when few words part them.
    order = Window.partitionBy(*document, "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(order) <= F.least(F.floor(F.col("n_template") / 4), F.lit(8))
    runs = diagonals.withColumn("new", F.when(near, 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = runs.groupBy(*document, "template", "label", "n_template", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min("low").alias("start"), (F.max("high") + GRAM).alias("end")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x, x + GRAM - 1)))))
    coverage = F.round(covered / F.col("n_template"), 6)
    fits = F.col("end") - F.col("start") <= STRETCH * F.col("n_template") + GRAM
    return merged.select(
        *document, "template", "label", F.col("start").cast("long"), F.col("end").cast("long"), coverage.alias("coverage"),
        ((coverage >= COVERED) & fits).alias("verified"),
    )


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the phrase counts, ``base_labels``, ``labels`` and ``score`` (the best coverage; 1 with a phrase)."""
    spans = license_spans(docs, id_col=id_col, text_col=text_col)
    best = spans.groupBy("doc_id", "text_hash").agg(
        F.max("coverage").alias("coverage"), F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("found")
    )
    rows = phrase_counts(docs, id_col, text_col)
    same = rows["doc_id"].eqNullSafe(best["doc_id"]) & (rows["text_hash"] == best["text_hash"])
    none = F.array().cast("array<string>")
    return rows.join(best, same, "left").select(
        rows["doc_id"], "n_words", "n_base", "first_word", "last_word", F.col("base_labels"),
        F.array_sort(F.array_union("base_labels", F.coalesce("found", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )
