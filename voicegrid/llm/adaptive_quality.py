"""Quality rules with thresholds that follow each language and source.

Every measure of a document is an integer.  A sketch counts a group's documents
by bucket: values below ``2 * STEPS`` each have their own, larger ones share a
bucket with those that agree in the leading bits, so a bucket is at most one
part in ``STEPS`` wide.  Sketches are plain counts: those of tasks, days or
sources merge by addition, in any order, with equal results.

A group's threshold for a measure is its third quartile plus ``FENCE``
interquartile ranges (or minus, below the first quartile), and at least
``SLACK`` away from the quartile, so that ordinary documents of a group stay
whatever its usual values are.  A (language, source) group of fewer than
``LEAST_ROWS`` documents takes its language's merged sketch, and a language of
fewer that of all documents.  The few thresholds are joined back to the rows.

Defined results: null texts have no words; null languages and sources are
groups of their own; empty texts fail the base rules; repeated rows count each;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voicegrid.llm.text_arrays import NOT_SPACE, column_of, grams, in_chunks, split_words, utf8
from voicegrid.session import scratch_table

STEPS = 32
FENCE = 3
LEAST_ROWS = 200
SYMBOLS = b"#*$%&|<>"
#: The measures with thresholds: their least distance from the quartile, and whether high or low values fail.
MEASURES = {
    "symbols_per_mille": (100, "high"),
    "duplicate_lines_per_mille": (300, "high"),
    "repeated_words_per_mille": (200, "high"),
    "word_length_per_cent": (300, "high"),
}
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeated_words(hashes: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice."""
    windows = grams(hashes, 3)
    if len(windows) < 2:
        return 0
    _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[at] > 1)
    if not len(starts):
        return 0
    inside = np.zeros(len(hashes), bool)
    for k in range(3):
        inside[starts + k] = True
    return int(inside.sum())


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id``, the key columns and the counts of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            column = column_of(batch, "text")
            words = split_words(column, NOT_SPACE, lower=False)
            raw, offsets = utf8(column)
            # A code point begins at each byte that doesn't continue one.
            begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[raw])])
            chars = np.concatenate([[0], np.cumsum(begins[words.ends] - begins[words.starts])])
            lows, highs = words.first[:-1], words.first[1:]
            data = raw.tobytes()
            lines = [_duplicate_lines(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            repeated = [_repeated_words(words.hashes[a:b]) for a, b in zip(lows, highs)]
            counts = [
                highs - lows, chars[highs] - chars[lows], symbols[offsets[1:]] - symbols[offsets[:-1]],
                [n for n, _ in lines], [n for _, n in lines], repeated,
            ]
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, c) for c in ("doc_id", *keys)] + [pa.array(x, pa.int64()) for x in counts],
                ["doc_id", *keys, *COUNTS],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), *keys, F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *keys))
    return rows.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} long" for c in COUNTS))


def with_measures(counts: DataFrame) -> DataFrame:
    """Adds the integer measures."""
    share = lambda part, whole, scale: F.expr(f"{scale} * {part} div greatest({whole}, 1)")
    return counts.withColumns(
        {
            "symbols_per_mille": share("n_symbols", "word_chars", 1000),
            "duplicate_lines_per_mille": share("n_dup_lines", "n_lines", 1000),
            "repeated_words_per_mille": share("n_repeat_words", "n_words", 1000),
            "word_length_per_cent": share("word_chars", "n_words", 100),
        }
    )


def bucket(value: str) -> Column:
    """The lowest value of the value's bucket."""
    shift = f"greatest(length(bin({value})) - {(2 * STEPS).bit_length() - 1}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})").cast("long")


def sketches(measures: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per key columns, measure and bucket: ``n`` documents.  Adding the counts of two sketches merges them."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(m).alias("bucket")) for m in MEASURES])).alias("e")
    return measures.select(*keys, each).groupBy(*keys, "e.measure", "e.bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """First and third quartile and the number of documents of each group of sketches."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    ranked = merged.select(
        *by, "measure", "bucket", F.sum("n").over(group).alias("rows"),
        F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    at = lambda quarter: F.min(F.when(4 * F.col("upto") >= quarter * F.col("rows"), F.col("bucket")))
    return ranked.groupBy(*by, "measure").agg(at(1).alias("q1"), at(3).alias("q3"), F.first("rows").alias("rows"))


def thresholds(sketch: DataFrame, keys: tuple[str, ...], least_rows: int = LEAST_ROWS) -> DataFrame:
    """Per key columns and measure: the ``threshold`` above which a document fails."""
    groups = _quartiles(sketch, list(keys))
    levels = [_quartiles(sketch, list(keys[:k])) for k in range(len(keys) - 1, -1, -1)]
    q1, q3 = [F.when(F.col("g.rows") >= least_rows, F.col("g.q1"))], [F.when(F.col("g.rows") >= least_rows, F.col("g.q3"))]
    joined = groups.alias("g")
    for k, level in enumerate(levels):
        same = F.col("g.measure") == F.col(f"l{k}.measure")
        shared = keys[: len(keys) - 1 - k]
        for key in shared:
            same &= F.col(f"g.{key}").eqNullSafe(F.col(f"l{k}.{key}"))
        joined = joined.join(level.alias(f"l{k}"), same)
        enough = (F.col(f"l{k}.rows") >= least_rows) if shared else F.lit(True)
        q1.append(F.when(enough, F.col(f"l{k}.q1")))
        q3.append(F.when(enough, F.col(f"l{k}.q3")))
    slack = F.create_map(*[F.lit(x) for m, (least, _) in MEASURES.items() for x in (m, least)])[F.col("g.measure")]
    low, high = F.coalesce(*q1), F.coalesce(*q3)
    return joined.select(
        *[F.col(f"g.{key}").alias(key) for key in keys], F.col("g.measure").alias("measure"),
        (high + F.greatest(FENCE * (high - low), slack)).alias("threshold"),
    )


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row: ``doc_id``, the counts, ``base_failed``, ``failed`` (measures beyond their thresholds) and ``kept``."""
    rows = scratch_table(with_measures(measure(docs, id_col=id_col, text_col=text_col, keys=keys)), "measures")
    limits = thresholds(sketches(rows, keys), keys)
    wide = scratch_table(
        limits.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col("threshold"))).alias(f"limit_{m}") for m in MEASURES]),
        "limits",
    )
    wide = wide.select(*[F.col(k).alias(f"_{k}") for k in keys], *[f"limit_{m}" for m in MEASURES])
    same = F.lit(True)
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_{key}"))
    judged = rows.join(wide, same, "left")
    failed = F.array_compact(F.array(*[F.when(F.col(m) > F.col(f"limit_{m}"), F.lit(m)) for m in MEASURES]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"),
    )
