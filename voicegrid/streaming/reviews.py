"""Review streams: row-local enrichment, windowed counts, duplicate removal.

The batch expressions are used unchanged; only the windowed counts and the
duplicate filter keep state, both bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from voicegrid.functions.labels import canonical_label
from voicegrid.functions.text import fold_key, normalize_whitespace
from voicegrid.operators.aspects import Vocabulary, associate_aspect_sentiment, explode_mentions
from voicegrid.operators.sentiment import SentimentModel, SuppliedModel

WINDOW_LENGTHS = {"D": "1 day", "W": "7 days"}
# Weeks start on Monday; windows are otherwise aligned to 1970-01-01, a Thursday.
WINDOW_STARTS = {"D": "0 days", "W": "4 days"}


def read_reviews(
    spark: SparkSession, path: str, schema: T.StructType, *, pattern: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of the Parquet review files in a folder, optionally those of one name pattern."""
    reader = spark.readStream.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def enrich_stream(
    stream: DataFrame,
    *,
    model: SentimentModel | SuppliedModel | None = None,
    vocabulary: Vocabulary | None = None,
) -> DataFrame:
    """Clean, score and extract aspects row by row; without a model labels must be present."""
    rows = stream
    if "clean_text" not in rows.columns:
        rows = rows.withColumn("clean_text", normalize_whitespace("review_text"))
    rows = rows.where(F.col("clean_text") != "")
    if model is not None:
        rows = model.predict(rows, model.text_column)
    return associate_aspect_sentiment(rows, vocabulary)


def _event_time(stream: DataFrame) -> DataFrame:
    # Watermarks need a zoned timestamp.
    return stream.withColumn("date", F.col("date").cast("timestamp")).where(F.col("date").isNotNull())


def _window(frequency: str) -> Column:
    length = WINDOW_LENGTHS[frequency]
    return F.window("date", length, length, WINDOW_STARTS[frequency])


def sentiment_windows(stream: DataFrame, *, frequency: str = "D", late_by: str = "2 days") -> DataFrame:
    """Reviews per period and label; a period is emitted once it can no longer change."""
    counted = (
        _event_time(stream)
        .withWatermark("date", late_by)
        .groupBy(_window(frequency).alias("window"), canonical_label(F.col("sentiment_label")).alias("sentiment_label"))
        .agg(F.count(F.lit(1)).alias("review_count"))
    )
    return counted.select(F.col("window.start").alias("period"), "sentiment_label", "review_count")


def aspect_windows(stream: DataFrame, *, frequency: str = "D", late_by: str = "2 days") -> DataFrame:
    """Mentions and negative mentions per period and aspect of an enriched stream."""
    mentions = explode_mentions(_event_time(stream))
    counted = (
        mentions.withWatermark("date", late_by)
        .groupBy(_window(frequency).alias("window"), "aspect")
        .agg(
            F.count(F.lit(1)).alias("mention_count"),
            F.count_if(F.col("aspect_sentiment_label") == "Negative").alias("negative_count"),
        )
    )
    return counted.select(F.col("window.start").alias("period"), "aspect", "mention_count", "negative_count")


def drop_repeats(stream: DataFrame, *, text_column: str = "clean_text", late_by: str = "2 days") -> DataFrame:
    """First arrival of each folded text within the watermark.

    State holds fixed-size keys, never texts.
    """
    keyed = _event_time(stream).withColumn("_text_key", fold_key(normalize_whitespace(text_column)))
    return keyed.withWatermark("date", late_by).dropDuplicatesWithinWatermark(["_text_key"]).drop("_text_key")


class _Earliest(StatefulProcessor):
    """Keeps the earliest row of a key until the watermark has passed it, then emits it once."""

    def __init__(self, schema: T.StructType) -> None:
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.schema)
        self.done = handle.getValueState("done", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = [tuple(row[name] for name in self.schema.names) for row in rows]
        if not self.done.exists():
            held = [tuple(self.best.get())] if self.best.exists() else []
            first = min([*found, *held], key=lambda row: row[:2])
            if not held or first != held[0]:
                if held:
                    self.handle.deleteTimer(held[0][0] // 1000)
                self.best.update(first)
                self.handle.registerTimer(first[0] // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.done.exists():
            # All that could still repeat the text within the watermark has come.
            self.done.clear()
            return iter(())
        first = tuple(self.best.get())
        self.best.clear()
        again = timerValues.getCurrentWatermarkInMs() + self.keep_ms
        self.done.update((again,))
        self.handle.registerTimer(again)
        return iter((Row(**dict(zip(self.schema.names, first))),))

    keep_ms = 0

    def close(self) -> None:
        pass


def earliest_of_repeats(
    stream: DataFrame, columns: Sequence[str], *, order_by: str = "review_id", text_column: str = "clean_text",
    late_by: str = "2 days", remember: timedelta = timedelta(days=2),
) -> DataFrame:
    """The earliest row of each folded text by ``date``, then ``order_by``, in whatever order rows arrive.

    A text's row comes out once the watermark has passed its date, when no
    earlier one can come any more; repeats within ``remember`` after that are
    dropped.  State holds the key and ``columns``, so leave texts out of them.
    """
    named = ["_micros", order_by, *(c for c in columns if c not in ("date", order_by))]
    keyed = _event_time(stream).withColumn("_text_key", F.hex(fold_key(normalize_whitespace(text_column))))
    # Workers see whole microseconds, whatever time zone they or the session are in.
    rows = keyed.withWatermark("date", late_by).withColumn("_micros", F.unix_micros("date")).select("_text_key", "date", *named)
    schema = T.StructType([rows.schema[name] for name in named])
    processor = _Earliest(schema)
    processor.keep_ms = int(remember.total_seconds() * 1000)
    first = rows.groupBy("_text_key").transformWithState(processor, schema, "append", "eventTime")
    return first.select(F.timestamp_micros("_micros").alias("date"), *named[1:])


def needs_column_families(spark: SparkSession) -> None:
    """Timers live in column families, which only the RocksDB state store has."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def write_batches(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append output whose batches have folders of their own, named by their number.

    A batch that is run again after a failure replaces its own folder, so each
    row counts once whatever happens between the write and the commit.
    """

    def put(batch: DataFrame, number: int) -> None:
        put_batch(batch, path, number)

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()


def put_batch(batch: DataFrame, path: str, number: int) -> None:
    """Store one batch under its number."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All stored batches."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*").select(schema.names)


def write_stream(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append a stream to Parquet; ``once`` works off what is there and stops."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
