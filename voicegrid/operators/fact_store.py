"""Trend facts kept per source, so that a new file changes trends without a rescan of the others.

Facts are daily counts and sums; they add up over sources and roll up to weeks
and months.  Each source has a folder of its own below the store, named by its
signature: storing a source again replaces its own part and nothing else, and
removing it is removing its folder.  Reading adds the parts in one aggregate,
whose size follows days, topics and aspects, not reviews.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrid.operators.aspects import explode_mentions
from voicegrid.operators.statistics import period_of
from voicegrid.operators.trends import mention_facts, review_facts

REVIEW_KEYS = ("period", "topic_label", "sentiment_label")
REVIEW_SUMS = ("review_count", "with_aspects")
MENTION_KEYS = ("period", "aspect", "sentiment_label")
MENTION_SUMS = ("mention_count", "sentiment_sum", "confidence_sum", "confidence_count", "rating_sum", "rating_count")
_REVIEWS = "period timestamp_ntz, topic_label string, sentiment_label string, review_count bigint, with_aspects bigint, source string"
_MENTIONS = (
    "period timestamp_ntz, aspect string, sentiment_label string, mention_count bigint, sentiment_sum double, "
    "confidence_sum double, confidence_count bigint, rating_sum double, rating_count bigint, source string"
)


class FactStore:
    """Review and mention facts of any number of sources below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def put(self, source: str, reviews: DataFrame, mentions: DataFrame | None = None) -> None:
        """Store one source's facts; a repeated call with the same source changes nothing else.

        ``source`` is the data's signature, so that equal data has one part.
        """
        facts = {"reviews": review_facts(reviews, "D")}
        if mentions is None and "detected_aspects" in reviews.columns:
            mentions = explode_mentions(reviews)
        if mentions is not None:
            facts["mentions"] = mention_facts(mentions, "D")
        for kind, rows in facts.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/source={source}")

    def _read(self, kind: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(f"{self.folder}/{kind}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def sources(self) -> DataFrame:
        """Stored sources with their review counts."""
        return self._read("reviews", _REVIEWS).groupBy("source").agg(F.sum("review_count").alias("review_count"))

    def _merged(self, rows: DataFrame, keys: tuple, sums: tuple, frequency: str | None) -> DataFrame:
        period = F.lit(None).cast("timestamp_ntz") if frequency is None else period_of(F.col("period"), frequency)
        others = [key for key in keys if key != "period"]
        return rows.groupBy(period.alias("period"), *others).agg(*(F.sum(name).alias(name) for name in sums))

    def review_facts(self, frequency: str | None) -> DataFrame:
        """As :func:`trends.review_facts` over all sources."""
        return self._merged(self._read("reviews", _REVIEWS), REVIEW_KEYS, REVIEW_SUMS, frequency)

    def mention_facts(self, frequency: str | None) -> DataFrame:
        """As :func:`trends.mention_facts` over all sources."""
        return self._merged(self._read("mentions", _MENTIONS), MENTION_KEYS, MENTION_SUMS, frequency)
