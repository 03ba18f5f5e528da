"""Topic model: corpus, TF-IDF + NMF fit, assignment, labels, summaries."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import arrow_udf

from voicegrid.functions.labels import canonical_label, dominant_label, label_score, match_label
from voicegrid.functions.text import clean_topic_text
from voicegrid.operators.canonical import keep_first, with_position
from voicegrid.operators.nmf import factorize_many, solve_rows
from voicegrid.operators.tfidf import (
    Vocabulary,
    english_stop_words,
    fit_vocabulary,
    load_vocabulary,
    save_vocabulary,
    sparse_vectors,
    tokens_of,
    weigh,
)
from voicegrid.schema import TopicConfig, TopicError, pick_text_column, require_columns
from voicegrid.session import compact_table, compute_once, cut_lineage, join_small, rows_frame


# ------------------------------------------------------------------ corpus --
def topic_corpus(
    df: DataFrame, *, text_column: str | None = None, order_by: str | Sequence[str] | None = "review_id"
) -> DataFrame:
    """First row of every distinct non-empty cleaned text, with ``topic_text`` added."""
    source = text_column or pick_text_column(df, TopicError)
    require_columns(df, [source], TopicError, "Topic modelling")
    placed = compute_once(with_position(df, order_by), "topic_text", clean_topic_text(source))
    filled = placed.where(F.col("topic_text") != "")
    return keep_first(filled, F.unhex(F.sha2("topic_text", 256)), [*df.columns, "topic_text"])


def stored_corpus(
    df: DataFrame, columns: Sequence[str], *, text_column: str | None = None, order_by: str | Sequence[str] | None = "review_id"
) -> DataFrame:
    """The same corpus with ``columns`` and ``topic_text``, stored without a shuffle of texts.

    All rows are written as they come.  Digests then tell each text's first
    row, and one bit for each stored row says whether it stays.
    """
    source = text_column or pick_text_column(df, TopicError)
    require_columns(df, [source], TopicError, "Topic modelling")
    columns = list(dict.fromkeys(columns))
    placed = df.withColumn("_pos", F.monotonically_increasing_id()) if order_by is None else with_position(df, order_by)
    cleaned = compute_once(placed.select(*dict.fromkeys([*columns, "_pos", source])), "topic_text", clean_topic_text(source))
    texts = [name for name in ("review_text", "clean_text", source) if name in columns]
    stored = compact_table(
        cleaned.where(F.col("topic_text") != "").select(*dict.fromkeys([*columns, "topic_text", "_pos"])),
        "corpus", beside=[*texts, "topic_text"], place=("_file", "_row"),
    )
    order = F.struct(F.col("_pos").isNull(), "_pos", "_file", "_row")
    first = stored.groupBy(F.unhex(F.sha2("topic_text", 256))).agg(F.min_by(F.struct("_file", "_row"), order).alias("first"))
    number, group = F.col("_row") + 1, F.bitmap_bucket_number(F.col("_row") + 1).alias("_group")
    bits = cut_lineage(
        first.select("first.*").groupBy("_file", group).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))
    )
    bit = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = join_small(stored.withColumn("_group", F.bitmap_bucket_number(number)), bits, ["_file", "_group"], "inner", rows=bits.count(), limit=20_000)
    return met.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*dict.fromkeys([*columns, "topic_text"]))


def corpus_statistics(df: DataFrame, *, text_column: str | None = None) -> DataFrame:
    """Source, modelled, blank and duplicate row counts, one row."""
    source = text_column or pick_text_column(df, TopicError)
    cleaned = compute_once(df.select(source), "topic_text", clean_topic_text(source))
    key = F.when(F.col("topic_text") != "", F.unhex(F.sha2("topic_text", 256)))
    per_key = cleaned.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    filled = F.col("key").isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("source_rows"),
        F.count_if(filled).alias("modeled_rows"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("empty_rows_removed"),
        F.coalesce(F.sum(F.when(filled, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows_removed"),
    )


# ------------------------------------------------------------------ labels --
def topic_label(keywords: Sequence[str], max_terms: int = 2) -> str:
    """Title-cased leading keywords, leaving out those that overlap a chosen one."""
    if not keywords:
        return "Unlabelled Topic"
    chosen: list[str] = []
    for term in filter(str.strip, keywords):
        words = set(term.lower().split())
        clash = any(
            term.strip().lower() == other.lower()
            or term.strip().lower() in other.lower().split()
            or other.lower() in words
            for other in chosen
        )
        if not clash and len(chosen) < max_terms:
            chosen.append(term)
    return " / ".join(term.title() for term in chosen or keywords[:max_terms])


def topic_keywords(h: DataFrame, top_n: int = 8) -> DataFrame:
    """Heaviest terms per topic of a long (topic_id, term, weight) table."""
    heaviest = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term")
    ranked = h.withColumn("rank", F.row_number().over(heaviest)).where(F.col("rank") <= top_n)
    return ranked.select("topic_id", "rank", "term", "weight")


# ------------------------------------------------------------------- model --
@dataclass(frozen=True)
class TopicModel:
    """Fitted vocabulary, factors and topic names."""

    vocabulary: Vocabulary
    h: np.ndarray
    config: TopicConfig = TopicConfig()
    metadata: dict[str, object] = field(default_factory=dict)

    @property
    def keywords(self) -> dict[int, list[str]]:
        """Heaviest terms per topic; ties alphabetical."""
        found = {}
        for topic, weights in enumerate(self.h):
            order = np.lexsort((np.arange(len(weights)), -weights))[: self.config.top_n_words]
            found[topic] = [self.vocabulary.terms[i] for i in order]
        return found

    @property
    def labels(self) -> dict[int, str]:
        """Readable name per topic."""
        return {topic: topic_label(words) for topic, words in self.keywords.items()}

    def tokens(self, text: str | Column) -> Column:
        """Vectorizer tokens of a cleaned text."""
        return topic_tokens(text, self.config)

    def with_weights(self, df: DataFrame, cleaned_text: str | Column, name: str = "_weights") -> DataFrame:
        """Add the topic weights of a cleaned text; null when it has no known term.

        The JVM cuts the text; tasks weigh the known terms of many texts at a
        time and solve all rows of W together, without a shuffle.
        """
        vocabulary, h = self.vocabulary, self.h

        @arrow_udf("array<double>")
        def solve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            terms = pa.array(vocabulary.terms, type=pa.string())
            for batch in batches:
                parts = list(weigh(batch, vocabulary, terms))
                solved = [solve_rows(p.row, p.term, p.weight, p.count, h, settled=0.0) for p in parts]
                known = np.concatenate([np.bincount(p.row, minlength=p.count) > 0 for p in parts] or [np.zeros(0, bool)])
                values = np.concatenate([w.ravel() for w in solved] or [np.zeros(0)])
                ends = np.arange(len(known) + 1, dtype=np.int32) * len(h)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~known))

        return df.withColumn(name, solve.asNondeterministic()(self.tokens(cleaned_text)))

    def assign(self, df: DataFrame, *, text_column: str | None = None, strict: bool = True) -> DataFrame:
        """Add topic id, label, strength and confidence (share of the row's weight).

        A text without known terms stops the job, or gets topic -1 when
        ``strict`` is off.
        """
        source = F.col("topic_text") if "topic_text" in df.columns else clean_topic_text(
            text_column or pick_text_column(df, TopicError)
        )
        weights = F.col("_weights")
        if strict:
            message = "A review contains no term known to the fitted topic model."
            weights = F.coalesce(weights, F.raise_error(message).cast("array<double>"))
        scored = self.with_weights(df, source).withColumn("_weights", weights)
        strength = F.array_max("_weights")
        topic = F.coalesce(F.array_position("_weights", strength) - 1, F.lit(-1)).cast("int")
        total = F.aggregate("_weights", F.lit(0.0), lambda total, value: total + value)
        names = F.create_map(*(F.lit(item) for pair in self.labels.items() for item in pair))
        kept = [name for name in df.columns if name not in ("topic_text", "topic_id", "topic_label")]
        return scored.select(
            *kept,
            topic.alias("topic_id"),
            strength.alias("topic_strength"),
            F.coalesce(strength / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("topic_confidence"),
        ).withColumn("topic_label", names[F.col("topic_id")])

    def keyword_table(self, spark: SparkSession) -> DataFrame:
        """(topic_id, topic_label, top_keywords) rows."""
        rows = [(t, self.labels[t], ", ".join(words)) for t, words in self.keywords.items()]
        return rows_frame(spark, rows, "topic_id int, topic_label string, top_keywords string")

    def factor_table(self, spark: SparkSession) -> DataFrame:
        """Long (topic_id, term, weight) form of H."""
        rows = [
            (topic, term, float(weight))
            for topic, weights in enumerate(self.h)
            for term, weight in zip(self.vocabulary.terms, weights)
        ]
        return rows_frame(spark, rows, "topic_id int, term string, weight double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Vocabulary, factors and metadata below ``path``."""
        save_vocabulary(self.vocabulary, spark, f"{path}/vocabulary")
        rows = [(topic, [float(v) for v in weights]) for topic, weights in enumerate(self.h)]
        spark.createDataFrame(rows, "topic_id int, weights array<double>").write.parquet(f"{path}/factors")
        meta = {
            **self.metadata,
            "documents": self.vocabulary.documents,
            "config": asdict(self.config),
            "topic_keywords": {str(k): v for k, v in self.keywords.items()},
            "topic_labels": {str(k): v for k, v in self.labels.items()},
        }
        spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        """Inverse of :meth:`save`."""
        meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        settings = meta.pop("config")
        if settings.get("stop_words") is not None:
            settings["stop_words"] = tuple(settings["stop_words"])
        config = TopicConfig(**settings)
        vocabulary = load_vocabulary(spark, f"{path}/vocabulary", meta.pop("documents"), config.ngram_max)
        rows = spark.read.parquet(f"{path}/factors").orderBy("topic_id").collect()
        meta = {k: v for k, v in meta.items() if k not in ("topic_keywords", "topic_labels")}
        return cls(vocabulary, np.array([row["weights"] for row in rows], dtype=float), config, meta)


def topic_tokens(text: str | Column, config: TopicConfig) -> Column:
    """Vectorizer tokens of a cleaned text under a configuration."""
    stop = english_stop_words() if config.stop_words is None else config.stop_words
    return tokens_of(F.col(text) if isinstance(text, str) else text, stop)


def document_limits(config: TopicConfig, documents: int) -> tuple[int, float]:
    """Effective ``min_df`` and ``max_df``.

    Below ``config.small_corpus`` texts rare terms stay, and a ``max_df`` that
    ``min_df`` contradicts is lifted; with 0 the limits hold as they stand.
    """
    low = config.min_df if documents >= config.small_corpus else 1
    lifted = config.small_corpus > 0 and int(config.max_df * documents) < low
    return low, 1.0 if lifted else config.max_df


@dataclass(frozen=True)
class TopicFit:
    """A model with the stored distinct texts and vectors it was fitted on."""

    model: TopicModel
    texts: DataFrame
    vectors: DataFrame
    documents: int


def fit_topics(
    df: DataFrame, config: TopicConfig = TopicConfig(), *, text_column: str | None = None
) -> TopicFit:
    """Fit on the distinct cleaned texts of ``df``.

    The distinct texts and then their vectors are stored in shared space, as
    later passes read them many times; wide review rows take no part.
    """
    texts = stored_corpus(df, [], text_column=text_column, order_by=None)
    return _fit_texts(compact_table(texts, "topic-texts"), config)


def _fit_texts(texts: DataFrame, config: TopicConfig) -> TopicFit:
    """Fit on stored distinct cleaned texts."""
    documents = texts.count()
    if documents == 0:
        raise TopicError("No usable text is left after cleaning.")
    if documents < config.n_topics:
        raise TopicError(f"Need at least {config.n_topics} usable unique reviews; received {documents}.")
    tokens = topic_tokens("topic_text", config)
    low, high = document_limits(config, documents)
    vocabulary = fit_vocabulary(
        texts, tokens, documents, max_features=config.max_features, ngram_max=config.ngram_max, min_df=low, max_df=high
    )
    if len(vocabulary) < config.n_topics:
        raise TopicError(f"Only {len(vocabulary)} usable terms remain for {config.n_topics} topics.")
    vectors = compact_table(
        sparse_vectors(texts, tokens, vocabulary).select("vector.indices", "vector.weights"), "topic-vectors"
    )
    return TopicFit(refit(vectors, documents, vocabulary, config)[0], texts, vectors, documents)


def refit(
    vectors: DataFrame, documents: int, vocabulary: Vocabulary, config: TopicConfig, seeds: Sequence[int] | None = None
) -> list[TopicModel]:
    """Factorize stored vectors under a configuration and several seeds, by default its own, in shared passes."""
    seeds = [config.seed] if seeds is None else list(seeds)
    found, _ = factorize_many(
        vectors,
        documents=documents,
        terms=len(vocabulary),
        topics=config.n_topics,
        seeds=seeds,
        max_iter=config.max_iter,
        tol=config.tol,
    )
    models = []
    for seed, factors in zip(seeds, found):
        meta = {
            "document_count": documents,
            "feature_count": len(vocabulary),
            "reconstruction_error": factors.error,
            "passes": factors.passes,
        }
        models.append(TopicModel(vocabulary, factors.h, replace(config, seed=seed), meta))
    return models


def model_topics(
    df: DataFrame,
    config: TopicConfig = TopicConfig(),
    *,
    text_column: str | None = None,
    order_by: str | Sequence[str] | None = "review_id",
    strict: bool = True,
) -> tuple[TopicFit, DataFrame]:
    """Fit and return the corpus rows with their topics.

    The corpus is stored: its texts are the distinct ones that the model is
    fitted on, so they are cleaned and compared once.
    """
    corpus = stored_corpus(df, df.columns, text_column=text_column, order_by=order_by)
    fit = _fit_texts(corpus.select("topic_text"), config)
    return fit, fit.model.assign(corpus, strict=strict)


# --------------------------------------------------------------- summaries --
def _label_counts() -> dict[str, Column]:
    label = match_label(F.col("sentiment_label"))
    return {name: F.count_if(label == name) for name in ("Positive", "Neutral", "Negative")}


def topic_summary(df: DataFrame, keywords: DataFrame) -> DataFrame:
    """Size, share and sentiment per topic with its keywords; empty topics are absent.

    ``keywords`` has ``topic_id``, ``topic_label`` and ``top_keywords``; it is
    bounded by the topic count.
    """
    has_label = "sentiment_label" in df.columns
    counts = _label_counts() if has_label else {}
    grouped = df.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("review_count"),
        *(column.alias(name) for name, column in counts.items()),
        *([F.avg(label_score(match_label(F.col("sentiment_label")))).alias("average_sentiment")] if has_label else []),
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    dominant = (
        dominant_label(F.col("Positive"), F.col("Neutral"), F.col("Negative")) if has_label else F.lit(None).cast("string")
    )
    average = F.col("average_sentiment") if has_label else F.lit(None).cast("double")
    return (
        grouped.join(keywords, "topic_id")
        .select(
            "topic_id",
            "topic_label",
            "top_keywords",
            "review_count",
            (F.col("review_count") / total).alias("percentage"),
            average.alias("average_sentiment"),
            F.when(average.isNotNull(), dominant).alias("dominant_sentiment"),
        )
        .orderBy(F.desc("review_count"), "topic_id")
    )


def topic_representatives(df: DataFrame, count: int = 5) -> DataFrame:
    """Strongest review ids per topic, in rank order."""
    strongest = Window.partitionBy("topic_id").orderBy(F.desc("topic_strength"), "review_id")
    ranked = (
        df.select("topic_id", "topic_strength", "review_id")
        .withColumn("rank", F.row_number().over(strongest))
        .where(F.col("rank") <= count)
    )
    pairs = F.array_sort(F.collect_list(F.struct("rank", "review_id")))
    return ranked.groupBy("topic_id").agg(pairs.getField("review_id").alias("representative_review_ids"))


def topic_sentiment_counts(df: DataFrame) -> DataFrame:
    """Reviews per topic and label."""
    return df.groupBy("topic_label", canonical_label(F.col("sentiment_label")).alias("sentiment_label")).agg(
        F.count(F.lit(1)).alias("review_count")
    )


def keyword_table(summary: DataFrame) -> DataFrame:
    """Topic names with their keywords and sizes."""
    return summary.select("topic_id", "topic_label", "top_keywords", "review_count")


def topic_size_extremes(summary: DataFrame) -> DataFrame:
    """Largest and smallest topic, one row; ties go to the lower id."""
    size = F.struct(F.col("review_count"), -F.col("topic_id"))
    return summary.agg(
        F.max_by("topic_label", size).alias("largest_topic"),
        F.max("review_count").alias("largest_count"),
        F.min_by("topic_label", F.struct(F.col("review_count"), F.col("topic_id"))).alias("smallest_topic"),
        F.min("review_count").alias("smallest_count"),
    )


def topic_examples(
    df: DataFrame, label: str, representatives: Mapping[int, Sequence[str]] | Sequence[str] = (), fallback: int = 5
) -> DataFrame:
    """Representative reviews of a topic in stored order, else its first reviews."""
    rows = df.where(F.col("topic_label") == label)
    ids = list(representatives) if not isinstance(representatives, Mapping) else [
        review for listed in representatives.values() for review in listed
    ]
    if not ids:
        return rows.orderBy("review_id").limit(fallback)
    listed = F.array(*map(F.lit, ids))
    return rows.where(F.col("review_id").isin(ids)).orderBy(F.array_position(listed, F.col("review_id")))


def topic_profile(df: DataFrame, label: str) -> DataFrame:
    """Sentiment counts of one topic."""
    return topic_sentiment_counts(df.where(F.col("topic_label") == label))


def assignment_coverage(df: DataFrame) -> DataFrame:
    """Share of rows with a topic, one row."""
    return df.agg(F.coalesce(F.avg((F.col("topic_id") >= 0).cast("double")), F.lit(0.0)).alias("assignment_coverage"))
