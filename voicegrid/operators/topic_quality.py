"""Topic quality: coherence, diversity, coverage, stability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid.operators.tfidf import Vocabulary
from voicegrid.operators.topics import TopicFit, refit
from voicegrid.session import compute_once, cut_lineage, rows_frame

Keywords = Mapping[int, Sequence[str]]


def _present_terms(texts: DataFrame, tokens: Column, terms: Sequence[str]) -> DataFrame:
    """Which of the given terms each text holds, as one array column ``present``.

    Terms are runs of tokens, so a padded substring test finds single words
    and pairs alike, and no pair has to be built.
    """
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    prepared = texts.select(F.explode_outer(F.array(joined)).alias("_text"))
    held = [F.when(F.col("_text").contains(f" {term} "), F.lit(term)).otherwise(F.lit("")) for term in terms]
    return compute_once(prepared, "present", F.array_remove(F.array(*held), "")).select("present")


def keyword_presence(texts: DataFrame, tokens: Column, keywords: Keywords, *, top_n: int = 5) -> DataFrame:
    """Documents per keyword and per keyword pair of one topic.

    The pairs wanted are known beforehand (ten per topic for five keywords),
    so every document emits only those it contains and nothing is joined.
    """
    wanted = _wanted(keywords, top_n)
    terms = sorted({word for _, left, right in wanted for word in (left, right)})
    return _count_pairs(_present_terms(texts, tokens, terms), wanted, {term: term for term in terms})


def vector_presence(vectors: DataFrame, vocabulary: Vocabulary, keywords: Keywords, *, top_n: int = 5) -> DataFrame:
    """The same counts from stored vectors: a text holds a vocabulary term when its vector has the term's number."""
    wanted = _wanted(keywords, top_n)
    numbers = {term: number for number, term in enumerate(vocabulary.terms)}
    listed = sorted({numbers[word] for _, left, right in wanted for word in (left, right)})
    held = F.array_intersect("indices", F.array(*map(F.lit, listed)).cast("array<int>"))
    return _count_pairs(compute_once(vectors.select("indices"), "present", held).select("present"), wanted, numbers)


def _wanted(keywords: Keywords, top_n: int) -> list[tuple[int, str, str]]:
    """Leading keywords of each topic, as pairs with themselves and with each other."""
    wanted = []
    for topic, words in keywords.items():
        top = list(words[:top_n])
        wanted += [(topic, word, word) for word in top] + [(topic, a, b) for a, b in combinations(top, 2)]
    return wanted


def _count_pairs(held: DataFrame, wanted: list[tuple[int, str, str]], values: Mapping[str, str | int]) -> DataFrame:
    """Rows of ``held`` whose ``present`` has both values of a wanted pair."""
    present = F.col("present")
    hits = [
        F.when(
            F.array_contains(present, values[a]) & F.array_contains(present, values[b]),
            F.struct(F.lit(t).alias("topic_id"), F.lit(a).alias("left_term"), F.lit(b).alias("right_term")),
        )
        for t, a, b in wanted
    ]
    rows = held.select(F.explode_outer(F.array_compact(F.array(*hits))).alias("pair"))
    return (
        rows.where(F.col("pair").isNotNull())
        .groupBy("pair.topic_id", "pair.left_term", "pair.right_term")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


def npmi_pairs(presence: DataFrame, keywords: Keywords, documents: int, *, top_n: int = 5) -> DataFrame:
    """Normalized pointwise mutual information of every keyword pair.

    Pairs with an absent keyword are left out; pairs never seen together get
    -1, pairs seen in every document get 1.
    """
    spark = presence.sparkSession
    # At most one row per keyword and pair; stored, as three joins read it.
    presence = cut_lineage(presence.repartition(1))
    rows = [(t, a, b) for t, words in keywords.items() for a, b in combinations(list(words[:top_n]), 2)]
    wanted = rows_frame(spark, rows, "topic_id int, left_term string, right_term string")
    single = presence.where(F.col("left_term") == F.col("right_term")).select(
        "topic_id", F.col("left_term").alias("term"), "documents"
    )
    both = presence.where(F.col("left_term") != F.col("right_term"))
    counted = (
        wanted.join(single.select("topic_id", F.col("term").alias("left_term"), F.col("documents").alias("n_left")), ["topic_id", "left_term"])
        .join(single.select("topic_id", F.col("term").alias("right_term"), F.col("documents").alias("n_right")), ["topic_id", "right_term"])
        .join(both.withColumnRenamed("documents", "n_both"), ["topic_id", "left_term", "right_term"], "left")
    )
    n = F.lit(float(documents))
    together = F.col("n_both") / n
    pmi = F.log(together / ((F.col("n_left") / n) * (F.col("n_right") / n)))
    npmi = (
        F.when(F.col("n_both").isNull(), F.lit(-1.0))
        .when(together >= 1, F.lit(1.0))
        .otherwise(pmi / -F.log(together))
    )
    return counted.select("topic_id", "left_term", "right_term", npmi.alias("npmi"))


def topic_coherence(texts: DataFrame, tokens: Column, keywords: Keywords, documents: int, *, top_n: int = 5) -> DataFrame:
    """Mean pair coherence, one row; 0 for fewer than two documents or no usable pair."""
    if documents < 2:
        return rows_frame(texts.sparkSession, [(0.0,)], "topic_coherence_npmi double")
    return mean_npmi(keyword_presence(texts, tokens, keywords, top_n=top_n), keywords, documents, top_n=top_n)


def mean_npmi(presence: DataFrame, keywords: Keywords, documents: int, *, top_n: int = 5) -> DataFrame:
    """Mean pair coherence of counted keywords, one row; 0 for fewer than two documents or no usable pair."""
    if documents < 2:
        return rows_frame(presence.sparkSession, [(0.0,)], "topic_coherence_npmi double")
    pairs = npmi_pairs(presence, keywords, documents, top_n=top_n)
    return pairs.agg(F.coalesce(F.avg("npmi"), F.lit(0.0)).alias("topic_coherence_npmi"))


def topic_diversity(keywords: DataFrame, top_n: int = 8) -> DataFrame:
    """Distinct share of the top terms in a (topic_id, rank, term) table, one row."""
    top = keywords.where(F.col("rank") <= top_n)
    share = F.count_distinct("term") / F.nullif(F.count("term"), F.lit(0))
    return top.agg(F.coalesce(share, F.lit(0.0)).alias("topic_diversity"))


def topic_coverage(vectors: DataFrame) -> DataFrame:
    """Share of documents with at least one known term, one row."""
    covered = (F.size("indices") > 0).cast("double")
    return vectors.agg(F.coalesce(F.avg(covered), F.lit(0.0)).alias("topic_coverage"))


def term_coverage(texts: DataFrame, tokens: Column, terms: Sequence[str]) -> DataFrame:
    """Share of texts that contain at least one of the given terms, one row."""
    covered = (F.size("present") > 0).cast("double")
    held = _present_terms(texts, tokens, terms)
    return held.agg(F.coalesce(F.avg(covered), F.lit(0.0)).alias("topic_coverage"))


def keyword_similarity(left: Keywords, right: Keywords, *, top_n: int = 8) -> float:
    """Mean overlap of topics matched one to one, best remaining partner first."""
    unmatched = {topic: frozenset(words[:top_n]) for topic, words in right.items()}
    overlaps = []
    for words in left.values():
        if not unmatched:
            break
        mine = frozenset(words[:top_n])
        scores = {t: len(mine & other) / len(mine | other) if mine | other else 1.0 for t, other in unmatched.items()}
        best = max(scores, key=lambda topic: (scores[topic], -topic))
        overlaps.append(scores[best])
        del unmatched[best]
    return sum(overlaps) / len(overlaps) if overlaps else 0.0


def topic_stability(fit: TopicFit, runs: int = 3) -> float | None:
    """Mean keyword similarity to refits under other seeds, on the stored vectors."""
    if runs <= 1:
        return None
    config = fit.model.config
    seeds = [config.seed + step for step in range(1, runs)]
    others = refit(fit.vectors, fit.documents, fit.model.vocabulary, config, seeds)
    scores = [keyword_similarity(fit.model.keywords, other.keywords, top_n=config.top_n_words) for other in others]
    return sum(scores) / len(scores)


def evaluate_topics(fit: TopicFit, *, stability_runs: int = 3) -> dict[str, object]:
    """Quality measures of a fitted model on the texts it was fitted on."""
    model = fit.model
    spark = fit.texts.sparkSession
    words = [(t, i + 1, word) for t, listed in model.keywords.items() for i, word in enumerate(listed)]
    keywords = rows_frame(spark, words, "topic_id int, rank int, term string")
    coherence = mean_npmi(vector_presence(fit.vectors, model.vocabulary, model.keywords), model.keywords, fit.documents)
    coverage = topic_coverage(fit.vectors).first()[0]
    return {
        "number_of_topics": model.config.n_topics,
        "modeled_reviews": fit.documents,
        "average_topic_size": fit.documents / model.config.n_topics,
        "topic_coherence_npmi": coherence.first()[0],
        "topic_diversity": topic_diversity(keywords, model.config.top_n_words).first()[0],
        "topic_coverage": coverage,
        "topic_stability": topic_stability(fit, stability_runs),
        "all_reviews_assigned": coverage == 1.0,
        "manual_interpretability_review_required": True,
    }
