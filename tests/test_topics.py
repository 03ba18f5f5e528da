"""TF-IDF, factorization, topics and their quality."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voicegrid.operators import nmf, tfidf, topic_quality, topics
from voicegrid.schema import TopicConfig, TopicError
from tests.conftest import THEMES

CONFIG = TopicConfig(n_topics=3, max_features=300)


@pytest.fixture(scope="module")
def modelled(themed_reviews):
    fit, rows = topics.model_topics(themed_reviews, CONFIG)
    return fit, rows.cache()


def test_settings():
    for bad in ({"n_topics": 1}, {"max_features": 2}, {"min_df": 0}, {"max_df": 0}, {"top_n_words": 0}, {"max_iter": 0}):
        with pytest.raises(ValueError, match="must be"):
            TopicConfig(**bad)
    assert topics.document_limits(TopicConfig(), 10) == (1, 0.95)
    assert topics.document_limits(TopicConfig(min_df=50), 30) == (50, 1.0)
    assert topics.document_limits(TopicConfig(small_corpus=0), 10) == (2, 0.95)
    assert topics.document_limits(TopicConfig(min_df=50, small_corpus=0), 30) == (50, 0.95)


def test_corpus(spark):
    frame = spark.createDataFrame([("1", "Good!"), ("2", "good"), ("3", "..."), ("4", None), ("5", "other")], "review_id string, clean_text string")
    corpus = topics.topic_corpus(frame)
    assert {(r.review_id, r.topic_text) for r in corpus.collect()} == {("1", "good"), ("5", "other")}
    assert tuple(topics.corpus_statistics(frame).first()) == (5, 2, 2, 1)


def test_weights_by_hand(spark):
    texts = ["red red blue", "blue green the", "green"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    tokens = tfidf.tokens_of(F.col("t"), ("the",))
    vocabulary = tfidf.fit_vocabulary(frame, tokens, 3, max_features=100)
    lists = [["red", "red", "blue", "red red", "red blue"], ["blue", "green", "blue green"], ["green"]]
    assert vocabulary.terms == tuple(sorted({t for words in lists for t in words}))
    found = {(r.i, r.term): r.weight for r in tfidf.long_weights(tfidf.sparse_vectors(frame, tokens, vocabulary), vocabulary, "i").collect()}
    for i, words in enumerate(lists):
        raw = {t: (1 + math.log(words.count(t))) * (math.log(4 / (1 + sum(t in w for w in lists))) + 1) for t in set(words)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for term, value in raw.items():
            assert found.pop((i, term)) == pytest.approx(value / norm)
    assert not found


def test_term_selection(spark):
    frame = spark.createDataFrame([("aa bb",), ("aa cc",), ("aa bb",), ("dd dd dd",)], "t string")
    counts = tfidf.term_statistics(frame, tfidf.tokens_of(F.col("t")), 1)
    rows = [tuple(r)[:3] for r in tfidf.select_terms(counts, 4, max_features=2).collect()]
    assert rows == [("aa", 3, 3), ("dd", 3, 1)]
    assert [r.term for r in tfidf.select_terms(counts, 4, max_features=9, min_df=2, max_df=0.5).collect()] == ["bb"]


def test_long_texts_are_weighed_in_steps(spark, monkeypatch):
    frame = spark.createDataFrame([(i, " ".join(f"w{j % 7}" for j in range(i, i + 40))) for i in range(20)], "i int, t string").coalesce(1)
    tokens = tfidf.tokens_of(F.col("t"))
    vocabulary = tfidf.fit_vocabulary(frame, tokens, 20, max_features=50)
    whole = {r.i: r.vector for r in tfidf.sparse_vectors(frame, tokens, vocabulary).collect()}
    monkeypatch.setattr(tfidf, "TOKENS_PER_STEP", 30)
    assert {r.i: r.vector for r in tfidf.sparse_vectors(frame, tokens, vocabulary).collect()} == whole


def stored(spark, matrix, parts):
    rows = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for r in matrix]
    return spark.createDataFrame(rows, "indices array<int>, weights array<double>").repartition(parts)


def test_factorization_error_matches_dense(spark):
    rng = np.random.default_rng(3)
    matrix = rng.random((60, 3)) @ rng.random((3, 12)) * (rng.random((60, 12)) > 0.3)
    found = nmf.factorize(stored(spark, matrix, 4), documents=60, terms=12, topics=3, seed=1, max_iter=60, tol=1e-6)
    row, term = np.nonzero(matrix)
    w = nmf.solve_rows(row, term, matrix[row, term], 60, found.h)
    assert (found.h >= 0).all() and (w >= 0).all()
    assert np.linalg.norm(matrix - w @ found.h) == pytest.approx(found.error, rel=1e-3)
    best = np.linalg.norm(matrix - np.linalg.svd(matrix)[0][:, :3] @ np.diag(np.linalg.svd(matrix)[1][:3]) @ np.linalg.svd(matrix)[2][:3])
    assert best <= found.error <= 1.25 * best


def test_many_tasks_are_summed_on_executors(spark, monkeypatch):
    matrix = np.random.default_rng(5).random((40, 8))
    table = stored(spark, matrix, 9)
    size = lambda row, term, weight, count: np.bincount(term, weight, minlength=8)
    direct = nmf._distributed_sum(table, 9, 8, size)
    monkeypatch.setattr(nmf, "DIRECT_RESULTS", 2)
    assert nmf._distributed_sum(table, 9, 8, size) == pytest.approx(direct)
    assert direct == pytest.approx(matrix.sum(axis=0))


def test_planted_themes(modelled):
    fit, rows = modelled
    found = {(r["product"], r.topic_id) for r in rows.collect()}
    assert len(found) == 3 and len({topic for _, topic in found}) == 3
    for theme, topic in found:
        assert set(fit.model.keywords[topic][:3]) <= {w for w in THEMES[theme].split()} | {
            f"{a} {b}" for a, b in zip(THEMES[theme].split(), THEMES[theme].split()[1:])
        }
    assert rows.where("topic_strength <= 0 or topic_confidence <= 0 or topic_confidence > 1").isEmpty()
    assert topics.assignment_coverage(rows).first()[0] == 1.0


def test_repeatable(themed_reviews, modelled):
    again = topics.fit_topics(themed_reviews, CONFIG).model
    assert np.allclose(again.h, modelled[0].model.h)


def test_labels():
    assert topics.topic_label(["customer service", "service", "support", "agent"]) == "Customer Service / Support"
    assert topics.topic_label([]) == "Unlabelled Topic"
    assert topics.topic_label(["app", "app crash", "App"]) == "App"


def test_summaries(spark, modelled):
    fit, rows = modelled
    summary = topics.topic_summary(rows, fit.model.keyword_table(spark)).collect()
    assert [r.review_count for r in summary] == [10, 10, 10] and [r.topic_id for r in summary] == [0, 1, 2]
    assert {r.average_sentiment for r in summary} == {1.0, 0.0, -1.0} and all(r.percentage == pytest.approx(1 / 3) for r in summary)
    best = {r.topic_id: r.representative_review_ids for r in topics.topic_representatives(rows).collect()}
    strongest = rows.where("topic_id = 0").orderBy(F.desc("topic_strength"), "review_id").first().review_id
    assert len(best[0]) == 5 and best[0][0] == strongest
    label = fit.model.labels[0]
    assert [r.review_id for r in topics.topic_examples(rows, label, best[0]).collect()] == best[0]
    assert topics.topic_examples(rows, label).count() == 5
    longest = fit.model.factor_table(spark)
    assert [r.term for r in topics.topic_keywords(longest, 8).where("topic_id = 1").orderBy("rank").collect()] == fit.model.keywords[1]


def test_unknown_text(spark, modelled):
    strange = spark.createDataFrame([("u", "qqqq zzzz")], "review_id string, clean_text string")
    loose = modelled[0].model.assign(strange, strict=False).first()
    assert (loose.topic_id, loose.topic_label) == (-1, None)
    with pytest.raises(PySparkException, match="no term known"):
        modelled[0].model.assign(strange).collect()


def test_quality(modelled):
    fit, _ = modelled
    found = topic_quality.evaluate_topics(fit, stability_runs=2)
    assert found["modeled_reviews"] == 30 and found["all_reviews_assigned"] and found["topic_coverage"] == 1.0
    assert -1 <= found["topic_coherence_npmi"] <= 1 and 0 < found["topic_diversity"] <= 1
    assert found["topic_stability"] > 0.5
    assert topic_quality.topic_stability(fit, 1) is None


def test_npmi_by_hand(spark):
    frame = spark.createDataFrame([("aa bb",), ("aa cc",), ("bb",), ("aa bb cc",)], "t string")
    words = {0: ["aa", "bb", "cc", "zz"]}
    presence = topic_quality.keyword_presence(frame, tfidf.tokens_of(F.col("t")), words)
    found = {(r.left_term, r.right_term): r.npmi for r in topic_quality.npmi_pairs(presence, words, 4).collect()}
    value = lambda both, a, b: math.log((both / 4) / (a / 4 * b / 4)) / -math.log(both / 4)
    assert found == {
        ("aa", "bb"): pytest.approx(value(2, 3, 3)), ("aa", "cc"): pytest.approx(value(2, 3, 2)), ("bb", "cc"): pytest.approx(value(1, 3, 2)),
    }
    never = spark.createDataFrame([("aa",), ("bb",)], "t string")
    tokens = tfidf.tokens_of(F.col("t"))
    assert topic_quality.topic_coherence(never, tokens, {0: ["aa", "bb"]}, 2).first()[0] == -1.0
    assert topic_quality.topic_coherence(never, tokens, {0: ["aa", "bb"]}, 1).first()[0] == 0.0
    always = spark.createDataFrame([("aa bb",), ("aa bb",)], "t string")
    assert topic_quality.topic_coherence(always, tokens, {0: ["aa", "bb"]}, 2).first()[0] == 1.0


def test_similarity():
    left = {0: ["a", "b"], 1: ["c", "d"]}
    assert topic_quality.keyword_similarity(left, {5: ["c", "d"], 6: ["a", "x"]}) == pytest.approx((1 / 3 + 1) / 2)
    assert topic_quality.keyword_similarity(left, {}) == 0.0


def test_save_and_load(spark, modelled, themed_reviews, tmp_path):
    model = modelled[0].model
    model.save(spark, str(tmp_path / "t"))
    again = topics.TopicModel.load(spark, str(tmp_path / "t"))
    assert again.labels == model.labels and again.config == model.config and again.metadata == model.metadata
    assert model.assign(themed_reviews).exceptAll(again.assign(themed_reviews)).isEmpty()


def test_seeds_share_passes(spark):
    rng = np.random.default_rng(5)
    vectors = stored(spark, np.maximum(rng.random((60, 12)) - 0.4, 0), 4)
    settings = dict(documents=60, terms=12, topics=3, max_iter=40, tol=1e-5)
    together, passes = nmf.factorize_many(vectors, seeds=[1, 2, 3], **settings)
    alone = [nmf.factorize_many(vectors, seeds=[seed], **settings) for seed in (1, 2, 3)]
    for one, ((other,), _) in zip(together, alone):
        assert np.allclose(one.h, other.h) and one.passes == other.passes and one.error == pytest.approx(other.error)
    assert passes == max(n for _, n in alone) < sum(n for _, n in alone)


def test_weights_in_the_jvm_solve_the_rows(spark, themed_reviews):
    fit = topics.fit_topics(themed_reviews, CONFIG)
    model = fit.model
    rows = model.with_weights(fit.texts, "topic_text").collect()
    terms = pa.array(model.vocabulary.terms, type=pa.string())
    words = {r["topic_text"]: r["words"] for r in fit.texts.select("topic_text", model.tokens("topic_text").alias("words")).collect()}
    for row in rows:
        (part,) = tfidf.weigh(pa.array([words[row["topic_text"]]], pa.list_(pa.string())), model.vocabulary, terms)
        assert np.allclose(row["_weights"], nmf.solve_rows(part.row, part.term, part.weight, 1, model.h)[0], atol=1e-7)
    unknown = spark.createDataFrame([("zzz qqq",), ("",)], "topic_text string")
    assert [r["_weights"] for r in model.with_weights(unknown, "topic_text").collect()] == [None, None]


def test_fit_guards(spark):
    few = spark.createDataFrame([("one",), ("two",)], "clean_text string")
    with pytest.raises(TopicError, match="at least 3"):
        topics.fit_topics(few, CONFIG)
    with pytest.raises(TopicError, match="No usable"):
        topics.fit_topics(few.where("false"), CONFIG)
    with pytest.raises(TopicError, match="usable terms"):
        topics.fit_topics(spark.createDataFrame([("one a",), ("one b",), ("one c",)], "clean_text string"), CONFIG)
    with pytest.raises(TopicError, match="clean_text"):
        topics.fit_topics(spark.range(3), CONFIG)


def test_term_tables_equal_vectors(spark, themed_reviews):
    """Weights of a term table of any size are those of a fitted vocabulary."""
    fit = topics.fit_topics(themed_reviews, TopicConfig(n_topics=3, max_features=100_000))
    vocabulary, tokens = fit.model.vocabulary, fit.model.tokens("topic_text")
    chosen = tfidf.select_terms(tfidf.term_statistics(fit.texts, tokens, 2), fit.documents, max_features=None, min_df=2, max_df=0.95)
    numbered = tfidf.number_terms(chosen).cache()
    assert [r.term for r in numbered.orderBy("number").collect()] == list(vocabulary.terms)
    weights = tfidf.term_weights(fit.texts, "topic_text", tokens, chosen)
    found = {r.topic_text: r.vector for r in tfidf.table_vectors(weights, numbered, "topic_text").collect()}
    for row in tfidf.sparse_vectors(fit.texts, tokens, vocabulary).collect():
        assert found[row.topic_text].indices == row.vector.indices and np.allclose(found[row.topic_text].weights, row.vector.weights)
