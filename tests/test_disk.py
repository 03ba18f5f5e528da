"""What is moved and stored: packed terms, texts that stay in place, tables given up when they are done with."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voicegrid.operators import canonical, sentiment, tfidf, topics
from voicegrid.plans.pipeline import run_pipeline
from voicegrid.schema import ColumnMapping, SentimentConfig, TopicConfig
from voicegrid.session import compact_table, cut_lineage, scratch_dir
from tests.conftest import THEMES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_lists_come_back(spark):
    for values in ([], [0], [1, 255], [256, 0, 3], [2**40, 1]):
        assert tfidf._numbers(tfidf._packed_numbers(np.array(values, np.int64))).tolist() == values
    for words in ([], [""], ["", "é", "a b", "x" * 300]):
        assert tfidf._strings(tfidf._packed_strings(pa.array(words, pa.string()))).to_pylist() == words
    values, known = tfidf._values(tfidf._packed_values(np.array([1.5, 0.0, 7.0, 1.5]), np.array([True, False, True, True])))
    assert values.tolist() == [1.5, 0.0, 7.0, 1.5] and known.tolist() == [True, False, True, True]


def test_weights_move_packed_terms_only(spark):
    """No term travels as a row of its own, and texts without a chosen term have no rows."""
    rows = [(k, f"w{k % 5} w{k % 7} {'zz ' * (k % 3)}") for k in range(60)] + [(60, "unseen"), (61, ""), (62, None)]
    df = cut_lineage(spark.createDataFrame(rows, "k int, t string").repartition(5))
    counts = cut_lineage(tfidf.term_statistics(df, tfidf.tokens_of(F.col("t"))))
    chosen = cut_lineage(tfidf.select_terms(counts, 63, max_features=None, min_df=2))
    weights = tfidf.term_weights(df, "k", tfidf.tokens_of(F.col("t")), chosen)
    assert "Join" not in plan_of(weights) and not re.search(r"hashpartitioning\(term", plan_of(weights))
    found = {(r["k"], r["term"]): r["weight"] for r in weights.collect()}
    vocabulary = tfidf.fit_vocabulary(df, tfidf.tokens_of(F.col("t")), 63, max_features=10_000, min_df=2)
    vectors = tfidf.sparse_vectors(df, tfidf.tokens_of(F.col("t")), vocabulary)
    expected = {(r["k"], r["term"]): r["weight"] for r in tfidf.long_weights(vectors, vocabulary, "k").collect()}
    assert len(expected) > 150 and found == pytest.approx(expected)


def test_stored_corpus_moves_no_text(spark):
    texts = ["Good!", "good", "...", None, "other", "GOOD", "", "third one", "Third  one"] * 3
    rows = [(f"{i % 20:02d}", i, text, text and text * 2) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "review_id string, n int, clean_text string, review_text string").repartition(4)
    for order in ("n", ["review_id", "n"]):
        expected = topics.topic_corpus(df, order_by=order)
        found = topics.stored_corpus(df, df.columns, order_by=order)
        assert found.columns == expected.columns and sorted(found.collect()) == sorted(expected.collect())
        assert not re.search(r"Exchange hashpartitioning\(|SortAggregate", plan_of(found))
    unordered = topics.stored_corpus(df, [], order_by=None)
    assert unordered.columns == ["topic_text"]
    assert sorted(r[0] for r in unordered.collect()) == ["good", "other", "third one"]


def test_compact_table_keeps_columns_and_places(spark):
    rows = [(1, "a", None, "x"), (2, None, "b b", "y")]
    df = spark.createDataFrame(rows, "k int, t string, u string, v string")
    for beside in ((), ("t",), ("u", "t")):
        stored = compact_table(df, "kept", beside=beside, place=("_file", "_row"))
        assert stored.columns == [*df.columns, "_file", "_row"]
        assert sorted(map(tuple, stored.select(df.columns).collect())) == rows
        assert stored.select("_file", "_row").distinct().count() == 2


def stored_tables(spark, kind):
    return set(Path(scratch_dir(spark).removeprefix("file:"), "voicegrid").glob(f"{kind}-*"))


def size(paths):
    return sum(part.stat().st_size for path in paths for part in path.glob("*.parquet"))


def test_canonical_rows_travel_with_one_text(spark):
    """Both forms of ids; equal positions do not bring blank texts back."""
    rows = [(1, " a  b ", "x"), (2, "A b", "y"), (2, "  ", "z"), (3, None, "u"), (4, "c", "v"), (5, "c ", "w")]
    df = spark.createDataFrame(rows, "n int, text string, product string")
    expected = [("a b", " a  b ", "x"), ("c", "c", "v")]
    for frame in (df, df.where("trim(text) != ''").withColumn("review_id", F.concat(F.lit("r"), "n", "product"))):
        found = canonical.canonicalize(frame, ColumnMapping("text", product="product"), order_by="n").dataframe
        assert sorted((r["clean_text"], r["review_text"], r["product"]) for r in found.collect()) == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"min_by\(struct\([^)]*_clean", plan)


def test_features_go_when_the_model_is_fitted(spark, themed_reviews):
    before = stored_tables(spark, "features")
    model = sentiment.fit_sentiment(themed_reviews, SentimentConfig())
    assert len(model.vocabulary) and stored_tables(spark, "features") == before


def test_analysis_stores_like_texts_side_by_side(spark):
    """The stored reviews take little more than their texts once, and come back as they were."""
    rng, words = random.Random(1), " ".join(THEMES.values()).split()
    texts = [" ".join(rng.choice(words) + str(rng.randrange(10**6)) * (k % 3 > 0) for k in range(400)) for _ in range(60)]
    rows = [(f"r{i:03d}", f" {text} ", text, f"{i % 3}") for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "review_id string, review_text string, clean_text string, product string")
    labelled = df.withColumn("sentiment_label", F.element_at(F.array(*map(F.lit, ("Negative", "Neutral", "Positive"))), F.col("product").cast("int") + 1))
    model = sentiment.fit_sentiment(labelled, SentimentConfig(max_features=50))
    before = {kind: stored_tables(spark, kind) for kind in ("scored", "enriched", "corpus")}
    config = TopicConfig(n_topics=2, max_features=50)
    done = run_pipeline(df, model, topic_config=config, vocabulary={"Battery": ["battery"]}, strict=False, stability_runs=1)
    assert sorted(map(tuple, done.dataframe.select("review_id", "review_text", "clean_text", "product").collect())) == rows
    path = f"{scratch_dir(spark)}/voicegrid/one-text-{rng.random()}"
    df.select("clean_text").write.option("compression", "zstd").parquet(path)
    one = size([Path(path.removeprefix("file:"))])
    for kind, found in before.items():
        new = stored_tables(spark, kind) - found
        assert len(new) == 1 and size(new) < 1.7 * one
