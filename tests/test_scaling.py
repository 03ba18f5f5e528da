"""What large and untidy tables need: conflicts kept, texts moved once, nothing squeezed into one task."""

import glob
import math
import time
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voicegrid.functions.casts import date_formats_of
from voicegrid.operators import canonical, labelled, sentiment, text_index, tfidf, topic_quality, topics, validation
from voicegrid.plans import catalog, surface
from voicegrid.plans.catalog import QUERIES
from voicegrid.schema import ColumnMapping, LabelledDataError, TopicConfig
from voicegrid.session import cut_lineage
from voicegrid.sources.driver_tables import feedback, gold_feedback


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Sixty documents in three files; 58 and 59 have the text of 0 and 1 under another label."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, f"from the license number {k % 58} {'good' if k % 3 else 'bad'}x{k % 58}", "en", "web") for k in range(60)]
    rows[58:] = [(58, rows[0][1], "en", "web"), (59, rows[1][1], "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    events = [(k * 5, datetime(2026, 1, 1 + k % 28), "view", float(k % 100)) for k in range(120)] + [(None, None, "view", 1.0), (30, None, "buy", 2.0)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(58)] + [(58, 1, 0), (59, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture
def shuffled(spark):
    """Joins as on tables too large to broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_with_two_labels_stay_with_each(spark, tables):
    found = QUERIES["labeled_clean"](spark, tables).collect()
    assert len(found) == len(set(found)) == 60 and len({row["text_md5"] for row in found}) == 58
    split = QUERIES["stratified_split"](spark, tables)
    assert split.count() == 60 and split.where("split = 'train'").count() > 35
    pairs = feedback(spark, tables)
    with pytest.raises(LabelledDataError, match="2 review text.* conflicting"):
        labelled.prepare_labelled(pairs)
    few = labelled.labelled_pairs(pairs).where("sentiment_label <> 'Neutral' or review_text like '%number 2 %'")
    with pytest.raises(LabelledDataError, match="at least 7"):
        labelled.prepare_labelled(few, keep_conflicts=True)


def test_models_learn_from_texts_with_two_labels(spark, tables):
    assert QUERIES["sentiment_training"](spark, tables).count() == 6
    assert QUERIES["sentiment_scored"](spark, tables).count() >= 60
    saved = QUERIES["saved_sentiment"](spark, tables).first()
    assert saved["changed"] == saved["out_of_range"] == 0


def counted(spark, df, column):
    """``df`` and a counter of the rows whose ``column`` is computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(value):
        seen.add(1)
        return value

    return df.withColumn(column, same.asNondeterministic()(column)), seen


def test_labelled_texts_are_read_once_for_a_model(spark, tables):
    gold, seen = counted(spark, gold_feedback(spark, tables), "review_text")
    catalog._fitted_on(gold)
    assert seen.value == gold_feedback(spark, tables).count() == 61
    few = [("a\tb", "positive"), ("a b", "Positive"), ("a b", "Negative"), ("", "Negative"), (None, "Neutral"), ("c", "Neutral")]
    rows = spark.createDataFrame(few, "review_text string, sentiment_label string")
    for settings in ({"keep_conflicts": True}, {"keep_conflicts": True, "min_per_class": 1}, {"min_per_class": 1}):
        results = []
        for store in (False, True):
            try:
                results.append(sorted(map(tuple, labelled.prepare_labelled(rows, store=store, **settings).collect())))
            except LabelledDataError as problem:
                results.append(str(problem))
        assert results[0] == results[1]
        assert settings.get("min_per_class") != 1 or not settings.get("keep_conflicts") or len(results[0]) == 3
    with pytest.raises(LabelledDataError, match="No usable"):
        labelled.prepare_labelled(rows.where("review_text = ''"), store=True)


def test_saved_model_scores_in_the_same_pass(spark, tables, monkeypatch):
    # Review 3 stands there twice, one row has no id and one no text.
    odd = feedback(spark, tables).where("doc_id is not null").limit(1)
    odd = odd.withColumn("review_id", F.lit(None).cast("string")).unionAll(odd.withColumn("review_id", F.lit("x")).withColumn("clean_text", F.lit(None).cast("string")))
    rows, seen = counted(spark, feedback(spark, tables).unionAll(odd), "clean_text")
    monkeypatch.setattr(surface, "feedback", lambda *_: rows)
    found = QUERIES["saved_sentiment"](spark, tables).first()
    assert seen.value == 63
    # A repeated id meets itself, and a row without an id meets none.
    assert found["reviews"] == 59 + 2 * 2 + 1 and found["out_of_range"] == 0
    twice = {row["sentiment_score"] for row in sentiment.predict_sentiment(feedback(spark, tables).where("doc_id = 3"), catalog._fitted(spark, tables)).collect()}
    assert found["changed"] == (0 if len(twice) == 1 else 2)


def test_long_texts_are_indexed_in_one_go(spark, tmp_path):
    text = "".join(chr(0x4E00 + k * k % 5000) + "aé\n𝛼"[k % 4] for k in range(300_000))
    grams = spark.createDataFrame([(text,), ("",), (None,), ("xy",), ("xyz",), ("𝛼𝛼𝛼𝛼",)], "text string").select(text_index._grams(F.col("text")).alias("g"))
    started = time.perf_counter()
    found = [row["g"] for row in grams.collect()]
    assert time.perf_counter() - started < 30
    assert len(found[0]) == len(set(found[0])) and set(found[0]) == {text[k : k + 3] for k in range(len(text) - 2)}
    assert [set(g or ()) for g in found[1:]] == [set(), set(), set(), {"xyz"}, {"𝛼𝛼𝛼"}]


def test_faulty_file_comes_from_many_tasks(spark, tables, shuffled):
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/voicegrid/faulty-*"))
    found = {row["fault"]: row["error"] for row in QUERIES["csv_failures"](spark, tables).collect()}
    assert found["surplus_fields"] == "CsvParseError" and found["too_many_rows"] == "RowLimitError"
    (base,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/voicegrid/faulty-*")) - before
    files = glob.glob(f"{base}/long.csv/part-*")
    assert len(files) > 1
    lines = [open(file).read().splitlines() for file in files]
    assert all(part[0] == "doc_id,product" for part in lines)
    assert sorted(line for part in lines for line in part[1:]) == sorted([*(f"{k},en,{k}" for k in range(60)), "3,en,3"])


def test_feedback_shuffles_texts_once(spark, tables, shuffled):
    rows = feedback(spark, tables)
    assert plan_of(rows).count("Exchange hashpartitioning") == 3
    dated = {row["doc_id"]: row for row in rows.where("doc_id in (1, 3, 59)").select("doc_id", "date", "category").collect() if row["category"] == "view"}
    assert {k: row["date"].day for k, row in dated.items()} == {1: 3, 3: 7, 59: 7}
    assert rows.count() == 61 and rows.where("doc_id = 3").count() == 2


def test_canonical_counts_need_no_text(spark, tables):
    rows = feedback(spark, tables).where("category is distinct from 'buy'").select("doc_id", "review_text", F.date_format("date", "yyyy-MM-dd").alias("date"), "rating")
    done = canonical.canonicalize(rows, ColumnMapping("review_text", date="date", rating="rating"), order_by="doc_id")
    assert "sha2" not in plan_of(done.casts) and done.casts.first()["invalid_dates"] == 0
    assert done.dataframe.count() == 58 and date_formats_of(rows, "date") == ()


def test_rules_read_a_stored_source(spark, tables, monkeypatch):
    seen = []
    whole = validation.validate_dataset
    monkeypatch.setattr(validation, "validate_dataset", lambda df, mapping: seen.append(df) or whole(df, mapping))
    QUERIES["validation_report"](spark, tables).collect()
    assert "Join" not in plan_of(seen[0]) and seen[0].count() == 61


def test_weights_move_in_blocks(spark, monkeypatch, shuffled):
    texts = ["red big dog", "red red dog big dog", "", None, "cat big dog", "cat", "é"]
    df = cut_lineage(spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "k string, t string").repartition(2))
    tokens = F.split("t", " ")
    lists = {f"k{i}": t.split(" ") for i, t in enumerate(texts) if t is not None}
    terms = {k: words + [f"{a} {b}" for a, b in zip(words, words[1:])] for k, words in lists.items()}
    for step in (1, 4, 10**6):
        monkeypatch.setattr(tfidf, "COUNTED_PER_STEP", step)
        counted = cut_lineage(tfidf.term_statistics(df, tokens))
        expected = {t: (sum(x.count(t) for x in terms.values()), sum(t in x for x in terms.values())) for x in terms.values() for t in x}
        assert {r["term"]: (r["corpus_count"], r["document_count"]) for r in counted.collect()} == expected
        chosen = cut_lineage(tfidf.select_terms(counted, 7, max_features=None, min_df=2))
        weights = tfidf.term_weights(df, "k", tokens, chosen)
        assert plan_of(weights).count("Exchange hashpartitioning") == 2
        idf = {t: math.log(8 / (1 + n)) + 1 for t, (_, n) in expected.items() if n >= 2}
        raw = {(k, t): (1 + math.log(x.count(t))) * idf[t] for k, x in terms.items() for t in set(x) if t in idf}
        norm = {k: math.sqrt(sum(w * w for (o, _), w in raw.items() if o == k)) for k, _ in raw}
        found = {(r["k"], r["term"]): r["weight"] for r in weights.collect()}
        assert found == pytest.approx({cell: w / norm[cell[0]] for cell, w in raw.items()})


def test_terms_are_counted_in_packed_buckets(spark, monkeypatch):
    """One row moves for a bucket of terms; a word with a blank and a pair that read alike are one term."""
    lists = [["red", "dog"], ["red dog"], ["", "é", "red", "dog", "red"], [], None, ["red dog", "cat"], ["red", "dog cat"], ["red", "dog", "red dog"]]
    df = cut_lineage(spark.createDataFrame([(words,) for words in lists], "t array<string>").repartition(3))
    terms = [words + [f"{a} {b}" for a, b in zip(words, words[1:])] for words in lists if words]
    expected = {t: (sum(x.count(t) for x in terms), sum(t in x for x in terms)) for x in terms for t in x}
    for step in (1, 10**6):
        monkeypatch.setattr(tfidf, "COUNTED_PER_STEP", step)
        counted = tfidf.term_statistics(df, F.col("t"))
        assert "FlatMapGroupsInArrow [bucket" in plan_of(counted)
        assert {r["term"]: (r["corpus_count"], r["document_count"]) for r in counted.collect()} == expected
        assert sum(1 for _ in counted.collect()) == len(expected)
    kept = plan_of(tfidf.select_terms(tfidf.term_statistics(df, F.col("t")), 8, max_features=None, min_df=2))
    assert kept.index("Exchange hashpartitioning(term") < kept.index("Filter")


def test_terms_are_made_once_before_they_are_numbered(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(idf):
        made.add(1)
        return idf

    rows = spark.createDataFrame([(f"t{k:02d}", 1.0) for k in range(40)], "term string, idf double")
    numbered = tfidf.number_terms(rows.withColumn("idf", F.udf(seen, "double")("idf")))
    assert [(r["term"], r["number"]) for r in numbered.orderBy("number").collect()] == [(f"t{k:02d}", k) for k in range(40)]
    assert made.value == 40


def test_topic_weights_are_solved_for_many_texts_at_once(spark, themed_reviews):
    """Weights come from one pass in tasks, and a row's do not hang on the rows beside it."""
    fit = topics.fit_topics(themed_reviews, TopicConfig(n_topics=3, max_features=60))
    scored = fit.model.with_weights(fit.texts, "topic_text")
    assert plan_of(scored).count("ArrowEvalPython") == 1 and "Generate" not in plan_of(scored) and "Exchange" not in plan_of(scored)
    found = {row["topic_text"]: row["_weights"] for row in scored.collect()}
    single = {row["topic_text"]: row["_weights"] for text in list(found)[:3] for row in fit.model.with_weights(fit.texts.where(F.col("topic_text") == text), "topic_text").collect()}
    assert single == {text: pytest.approx(found[text], abs=1e-13) for text in single}


def test_topics_clean_a_text_once(spark, themed_reviews):
    """The fitted texts are those of the stored corpus."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    rows = themed_reviews.withColumn("clean_text", F.udf(read, "string").asNondeterministic()("clean_text"))
    fit, found = topics.model_topics(rows, TopicConfig(n_topics=3, max_features=60))
    assert found.count() == fit.documents == 30 and seen.value == 30


def test_weighing_finds_words_and_pairs_by_number():
    """Terms of words with blanks of their own are found at each blank."""
    vocabulary = tfidf.Vocabulary(("a", "a b", "a b c", "c", "é a"), np.array([1.0, 2.0, 3.0, 4.0, 5.0]), 9)
    lists = [["a", "b", "c"], ["a b", "c"], ["a", "b c"], [], None, ["x", "é", "a", "a"], ["a"], ["b", "a b c"]]
    parts = list(tfidf.weigh(pa.array(lists, pa.list_(pa.string())), vocabulary, pa.array(vocabulary.terms)))
    (part,) = parts
    found = {(r, vocabulary.terms[t]): w for r, t, w in zip(part.row.tolist(), part.term.tolist(), part.weight.tolist())}
    raw = {}
    for r, words in enumerate(lists):
        terms = (words or []) + [f"{x} {y}" for x, y in zip(words or [], (words or [])[1:])]
        raw |= {(r, t): (1 + math.log(terms.count(t))) * vocabulary.idf[vocabulary.terms.index(t)] for t in set(terms) & set(vocabulary.terms)}
    norm = {r: math.sqrt(sum(w * w for (o, _), w in raw.items() if o == r)) for r, _ in raw}
    assert part.count == 8 and found == pytest.approx({cell: w / norm[cell[0]] for cell, w in raw.items()})


def test_texts_that_share_a_key_are_weighed_as_one(spark):
    rows = [("a", "red red dog"), ("a", "dog red"), ("b", "dog"), (None, "red dog"), ("c", "dog red")]
    df = cut_lineage(spark.createDataFrame(rows, "k string, t string").repartition(3))
    chosen = spark.createDataFrame([("red", 2.0), ("dog", 1.0), ("dog red", 3.0)], "term string, idf double")
    found = {(r["k"], r["term"]): r["weight"] for r in tfidf.term_weights(df, "k", F.split("t", " "), chosen).collect()}
    a = {"red": (1 + math.log(3)) * 2, "dog": 1 + math.log(2), "dog red": 3.0}
    c = {"red": 2.0, "dog": 1.0, "dog red": 3.0}
    weighed = {(k, t): w / math.sqrt(sum(x * x for x in own.values())) for k, own in (("a", a), ("c", c)) for t, w in own.items()}
    assert found == pytest.approx(weighed | {("b", "dog"): 1.0})


def test_coherence_reads_vectors(spark, themed_reviews, monkeypatch):
    fit = topics.fit_topics(themed_reviews, TopicConfig(n_topics=3, max_features=60))
    tokens, words = topics.topic_tokens("topic_text", fit.model.config), fit.model.keywords
    by_text = topic_quality.keyword_presence(fit.texts, tokens, words).collect()
    assert len(by_text) > 9 and sorted(by_text) == sorted(topic_quality.vector_presence(fit.vectors, fit.model.vocabulary, words).collect())
    expected = topic_quality.topic_coherence(fit.texts, tokens, words, fit.documents).first()[0]
    monkeypatch.setattr(topic_quality, "_present_terms", None)  # no text is taken apart again
    assert topic_quality.evaluate_topics(fit, stability_runs=1)["topic_coherence_npmi"] == pytest.approx(expected)
