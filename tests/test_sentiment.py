"""Labelled data, metrics and both sentiment models."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voicegrid.operators import labelled, metrics, sentiment
from voicegrid.plans.pipeline import sentiment_stage
from voicegrid.schema import FeedbackError, LabelledDataError, SentimentConfig, SplitConfig

WORDS = {"Positive": "great love perfect", "Negative": "broken awful refund", "Neutral": "okay average fine"}


@pytest.fixture(scope="module")
def gold(spark):
    rows = [(f"{words} sample {label.lower()} number{i}", label) for label, words in WORDS.items() for i in range(15)]
    return spark.createDataFrame(rows, "review_text string, sentiment_label string")


def test_preparation(spark, gold):
    doubled = gold.unionAll(gold.select(F.concat(F.lit("  "), "review_text"), F.lower("sentiment_label")))
    assert labelled.prepare_labelled(doubled).count() == 45
    conflict = gold.unionAll(gold.limit(1).select("review_text", F.lit("Neutral")))
    with pytest.raises(LabelledDataError, match="conflicting"):
        labelled.prepare_labelled(conflict)
    assert labelled.label_conflicts(labelled.labelled_pairs(conflict)).count() == 1
    with pytest.raises(LabelledDataError, match="Missing labels: Neutral"):
        labelled.prepare_labelled(gold.where("sentiment_label <> 'Neutral'"))
    with pytest.raises(LabelledDataError, match="at least 7"):
        labelled.prepare_labelled(gold.where("sentiment_label <> 'Neutral' or review_text like '%number1_'"))
    with pytest.raises(LabelledDataError, match="No usable"):
        labelled.prepare_labelled(gold.withColumn("review_text", F.lit(" ")))
    with pytest.raises(PySparkException, match="Unsupported"):
        labelled.prepare_labelled(gold.withColumn("sentiment_label", F.lit("great")))
    with pytest.raises(LabelledDataError, match="lacks"):
        labelled.prepare_labelled(gold.drop("sentiment_label"))


def test_split_shares(spark, monkeypatch):
    rows = spark.range(2000).select(
        F.concat(F.lit("text "), "id").alias("review_text"), F.when(F.col("id") % 10 == 0, "Negative").otherwise("Positive").alias("sentiment_label")
    )
    monkeypatch.setattr(labelled, "RANK_BUCKET_ROWS", 50)
    split = labelled.split_labelled(rows)
    counts = {(r.sentiment_label, r.split): r.n for r in split.groupBy("sentiment_label", "split").agg(F.count("*").alias("n")).collect()}
    assert counts == {
        ("Negative", "train"): 140, ("Negative", "validation"): 30, ("Negative", "test"): 30,
        ("Positive", "train"): 1260, ("Positive", "validation"): 270, ("Positive", "test"): 270,
    }
    monkeypatch.setattr(labelled, "RANK_BUCKET_ROWS", 10**6)
    whole = labelled.split_labelled(rows.repartition(3))
    assert split.exceptAll(whole).isEmpty()
    assert not labelled.split_labelled(rows, SplitConfig(seed=7)).exceptAll(whole).isEmpty()


def test_split_settings():
    with pytest.raises(ValueError, match="sum"):
        SplitConfig(0.5, 0.2, 0.2)
    with pytest.raises(ValueError, match="greater"):
        SplitConfig(1.1, -0.2, 0.1)


# Published confusion matrices (actual by predicted) and scores.
PUBLISHED = [
    ([[34, 3, 11], [10, 0, 12], [26, 3, 638]], (0.9118, 0.4836, 0.5550, 0.5124, 0.9071)),
    ([[38, 2, 8], [7, 1, 14], [6, 1, 660]], (0.9484, 0.6543, 0.6089, 0.6077, 0.9379)),
]


@pytest.mark.parametrize(("matrix", "scores"), PUBLISHED)
def test_published_scores(spark, matrix, scores):
    names = ("Negative", "Neutral", "Positive")
    rows = [(a, p, matrix[i][j]) for i, a in enumerate(names) for j, p in enumerate(names)]
    counted = spark.createDataFrame(rows, "actual string, predicted string, n bigint")
    expanded = counted.where("n > 0").select("actual", "predicted", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    found = metrics.evaluate_predictions(expanded)
    keys = ("accuracy", "precision_macro", "recall_macro", "macro_f1", "weighted_f1")
    assert tuple(round(found[k], 4) for k in keys) == scores
    assert found["confusion_matrix"] == matrix
    weighted = metrics.confusion_matrix(counted, weight="n")
    assert [r.row_count for r in weighted.collect()] == [n for row in matrix for n in row]


def test_class_report_zero_division(spark):
    rows = spark.createDataFrame([("Positive", "Positive"), ("Neutral", "Positive")], "actual string, predicted string")
    report = {r.label: (r.precision, r.recall, r.f1_score, r.support) for r in metrics.class_report(metrics.confusion_matrix(rows)).collect()}
    assert report == {"Negative": (0, 0, 0, 0), "Neutral": (0, 0, 0, 1), "Positive": (0.5, 1.0, pytest.approx(2 / 3), 1)}
    with pytest.raises(FeedbackError, match="prediction"):
        metrics.evaluate_predictions(rows.limit(0))


def test_comparison(spark):
    first = spark.createDataFrame([(0.9, 1.5)], "accuracy double, training_seconds double")
    rows = {r.metric: (r.a, r.b) for r in metrics.model_comparison(first, None, names=("a", "b")).collect()}
    assert len(rows) == 9 and rows["Accuracy"] == (0.9, None) and rows["Training time (s)"] == (1.5, None)
    assert metrics.model_comparison(None, None) is None


@pytest.fixture(scope="module")
def trained(gold):
    return sentiment.train_sentiment(gold, SentimentConfig(max_features=200))


def test_training(trained, gold):
    _, report, tested = trained
    assert report["accuracy"] == 1.0 and report["validation_metrics"]["accuracy"] == 1.0
    assert (report["train_rows"], report["validation_rows"], report["test_rows"]) == (33, 6, 6)
    assert tested.columns == ["review_text", "actual", "predicted", "confidence"]
    assert 1 / 3 < report["mean_confidence"] <= 1 and report["class_distribution"]["Neutral"] == 15


def test_probabilities_by_hand(spark, trained):
    """Scores equal a plain dictionary computation."""
    model = trained[0]
    text = "Great GREAT love, unknown words; okay"
    scored = sentiment.predict_sentiment(spark.createDataFrame([(text, text), ("zzz", "zzz")], "review_text string, clean_text string"), model).collect()
    tokens = ["great", "great", "love", "unknown", "words", "okay"]
    terms = tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
    index = {t: i for i, t in enumerate(model.vocabulary.terms)}
    weight = {t: (1 + np.log(terms.count(t))) * model.vocabulary.idf[index[t]] for t in set(terms) if t in index}
    norm = np.sqrt(sum(w * w for w in weight.values()))
    margin = model.intercepts + sum(w / norm * model.coefficients[:, index[t]] for t, w in weight.items())
    expected = np.exp(margin) / np.exp(margin).sum()
    assert scored[0].sentiment_label == "Positive" and scored[0].sentiment_score == pytest.approx(expected.max())
    prior = np.exp(model.intercepts) / np.exp(model.intercepts).sum()
    assert scored[1].sentiment_score == pytest.approx(prior.max())


def test_save_and_load(spark, trained, gold, tmp_path):
    trained[0].save(spark, str(tmp_path / "m"))
    again = sentiment.SentimentModel.load(spark, str(tmp_path / "m"))
    rows = gold.withColumn("clean_text", F.col("review_text"))
    assert trained[0].predict(rows).exceptAll(again.predict(rows)).isEmpty()


class Scorer:
    labels = ("negative", "Neutral", "POSITIVE")

    def score(self, texts):
        assert len(texts) <= 4
        return np.array([[0.2, 0.1, 0.7] if "good" in t else [0.6, 0.3, 0.1] for t in texts])


class WrongLabels(Scorer):
    labels = ("bad", "Neutral", "Positive")


def test_supplied_scorer(spark):
    rows = spark.createDataFrame([("  good  one", "x"), ("poor", "x")] * 5, "review_text string, clean_text string")
    found = sentiment.predict_sentiment(rows, sentiment.SuppliedModel(Scorer, batch_size=4)).distinct().collect()
    assert {(r.review_text, r.sentiment_label, r.sentiment_score) for r in found} == {("  good  one", "Positive", 0.7), ("poor", "Negative", 0.6)}
    with pytest.raises(PySparkException, match="exactly the labels"):
        sentiment.predict_sentiment(rows, sentiment.SuppliedModel(WrongLabels)).collect()
    with pytest.raises(ValueError, match="batch_size"):
        sentiment.predict_sentiment(rows, sentiment.SuppliedModel(Scorer, batch_size=0))
    with pytest.raises(FeedbackError, match="kind"):
        sentiment_stage(rows, sentiment.SuppliedModel(Scorer), kind="logistic_regression")
    with pytest.raises(FeedbackError, match="clean_text"):
        sentiment.predict_sentiment(rows.drop("clean_text"), sentiment.SuppliedModel(Scorer))


def test_scoring_does_not_shuffle(trained, gold):
    scored = trained[0].predict(gold.withColumn("clean_text", F.col("review_text"))).where("sentiment_label = 'Positive'")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
