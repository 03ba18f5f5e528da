"""Text and label functions against Python's own string behaviour."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voicegrid.functions import labels, text
from voicegrid.operators.tfidf import english_stop_words, terms_of

SAMPLES = [
    None, "", "  ", "  Great   app\n\tnow ", "Straße Été naïve", "Wow!!!! ok... no,,, yes?? a!!",
    "Battery!!! works at https://example.com/x?y=1 www.a.b", "it's a re-run 'quoted' well-", "24h x_1 你好 a", "don't 'tis rock'n'roll''",
]


def apply(spark, expression, values=SAMPLES):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [row[0] for row in rows.orderBy("i").select(expression("t")).collect()]


def squeeze(value):
    return re.sub(r"\s+", " ", value or "").strip()


def test_whitespace(spark):
    assert apply(spark, text.normalize_whitespace) == [squeeze(v) for v in SAMPLES]


def test_classical_and_transformer(spark):
    expected = [re.sub(r"([!?.,])\1{2,}", r"\1", squeeze(v).lower()) for v in SAMPLES]
    assert apply(spark, text.clean_for_classical_model) == expected
    assert apply(spark, text.clean_for_transformer) == [squeeze(v) for v in SAMPLES]


def test_topic_text_and_tokens(spark):
    assert apply(spark, text.clean_topic_text, ["  Battery!!! works at https://example.com  "]) == ["battery works at"]
    cleaned = apply(spark, text.clean_topic_text)
    tokens = apply(spark, text.tokenize_topic_text)
    assert tokens == [re.findall(r"\b[\w][\w'-]+\b", c) for c in cleaned]


def test_aspect_text(spark):
    expected = [" ".join(re.sub(r"[^a-z0-9']+", " ", (v or "").lower()).split()) for v in SAMPLES]
    assert apply(spark, text.normalize_aspect_text) == expected


def test_counts(spark):
    assert apply(spark, text.word_count) == [len(re.findall(r"\b\w+\b", v or "")) for v in SAMPLES]
    assert apply(spark, text.character_count) == [len((v or "").strip()) for v in SAMPLES]


def test_fold_is_casefold_for_western_text(spark):
    assert apply(spark, text.fold) == [None if v is None else v.casefold() for v in SAMPLES]


def test_plain_tokens(spark):
    expected = [
        [w.strip("'") for w in re.findall(r"[A-Za-z][A-Za-z']+", (v or "").casefold())] for v in SAMPLES
    ]
    assert apply(spark, text.plain_tokens) == expected


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZéß' -_.!?,\n 1你", max_size=40), min_size=1, max_size=8))
def test_text_properties(spark, values):
    assert apply(spark, text.normalize_whitespace, values) == [squeeze(v) for v in values]
    assert apply(spark, text.word_count, values) == [len(re.findall(r"\b\w+\b", v)) for v in values]
    cleaned = apply(spark, text.clean_topic_text, values)
    assert apply(spark, text.tokenize_topic_text, values) == [re.findall(r"\b[\w][\w'-]+\b", c) for c in cleaned]


def test_strip_accents(spark):
    assert apply(spark, text.strip_accents, ["café à mañana čech"]) == ["cafe a manana cech"]


def test_bigrams(spark):
    row = spark.range(1).select(
        terms_of(F.array(*map(F.lit, "abc")), 2), terms_of(F.array(F.lit("a")), 2), terms_of(F.array().cast("array<string>"), 2)
    ).first()
    assert list(row) == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_stop_words_pass_the_vectorizer():
    words = english_stop_words()
    assert "the" in words and "don" in words and not any("'" in w or len(w) < 2 for w in words)


def test_labels(spark):
    rows = spark.createDataFrame([(" positive ",), ("NEUTRAL",), ("Negative",)], "l string")
    assert [r[0] for r in rows.select(labels.normalize_label(F.col("l"))).collect()] == ["Positive", "Neutral", "Negative"]
    numbers = spark.createDataFrame([("1",), ("0",)], "l string")
    mapped = numbers.select(labels.normalize_label(F.col("l"), {"1": "positive", "0": "NEGATIVE"}))
    assert [r[0] for r in mapped.collect()] == ["Positive", "Negative"]
    for bad in ("2", None):
        with pytest.raises(PySparkException, match="Unsupported sentiment label"):
            spark.createDataFrame([(bad,)], "l string").select(labels.normalize_label(F.col("l"))).collect()
    nulls = spark.createDataFrame([(None,)], "l string").select(labels.canonical_label(F.col("l")))
    assert nulls.first()[0] is None
    odd = spark.createDataFrame([("Great",), ("positive",), (None,)], "sentiment_label string")
    assert [r[0] for r in labels.unsupported_labels(odd).collect()] == ["Great"]


def test_dominant_label_ties(spark):
    row = spark.range(1).select(
        labels.dominant_label(F.lit(2), F.lit(2), F.lit(2)),
        labels.dominant_label(F.lit(2), F.lit(2), F.lit(1), order=("Positive", "Neutral", "Negative")),
        labels.dominant_label(F.lit(0), F.lit(2), F.lit(1)),
    ).first()
    assert list(row) == ["Negative", "Positive", "Neutral"]
