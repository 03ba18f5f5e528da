"""Toxicity, quality rules and decontamination."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from voicegrid.llm import adaptive_quality as A, positional_index as P, toxic_compression as X
from voicegrid.llm.queries import op7_compression_toxicity, op10_positional_decontamination


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for k in range(600):
        words = prose(1000 + k, 90).split()
        if k % 3 == 0:
            for at in range(5, 90, 17):
                words[at] = ("zagruffle", "mordwimpy")[at % 2]
        rows.append((k, " ".join(words), "en", int(k % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    return docs.drop("toxic"), docs.select("doc_id", "toxic")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = X.fit(docs, labels)
    scored = X.score(docs, model).join(labels, "doc_id").withColumn("held", X.held_out()).collect()
    held = [(r["score"] >= 0.3, r["toxic"]) for r in scored if r["held"]]
    assert len(held) > 100 and sum(p == bool(t) for p, t in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in scored)
    kept = X.keep_below(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.3 for r in scored)


def test_held_out_labels_are_never_learned(labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = X.fit(docs, labels), X.fit(docs, turned)
    assert (one.toxic, one.ordinary, one.threshold, one.weights) == (two.toxic, two.ordinary, two.threshold, two.weights)


def test_passages_far_behind_are_learned_and_found(spark):
    def text(seed, words, passage):
        found = prose(seed, words).split()
        if passage:
            found[-60::4] = [("zagruffle", "mordwimpy", "bluxternid")[k % 3] for k in range(15)]
        return " ".join(found)

    rows = [(k, text(5_000 + k, 4_500, k % 3 == 0), int(k % 3 == 0)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    assert min(len(x) for _, x, _ in rows) > 22_000
    model = X.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    for words in (200, 4_500, 25_000, 60_000):
        clean, toxic = (text(9_000 + words, words, passage) for passage in (False, True))
        assert words < 25_000 or len(clean) > 100_000
        assert model.score(clean) < 0.3 <= model.score(toxic)
    # Whole texts or none: of the rows that together are too long, some are left.
    few = X.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), max_toxic=30, max_ordinary=60, mean_chars=20_000)
    assert model.toxic and few.toxic


def test_clean_features_do_not_grow_with_length():
    model = X.CompressionModel(b"x", b"y", 3, [], [1.0, 0.003, 0.0015, 0.0004, 0.0001, 5e-5, 2e-5, 2e-5, 2e-5])
    model.rate = X._rate(model.tail)
    rng, means = np.random.default_rng(1), []
    for windows in (10, 200, 4_000, 80_000):
        drawn = []
        for _ in range(200):
            model.evidence = lambda text, n=windows: (rng.random(n)[:, None] < np.array(model.tail[1:])).sum(1)
            drawn.append(model.features("x"))
        means.append(np.mean(drawn, axis=0))
    assert (np.abs(np.array(means)) < (0.7, 0.3, 0.02, 0.7)).all()


def test_query_on_given_tables(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    rows = op7_compression_toxicity(spark, "/root/testdata/sf0.01")
    assert rows.count() == 1000
    joined = rows.join(labels, "doc_id").where("held_out").collect()
    hits = [r for r in joined if r["predicted"] == 1]
    assert sum(r["toxic"] for r in hits) / max(1, len(hits)) > 0.6 and sum(r["toxic"] for r in hits) > 0


def test_awkward_toxicity(spark, labelled, awkward, no_docs):
    model = X.fit(*labelled)
    rows = X.score(awkward, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in awkward.collect())
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}) == 1
    assert X.score(no_docs, model).count() == 0
    none = X.fit(awkward, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert {r["score"] for r in X.score(awkward, none).collect()} == {0.0}


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {k + i for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for i in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_equal_plain_ones(documents, texts, awkward, no_docs):
    for row in A.judge(documents).collect():
        expected = base_counts(texts[row["doc_id"]])
        assert tuple(row[n] for n in NAMES) == expected
        assert row["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (row["base_failed"] and row["kept"])
    got = Counter(tuple(r[n] for n in ("doc_id", *NAMES)) for r in A.judge(awkward).collect())
    assert got == Counter((r["doc_id"], *base_counts(r["text"])) for r in awkward.collect())
    assert A.judge(no_docs).count() == 0


def test_sketches_merge_and_thresholds_follow_groups(spark):
    rows = []
    for k in range(1_200):
        lang, source = ("en", "de")[k % 2], f"s{k % 4}" if k < 1_190 else "rare"
        symbols = (k * 7) % 40 if lang == "en" else 400 + (k * 7) % 40
        rows.append((k, lang, source, symbols, 0, 0, 500))
    rows += [(5_000, "en", "s0", 420, 0, 0, 500), (5_001, "de", "rare", 430, 0, 0, 500), (5_002, "en", "rare", 430, 0, 0, 500)]
    schema = "doc_id long, lang string, source string, symbols_per_mille long, duplicate_lines_per_mille long, repeated_words_per_mille long, word_length_per_cent long"
    frame = spark.createDataFrame(rows, schema)
    keys = ("lang", "source")
    whole = A.sketches(frame, keys)
    parts = A.sketches(frame.where("doc_id % 3 = 0"), keys).unionAll(A.sketches(frame.where("doc_id % 3 <> 0"), keys))
    merged = parts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    limits = {(r["lang"], r["source"]): r["threshold"] for r in A.thresholds(whole, keys).where("measure = 'symbols_per_mille'").collect()}
    assert limits["en", "s0"] < 420 < limits["de", "s1"]
    assert limits["en", "rare"] < 430 < limits["de", "rare"]


def test_buckets_are_narrow(spark):
    rows = spark.range(0, 200_000, 37).select("id", A.bucket("id").alias("low")).collect()
    assert all(r["low"] <= r["id"] < r["low"] + max(1, r["low"] // A.STEPS + 1) for r in rows)
    assert all(r["low"] == r["id"] for r in rows if r["id"] < 2 * A.STEPS)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def expected_hits(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(item)
    sizes, out = {len(w) for w in windows}, []
    for doc, text in docs:
        words, hit, names = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if found := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out.append((doc, len(words), len(hit), tuple(sorted(str(x) for x in names if x is not None)), bool(hit)))
    return Counter(out)


def hits(frame):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in frame.collect())


def test_decontamination_equals_plain_search(spark, documents, texts):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = expected_hits(texts.items(), [(r["item_id"], r["text"]) for r in items.collect()])
    assert hits(P.decontaminate(documents, items)) == expected
    assert any(row[4] for row in expected)
    row = op10_positional_decontamination(spark, "/root/testdata/sf0.001").where("not contaminated").first()
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest() and row["n_items"] == 0


def test_awkward_decontamination(spark, awkward, no_docs):
    base = awkward.where("doc_id = 1").first()["text"]
    rows = [("a", base), ("b", " ".join(base.split()[20:34])), ("c", "Word"), ("d", None), (None, "reserved all rights"), ("a", base), ("e", " ")]
    items = spark.createDataFrame([(*r, "x") for r in rows], "item_id string, text string, term string")
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    expected = expected_hits(docs, rows)
    assert hits(P.decontaminate(awkward, items)) == expected
    index = P.build_index(awkward)
    blocks = P.search(index, items, block_words=20)
    assert Counter((r["id"], r["n_words"], tuple(sorted(set(r["items"])))) for r in blocks.collect()) == Counter(x[:2] + x[3:4] for x in expected.elements())
    assert hits(P.decontaminate(awkward, items.limit(0))) == expected_hits(docs, [])
    assert P.decontaminate(no_docs, items).count() == 0


def test_equal_segments_keep_their_rows_in_several_passes(spark):
    base, long = prose(7, 40), prose(8, 3_000)
    texts = [base] * 24 + [None, ""] * 12 + [long] * 4
    rows = list(enumerate(texts))
    items = [(k, " ".join(base.split()[k : k + 12])) for k in range(0, 28, 4)] + [(90, " ".join(long.split()[700:720]))]
    questions = spark.createDataFrame(items, "item_id long, text string")
    assert sum(len(text) for _, text in items) > 2 * 20
    # Partitions of one text or of copies alone make segments of equal content.
    docs = [spark.createDataFrame(rows[a:b], "doc_id long, text string").repartition(n) for a, b, n in ((0, 24, 6), (24, 48, 6), (48, 52, 4))]
    index = P.build_index(docs[0].unionAll(docs[1]).unionAll(docs[2]))
    assert index.count() > index.select("terms", "positions", "firsts").distinct().count()
    found = P.search(index, questions, block_words=20).collect()
    expected = expected_hits(rows, items)
    assert Counter((r["id"], r["n_words"], tuple(sorted(set(r["items"])))) for r in found) == Counter(x[:2] + x[3:4] for x in expected.elements())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red a b blue c green"), (2, "green blue red"), (3, "red " + "x " * 50 + "blue green"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q", "Red blue GREEN")], "item_id string, text string")
    found = P.proximity(P.build_index(docs.coalesce(1)), items, slop=6).collect()
    assert {(r["id"], r["start"], r["end"]) for r in found} == {(1, 0, 6), (2, 0, 3)}
