"""Blob ledger and diagonal voting."""

import hashlib
import re
import time
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from voicegrid.llm import secret_ledger as S
from voicegrid.llm.license_votes import license_spans, scan_licenses

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def test_base_spans_equal_plain_search(spark, documents, texts):
    for row in S.scan_history(documents, S.Ledger(spark)).collect():
        got = [(x["kind"], x["start"], x["end"]) for x in row["found"] if x["kind"] in S.BASE]
        assert got == base_spans(texts[row["doc_id"]])


def test_only_unseen_pairs_are_scanned(spark, awkward):
    ledger = S.Ledger(spark)
    first = S.scan_history(awkward, ledger).collect()
    scans = ledger.findings().count()
    assert scans == awkward.select(F.coalesce("text", F.lit("")).alias("t")).distinct().count()
    again = S.scan_history(awkward, ledger).collect()
    assert ledger.findings().count() == scans and Counter(map(str, first)) == Counter(map(str, again))
    new = spark.createDataFrame([(99, "token: abcdefgh1"), (1, awkward.where("doc_id = 1").first()["text"])], "doc_id long, text string")
    assert [r["found"][0]["kind"] for r in S.scan_history(new, ledger).collect() if r["found"]] == ["assign"]
    assert ledger.findings().count() == scans + 1
    S.scan_history(new, ledger, rules=S.RULES[:2]).collect()
    assert ledger.findings().where(F.col("rules") == S.rules_version(S.RULES[:2])).count() == 2


def test_awkward_paths_keep_their_rows(spark, awkward, no_docs):
    rows = S.scan_history(awkward, S.Ledger(spark)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in awkward.collect())
    assert [x["kind"] for r in rows if r["doc_id"] == 11 for x in r["found"]] == ["assign", "access", "hex"]
    assert S.scan_history(no_docs, S.Ledger(spark)).count() == 0


def test_redaction_changes_findings_only(spark, awkward, no_docs):
    after = S.redact(awkward, S.Ledger(spark))
    assert after.columns == awkward.columns and after.count() == awkward.count()
    text = after.where("doc_id = 11").first()["text"]
    assert text == "[assign], [access] and [hex] tail"
    assert after.where("text is null").count() == awkward.where("text is null").count()
    assert S.redact(no_docs, S.Ledger(spark)).count() == 0


def test_key_blocks_with_headers():
    block = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011AABB\n\nMIIB+/=\n-----END RSA PRIVATE KEY-----"
    spans = S.find_spans(f"a {block} b -----BEGIN PRIVATE KEY----- c -----BEGIN PRIVATE KEY-----\nAA\n-----END PRIVATE KEY-----", S.compile_rules())
    keys = [(x["start"], x["end"]) for x in spans if x["kind"] == "private_key"]
    assert keys[0] == (2, 2 + len(block)) and len(keys) == 2


def test_long_runs_stay_fast():
    text = "eyJ" * 20_000 + "a" * 50_000 + "-----BEGIN PRIVATE KEY-----" * 500
    assert [x["kind"] for x in S.find_spans(text, S.compile_rules())] == ["hex"]


def kinds_of(text):
    return [(x["kind"], text[x["start"] : x["end"]]) for x in S.find_spans(text, S.compile_rules()) if x["kind"] in ("jwt", "url_password")]


def test_long_parts_are_found(spark):
    for size in (500, 501, 2_000, 50_000):
        token = f"eyJ{'h' * size}.eyJ{'p' * size}.{'s' * 43}"
        assert kinds_of(f"x eyJ.{token}, y") == [("jwt", token)]
    for size in (64, 65, 200, 5_000):
        for user, word in (("u", "p" * size), ("u" * size, "pass"), ("u" * size, "p" * size)):
            assert kinds_of(f"see https://{user}:{word}@host/ now") == [("url_password", f"://{user}:{word}@")]
    docs = spark.createDataFrame([(1, f"a eyJ{'g' * 300}.eyJ{'z' * 2_000}.sig b https://me:{'w' * 200}@host c")], "doc_id long, text string")
    assert S.redact(docs, S.Ledger(spark)).first()["text"] == "a [jwt] b https[url_password]host c"


@settings(max_examples=2_000, deadline=None)
@given(st.one_of(
    st.lists(st.sampled_from(["eyJ", "eyJ", ".", ".", "a", "eyJb", "-", " ", "ey"]), max_size=16).map("".join),
    st.lists(st.sampled_from(["://", "://", ":", "@", "/", "a", "bcd", "é", " "]), max_size=16).map("".join),
))
def test_linear_search_equals_the_patterns(text):
    plain = [(rule, re.compile(rule.pattern)) for rule in S.RULES]
    assert S.find_spans(text, S.compile_rules()) == S.find_spans(text, plain)


def test_unbounded_parts_stay_linear():
    hard = ("eyJ" * 100_000, "eyJa.b." * 60_000, "eyJa.eyJb " * 40_000, "://a:" * 60_000, "://" + "a" * 300_000, ("://" + "a" * 20 + ":") * 12_000)
    began = time.process_time()
    assert all(not kinds_of(text) for text in hard)
    assert time.process_time() - began < 5


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def expected_phrases(text):
    words = words_of(text)
    at = [(k, label) for phrase, label in PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), sorted({label for _, label in at})


def test_phrases_equal_plain_search(documents, texts):
    for row in scan_licenses(documents).collect():
        got = tuple(row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))
        assert got == expected_phrases(texts[row["doc_id"]])
        assert 0 <= row["score"] <= 1 and set(row["base_labels"]) <= set(row["labels"])


def test_gaps_shift_the_diagonal_and_still_verify(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    broken = notice.replace("obtaining a copy", "who is obtaining one copy").replace("without limitation", "")
    rows = [(1, "x " * 30 + notice), (2, "y " * 9 + broken), (3, "permission is hereby granted, and no more"), (4, notice + " . " + notice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = [r for r in license_spans(docs).collect() if r["template"] == "mit-grant"]
    verified = {(r["doc_id"], r["start"]) for r in spans if r["verified"]}
    assert {(1, 30), (2, 9)} <= verified and 3 not in {i for i, _ in verified}
    assert len([1 for i, _ in verified if i == 4]) == 2
    labels = {r["doc_id"]: r["labels"] for r in scan_licenses(docs).collect()}
    assert labels[1] == ["mit"] and labels[2] == ["mit"] and "mit" not in labels[3]


def test_awkward_documents_get_licence_rows(awkward, no_docs):
    rows = scan_licenses(awkward).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in awkward.collect())
    assert {r["n_base"] for r in rows if r["doc_id"] == 12} == {3}
    assert scan_licenses(no_docs).count() == 0


def test_query_digest_shape(spark):
    from voicegrid.llm.queries import op1_blob_ledger

    row = op1_blob_ledger(spark, "/root/testdata/sf0.001").where("n_hex = 0 and n_assign = 0 and n_access = 0").first()
    assert row["base_sha256"] == hashlib.sha256(b"").hexdigest()
