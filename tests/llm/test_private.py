"""Personal data spans against a plain loop over regular expressions."""

import re

from hypothesis import given, settings, strategies as st

from voicegrid.llm.private_data import BASE, KINDS, find_private


def luhn(digits):
    twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def plain_base(text):
    """Base spans as the contract words them."""
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    found = []
    for place, (kind, (pattern, right)) in enumerate(rules.items()):
        found += [(m.start(), place, m.end(), kind) for m in re.finditer(pattern, text or "") if right(m[0])]
    return sorted(found)


def base_of(row):
    return [(s["start"], s["place"], s["end"], s["kind"]) for s in row["found"] if s["kind"] in BASE]


MIXED = [
    "a@b.com_x@d.org, a@b..c@d.e.f. 1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1",
    "4111 1111 1111 1111-4111-1111 4111111111111111 41111111111111112 é+1 (437) 555-1520 +1 +44 20 7946 0958.",
    "\U0001F600 x@y.z \U0001F600 1.1.1.1 漢字 4111111111111111", "++1-234-567-8901+12 3456 7890 1 ", "@a.b a@ a@b a@b. .@-.-",
    "9" * 3_000, "1 " * 2_000, "a." * 2_000 + "@b.c", "1.1.1.1 " * 700, "x" * 50_000, "+" * 3_000 + "1" * 12,
]


def test_base_spans(spark, documents, texts):
    rows = spark.createDataFrame(list(enumerate(MIXED)), "doc_id long, text string")
    for row in find_private(rows).collect():
        assert base_of(row) == plain_base(row["text"])
        assert all(row["text"][s["start"] : s["end"]] == s["text"] and 0 <= s["score"] <= 1 for s in row["found"])
    found = {row["doc_id"]: base_of(row) for row in find_private(documents).collect()}
    assert found == {key: plain_base(text) for key, text in texts.items()}
    assert sum(map(len, found.values())) > 10


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab1234567890.@+-() _é\n", max_size=60), min_size=40, max_size=80))
def test_any_text(spark, many):
    rows = spark.createDataFrame([(text,) for text in many], "text string")
    assert all(base_of(row) == plain_base(row["text"]) for row in find_private(rows).collect())


def test_added_kinds(spark):
    cases = [
        ("account DE89 3704 0044 0532 0130 00 here", [("iban", 1.0)]), ("DE89370400440532013000", [("iban", 0.85)]),
        ("DE88 3704 0044 0532 0130 00", []), ("GB82WEST12345698765432,", [("iban", 0.85)]), ("SSN: 123-45-6789", [("social", 0.6)]),
        ("123-45-6789", []), ("SSN 666-45-6789", []), ("call 415-555-1234 now", [("national", 0.6)]), ("415-555-1234", []),
        ("phone +1 415-555-1234", [("phone", 0.9)]), ("version 1.2.3.4", [("ip", 0.35)]), ("server 1.2.3.4", [("ip", 0.85)]),
        ("my credit card 4111111111111111", [("card", 1.0)]), ("1.2.3.4 " + "x" * 60 + " server", [("ip", 0.6)]),
    ]
    rows = spark.createDataFrame([(text,) for text, _ in cases], "text string")
    found = {row["text"]: [(s["kind"], s["score"]) for s in row["found"]] for row in find_private(rows).collect()}
    assert found == dict(cases)
    assert [kind.name for kind in KINDS[:4]] == list(BASE)


def test_awkward(spark, awkward, no_docs):
    found = find_private(awkward).collect()
    assert len(found) == awkward.count() and all(row["found"] == [] for row in found if not row["text"])
    assert find_private(no_docs).count() == 0
    assert "Arrow" not in find_private(awkward)._jdf.queryExecution().toString() and "Exchange" not in find_private(awkward)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
