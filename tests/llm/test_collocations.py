"""Phrases against a plain count over all texts, and tile counting against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from voicegrid.llm import collocations as module
from voicegrid.llm.collocations import collocations, count_pairs, pack, unpack

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    """Rows of (text, lang), as the contract words it."""
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    f[lang or "und", tuple(words[k : k + size])] += 1
    held = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    longer = {}
    for (lang, words), a in held.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                part = (lang, words[k : k + size])
                longer[part] = max(longer.get(part, 0), a)
    for lang in n:
        rows = []
        for (its, words), a in held.items():
            if its == lang and not 100 * longer.get((its, words), -1) >= 80 * a:
                cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def prose(seed, size):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "hall", "a", "ÄB", "漢字", "x-y", "Zürich", "\U0001F600"]
    return "".join(rng.choice(words[: rng.randint(2, 12)]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "; "]) for _ in range(size))


@pytest.fixture(params=[(200_000, 65_536), (60, 8)], ids=["plain", "small piles"])
def sizes(request, monkeypatch):
    tokens, dense = request.param
    monkeypatch.setattr(module, "SEGMENT_TOKENS", tokens)
    monkeypatch.setattr(module, "DENSE", dense)
    monkeypatch.setattr(module, "BUCKET_WINDOWS", dense * 16)


def test_brute_force(spark, sizes):
    rows = [(prose(k, 60), ["en", "de", None][k % 3]) for k in range(60)]
    rows += [("New York city hall is big. " * 40, "en"), ("new YORK", "en"), (None, "en"), ("", None), (" \t\n", "xx"), ("Only. Single. Words.", "yy"), ("q" * 5000, "en")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    found = sorted(map(tuple, collocations(df, least=6).collect()))
    assert found == brute(rows, 6) and len(found) > 50
    assert sorted(map(tuple, collocations(df, least=6, top=4).collect())) == brute(rows, 6, 4)


def test_awkward(spark, awkward, no_docs):
    rows = [(row["text"], row["lang"]) for row in awkward.collect()]
    assert sorted(map(tuple, collocations(awkward, least=3).collect())) == brute(rows, 3)
    assert collocations(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 3000), st.integers(1, 1 << 40)), max_size=200), st.integers(1, 40))
def test_tiles(pairs, dense):
    wanted = Counter()
    for a, b, n in pairs:
        wanted[a << 32 | b] += n
    before, module.DENSE = module.DENSE, dense
    try:
        codes, counts = count_pairs(np.array([a << 32 | b for a, b, _ in pairs], np.uint64), np.array([n for *_, n in pairs], np.int64))
    finally:
        module.DENSE = before
    assert dict(zip(codes.tolist(), counts.tolist())) == wanted and (np.diff(codes.astype(np.int64)) > 0).all()
    assert (unpack(pack(codes)) == codes).all()
