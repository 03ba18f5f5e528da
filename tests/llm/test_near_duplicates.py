"""Circulant MinHash and components against exact joins."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tests.llm.conftest import prose
from voicegrid.llm import circulant_minhash as M
from voicegrid.llm.components import connected_components


def exact(rows, size, percent=80):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        n = min(size, len(words))
        sets.append((i, frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if n else frozenset()))
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, (_, x)), (b, (_, y)) in combinations(enumerate(sets), 2):
        both = len(x & y)
        if both and 100 * both >= percent * (len(x) + len(y) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))


def found(frame):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect())


@pytest.mark.parametrize("size", [2, 5])
def test_documents_equal_exact_join(documents, texts, size):
    assert found(M.near_duplicates(documents, shingle=size)) == exact(texts.items(), size)


def test_borderline_group_loses_no_link(spark):
    rng = random.Random(5)
    base = prose(9, 120).split()
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(2, 10)):
            words[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(M.near_duplicates(docs, shingle=2)) == exact(rows, 2)


def test_awkward_documents(awkward, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = M.near_duplicates(awkward, shingle=2)
    assert found(got) == exact(rows, 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())
    assert M.near_duplicates(no_docs).count() == 0


def test_signature_is_the_shifted_minimum():
    values = np.array([3, 99, 12345678901234567890], np.uint64)
    table = M.shifted_permutation()
    assert sorted(table[: M.POSITIONS, 0].tolist())[:5] == [0, 1, 2, 3, 4]
    assert (table[0, 1:] == table[1, :-1]).all() and (table[M.POSITIONS - 1, 1:] == table[0, :-1]).all()
    places = (M.mix(values ^ np.uint64(0xA5A5A5A5)) & np.uint64(M.POSITIONS - 1)).astype(int)
    order = table[:, 0]
    expected = [min(order[(p + k) % M.POSITIONS] for p in places) for k in range(M.WIDTH)]
    assert M.signature(values).tolist() == expected


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8):
        agree = []
        for _ in range(40):
            common, own = rng.integers(0, 2**63, int(600 * share)), rng.integers(0, 2**63, 600 - int(600 * share))
            a, b = np.concatenate([common, own[::2]]).astype(np.uint64), np.concatenate([common, own[1::2]]).astype(np.uint64)
            agree.append((M.signature(a) == M.signature(b)).mean())
        assert abs(np.mean(agree) - share) < 0.03


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 160)} == {100} and got[201] == 200
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
