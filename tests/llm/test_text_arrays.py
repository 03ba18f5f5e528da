"""Vectorised words against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from voicegrid.llm.text_arrays import ALPHANUMERIC, NOT_SPACE, in_chunks, split_words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ z09\n\t.,é漢\x85\x1c'", max_size=30)), max_size=8)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_equal_regular_expressions(texts):
    for kind, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = split_words(pa.array(texts, pa.string()), kind)
        data = words.data.tobytes()
        got = [data[a:b].decode() for a, b in zip(words.starts, words.ends)]
        expected = [re.findall(pattern, lowered(text)) for text in texts]
        assert got == [word for each in expected for word in each]
        assert np.diff(words.first).tolist() == [len(each) for each in expected]
        by_hash = {}
        for word, value in zip(got, words.hashes.tolist()):
            assert by_hash.setdefault(value, word) == word
        assert len(by_hash) == len(set(got))


def test_slices_and_segments_hash_alike():
    long = " ".join(f"w{k}" for k in range(300_000))
    words = split_words(pa.array(["skip me", long, "w1 w299999"]).slice(1), NOT_SPACE)
    assert len(set(words.hashes[:300_000].tolist())) == 300_000
    assert words.hashes[300_000] == words.hashes[1] and words.hashes[300_001] == words.hashes[299_999]


def test_chunks_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 50, 3, 3)] + [None]})
    pieces = list(in_chunks(iter([batch]), "text", 10))
    assert [x for p in pieces for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(pieces) > 2
