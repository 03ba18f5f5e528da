"""Byte-pair transducer against the library, wavelet shards and round trips."""

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from voicegrid.llm import bpe_transducer as B, token_shards as S, wavelet as V
from voicegrid.llm.queries import op6_bpe_transducer

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = B.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = B.Encoder(RANKS, public_tokenizers.PATTERN)
ALPHABET = " \n\t  abcdeABC'sß漢\U0001F600é12.,!?\x1c\x85\xa0-="


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_encoding_equals_the_library(text):
    assert ids_of(ENCODER.encode(text)) == LIBRARY.encode_ordinary(text)


def test_documents_and_long_pieces_equal_the_library(texts):
    own = B.Encoder(RANKS, public_tokenizers.PATTERN)
    own.transducer.max_states = 500
    runs = ["a" * 3_000, "=-" * 700, " " * 500 + "x", "ab" * 900 + "漢" * 300]
    for text in [*texts.values(), *runs]:
        assert ids_of(own.encode(text)) == LIBRARY.encode_ordinary(text)
    for run in runs:
        piece = run.strip().encode()
        assert list(own.transducer.stream(piece)) == own.transducer.merge(piece)


def test_tokens_come_out_before_the_end():
    def endless():
        while True:
            yield from b"lookahead"

    stream = B.Transducer(RANKS).stream(endless())
    assert len([next(stream) for _ in range(50)]) == 50


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=20))
def test_stream_decoding_equals_decoding_at_once(data, cuts):
    stream, out, at = B.Utf8Stream(), [], 0
    for cut in cuts:
        out.append(stream.feed(data[at : at + cut]))
        assert len(stream.held) <= 3
        at += cut
    out += [stream.feed(data[at:]), stream.close()]
    assert "".join(out) == data.decode("utf-8", "replace")


def test_query_equals_the_library(spark, texts):
    rows = op6_bpe_transducer(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_awkward_round_trip(awkward, no_docs):
    back = B.decode(B.encode(awkward, PATH, public_tokenizers.PATTERN), PATH)
    expected = Counter((r["doc_id"], r["text"] or "") for r in awkward.collect())
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == expected
    assert B.round_trip(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    assert B.decode(B.encode(no_docs, PATH, public_tokenizers.PATTERN), PATH).count() == 0


@pytest.mark.parametrize("count", [0, 1, 65_535, 65_536, 65_537, 150_000])
def test_wavelet_file(count):
    rng = np.random.default_rng(count)
    values = (rng.integers(0, 49_408, count) // rng.integers(1, 4_000)).astype(np.uint32)
    file = V.WaveletFile(io.BytesIO(V.build(values, 16, [7, None], np.array([count, 0]))))
    assert (file.tokens() == values).all() and file.ids == [7, None] and file.lengths.tolist() == [count, 0]
    for at in rng.integers(0, max(count, 1), 15 if count else 0).tolist():
        symbol = int(values[at])
        places = np.flatnonzero(values == symbol)
        assert file.access(at) == symbol
        assert file.rank(symbol) == len(places) and file.rank(symbol, 0, at) == (values[:at] == symbol).sum()
        assert file.select(symbol, len(places) - 1) == places[-1]
    assert file.rank(1 << 16) == 0 and file.rank(65_535) == 0


def expected_shards(rows):
    library, start, out = Tokenizer.from_file(WORDS), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_shards_equal_the_library(documents, texts):
    manifest = S.write_shards(documents, WORDS, end_id=1, shard_tokens=3_000)
    assert manifest.count() > 5
    got = sorted(tuple(r) for r in S.read_shards(manifest).collect())
    assert got == expected_shards(texts.items())
    ends = S.find_token(manifest, 1).collect()
    assert sum(r["n"] for r in ends) == len(texts)
    assert all(len(r["positions"]) == r["n"] for r in ends)


def test_awkward_shards(awkward, no_docs):
    got = S.read_shards(S.write_shards(awkward, WORDS, end_id=1)).collect()
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, n, c) for i, _, n, c in expected_shards(rows))
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [a for a, _ in starts] == np.cumsum([0] + [n for _, n in starts])[:-1].tolist()
    assert S.read_shards(S.write_shards(no_docs, WORDS, end_id=1)).count() == 0


def test_words_of_any_kind_equal_the_library():
    rng, own, library = random.Random(3), S.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    signs = [*" \n\t  abcİΣσßÀé́.,!?'s\x1c\x85123漢", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof text|>"]
    for _ in range(600):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 9))] + [None]
        ids, sizes = own.encode(pa.array(texts), 1)
        wanted = [library.encode(text or "", add_special_tokens=False).ids + [1] for text in texts]
        assert sizes.tolist() == list(map(len, wanted)) and ids.tolist() == sum(wanted, [])


def test_special_tokens_and_few_kept_words(monkeypatch, spark):
    monkeypatch.setattr(S, "MAX_WORDS", 5)
    rows = [(k, f"word{k} the<|endoftext|>end <|startoftext|> {'x' * k}, New. " * (k + 1)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in S.read_shards(S.write_shards(docs, WORDS, end_id=1, shard_tokens=100)).collect())
    assert got == expected_shards(rows)
