"""Token ids of a corpus in wavelet files, in the order of the document ids.

Documents are dealt out by id range and sorted within each task; a task encodes
them with a public tokenizer and closes a file at ``SHARD_TOKENS`` tokens (a
single longer document makes a longer file).  Texts are cut at spaces and line
feeds, which no token of a tokenizer that drops white space crosses; a bounded
table keeps the ids of words seen before, by the words' 64-bit hashes, and the
library encodes the others.  Special tokens that stand in a text get their ids.
The manifest holds one row a file.  Only the tokens of each task, one number a
task, pass through the driver.

Defined results: null is empty; a document without tokens has its end id alone;
repeated ids stay separate documents next to each other; null ids come first;
an empty table has no file.  The id must be an integer; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voicegrid.llm.shared_files import new_folder, open_file, write_file
from voicegrid.llm.text_arrays import Words, column_of, in_chunks, split_words, utf8
from voicegrid.llm.wavelet import WaveletFile, build
from voicegrid.llm.worker_state import kept
from voicegrid.session import scratch_table

SHARD_TOKENS = 2_000_000
MAX_WORDS = 700_000
#: Bytes of words: all but space and line feed.
BETWEEN_SPACES = ~np.isin(np.arange(256), [10, 32])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
MARKS = ".,"


class WordEncoder:
    """Ids of whole texts, word by word, for tokenizers that drop white space.

    Words are found and hashed on the bytes of many texts at once; a word's ids
    stand in one pool, at a place that a sorted table of hashes names.  Special
    tokens in a text become their ids, as the library has it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.word_end[number] = bool(suffix) and token.endswith(suffix)
        # Marks that are one token are taken off words.
        self.mark_ids = np.full(256, -1)
        for sign, found in zip(MARKS, self.tokenizer.encode_batch_fast(list(MARKS), add_special_tokens=False)):
            if len(found.ids) == 1 and self.word_end[found.ids[0]]:
                self.mark_ids[ord(sign)] = found.ids[0]
        self.is_mark = self.mark_ids >= 0
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _ids(self, words: list[str]) -> list[list[int]]:
        """The library's ids of words; words of letters alone go to it many at a time, for each ends with its only word-end token."""
        out: list[list[int] | None] = [None] * len(words)
        letters = [k for k, word in enumerate(words) if word.isalpha() and (word.isascii() or word.lower().isalpha())]
        groups = [letters[k : k + 256] for k in range(0, len(letters), 256)] if self.word_end.any() else []
        joined = [" ".join(words[k] for k in group) for group in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = found.ids  # the library makes a new list at each look
            ends = (np.flatnonzero(self.word_end[np.array(ids, np.int64)]) + 1).tolist()
            if len(ends) == len(group):
                for k, low, high in zip(group, [0, *ends], ends):
                    out[k] = ids[low:high]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)):
            out[k] = found.ids
        return out

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Puts new words into the table."""
        found = self._ids(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
        at = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.starts, self.sizes = (np.concatenate(x)[at] for x in ((self.keys, keys), (self.starts, starts), (self.sizes, sizes)))

    def _split(self, texts: pa.Array) -> tuple[Words, np.ndarray]:
        """Words, and for each the id of a single mark behind it, or -1.

        A full stop or comma between a letter and a space is a token of its
        own, so it is taken off and most words are met in one form only.  For
        the same reason letters are made small, unless a special token may
        stand there, which large letters would not be.
        """
        raw, offsets = utf8(texts)
        raw = raw.copy()
        last = np.zeros(len(raw) + 1, bool)
        last[offsets] = True
        mark = np.flatnonzero(self.is_mark[raw])
        mark = mark[~last[mark]]  # not a text's first sign
        after = np.where(last[mark + 1], 32, raw[np.minimum(mark + 1, len(raw) - 1)])
        mark = mark[_LETTER[raw[mark - 1]] & ~BETWEEN_SPACES[after]]
        ids = self.mark_ids[raw[mark]]
        raw[mark] = 32
        column = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(raw)) if len(texts) else texts
        words = split_words(column, BETWEEN_SPACES, lower=b"<|" not in raw.tobytes())
        behind = np.full(len(words.ends), -1)
        behind[np.searchsorted(words.ends, mark)] = ids
        return words, behind

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text's with the end id behind them; and the number of ids of each text."""
        words, behind = self._split(texts)
        place, keys = pd.factorize(words.hashes)
        if len(self.keys) > MAX_WORDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            first = np.empty(len(keys), np.int64)
            first[place[::-1]] = np.arange(len(place))[::-1]
            raw = words.data.tobytes()
            self._learn(keys[new], [raw[words.starts[k] : words.ends[k]].decode() for k in first[new]])
            at = np.searchsorted(self.keys, keys)
        sizes, starts = self.sizes[at][place], self.starts[at][place]
        before = np.concatenate([[0], np.cumsum(sizes + (behind >= 0))])
        own = np.diff(before[words.first])
        # Each word's ids, its mark, and behind a text's last word the end id.
        text_of = np.repeat(np.arange(len(own)), np.diff(words.first))
        target = before[:-1] + text_of
        out = np.full(before[-1] + len(own), end, np.uint32)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(target, sizes) + inside] = self.pool[np.repeat(starts, sizes) + inside]
        marked = np.flatnonzero(behind >= 0)
        out[target[marked] + sizes[marked]] = behind[marked]
        return out, own + 1


def write_shards(
    docs: DataFrame, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Writes the files and returns the manifest: ``part``, ``before`` (tokens earlier in the part), ``path``,
    ``n_tokens`` and ``n_docs``."""
    folder = new_folder(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("words", tokenizer_path, lambda: WordEncoder(tokenizer_path))
        part, before, held = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        arrays: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal before
            values = np.concatenate(arrays)
            content = build(values, max(encoder.bits, end_id.bit_length()), ids, np.array([len(x) for x in arrays]))
            row = {"part": part, "before": before, "path": write_file(folder, ".wvlt", content), "n_tokens": len(values), "n_docs": len(ids)}
            before += len(values)
            ids.clear()
            arrays.clear()
            return pa.RecordBatch.from_pylist([row])

        for batch in in_chunks(batches, "text"):
            tokens, sizes = encoder.encode(column_of(batch, "text"), end_id)
            for doc, tokens in zip(column_of(batch, "doc_id").to_pylist(), np.split(tokens, np.cumsum(sizes)[:-1])):
                if arrays and held + len(tokens) > shard_tokens:
                    yield close()
                    held = 0
                ids.append(doc)
                arrays.append(tokens)
                held += len(tokens)
        if arrays:
            yield close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return scratch_table(
        rows.mapInArrow(run, "part long, before long, path string, n_tokens long, n_docs long"), "manifest"
    )


def _tasks(manifest: DataFrame) -> int:
    """A task for each few files, so that adaptive execution doesn't join rows that stand for whole files."""
    return max(1, min(manifest.count(), 100_000))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (tokens of all documents before), ``n_tokens``, ``ids_crc32``."""
    starts, total = {}, 0
    for part, tokens in sorted(manifest.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts[part], total = total, total + tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as handle:
                    shard = WaveletFile(handle)
                    tokens = shard.tokens().astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(shard.lengths)])
                sums = [zlib.crc32(tokens[low:high]) for low, high in zip(offsets[:-1], offsets[1:])]
                first = starts[row["part"]] + row["before"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (shard.ids, offsets[:-1] + first, shard.lengths, sums)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = manifest.select("part", "before", "path").repartition(_tasks(manifest), "path")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def find_token(manifest: DataFrame, token: int, limit_per_shard: int | None = None) -> DataFrame:
    """Occurrences of a token in every file without reading whole files: ``path``, ``n``, ``positions``.

    ``limit_per_shard`` bounds the listed positions of each file, not the count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in column_of(batch, "path").to_pylist():
                with open_file(path) as handle:
                    shard = WaveletFile(handle)
                    count = shard.rank(token)
                    listed = count if limit_per_shard is None else min(count, limit_per_shard)
                    row = {"path": path, "n": count, "positions": [shard.select(token, k) for k in range(listed)]}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("n", pa.int64()), ("positions", pa.list_(pa.int64()))]))

    return manifest.select("path").repartition(_tasks(manifest), "path").mapInArrow(run, "path string, n long, positions array<long>")
