"""Benchmark decontamination with a distributed positional inverted index.

The training documents are cut into segments.  A segment stores, for each
term, the ascending positions at which it stands; a document's words take
consecutive positions and one free position follows each document, so no match
crosses documents.  Segments are rows of a Parquet table: building and
searching both run one segment at a time and shuffle no posting.

A search takes the test phrases in blocks of a stated number of words (a
block's phrases travel with the tasks), counts the postings of the block's
terms over all segments, and in each segment intersects offset-adjusted posting
lists, rarest term of the phrase first.

Defined results: null or empty texts have no words and no hits; a phrase
without words never occurs; repeated rows are separate documents; repeated test
rows count once by their id; null test ids are left out of the lists of ids but
their words still count as hit; empty tables give empty or hit-free results.
Other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voicegrid.llm.text_arrays import ALPHANUMERIC, binaries, column_of, in_chunks, split_words
from voicegrid.session import scratch_table

SEGMENT_BYTES = 4 << 20
BLOCK_WORDS = 2_000_000
WINDOW = 10


@dataclass
class Phrases:
    """Phrases over a sorted vocabulary; row i of ``terms`` has ``lengths[i]`` vocabulary numbers, then -1."""

    vocabulary: np.ndarray
    terms: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    names: list[str | None]

    def ordered(self, counts: np.ndarray) -> np.ndarray:
        """Offsets of each phrase's words, rarest term first."""
        weight = np.where(self.terms >= 0, counts[self.terms], np.iinfo(np.int64).max)
        return np.argsort(weight, axis=1, kind="stable").astype(np.int16)


def phrases_of(items: list[tuple], window: int) -> Phrases:
    """Windows of ``window`` words of every item; a shorter item is one phrase."""
    words = split_words(pa.array([text for _, text in items], pa.string()), ALPHANUMERIC)
    vocabulary, terms = np.unique(words.hashes, return_inverse=True)
    rows, owners = [], []
    for k, (low, high) in enumerate(zip(words.first[:-1], words.first[1:])):
        if high - low >= window:
            seen = np.lib.stride_tricks.sliding_window_view(terms[low:high], window)
        elif high > low:
            seen = np.full((1, window), -1)
            seen[0, : high - low] = terms[low:high]
        else:
            continue
        rows.append(seen)
        owners.append(np.full(len(seen), k))
    table = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    # Small numbers, for the phrases travel with every task.
    return Phrases(vocabulary, table.astype(np.int32), (table >= 0).sum(1).astype(np.int32), owner.astype(np.int32), [None if i is None else str(i) for i, _ in items])


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    """Test items in blocks of about ``block_words`` words, by a hash of the item."""
    texts = items.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("words")).distinct()
    characters = texts.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = 1 + characters // (2 * block_words)
    for k in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k) if blocks > 1 else texts
        yield [tuple(row) for row in part.collect()]


SEGMENT_SCHEMA = "segment string, terms binary, offsets binary, positions binary, firsts binary, n_words binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the segments of all documents to shared scratch space and returns them.

    Each segment is stored under a name of its own, since two of them may hold equal texts.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text", SEGMENT_BYTES):
            words = split_words(column_of(batch, "text"), ALPHANUMERIC)
            counts = np.diff(words.first)
            firsts = words.first[:-1] + np.arange(len(counts))
            positions = np.arange(len(words.hashes)) + np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(words.hashes, kind="stable")
            terms, starts = np.unique(words.hashes[order], return_index=True)
            offsets = np.append(starts, len(order)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]), binaries([terms.tobytes()]), binaries([offsets.tobytes()]),
                    binaries([positions[order].astype(np.int32).tobytes()]),
                    binaries([firsts.astype(np.int64).tobytes()]), binaries([counts.astype(np.int64).tobytes()]),
                    pa.array([column_of(batch, "id").to_pylist()], pa.list_(batch.schema.field("id").type)),
                ],
                ["segment", "terms", "offsets", "positions", "firsts", "n_words", "ids"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = f"ids array<{rows.schema['id'].dataType.simpleString()}>"
    return scratch_table(rows.mapInArrow(segments, f"{SEGMENT_SCHEMA}, {ids}"), "segments")


class Segment:
    """One stored segment, open for search."""

    def __init__(self, row: dict) -> None:
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.offsets = np.frombuffer(row["offsets"], np.int32)
        self.positions = np.frombuffer(row["positions"], np.int32)
        self.firsts = np.frombuffer(row["firsts"], np.int64)
        self.n_words = np.frombuffer(row["n_words"], np.int64)
        self.ids = row["ids"]

    def slots(self, vocabulary: np.ndarray) -> np.ndarray:
        """The place of each vocabulary term in this segment, or -1."""
        if not len(self.terms):
            return np.full(len(vocabulary), -1)
        at = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        return np.where(self.terms[at] == vocabulary, at, -1)

    def postings(self, slot: int) -> np.ndarray:
        return self.positions[self.offsets[slot] : self.offsets[slot + 1]]

    def span(self) -> int:
        return int(self.firsts[-1] + self.n_words[-1] + 1) if len(self.firsts) else 0


def _exact(segment: Segment, phrases: Phrases, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase numbers and start positions of every occurrence.

    Phrases share their lists, so they are intersected in groups: all phrases
    with the same rarest term at the same offset start from one list.
    """
    slots = segment.slots(phrases.vocabulary)
    slot_of = np.where(phrases.terms >= 0, slots[phrases.terms], -2)
    alive = np.flatnonzero((slot_of != -1).all(1))
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = order[alive, 0]
    lead_slot = slot_of[alive, lead]
    counts = segment.offsets[lead_slot + 1] - segment.offsets[lead_slot]
    steps = np.searchsorted(np.cumsum(counts, dtype=np.int64), np.arange(0, max(1, int(counts.sum())), 1 << 20))
    found_phrases, found_starts = [], []
    # The term at each position, from the stored lists of the terms in use: one look says whether
    # an offset-adjusted list holds a position.
    at_position = np.full(segment.span() + phrases.terms.shape[1], -1, np.int32)
    for slot in np.unique(slot_of[alive]):
        if slot >= 0:
            at_position[segment.postings(slot)] = slot
    for low, high in zip(steps, np.append(steps[1:], len(alive))):
        if low == high:
            continue
        n = counts[low:high]
        phrase = np.repeat(alive[low:high], n)
        start = np.concatenate([segment.postings(s) for s in lead_slot[low:high]]).astype(np.int64)
        start -= np.repeat(lead[low:high], n)
        keep = start >= 0
        phrase, start = phrase[keep], start[keep]
        for k in range(1, phrases.terms.shape[1]):
            if not len(phrase):
                break
            offset = order[phrase, k]
            wanted = slot_of[phrase, offset]
            keep = (wanted == -2) | (at_position[start + offset] == wanted)
            phrase, start = phrase[keep], start[keep]
        found_phrases.append(phrase)
        found_starts.append(start)
    if not found_phrases:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_phrases), np.concatenate(found_starts)


def _term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Postings of each vocabulary term over all segments."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, offsets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms, sizes = np.frombuffer(terms, np.uint64), np.diff(np.frombuffer(offsets, np.int32))
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                    total += np.where(terms[at] == vocabulary, sizes[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    rows = index.select("terms", "offsets").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n"))
    for term, n in rows.collect():
        counts[term] = n
    return counts


def search(
    index: DataFrame, items: DataFrame, *, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document: ``id``, ``n_words``, ``ranges`` of hit words (start and end from 0) and ``items`` that hit it.

    A test set of one block takes one pass; of more, one pass a block, and the
    documents' hits are then brought together by segment and place.
    """
    passes = []
    for rows in item_blocks(items, item_id, item_text, block_words):
        phrases = phrases_of(rows, window)
        order = phrases.ordered(_term_counts(index, phrases.vocabulary))
        passes.append(_search_block(index, phrases, order))
    if len(passes) == 1:
        return passes[0].select("id", "n_words", "ranges", "items")
    union = passes[0]
    for more in passes[1:]:
        union = union.unionByName(more)
    return union.groupBy("segment", "place").agg(
        F.any_value("id").alias("id"), F.any_value("n_words").alias("n_words"),
        F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"),
    ).select("id", "n_words", "ranges", "items")


def _search_block(index: DataFrame, phrases: Phrases, order: np.ndarray) -> DataFrame:
    range_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                phrase, start = _exact(segment, phrases, order)
                ranges: list[list] = [[] for _ in segment.firsts]
                found: list[list] = [[] for _ in segment.firsts]
                if len(phrase):
                    marks = np.zeros(segment.span() + 1, np.int32)
                    np.add.at(marks, start, 1)
                    np.add.at(marks, start + phrases.lengths[phrase], -1)
                    hit = np.concatenate([[False], np.cumsum(marks) > 0, [False]])
                    lows, highs = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
                    for doc, low, high in zip(np.searchsorted(segment.firsts, lows, "right") - 1, lows, highs):
                        first = segment.firsts[doc]
                        ranges[doc].append({"start": int(low - first), "end": int(high - first)})
                    docs = np.searchsorted(segment.firsts, start, "right") - 1
                    for doc, item in np.unique(np.stack([docs, phrases.items[phrase]], 1), axis=0):
                        if phrases.names[item] is not None:
                            found[doc].append(phrases.names[item])
                size = len(segment.firsts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * size, pa.string()), pa.array(range(size), pa.int64()),
                        pa.array(segment.ids, batch.schema.field("ids").type.value_type),
                        pa.array(segment.n_words, pa.int64()), pa.array(ranges, range_type),
                        pa.array([sorted(set(x)) for x in found], pa.list_(pa.string())),
                    ],
                    ["segment", "place", "id", "n_words", "ranges", "items"],
                )

    found = "n_words long, ranges array<struct<start:bigint,end:bigint>>, items array<string>"
    return index.mapInArrow(run, f"segment string, place long, id {_id_type(index)}, {found}")


def _id_type(index: DataFrame) -> str:
    return index.schema["ids"].dataType.elementType.simpleString()


def proximity(
    index: DataFrame, items: DataFrame, *, slop: int, item_id: str = "item_id", item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Places where all distinct words of an item stand within ``slop`` words of its rarest one, in any order.

    Returns ``id``, ``item_id`` and the ``start`` and ``end`` word of the
    closest such group around each occurrence of the rarest word.
    """
    passes = []
    for rows in item_blocks(items, item_id, item_text, block_words):
        words = split_words(pa.array([text for _, text in rows], pa.string()), ALPHANUMERIC)
        vocabulary, terms = np.unique(words.hashes, return_inverse=True)
        counts = _term_counts(index, vocabulary)
        wanted = []
        for k, (name, _) in enumerate(rows):
            own = np.unique(terms[words.first[k] : words.first[k + 1]])
            if len(own):
                wanted.append((None if name is None else str(name), own[np.argsort(counts[own], kind="stable")]))
        passes.append(_near(index, vocabulary, wanted, slop))
    union = passes[0]
    for more in passes[1:]:
        union = union.unionByName(more)
    return union


def _near(index: DataFrame, vocabulary: np.ndarray, wanted: list[tuple], slop: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                slots = segment.slots(vocabulary)
                out: list[tuple] = []
                for name, own in wanted:
                    if (slots[own] < 0).any():
                        continue
                    base = segment.postings(slots[own[0]]).astype(np.int64)
                    doc = np.searchsorted(segment.firsts, base, "right") - 1
                    low, high = base.copy(), base.copy()
                    keep = np.ones(len(base), bool)
                    for term in own[1:]:
                        other = segment.postings(slots[term]).astype(np.int64)
                        at = np.searchsorted(other, base)
                        left, right = other[np.maximum(at - 1, 0)], other[np.minimum(at, len(other) - 1)]
                        near = np.where(np.abs(left - base) <= np.abs(right - base), left, right)
                        keep &= (np.abs(near - base) <= slop) & (np.searchsorted(segment.firsts, near, "right") - 1 == doc)
                        low, high = np.minimum(low, near), np.maximum(high, near)
                    for k in np.flatnonzero(keep):
                        first = segment.firsts[doc[k]]
                        out.append((segment.ids[doc[k]], name, int(low[k] - first), int(high[k] - first + 1)))
                columns = list(zip(*out)) or [[], [], [], []]
                kinds = [batch.schema.field("ids").type.value_type, pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds)], ["id", "item_id", "start", "end"]
                )

    return index.mapInArrow(run, f"id {_id_type(index)}, item_id string, start long, end long")


def item_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items``, ``ranges`` and ``contaminated``."""
    found = search(build_index(docs, id_col), items, window=window)
    merged = F.expr("aggregate(array_sort(ranges), named_struct('n', 0L, 'to', 0L), (a, r) -> named_struct("
                    "'n', a.n + greatest(r.end - greatest(r.start, a.to), 0L), 'to', greatest(a.to, r.end)), a -> a.n)")  # fmt: skip
    names = F.array_sort(F.array_distinct("items"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", merged.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        names.alias("items"), "ranges", (F.size("ranges") > 0).alias("contaminated"),
    )
