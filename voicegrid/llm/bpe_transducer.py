"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The merges (a rank for each token) decide which two tokens may stand side by
side: those that merging their joined bytes gives back unchanged.  A sequence
is the BPE encoding of its bytes if and only if all its neighbours may stand
side by side, so each prefix of the input has one last token.  The transducer
reads bytes and keeps, for every place at which a token may still begin, the
last token before it; its move on a byte gives the token that ends there.  What
the paths to all such places share is fixed and comes out, so the lookahead is
bounded by the longest token and ``LOOKAHEAD`` bytes.  States and moves are
made when an input first needs them and dropped together when there are too
many.

Texts are cut where every match of the pattern surely ends (a single space or
line feed between other characters), and bounded tables keep the ids of pieces and
matches seen before; only new ones run through the pattern and the transducer.

Decoding joins the tokens' bytes; :class:`Utf8Stream` turns a stream of byte
pieces into text with a state machine that holds back at most three bytes.

Defined results: null is empty; empty texts have no tokens; repeated rows are
encoded alike; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from voicegrid.llm.text_arrays import binaries, column_of, in_chunks
from voicegrid.llm.worker_state import kept, let_go

MAX_STATES = 300_000
MAX_PIECES = 250_000
#: Bytes between two looks for fixed tokens within one piece.
LOOKAHEAD = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes single pieces of bytes by merge ranks."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token) + 1)}
        self.lengths = {rank: (rank, len(token)) for token, rank in ranks.items()}
        self.max_states = max_states
        self._forget()

    def _forget(self) -> None:
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.ends: dict[bytes, tuple] = {}
        # A state: the longest end of the input that begins a token, and for this and each shorter end that
        # begins a token too (``sizes``, the empty one last) the last token before it (-1: the input's start).
        # States are numbered in steps of 256, so that a state plus a byte names a move.
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple[bytes, tuple[int, ...]]] = []
        self.last: list[tuple[int, int]] = []
        self.sizes: dict[bytes, tuple[int, ...]] = {b"": (0,)}
        self.moves: dict[int, int] = {}
        self._number((b"", (-1,)))

    def _number(self, state: tuple[bytes, tuple[int, ...]]) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states) << 8
            self.states.append(state)
            self.last.append(self.lengths.get(state[1][-1]))
        return number

    def merge(self, piece: bytes, parts_left: int = 1) -> list[int]:
        """Plain BPE: joins the lowest-ranked pair until none, or ``parts_left`` parts, are left."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > parts_left:
            rank, at = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; none for a byte."""
        found = self.halves.get(token)
        if found is None:
            parts = self.merge(self.tokens[token], 2)
            found = self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else ()
        return found or None

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border between two tokens.

        The tokens' merges are undone from the last one back.  At each moment
        the parts at the border would merge if their join had a lower rank than
        the merges that had not happened yet.
        """
        next_rank = 1 << 60
        while True:
            if self.ranks.get(self.tokens[left] + self.tokens[right], 1 << 60) < next_rank:
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            # Of two merges that may be undone, the later one goes first: the higher rank, and on
            # equal ranks the right one, for the leftmost pair merges first.
            if b is None or (a is not None and left > right):
                next_rank, left = left, a[1]
            else:
                next_rank, right = right + 1, b[0]

    def _end(self, end: bytes) -> tuple:
        """For a grown end: the tokens it ends with (and where they begin), the kept end, the kept lengths."""
        found = self.ends.get(end)
        if found is None:
            tails = [(size, end[-size:]) for size in range(len(end), 0, -1)]
            tokens = [(self.ranks[tail], size - 1) for size, tail in tails if tail in self.ranks]
            sizes = [size for size, tail in tails if tail in self.prefixes]
            kept_end = end[-sizes[0] :]
            self.sizes[kept_end] = (*sizes, 0)
            found = self.ends[end] = (tokens, kept_end, sizes)
        return found

    def _move(self, state: int, byte: int) -> int:
        """Makes the transition of a state on a byte and returns the next state."""
        end, values = self.states[state >> 8]
        before = dict(zip(self.sizes[end], values))
        tokens, kept, sizes = self._end(end + bytes((byte,)))
        for token, start in tokens:
            left = before[start]
            apart = left < 0 or self.pairs.get((left, token))
            if apart is None:
                apart = self.pairs[left, token] = self._stay_apart(left, token)
            if apart:
                break
        else:
            raise ValueError("a byte has no token")
        grown = (kept, (*[before[size - 1] for size in sizes], token))
        if len(self.states) > self.max_states:
            self._forget()
            self.sizes[kept] = (*sizes, 0)
            return self._number(grown)
        number = self.moves[state + byte] = self._number(grown)
        return number

    def stream(self, piece: bytes) -> Iterator[int]:
        """Tokens of a piece; each comes out once every way in which the input may go on has it."""
        state, last, done = 0, [], 0
        for at, byte in enumerate(piece, 1):
            known = self.moves.get(state + byte)
            state = self._move(state, byte) if known is None else known
            last.append(self.last[state >> 8][0])
            if at % LOOKAHEAD == 0:
                fixed = self._fixed(last, done, at - len(self.states[state >> 8][0]), at)
                yield from fixed
                done += sum(len(self.tokens[t]) for t in fixed)
        yield from self._path(last, done, len(piece))

    def short(self, piece: bytes) -> list[int]:
        """The same for a piece of a few bytes, all at once."""
        if len(self.states) > self.max_states - LOOKAHEAD:
            self._forget()
        state, trail, known = 0, [], self.moves.get
        for byte in piece:
            move = state + byte
            state = known(move)
            if state is None:
                state = self._move(move & ~255, byte)
            trail.append(state)
        last, high, out = self.last, len(piece), []
        while high:
            token, size = last[trail[high - 1] >> 8]
            out.append(token)
            high -= size
        return out[::-1]

    def _path(self, last: list[int], low: int, high: int) -> list[int]:
        """Tokens from ``low`` to ``high``, walking back along the last tokens."""
        out = []
        while high > low:
            out.append(last[high - 1])
            high -= len(self.tokens[out[-1]])
        return out[::-1]

    def _fixed(self, last: list[int], done: int, low: int, high: int) -> list[int]:
        """What the paths to all places from ``low`` to ``high`` begin with."""
        paths = [self._path(last, done, max(place, done)) for place in range(low, high + 1)]
        shared = 0
        while all(len(p) > shared and p[shared] == paths[0][shared] for p in paths):
            shared += 1
        return paths[0][:shared]

    def encode(self, piece: bytes) -> list[int]:
        """A piece that is a token itself is that token; any other goes through the transducer."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.short(piece) if len(piece) < LOOKAHEAD else list(self.stream(piece))


class _Uneven(Exception):
    """A piece begins or ends with white space."""


#: Between these characters one space always belongs to what follows it.
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class _Pieces(dict):
    """Ids, as bytes, of pieces seen before.

    A full table is set aside and met once more before it goes, so pieces in use stay.
    """

    def __init__(self, encoder: Encoder, lead: str) -> None:
        super().__init__()
        self.encoder, self.lead = encoder, lead
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Uneven
        if "\n" in piece:
            first, *rest = piece.split("\n")
            plain = self.encoder.plain
            return self.encoder.line_feed.join([self[first], *(plain[x] for x in rest)])
        if len(self) >= self.encoder.max_pieces:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(piece)
        ids = self[piece] = self.encoder.of_piece(self.lead + piece) if ids is None else ids
        return ids


class Encoder:
    """Whole texts to ids (little-endian unsigned 32-bit), piece by piece; tables hold ``max_pieces`` at most."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES) -> None:
        self.max_pieces = max_pieces
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.matches: dict[str, bytes] = {}
        self.matches_before: dict[str, bytes] = {}
        self.spaced, self.plain = _Pieces(self, " "), _Pieces(self, "")
        self.line_feed = self.of_piece("\n")

    def of_piece(self, piece: str) -> bytes:
        matches = self.pattern.findall(piece)
        return b"".join([self.matches.get(match) or self._of_match(match) for match in matches])

    def _of_match(self, match: str) -> bytes:
        if len(self.matches) >= self.max_pieces:
            self.matches, self.matches_before = {}, self.matches
        packed = self.matches_before.get(match)
        if packed is None:
            ids = self.transducer.encode(match.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        self.matches[match] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            return self.line_feed.join([self._line(line) for line in text.split("\n")])
        except _Uneven:
            first, *rest = _SINGLE_SPACE.split(text)
            return self._uneven("", first) + b"".join([self._uneven(" ", piece) for piece in rest])

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))

    def _uneven(self, lead: str, piece: str) -> bytes:
        try:
            return (self.spaced if lead else self.plain)[piece]
        except _Uneven:
            return self.of_piece(lead + piece)


class Utf8Stream:
    """Incremental UTF-8 decoding: bytes in pieces of any cut, text out as soon as characters end.

    Invalid bytes become U+FFFD, as in Python's ``errors="replace"``.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Length of an incomplete but valid character at the end (0 to 3)."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if back >= size:
                return 0
            if back > 1:
                # The second byte's range depends on the first.
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, piece: bytes) -> str:
        data = self.held + piece
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def encoder_for(path: str, pattern: str, small: bool = False) -> Encoder:
    """One encoder for each vocabulary and worker."""

    def make() -> Encoder:
        encoder = Encoder(read_ranks(path), pattern, MAX_PIECES // 5 if small else MAX_PIECES)
        if small:
            encoder.transducer.max_states = MAX_STATES // 3
        return encoder

    return kept("byte pairs", (path, pattern, small), make)


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder_for(path, pattern)
        for batch in in_chunks(batches, "text"):
            ids = [own.encode(text or "") for text in column_of(batch, "text").to_pylist()]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), counts, binaries(ids)], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and the ``text`` of binary ids, decoded token by token as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            texts = []
            for ids in column_of(batch, "ids").to_pylist():
                stream, out = Utf8Stream(), []
                ids = np.frombuffer(ids or b"", "<u4")
                for low in range(0, len(ids), 4096):
                    out.append(stream.feed(b"".join(map(tokens.__getitem__, ids[low : low + 4096].tolist()))))
                texts.append("".join([*out, stream.close()]))
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
    small: bool = False,
) -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns both digests.

    ``doc_id``, ``n_tokens``, ``ids_sha256`` of the decimal ids joined by one
    space, ``decoded_sha256`` of the decoded bytes and, if asked for, ``ids``.
    ``small`` takes smaller tables and lets go of them after each task, for
    workers that other operators use too; results are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder_for(path, pattern, small)
        token = own.transducer.tokens.__getitem__
        decimal = {rank: str(rank) for rank in own.transducer.tokens}.__getitem__
        for batch in in_chunks(batches, "text"):
            counts, id_digests, digests, packed = [], [], [], []
            for text in column_of(batch, "text").to_pylist():
                raw = own.encode(text or "")
                ids = np.frombuffer(raw, "<u4").tolist()
                packed += [raw] if with_ids else []
                stream = Utf8Stream()
                decoded = stream.feed(b"".join(map(token, ids))) + stream.close()
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                digests.append(hashlib.sha256(decoded.encode()).hexdigest())
            columns = [column_of(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [binaries(packed)] * with_ids, names + ["ids"] * with_ids)
        if small:
            let_go()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + ", ids binary" * with_ids)
