"""Phrases of two to four words that stand together more often than their parts explain, per language.

Words get numbers by language and falling frequency, so that the commonest
words share the first tiles of ``TILE`` x ``TILE`` pairs.  A tile that is
crowded in some pile of pairs is counted by direct address (``bincount``), all
others together as sorted coordinates.  Frequent pairs are ranked in turn and
become the first element of the next level: a phrase of three words is a pair
of (pair, word), one of four a pair of (triple, word).

What moves between tasks: distinct words of a segment (about ``SEGMENT_TOKENS``
words of text), which fetch their numbers by a join; and windows of four word
numbers, added up within each task before they are dealt out.  Windows meet the
table of frequent pairs in buckets by pair and third word, so that a pair that
fills a third of the corpus is spread.  No vocabulary is broadcast or collected.

Only words that occur ``least`` times can be part of a phrase that does, so
other words are left out of the windows, but all words count in ``n``.

Defined results: a null text has no words, a null language is ``und``; rows
with repeated ids are separate texts; an empty table has no phrases; ids and
other columns are ignored.  A language keeps its ``top`` first phrases, which
is the feature.  Numbers are exact: scores are whole quotients of decimals.
More than 2**31 different frequent words or phrases of one length are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voicegrid.llm.text_arrays import binaries, column_of, in_chunks, mix, split_words
from voicegrid.llm.worker_state import trim
from voicegrid.operators.canonical import number_rows
from voicegrid.session import scratch_table

SEGMENT_TOKENS = 500_000
TILE_BITS = 10
#: Pairs of one tile in one pile from which the tile is counted by direct address.
DENSE = 1 << 16
PILE = 500_000
BUCKET_WINDOWS = 250_000
SPREAD = 4
_ALL = np.arange(256)
#: Bytes that end a piece of text; pieces fall into words at spaces and tabs.
ENDS = np.isin(_ALL, [*b".,;:!?", *range(10, 14)])
IN_WORD = ~(ENDS | (_ALL == 32) | (_ALL == 9))
WINDOWS = "ab binary, c binary, d binary, n binary, size long"


def pack(codes: np.ndarray) -> bytes:
    """Ascending codes by their differences, which compress well."""
    return np.diff(codes, prepend=codes.dtype.type(0)).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint64), dtype=np.uint64)


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(counts[order], starts) if len(codes) else counts


def count_pairs(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``summed``, with crowded tiles by direct address; a code is a pair of 32-bit numbers."""
    side = np.uint64((1 << TILE_BITS) - 1)
    tile = (codes >> np.uint64(32 + TILE_BITS) << np.uint64(32)) | ((codes & np.uint64(0xFFFFFFFF)) >> np.uint64(TILE_BITS))
    tiles, place, sizes = np.unique(tile, return_inverse=True, return_counts=True)
    crowded = sizes >= DENSE
    if not crowded.any():
        return summed(codes, counts)
    thin = ~crowded[place]
    found = [summed(codes[thin], counts[thin])]
    cells = ((codes >> np.uint64(32)) & side) << np.uint64(TILE_BITS) | (codes & side)
    for k in np.flatnonzero(crowded):
        inside = place == k
        total = np.bincount(cells[inside].astype(np.int64), weights=counts[inside], minlength=1 << 2 * TILE_BITS)
        cell = np.flatnonzero(total).astype(np.uint64)
        base = (tiles[k] >> np.uint64(32) << np.uint64(32 + TILE_BITS)) | ((tiles[k] & np.uint64(0xFFFFFFFF)) << np.uint64(TILE_BITS))
        found.append((base | (cell >> np.uint64(TILE_BITS) << np.uint64(32)) | (cell & side), total[cell.astype(np.int64)].astype(np.int64)))
    codes, counts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(codes, kind="stable")
    return codes[order], counts[order]


class _Segment:
    """Words of many texts of any languages, with local numbers for the different ones."""

    def __init__(self) -> None:
        self.size = 0
        self.keys, self.places, self.words, self.langs, self.starts = [], [], [], [], []

    def add(self, batch: pa.RecordBatch) -> None:
        words = split_words(column_of(batch, "text"), IN_WORD)
        if not len(words.starts):
            return
        langs = column_of(batch, "lang").fill_null("und").dictionary_encode()
        salts = np.array([int.from_bytes(hashlib.blake2b(x.as_py().encode(), digest_size=8).digest()) for x in langs.dictionary], np.uint64)
        per_doc = np.diff(words.first)
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), per_doc)
        piece = np.cumsum(ENDS[words.data], dtype=np.int32)[words.starts]
        begins = np.r_[True, piece[1:] != piece[:-1]]
        begins[words.first[:-1][per_doc > 0]] = True
        keys, first, place = np.unique(mix(words.hashes ^ salts[lang]), return_index=True, return_inverse=True)
        low = words.starts[first]
        ends = np.cumsum(words.ends[first] - low)
        begin = ends - (words.ends[first] - low)
        letters = words.data[np.repeat(low - begin, np.diff(np.r_[begin, ends[-1]])) + np.arange(ends[-1])]
        offsets = np.r_[0, ends].astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))
        self.places.append(place.astype(np.int64) + sum(map(len, self.keys)))
        self.keys.append(keys)
        self.words.append(text)
        self.langs.append(langs.dictionary.cast(pa.large_string()).take(pa.array(lang[first])))
        self.starts.append(begins)
        self.size += len(place)

    def close(self) -> pa.RecordBatch:
        keys, first, inverse = np.unique(np.concatenate(self.keys), return_index=True, return_inverse=True)
        tokens = inverse[np.concatenate(self.places)]
        lists = lambda values: pa.array([values.tolist()])
        text, lang = (pa.concat_arrays(x).take(pa.array(first)).cast(pa.string()) for x in (self.words, self.langs))
        one = pa.array([0, len(keys)], pa.int32())
        row = pa.RecordBatch.from_arrays(
            [
                binaries([tokens.astype(np.int32).tobytes()]), binaries([np.packbits(np.concatenate(self.starts)).tobytes()]),
                pa.ListArray.from_arrays(one, text), pa.ListArray.from_arrays(one, lang), lists(np.bincount(tokens, minlength=len(keys))),
            ],
            ["tokens", "starts", "words", "langs", "counts"],
        )
        self.__init__()
        return row


def write_segments(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Stored segments with a number of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _Segment()
        for batch in in_chunks(batches, "text"):
            segment.add(batch)
            if segment.size >= SEGMENT_TOKENS:
                yield segment.close()
        if segment.size:
            yield segment.close()
        trim()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kept = rows.mapInArrow(run, "tokens binary, starts binary, words array<string>, langs array<string>, counts array<long>")
    return scratch_table(kept.withColumn("segment", F.monotonically_increasing_id()), "phrase-segments")


def _ranked(counted: DataFrame, order: list[str], name: str) -> DataFrame:
    """Stored rows with a number by falling ``n`` (within the columns before it in ``order``)."""
    place = [(-F.col(c)).alias(c) if c == "n" else F.col(c) for c in order]
    numbered = number_rows(counted.select(F.struct(*place).alias("_pos")))
    columns = [(-F.col("_pos.n")).alias("n") if c == "n" else F.col(f"_pos.{c}") for c in order]
    limit = F.when(F.col("_number") > 1 << 31, F.raise_error(F.lit("More than 2**31 frequent words or phrases of one length")).cast("bigint"))
    return scratch_table(numbered.select(F.coalesce(limit, F.col("_number") - 1).alias("id"), *columns), name)


def _rows(ab: np.ndarray, c: np.ndarray, d: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """Windows that are equal added up, ascending, in rows of bounded size."""
    rest = ((c + 1).astype(np.uint64) << np.uint64(32)) | (d + 1).astype(np.uint64)
    order = np.lexsort((rest, ab))
    ab, rest = ab[order], rest[order]
    starts = np.flatnonzero(np.r_[True, (ab[1:] != ab[:-1]) | (rest[1:] != rest[:-1])]) if len(ab) else np.zeros(0, np.int64)
    if not len(starts):
        return
    n, ab, c, d = np.add.reduceat(n[order], starts), ab[starts], c[order][starts], d[order][starts]
    for at in range(0, len(ab), BUCKET_WINDOWS):
        part = slice(at, at + BUCKET_WINDOWS)
        yield pack(ab[part]), c[part].astype(np.int32).tobytes(), d[part].astype(np.int32).tobytes(), n[part].astype(np.int64).tobytes(), len(ab[part])


def _window_batch(rows: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), (), ()]
    return pa.RecordBatch.from_arrays([*(binaries(list(x)) for x in columns[:4]), pa.array(list(columns[4]), pa.int64())], ["ab", "c", "d", "n", "size"])


def _read(columns: dict, at: int) -> tuple[np.ndarray, ...]:
    return unpack(columns["ab"][at]), *(np.frombuffer(columns[k][at], t) for k, t in (("c", np.int32), ("d", np.int32), ("n", np.int64)))


def windows_of(segments: DataFrame, words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stored windows (a, b, c, d) of word numbers, with their counts; c and d are -1 where the phrase can't go on."""
    fetched = words.join(vocabulary.select("id", "lang", "word"), ["lang", "word"]).select("segment", "local", "id")
    numbers = fetched.groupBy("segment").agg(F.collect_list(F.struct("local", "id")).alias("numbers"))
    coded = segments.select("segment", "tokens", "starts").join(numbers, "segment").select("tokens", "starts", "numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tokens = np.frombuffer(column_of(batch, "tokens")[k].as_buffer(), np.int32)
                starts = np.unpackbits(np.frombuffer(column_of(batch, "starts")[k].as_buffer(), np.uint8), count=len(tokens)).astype(bool)
                known = column_of(batch, "numbers")[k].values
                ids = np.full(int(tokens.max()) + 1, -1, np.int32)
                ids[known.field("local").to_numpy(zero_copy_only=False)] = known.field("id").to_numpy(zero_copy_only=False)
                w = ids[tokens]
                after = [np.r_[w[j:], np.full(min(j, len(w)), -1, np.int32)] for j in (1, 2, 3)]
                held = [~np.r_[starts[j:], np.ones(min(j, len(w)), bool)] & (x >= 0) for j, x in zip((1, 2, 3), after)]
                b = np.where((w >= 0) & held[0], after[0], -1)
                c = np.where((b >= 0) & held[1], after[1], -1)
                d = np.where((c >= 0) & held[2], after[2], -1)
                at = np.flatnonzero(b >= 0)
                ab = (w[at].astype(np.uint64) << np.uint64(32)) | b[at].astype(np.uint64)
                yield _window_batch(_rows(ab, c[at], d[at], np.ones(len(at), np.int64)))
        trim()

    return scratch_table(coded.mapInArrow(run, WINDOWS), "windows")


def _buckets(windows: DataFrame) -> int:
    total = windows.agg(F.sum("size")).first()[0] or 0
    return max(2 * windows.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET_WINDOWS))


def _dealt(buckets: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Each bucket's part of the arrays, in their order."""
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else np.zeros(0, np.int64)
    arrays = [x[order] for x in arrays]
    for low, high in zip(starts, np.r_[starts[1:], len(buckets)]):
        yield int(buckets[low]), *(x[low:high] for x in arrays)


def frequent_pairs(windows: DataFrame, least: int) -> DataFrame:
    """``a``, ``b``, ``n`` of the pairs that occur ``least`` times."""
    total = _buckets(windows)

    def deal(codes: list, counts: list) -> pa.RecordBatch:
        ab, n = count_pairs(np.concatenate(codes), np.concatenate(counts))
        block = mix((ab >> np.uint64(37) << np.uint64(32)) | ((ab & np.uint64(0xFFFFFFFF)) >> np.uint64(TILE_BITS)))
        rows = [(k, pack(x), y.astype(np.int64).tobytes()) for k, x, y in _dealt((block % np.uint64(total)).astype(np.int64), ab, n)]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int64()), *(binaries(list(x)) for x in columns[1:])], ["bucket", "ab", "n"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0
        for batch in batches:
            for ab, n in zip(column_of(batch, "ab"), column_of(batch, "n")):
                codes.append(unpack(ab.as_buffer()))
                counts.append(np.frombuffer(n.as_buffer(), np.int64).copy())
                held += len(codes[-1])
                if held >= PILE:
                    yield deal(codes, counts)
                    codes, counts, held = [], [], 0
        if codes:
            yield deal(codes, counts)
        trim()

    def add(group: pa.Table) -> pa.Table:
        codes = [unpack(x) for x in group["ab"].to_pylist()]
        counts = [np.frombuffer(x, np.int64) for x in group["n"].to_pylist()]
        ab, n = count_pairs(np.concatenate(codes), np.concatenate(counts))
        ab, n = ab[n >= least], n[n >= least]
        return pa.table({"a": (ab >> np.uint64(32)).astype(np.int64), "b": (ab & np.uint64(0xFFFFFFFF)).astype(np.int64), "n": n})

    parts = windows.select("ab", "n").mapInArrow(local, "bucket long, ab binary, n binary")
    return parts.groupBy("bucket").applyInArrow(add, "a long, b long, n long")


def _spread(ab: np.ndarray, third: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(mix(ab) + third.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def advance(windows: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Stored windows whose first two elements are a frequent pair, which becomes one element."""
    total = _buckets(windows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ab, c, d, n = _read({k: [column_of(batch, k)[at].as_buffer()] for k in ("ab", "c", "d", "n")}, 0)
                on = np.flatnonzero(c >= 0)
                parts = _dealt(_spread(ab[on], c[on] % SPREAD, total), ab[on], c[on], d[on], n[on])
                rows = [(k, pack(x), *(y.tobytes() for y in rest), len(x)) for k, x, *rest in parts]
                columns_out = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(columns_out[0]), pa.int64()), *(binaries(list(x)) for x in columns_out[1:5]), pa.array(list(columns_out[5]), pa.int64())],
                    ["bucket", "ab", "c", "d", "n", "size"],
                )
        trim()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (column_of(batch, k).to_numpy(zero_copy_only=False).astype(np.uint64) for k in ("a", "b"))
            ab = np.tile((a << np.uint64(32)) | b, SPREAD)
            third = np.repeat(np.arange(SPREAD), batch.num_rows)
            numbers = np.tile(column_of(batch, "id").to_numpy(zero_copy_only=False), SPREAD)
            yield pa.RecordBatch.from_arrays([pa.array(_spread(ab, third, total)), pa.array(ab.view(np.int64)), pa.array(numbers)], ["bucket", "ab", "id"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = {k: left[k].to_pylist() for k in ("ab", "c", "d", "n")}
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_window_batch(iter(()))])
        ab, c, d, n = (np.concatenate(x) for x in zip(*(_read(columns, at) for at in range(left.num_rows))))
        known, ids = right["ab"].to_numpy().view(np.uint64), right["id"].to_numpy()
        order = np.argsort(known)
        known, ids = known[order], ids[order]
        at = np.minimum(np.searchsorted(known, ab), len(known) - 1)
        on = np.flatnonzero(known[at] == ab)
        pair = (ids[at[on]].astype(np.uint64) << np.uint64(32)) | c[on].astype(np.uint64)
        return pa.Table.from_batches([_window_batch(_rows(pair, d[on], np.full(len(on), -1), n[on]))])

    left = windows.select("ab", "c", "d", "n").mapInArrow(deal, f"bucket long, {WINDOWS}")
    right = pairs.select("a", "b", "id").mapInArrow(keys, "bucket long, ab long, id long")
    return scratch_table(left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(meet, WINDOWS), name)


def frequent_phrases(docs: DataFrame, least: int, longest: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase`` (array of words), ``ids`` and ``f`` of all frequent phrases, single words too; words per language."""
    segments = write_segments(docs, text_col, lang_col)
    zipped = F.posexplode(F.arrays_zip("words", "langs", "counts")).alias("local", "x")
    words = segments.select("segment", zipped).select(
        "segment", "local", F.col("x.langs").alias("lang"), F.col("x.words").alias("word"), F.col("x.counts").alias("n")
    )
    counted = scratch_table(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    vocabulary = _ranked(counted.where(F.col("n") >= least), ["lang", "n", "word"], "vocabulary")
    level = vocabulary.select("id", "lang", F.array("word").alias("phrase"), F.array("id").alias("ids"), F.col("n").alias("f"))
    single = vocabulary.select(F.col("id").alias("b"), "word")
    windows = windows_of(segments, words, vocabulary)
    found = level.drop("id")
    for size in range(2, longest + 1):
        pairs = _ranked(frequent_pairs(windows, least), ["n", "a", "b"], f"phrases-{size}")
        first = level.select(F.col("id").alias("a"), "lang", "phrase", "ids")
        joined = pairs.join(first, "a").join(single, "b").select(
            "id", "lang", F.concat("phrase", F.array("word")).alias("phrase"), F.concat("ids", F.array("b")).alias("ids"), F.col("n").alias("f")
        )
        level = scratch_table(joined, f"level-{size}")
        found = found.unionByName(level.drop("id"))
        if size < longest:
            windows = advance(windows, pairs, f"windows-{size}")
    return found, counted.groupBy("lang").agg(F.sum("n").alias("n"))


def _exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def _part(start: Column | int, size: Column | int) -> Column:
    return F.slice("ids", start, size)


def collocations(
    docs: DataFrame, *, least: int = 30, longest: int = 4, top: int = 2000, scale: int = 2_000_000, inside: int = 80,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase's score is its lowest floor(scale * a / (l + r)) over all cuts.  A
    phrase goes if a longer one that holds it occurs ``inside`` percent as often.
    """
    found, totals = frequent_phrases(docs, least, longest, text_col, lang_col)
    candidates = found.where(F.size("ids") > 1)
    known = found.select(F.col("ids").alias("part"), "f")
    cuts = candidates.select("ids", "f", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _part(1, F.col("k")), "right": _part(F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(known.select(F.col("part").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(known.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumns({"times": F.lit(scale).cast("decimal(10,0)") * _exact(F.col("f")), "both": _exact(F.col("l")) + _exact(F.col("r"))})
    lowest = cuts.groupBy("ids").agg(F.min(F.struct(F.expr("times div both").alias("score"), "k", "l", "r")).alias("cut"))
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("ids") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.size("ids") - size + 1), lambda at: F.slice("ids", at, size)),
        )
    )
    held = candidates.where(F.size("ids") > 2).select(F.explode(spans).alias("ids"), F.col("f").alias("longer"))
    held = held.groupBy("ids").agg(F.max("longer").alias("longer"))
    free = candidates.join(held, "ids", "left").where(
        F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("f")) * inside)
    )
    scored = free.join(lowest, "ids").select("lang", F.array_join("phrase", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
