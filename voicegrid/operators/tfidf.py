"""TF-IDF shared by the sentiment and the topic model.

Vocabulary statistics are a Spark aggregate over exploded terms.  Weighting a
text against a fitted vocabulary is row-local: the JVM tokenizes, an Arrow
function looks terms up and weighs them, and no term is ever shuffled.
Spark's own IDF stage has another formula and no sublinear counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from voicegrid.functions.text import vector_tokens
from voicegrid.operators.canonical import number_rows
from voicegrid.session import cut_lineage, join_small, release

# Tokens weighed in one step inside a task; bounds memory for long texts.
TOKENS_PER_STEP = 400_000
# Tokens counted in one step: repeats within it are combined before anything leaves the task.
COUNTED_PER_STEP = 2_000_000
# Chosen terms dealt out in one step.
KNOWN_PER_STEP = 1_000_000
# Buckets of counted terms for each shuffle partition: one of them is in memory at a time.
BUCKETS_PER_PARTITION = 2
# Base of the polynomial hash of a term's bytes, modulo 2^64.
HASH_BASE = 0x9E3779B97F4A7C15


def english_stop_words() -> tuple[str, ...]:
    """Spark's English stop list, cut the way the vectorizer cuts text."""
    found: set[str] = set()
    for entry in StopWordsRemover.loadDefaultStopWords("english"):
        found.update(part for part in entry.replace("'", " ").split() if len(part) > 1)
    return tuple(sorted(found))


@dataclass(frozen=True)
class Vocabulary:
    """Fitted terms in alphabetical order with their inverse document frequency."""

    terms: tuple[str, ...]
    idf: np.ndarray
    documents: int
    ngram_max: int = 2

    def __len__(self) -> int:
        return len(self.terms)


def tokens_of(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Vector tokens without stop words; removal comes before bigrams."""
    tokens = vector_tokens(text)
    return F.filter(tokens, lambda word: ~word.isin(list(stop_words))) if stop_words else tokens


def terms_of(tokens: Column, ngram_max: int) -> Column:
    """Tokens plus, for ``ngram_max=2``, neighbouring pairs."""
    if ngram_max == 1:
        return tokens
    count = F.size(tokens) - 1
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(count, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(count, F.lit(0))),
        lambda left, right: F.concat(left, F.lit(" "), right),
    )
    return F.concat(tokens, pairs)


def term_statistics(df: DataFrame, tokens: Column, ngram_max: int = 2) -> DataFrame:
    """Corpus count and document count per term.

    Tasks count the terms of many texts at a time and pack them by a hash of
    the term: a row holds one bucket's terms and their counts, compressed.  The
    rows of a bucket then meet in one small group.  Buckets go with the
    session's shuffle partitions, and a frequent term is one entry in each row.
    Terms are dealt out by name for later joins; limits on counts apply before that.
    """
    return _bucket_counts(df, tokens, ngram_max).repartition("term")


def _bucket_counts(df: DataFrame, tokens: Column, ngram_max: int) -> DataFrame:
    """The counts as they lie in their buckets."""
    buckets = _buckets(df)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, hashes, corpus, documents in _counted_terms(batch.column(0), ngram_max):
                filled, parts = _dealt(terms, hashes, buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(filled, pa.int32()),
                        pa.array([_packed_strings(terms.take(pa.array(part))) for part in parts], pa.binary()),
                        pa.array([_packed_numbers(corpus[part]) for part in parts], pa.binary()),
                        pa.array([_packed_numbers(documents[part]) for part in parts], pa.binary()),
                    ],
                    names=["bucket", "terms", "corpus", "documents"],
                )

    def merge(group: pa.Table) -> pa.Table:
        names = ["term", "corpus_count", "document_count"]
        counts = [np.concatenate([_numbers(cell.as_py()) for cell in group[name]]).astype(np.int64) for name in ("corpus", "documents")]
        rows = pa.Table.from_arrays([_all_strings(group["terms"]), *map(pa.array, counts)], names=names)
        sums = rows.group_by("term", use_threads=False).aggregate([(name, "sum") for name in names[1:]])
        return pa.Table.from_arrays([sums["term"], *(sums[f"{name}_sum"] for name in names[1:])], names=names)

    packed = df.select(tokens.alias("_tokens")).mapInArrow(count, "bucket int, terms binary, corpus binary, documents binary")
    return packed.groupBy("bucket").applyInArrow(merge, "term string, corpus_count bigint, document_count bigint")


def inverse_document_frequency(document_count: Column, documents: int) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((1.0 + F.lit(documents)) / (1.0 + document_count)) + 1.0


def select_terms(
    statistics: DataFrame, documents: int, *, max_features: int | None, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """Terms within the document-frequency limits: the most frequent ``max_features`` of them, or all."""
    limit = max_df * documents
    chosen = statistics.where((F.col("document_count") >= min_df) & (F.col("document_count") <= limit))
    if max_features is not None:
        chosen = chosen.orderBy(F.desc("corpus_count"), "term").limit(max_features)
    return chosen.withColumn("idf", inverse_document_frequency(F.col("document_count"), documents))


def term_weights(df: DataFrame, key: str, tokens: Column, chosen: DataFrame, ngram_max: int = 2) -> DataFrame:
    """(key, term, weight) of any number of terms: no vocabulary leaves the executors.

    Texts that share a key count as one; texts without a key have no rows.
    ``df`` should be stored, as it is read several times.
    """
    keyed = df.where(F.col(key).isNotNull())
    shared = cut_lineage(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key))
    rows = shared.count()
    if not rows:
        return _packed_weights(keyed, key, tokens, chosen, ngram_max)
    alone = _packed_weights(join_small(keyed, shared, key, "left_anti", rows=rows), key, tokens, chosen, ngram_max)
    return alone.unionAll(_joined_weights(join_small(keyed, shared, key, "left_semi", rows=rows), key, tokens, chosen, ngram_max))


def _joined_weights(df: DataFrame, key: str, tokens: Column, chosen: DataFrame, ngram_max: int) -> DataFrame:
    """Weights of texts that may share keys: counts meet by key and term."""
    lists = df.select(key, tokens.alias("_tokens")).select(key, terms_of(F.col("_tokens"), ngram_max).alias("_terms"))
    rows = lists.select(key, F.explode_outer("_terms").alias("term")).where(F.col("term").isNotNull())
    counts = rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.join(chosen.select("term", "idf"), "term").select(key, "term", ((1.0 + F.log("n")) * F.col("idf")).alias("weight"))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return weighed.join(norms, key).select(key, "term", (F.col("weight") / F.col("_norm")).alias("weight"))


def _packed_weights(df: DataFrame, key: str, tokens: Column, chosen: DataFrame, ngram_max: int) -> DataFrame:
    """Weights of texts with keys of their own.

    Tasks pack the terms of a block of texts by bucket.  In its bucket a block
    is answered with the ``idf`` of each of its terms, in the order asked.  The
    answers meet the block's texts, which were sent there as numbered words:
    no row goes out for a single term or cell.  As ``df`` is stored, both
    passes over it form the same blocks.
    """
    kind, buckets = df.schema[key].dataType.simpleString(), _buckets(df)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for (start, stop), words, rows in _token_steps(batch.column(1), COUNTED_PER_STEP):
                if len(words):
                    yield block, batch.column(0).slice(start, stop - start), *_numbered_words(words), rows
                block += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, words, code, rows in blocks(batches):
            terms, hashes, _, _ = _numbered_terms(words, code, rows, ngram_max)
            filled, parts = _dealt(terms, hashes, buckets)
            lists = pa.array([_packed_strings(terms.take(pa.array(part))) for part in parts], pa.binary())
            asked = [pa.array(filled, pa.int32()), pa.array(np.full(len(filled), block), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([*asked, pa.nulls(len(filled), pa.binary())], names=["bucket", "block", "terms", "idf"])

    def know(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, KNOWN_PER_STEP):
            terms, idf = table.column(0).combine_chunks(), table.column(1).to_numpy()
            filled, parts = _dealt(terms, _mixed(_word_hashes(terms)[0]), buckets)
            lists = pa.array([_packed_strings(terms.take(pa.array(part))) for part in parts], pa.binary())
            values = pa.array([_packed_values(idf[part], np.ones(len(part), bool)) for part in parts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(filled, pa.int32()), pa.nulls(len(filled), pa.int64()), lists, values],
                names=["bucket", "block", "terms", "idf"],
            )

    def answer(group: pa.Table) -> pa.Table:
        asked, known = group.filter(pc.is_valid(group["block"])), group.filter(pc.is_null(group["block"]))
        idf = np.concatenate([np.zeros(0), *(_values(cell.as_py())[0] for cell in known["idf"])])
        lists = [_strings(cell.as_py()) for cell in asked["terms"]]
        terms = pa.concat_arrays([pa.array([], pa.string()), *lists])
        place = pc.index_in(terms, value_set=_all_strings(known["terms"])).fill_null(-1).to_numpy(zero_copy_only=False)
        found = place >= 0
        values = np.zeros(len(place))
        values[found] = idf[place[found]]
        cuts = np.cumsum([len(listed) for listed in lists])[:-1]
        answers = [_packed_values(*part) for part in zip(np.split(values, cuts), np.split(found, cuts))] if lists else []
        return pa.Table.from_arrays(
            [asked["block"], asked["bucket"], pa.array(answers, pa.binary())], names=["block", "bucket", "data"]
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, words, code, rows in blocks(batches):
            lists = [_packed_strings(words), _packed_numbers(code), _packed_numbers(np.bincount(rows, minlength=len(keys)))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    *(pa.array([item], pa.binary()) for item in lists),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                ],
                names=["block", "data", "code", "sizes", "keys"],
            )

    def weigh_block(group: pa.Table) -> pa.Table:
        text = group.filter(pc.is_null(group["bucket"])).to_batches()[0]
        words, code = _strings(text["data"][0].as_py()), _numbers(text["code"][0].as_py()).astype(np.int64)
        sizes = _numbers(text["sizes"][0].as_py()).astype(np.int64)
        terms, hashes, row, term = _numbered_terms(words, code, np.repeat(np.arange(len(sizes)), sizes), ngram_max)
        idf, known = np.zeros(len(terms)), np.zeros(len(terms), bool)
        parts = dict(zip(*_dealt(terms, hashes, buckets)))
        answers = group.filter(pc.is_valid(group["bucket"]))
        for bucket, cell in zip(answers["bucket"].to_pylist(), answers["data"]):
            part = parts.pop(bucket)
            idf[part], known[part] = _values(cell.as_py())
        if parts:
            raise RuntimeError("A block of texts was not read twice alike; weigh a stored table.")
        held = known[term]
        cells, counts = _counted(row[held] * len(terms) + term[held])
        row, term = np.divmod(cells, len(terms))
        weight = (1.0 + np.log(counts)) * idf[term]
        length = np.sqrt(np.bincount(row, weight * weight, minlength=len(sizes)))
        keys = text["keys"].flatten().take(pa.array(row))
        return pa.Table.from_arrays([keys, terms.take(pa.array(term)), pa.array(weight / length[row])], names=[key, "term", "weight"])

    texts = df.select(key, tokens.alias("_tokens"))
    asked = "bucket int, block bigint, terms binary, idf binary"
    listed = chosen.select("term", F.col("idf").cast("double").alias("idf")).where(F.col("term").isNotNull())
    met = texts.mapInArrow(ask, asked).unionAll(listed.mapInArrow(know, asked)).groupBy("bucket")
    answers = met.applyInArrow(answer, "block bigint, bucket int, data binary")
    sent = texts.mapInArrow(send, f"block bigint, data binary, code binary, sizes binary, keys array<{kind}>")
    block = sent.unionByName(answers, allowMissingColumns=True).groupBy("block")
    return block.applyInArrow(weigh_block, f"`{key}` {kind}, term string, weight double")


def number_terms(chosen: DataFrame) -> DataFrame:
    """``term``, ``number`` (0-based, alphabetical) and ``idf``; ranks come from range partitions.

    The terms are stored first, as finding the ranges reads them once more.
    """
    numbered = number_rows(cut_lineage(chosen.select(F.struct("term", "idf").alias("_pos"))))
    return numbered.select("_pos.term", (F.col("_number") - 1).alias("number"), "_pos.idf")


def table_vectors(weights: DataFrame, numbered: DataFrame, key: str) -> DataFrame:
    """``vector`` (ascending numbers and their weights) of each text from a weight table of any vocabulary size."""
    cells = weights.join(numbered.select("term", "number"), "term").select(key, F.struct("number", "weight").alias("cell"))
    listed = cells.groupBy(key).agg(F.array_sort(F.collect_list("cell")).alias("_cells"))
    return listed.select(
        key, F.struct(F.col("_cells.number").alias("indices"), F.col("_cells.weight").alias("weights")).alias("vector")
    )


def fit_vocabulary(
    df: DataFrame,
    tokens: Column,
    documents: int,
    *,
    max_features: int,
    ngram_max: int = 2,
    min_df: int = 1,
    max_df: float = 1.0,
) -> Vocabulary:
    """Collect the selected terms, at most ``max_features`` of them."""
    chosen = select_terms(
        _bucket_counts(df, tokens, ngram_max), documents, max_features=max_features, min_df=min_df, max_df=max_df
    )
    rows = sorted((row["term"], row["idf"]) for row in chosen.select("term", "idf").collect())
    del chosen
    release(df.sparkSession)
    return Vocabulary(
        tuple(term for term, _ in rows), np.array([idf for _, idf in rows], dtype=float), documents, ngram_max
    )


# ------------------------------------------------------- inside the tasks --
@dataclass(frozen=True)
class SparseRows:
    """Weighted terms of consecutive texts: parallel row, term and weight arrays."""

    count: int
    row: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def _row_steps(offsets: np.ndarray, tokens: int) -> Iterator[tuple[int, int]]:
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + tokens, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def _token_steps(tokens: pa.Array, step: int) -> Iterator[tuple[tuple[int, int], pa.Array, np.ndarray]]:
    """Steps over token lists: first and last row, the words there, and each one's row within the step."""
    lists = pc.fill_null(tokens, pa.scalar([], type=tokens.type)) if tokens.null_count else tokens
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = lists.flatten()
    for start, stop in _row_steps(offsets, step):
        words = flat.slice(offsets[start], offsets[stop] - offsets[start])
        yield (start, stop), words, np.repeat(np.arange(stop - start), np.diff(offsets[start : stop + 1]))


def _numbered_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, the most frequent first, and the number of each occurrence."""
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(code, minlength=len(coded.dictionary)), kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), number[code]


def _numbered_terms(
    words: pa.Array, code: np.ndarray, rows: np.ndarray, ngram_max: int
) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of numbered words with their hashes, and row and term number of every occurrence.

    Pairs are found as pairs of word numbers, and only distinct ones are
    spelled out; where a word has a blank, equal spellings are then made one,
    as it may read like a pair.  A term's hash is that of its bytes.
    """
    hashes, lengths = _word_hashes(words)
    if ngram_max != 2 or len(code) < 2:
        return words, _mixed(hashes), rows, code
    same = rows[1:] == rows[:-1]
    pairs = pa.array((code[:-1] * len(words) + code[1:])[same]).dictionary_encode()
    first, second = np.divmod(pairs.dictionary.to_numpy(), len(words))
    power = _powers(int(lengths.max(initial=0)) + 2)
    both = hashes[first] * power[lengths[second] + 1] + np.uint64(ord(" ")) * power[lengths[second]] + hashes[second]
    spelled = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), " ")
    terms, mixed = pa.concat_arrays([words, spelled]), _mixed(np.concatenate([hashes, both]))
    owner = np.concatenate([rows, rows[1:][same]])
    number = np.concatenate([code, pairs.indices.to_numpy().astype(np.int64) + len(words)])
    if pc.any(pc.match_substring(words, " ")).as_py():
        merged = terms.dictionary_encode()
        terms, number = merged.dictionary, merged.indices.to_numpy().astype(np.int64)[number]
        mixed = _mixed(_word_hashes(terms)[0])
    return terms, mixed, owner, number


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``rows`` rows; an empty input has none."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(part.num_rows for part in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(part.num_rows for part in held):
        yield pa.Table.from_batches(held)


def _buckets(df: DataFrame) -> int:
    return BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(terms: pa.Array, hashes: np.ndarray, buckets: int) -> tuple[list[int], list[np.ndarray]]:
    """Buckets of terms and, for each of them, the places of its terms in alphabetical order."""
    order = pc.sort_indices(terms).to_numpy()
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)[order]
    order = order[np.argsort(bucket, kind="stable")]
    sizes = np.bincount(bucket, minlength=buckets)
    return np.flatnonzero(sizes).tolist(), np.split(order, np.cumsum(sizes[sizes > 0])[:-1]) if len(order) else []


def _packed_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _bytes(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def _packed_numbers(values: np.ndarray) -> bytes:
    """Whole numbers from 0 up in as few bytes as the largest takes; first bytes, second bytes and so on lie together."""
    width = max((int(values.max(initial=0)).bit_length() + 7) // 8, 1)
    planes = np.ascontiguousarray(values, np.dtype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + _packed_bytes(planes.T.tobytes())


def _numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_bytes(packed[1:]), np.uint8).reshape(packed[0], -1)
    found = np.zeros((planes.shape[1], 8), np.uint8)
    found[:, : packed[0]] = planes.T
    return found.view(np.dtype("<u8")).ravel()


def _packed_strings(values: pa.Array) -> bytes:
    """Strings as their lengths and their bytes."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), "")
    lengths = _packed_numbers(pc.binary_length(values).to_numpy())
    return len(lengths).to_bytes(8, "little") + lengths + _packed_bytes(joined[0].as_buffer().to_pybytes())


def _strings(packed: bytes) -> pa.Array:
    cut = 8 + int.from_bytes(packed[:8], "little")
    ends = np.concatenate([[0], np.cumsum(_numbers(packed[8:cut]))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(_bytes(packed[cut:]))])


def _all_strings(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.string()), *(_strings(cell.as_py()) for cell in column)])


def _packed_values(values: np.ndarray, known: np.ndarray) -> bytes:
    """Values of which some are not known, as the distinct ones and the place of each among them; 0 stands for unknown."""
    distinct, place = np.unique(values[known], return_inverse=True)
    code = np.zeros(len(values), np.int64)
    code[known] = place + 1
    return len(distinct).to_bytes(8, "little") + distinct.astype("<f8").tobytes() + _packed_numbers(code)


def _values(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 8 + 8 * int.from_bytes(packed[:8], "little")
    code = _numbers(packed[cut:]).astype(np.int64)
    return np.concatenate([[0.0], np.frombuffer(packed[8:cut], "<f8")])[code], code > 0


def _counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and how often each occurs."""
    numbers = np.sort(numbers)
    firsts = np.flatnonzero(np.concatenate([np.ones(min(len(numbers), 1), bool), numbers[1:] != numbers[:-1]]))
    return numbers[firsts], np.diff(np.append(firsts, len(numbers)))


def _powers(count: int) -> np.ndarray:
    """The first powers of the hash base."""
    found = np.full(count, HASH_BASE, np.uint64)
    found[:1] = 1
    return np.multiply.accumulate(found)


def _word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length in bytes of each word: its bytes as the digits of a number modulo 2^64."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")
    data = np.frombuffer(joined[0].as_buffer(), np.uint8) if len(words) else np.zeros(0, np.uint8)
    lengths = pc.binary_length(words).to_numpy().astype(np.int64)
    ends = np.cumsum(lengths)
    place = np.repeat(ends, lengths) - np.arange(len(data)) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * _powers(int(lengths.max(initial=0)))[place])])
    return sums[ends] - sums[ends - lengths], lengths


def _counted_terms(tokens: pa.Array, ngram_max: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Steps over token lists: terms, hashes, and corpus and document counts."""
    for _, listed, rows in _token_steps(tokens, COUNTED_PER_STEP):
        words, code = _numbered_words(listed)
        terms, hashes, owner, number = _numbered_terms(words, code, rows, ngram_max)
        cells, _ = _counted(owner * max(len(terms), 1) + number)
        yield terms, hashes, np.bincount(number, minlength=len(terms)), np.bincount(cells % max(len(terms), 1), minlength=len(terms))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Hashes whose every bit depends on the high bits too."""
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(32))


def _pair_table(terms: Sequence[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words that stand in pairs, pairs of their numbers in ascending order, and each pair's term.

    A term is a pair at each of its blanks, as words may have blanks of their own.
    """
    cuts = [(i, term[:k], term[k + 1 :]) for i, term in enumerate(terms) for k, letter in enumerate(term) if letter == " "]
    words = sorted({part for _, *parts in cuts for part in parts})
    number = {word: i for i, word in enumerate(words)}
    codes = np.array([number[left] * len(words) + number[right] for _, left, right in cuts], dtype=np.int64)
    order = np.argsort(codes)
    return pa.array(words, pa.string()), codes[order], np.array([i for i, *_ in cuts], dtype=np.int64)[order]


def weigh(tokens: pa.Array, vocabulary: Vocabulary, terms: pa.Array) -> Iterator[SparseRows]:
    """L2-normalized TF-IDF rows of a batch of token lists.

    Each distinct word is looked up once; pairs are found by the numbers of their words.
    """
    size = max(len(vocabulary), 1)
    words, codes, targets = _pair_table(vocabulary.terms if vocabulary.ngram_max == 2 else ())

    def numbers(of: pa.Array, among: pa.Array, code: np.ndarray) -> np.ndarray:
        return pc.index_in(of, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[code]

    for (start, stop), listed, rows in _token_steps(tokens, TOKENS_PER_STEP):
        coded = listed.dictionary_encode()
        code = coded.indices.to_numpy()
        ids = numbers(coded.dictionary, terms, code)
        cells = [rows[ids >= 0] * size + ids[ids >= 0]]
        if len(codes) and len(code) > 1:
            word = numbers(coded.dictionary, words, code)
            both = np.flatnonzero((rows[1:] == rows[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0))
            pair = word[both] * len(words) + word[both + 1]
            place = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
            known = codes[place] == pair
            cells.append(rows[both[known]] * size + targets[place[known]])
        every = np.sort(np.concatenate(cells))
        firsts = np.flatnonzero(np.concatenate([np.ones(min(len(every), 1), bool), every[1:] != every[:-1]]))
        counts = np.diff(np.append(firsts, len(every)))
        row, term = np.divmod(every[firsts], size)
        weight = (1.0 + np.log(counts)) * vocabulary.idf[term] if len(row) else np.zeros(0)
        length = np.sqrt(np.bincount(row, weight * weight, minlength=stop - start))
        yield SparseRows(stop - start, row, term, weight / length[row] if len(row) else weight)


def sparse_vectors(df: DataFrame, tokens: Column, vocabulary: Vocabulary) -> DataFrame:
    """Add ``vector``: a struct of ascending term numbers and their weights."""

    @arrow_udf("struct<indices:array<int>,weights:array<double>>")
    def vectorize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = pa.array(vocabulary.terms, type=pa.string())
        for batch in batches:
            indices, weights, sizes = [], [], []
            for part in weigh(batch, vocabulary, terms):
                indices.append(part.term.astype(np.int32))
                weights.append(part.weight)
                sizes.append(np.bincount(part.row, minlength=part.count))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, int)]))]).astype(np.int32)
            offsets = pa.array(ends, type=pa.int32())
            yield pa.StructArray.from_arrays(
                [
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(indices or [np.zeros(0, np.int32)]))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(weights or [np.zeros(0)]))),
                ],
                names=["indices", "weights"],
            )

    return df.withColumn("vector", vectorize.asNondeterministic()(tokens))


def long_weights(vectors: DataFrame, vocabulary: Vocabulary, key: str) -> DataFrame:
    """(key, term, weight) rows of a vector table."""
    pairs = F.arrays_zip("vector.indices", "vector.weights")
    rows = vectors.select(key, F.explode_outer(pairs).alias("cell")).where(F.col("cell").isNotNull())
    names = F.array(*(F.lit(term) for term in vocabulary.terms))
    return rows.select(key, F.element_at(names, F.col("cell.indices") + 1).alias("term"), F.col("cell.weights").alias("weight"))


def save_vocabulary(vocabulary: Vocabulary, spark, path: str) -> None:
    """Terms and weights as Parquet."""
    rows: Iterable[tuple] = ((i, t, float(w)) for i, (t, w) in enumerate(zip(vocabulary.terms, vocabulary.idf)))
    spark.createDataFrame(list(rows), "position int, term string, idf double").write.parquet(path)


def load_vocabulary(spark, path: str, documents: int, ngram_max: int) -> Vocabulary:
    """Inverse of :func:`save_vocabulary`."""
    rows = spark.read.parquet(path).orderBy("position").collect()
    return Vocabulary(
        tuple(row["term"] for row in rows), np.array([row["idf"] for row in rows], dtype=float), documents, ngram_max
    )
