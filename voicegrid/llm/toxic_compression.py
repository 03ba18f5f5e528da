"""Toxicity by compression distance: one zstandard dictionary each for toxic and ordinary text.

A window of words is compressed twice: with the ordinary dictionary, and with
the toxic one placed before it.  What only toxic text has makes the window
shorter the second time; the bytes saved are the window's evidence.  A window
counts when its evidence passes a threshold calibrated on ordinary text.  A
logistic model, fitted on labelled texts that the dictionaries have not seen,
gives the score from four features: how unlikely the strongest window is among
as many ordinary windows, the counting windows by those expected of ordinary
text, the mean evidence, and the strongest passage of neighbouring windows, less
what as many ordinary windows reach.  None of them grows with the length of clean
text.

Toxic text is ordinary for the most part, so its training texts are reduced to
the parts of words that stand at many places (with different words before them,
so copies count once) in toxic texts and almost nowhere in ordinary ones.

Fitting reads at most ``max_toxic`` and ``max_ordinary`` labelled documents,
chosen by a hash of the id, each of them whole.  So that they fit the driver, a
document is passed over where its class would have more than ``mean_chars``
characters for each of its rows allowed.  A third of them calibrates
dictionaries trained on the others, and the final ones are trained on all.
Scoring reads whole texts.

Defined results: null and empty texts have no window and score as the model
scores no evidence; repeated rows score alike; labels without a document or
with nulls are not used; without labels of both classes, or without any word
part of the toxic class alone, every score is 0; a null id is not held out;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from voicegrid.llm.text_arrays import column_of, in_chunks
from voicegrid.llm.worker_state import kept
from voicegrid.session import scratch_table

WINDOW, STEP = 32, 16
PART = 6
#: A toxic word part stands at this many different places and is this many times as frequent as in ordinary text.
LEAST_PLACES, LEAST_RATIO = 6, 20
MAX_TOXIC, MAX_ORDINARY, MEAN_CHARS = 2_000, 6_000, 20_000
TOXIC_BYTES, ORDINARY_BYTES = 4_096, 65_536
FALSE_WINDOWS = 0.001
#: More evidence than this in a window says no more.
MOST, MOST_PASSAGE = 8, 20
HELD_OUT_FOLD = 2

WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label may not be learned."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == HELD_OUT_FOLD, F.lit(False))


def _parts(word: str) -> set[str]:
    word = f" {word} "
    return {word[k : k + PART] for k in range(max(1, len(word) - PART + 1))}


def toxic_parts(toxic: list[str], ordinary: list[str]) -> dict[str, int]:
    """Word parts of toxic text alone, with the number of their places."""
    places: dict[str, set] = {}
    for text in toxic:
        before = ""
        for word in WORD.findall(text.lower()):
            places.setdefault(word, set()).add(before)
            before = word
    own, other = Counter(), Counter()
    for word, befores in places.items():
        for part in _parts(word):
            own[part] += len(befores)
    own = Counter({part: n for part, n in own.items() if n >= LEAST_PLACES})
    seen = Counter(word for text in ordinary for word in WORD.findall(text.lower()))
    for word, n in seen.items():
        for part in _parts(word):
            if part in own:
                other[part] += n
    sizes = [max(1, sum(map(len, texts))) for texts in (toxic, ordinary)]
    return {part: n for part, n in own.items() if n / sizes[0] > LEAST_RATIO * (other[part] + 0.5) / sizes[1]}


def reduced(text: str, parts: dict[str, int]) -> list[bytes]:
    """A text's toxic word parts, joined where they overlap."""
    out = []
    for word in WORD.findall(text.lower()):
        word = f" {word} "
        found = [(k, parts[word[k : k + PART]]) for k in range(max(1, len(word) - PART + 1)) if word[k : k + PART] in parts]
        if found:
            most = max(n for _, n in found)
            at = [k for k, n in found if 2 * n >= most]
            out.append(word[at[0] : at[-1] + PART].encode())
    return out


@dataclass
class CompressionModel:
    """Two dictionaries, the window threshold, the logistic weights (intercept last) and, for each
    evidence from 0 to ``MOST``, the share of ordinary windows with as much or more."""

    toxic: bytes
    ordinary: bytes
    threshold: int = 1
    weights: list[float] = field(default_factory=list)
    tail: list[float] = field(default_factory=lambda: [1.0] * (MOST + 1))
    rate: float = 0.0
    _made: tuple | None = None

    def _compressors(self) -> tuple:
        if self._made is None:
            made = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                settings = zstandard.ZstdCompressionParameters.from_level(
                    12, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
                    window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=4,
                )
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=settings)
                made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress)
            self._made = tuple(made)
        return self._made

    def evidence(self, text: str | None) -> np.ndarray:
        """Bytes saved by the toxic dictionary in each window of the whole text."""
        words = WORD.findall((text or "").lower())
        if not words or not self.toxic:
            return np.zeros(0, np.int64)
        plain, toxic = self._compressors()
        windows = [f" {' '.join(words[k : k + WINDOW])} ".encode() for k in range(0, max(1, len(words) - WINDOW + STEP), STEP)]
        return np.array([len(plain(window)) - len(toxic(window)) for window in windows])

    def features(self, text: str | None) -> list[float]:
        found = self.evidence(text)
        if not len(found):
            return [0.0] * 4
        bounded = np.clip(found, 0, MOST)
        chance = -np.expm1(len(found) * np.log1p(-min(self.tail[bounded.max()], 1 - 1e-9)))
        above, expected = (found >= self.threshold).sum(), len(found) * self.tail[min(self.threshold, MOST)]
        # The highest sum of neighbours over ordinary windows grows with the logarithm of their number.
        sums = np.concatenate([[0], np.cumsum(bounded - 1)])
        passage = self.rate * (sums - np.minimum.accumulate(sums)).max() - np.log(len(found))
        return [
            float(-np.log10(max(chance, 1e-9))), float(np.log((above + 1) / (expected + 1))), float(bounded.mean()),
            float(np.clip(passage, 0, MOST_PASSAGE)),
        ]

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        margin = float(np.dot(self.weights[:-1], self.features(text)) + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    def portable(self) -> CompressionModel:
        return CompressionModel(self.toxic, self.ordinary, self.threshold, self.weights, self.tail, self.rate)


def _logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method on a few features and an intercept."""
    x = np.column_stack([rows, np.ones(len(rows))])
    weights = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _rate(tail: list[float]) -> float:
    """The exponent at which sums of ordinary evidence above 1 fall off: exp(rate * (evidence - 1)) has mean 1."""
    share, gain = np.append(-np.diff(tail), tail[-1]), np.arange(len(tail)) - 1
    low, high = 0.0, 20.0
    if share @ gain >= 0:
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if share @ np.exp(middle * gain) < 1 else (low, middle)
    return low


def fit(
    docs: DataFrame, labels: DataFrame, *, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY,
    mean_chars: int = MEAN_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> CompressionModel:
    """Learns from labelled rows outside the held-out fold."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(id_col).alias("order")
    )
    totals = {row["label"]: row["count"] for row in usable.groupBy("label").count().collect()}
    if len(totals) < 2:
        return CompressionModel(b"", b"")
    most = {0: max_ordinary, 1: max_toxic}
    chosen = [usable.where(F.col("label") == k).orderBy("order", "id").limit(n) for k, n in most.items()]
    sample = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most max_ordinary + max_toxic rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    stored = scratch_table(texts.join(sample, "id").select("order", "label", "text"), "labelled")
    sizes = stored.groupBy("order", "label").agg(F.sum(F.length("text")).alias("chars")).collect()
    left, taken = {k: n * mean_chars for k, n in most.items()}, []
    for row in sorted(sizes):
        if row["chars"] <= left[row["label"]]:
            left[row["label"]] -= row["chars"]
            taken.append((row["order"], row["label"]))
    if not taken:
        return CompressionModel(b"", b"")
    kept_rows = F.broadcast(docs.sparkSession.createDataFrame(taken, "order long, label int"))
    return learn(sorted(map(tuple, stored.join(kept_rows, ["order", "label"]).select("order", "label", "text").collect())), totals)


def learn(rows: list[tuple[int, int, str]], totals: dict[int, int]) -> CompressionModel:
    """A model of (order, label, whole text) rows; ``totals`` has the number of labels of each class."""
    part = [[(text, label) for order, label, text in rows if (order % 3 == 0) == rest] for rest in (False, True)]
    trial = _dictionaries(part[0])
    if not trial.toxic or len({label for _, label in part[1]}) < 2:
        return CompressionModel(b"", b"")
    # The threshold and the weights come from texts that the trial dictionaries have not seen.
    ordinary = np.concatenate([np.zeros(1, np.int64), *(trial.evidence(text) for text, label in part[1] if not label)])
    trial.threshold = max(1, int(np.quantile(ordinary, 1 - FALSE_WINDOWS)) + 1)
    trial.tail = [float(((ordinary >= k).sum() + 0.5) / (len(ordinary) + 0.5)) for k in range(MOST + 1)]
    trial.tail[0], trial.rate = 1.0, _rate(trial.tail)
    features = np.array([trial.features(text) for text, _ in part[1]])
    classes = np.array([label for _, label in part[1]])
    weights = _logistic(features, classes)
    # The sample has other class shares than the labels have.
    weights[-1] += np.log(totals[1] / totals[0]) - np.log(classes.sum() / (len(classes) - classes.sum()))
    model = _dictionaries(part[0] + part[1])
    model.threshold, model.weights, model.tail, model.rate = trial.threshold, weights.tolist(), trial.tail, trial.rate
    return model


def _dictionaries(rows: list[tuple[str, int]]) -> CompressionModel:
    """A model with dictionaries alone; without toxic word parts they are empty."""
    texts = [[text for text, label in rows if label == k] for k in (0, 1)]
    parts = toxic_parts(texts[1], texts[0])
    pieces = [piece for text in texts[1] for piece in reduced(text, parts)]
    if not pieces or not texts[0]:
        return CompressionModel(b"", b"")
    groups = [b"".join(pieces[k : k + 12]) for k in range(0, len(pieces), 12)]
    plain = [text.lower().encode()[k : k + 200] for text in texts[0] for k in range(0, len(text), 200)]
    return CompressionModel(_dictionary(TOXIC_BYTES, groups), _dictionary(ORDINARY_BYTES, plain))


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def score(docs: DataFrame, model: CompressionModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept("toxicity", repr(model.portable()), model.portable)
        for batch in in_chunks(batches, "text"):
            scores = [own.score(text) for text in column_of(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_below(docs: DataFrame, model: CompressionModel, limit: float, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept("toxicity", repr(model.portable()), model.portable)
        for batch in in_chunks(batches, text_col):
            keep = [own.score(text) < limit for text in column_of(batch, text_col).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
