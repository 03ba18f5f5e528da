"""Non-negative matrix factorization of TF-IDF rows, V ~ W H.

V stays distributed; only H (topics x terms, both bounded by configuration)
is on the driver.  A pass solves the rows of W where they are and returns the
sums W'W and W'V per task.  Many tasks are first summed in groups, so the
driver receives about the square root of the task count.  Sums are taken in
task order, which makes a run repeatable.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

# More task results than this are summed on executors first.
DIRECT_RESULTS = 64
SVD_EXTRA = 10
SVD_PASSES = 5
ROW_SWEEPS = 30
FACTOR_SWEEPS = 10

BatchSums = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


@dataclass(frozen=True)
class Factors:
    """Fitted H, the final error norm and the number of passes used."""

    h: np.ndarray
    error: float
    passes: int


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    indices, weights = batch.column(0), batch.column(1)
    sizes = pa.compute.list_value_length(indices).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, indices.flatten().to_numpy(), weights.flatten().to_numpy(), len(sizes)


def _add_up(frame: pd.DataFrame) -> np.ndarray:
    total = None
    for payload in frame.sort_values("part")["payload"]:
        values = np.frombuffer(payload, dtype=np.float64)
        total = values.copy() if total is None else total + values
    return total


def _distributed_sum(vectors: DataFrame, partitions: int, size: int, sums: BatchSums) -> np.ndarray:
    """Sum of ``sums`` over all batches, as one vector of ``size`` numbers."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += sums(*_unpack(batch))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "payload"]
        )

    schema = "part bigint, payload binary"
    results = vectors.mapInArrow(per_task, schema)
    if partitions > DIRECT_RESULTS:
        groups = math.isqrt(partitions) + 1

        def combine(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [int(key[0])], "payload": [_add_up(frame).tobytes()]})

        grouped = results.groupBy((F.col("part") % groups).alias("slot"))
        results = grouped.applyInPandas(combine, schema)
    return _add_up(results.toPandas())


def solve_rows(
    row: np.ndarray, term: np.ndarray, weight: np.ndarray, count: int, h: np.ndarray, *, settled: float = 1e-9
) -> np.ndarray:
    """Non-negative least-squares rows of W for a fixed H, by coordinate descent.

    Sweeps end early once no row moves by ``settled``; with 0 a row's result
    does not depend on the rows beside it.
    """
    gram = h @ h.T
    target = np.column_stack([np.bincount(row, weight * h[c, term], minlength=count) for c in range(len(h))])
    w = np.zeros((count, len(h)))
    for _ in range(ROW_SWEEPS):
        before = w.copy()
        for c in np.flatnonzero(np.diag(gram) > 0):
            w[:, c] = np.maximum(0.0, w[:, c] + (target[:, c] - w @ gram[:, c]) / gram[c, c])
        if np.abs(w - before).max(initial=0.0) < settled:
            break
    return w


def _times(dense: np.ndarray, row, term, weight, count: int) -> np.ndarray:
    # Columns are laid out one after another: entries picked from one stay in the cache.
    columns = np.ascontiguousarray(dense.T)
    return np.column_stack([np.bincount(row, weight * column[term], minlength=count) for column in columns])


def _transposed(left: np.ndarray, row, term, weight, terms: int) -> np.ndarray:
    columns = np.ascontiguousarray(left.T)
    return np.stack([np.bincount(term, weight * column[row], minlength=terms) for column in columns])


#: What a run asks of the next pass: the number of sums and the function that makes them.
Request = tuple[int, BatchSums]


def starting_factors(documents: int, terms: int, topics: int, seed: int) -> Generator[Request, np.ndarray, np.ndarray]:
    """Start of H from the positive or negative side of leading singular vectors.

    Zeros are replaced by the mean of V.  Singular vectors come from seeded
    subspace iteration: every step is one pass with a terms x (topics + 10)
    result.
    """
    width = min(topics + SVD_EXTRA, terms)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))
    product = basis
    for _ in range(SVD_PASSES):
        current = basis

        def gram_product(row, term, weight, count, current=current):
            return _transposed(_times(current, row, term, weight, count), row, term, weight, terms).ravel()

        product = (yield width * terms, gram_product).reshape(width, terms).T
        last = basis
        basis, _ = np.linalg.qr(product)
    values, rotation = np.linalg.eigh((last.T @ product + product.T @ last) / 2)
    order = np.argsort(values)[::-1][:topics]
    singular = np.sqrt(np.maximum(values[order], 1e-300))
    right = last @ rotation[:, order]

    def side_norms(row, term, weight, count):
        left = _times(right / singular, row, term, weight, count)
        positive, negative = np.maximum(left, 0), np.maximum(-left, 0)
        return np.concatenate([(positive**2).sum(axis=0), (negative**2).sum(axis=0), [weight.sum()]])

    sides = yield 2 * topics + 1, side_norms
    left_positive, left_negative = np.sqrt(sides[:topics]), np.sqrt(sides[topics : 2 * topics])
    h = np.zeros((topics, terms))
    h[0] = np.sqrt(singular[0]) * np.abs(right[:, 0])
    for c in range(1, topics):
        up, down = np.maximum(right[:, c], 0), np.maximum(-right[:, c], 0)
        up_strength = left_positive[c] * np.linalg.norm(up)
        down_strength = left_negative[c] * np.linalg.norm(down)
        side, strength = (up, up_strength) if up_strength >= down_strength else (down, down_strength)
        length = np.linalg.norm(side)
        if length > 0:
            h[c] = np.sqrt(singular[c] * strength) * side / length
    h[h < 1e-6] = 0.0
    h[h == 0.0] = sides[-1] / (documents * terms)
    return h


def _run(documents: int, terms: int, topics: int, seed: int, max_iter: int, tol: float) -> Generator[Request, np.ndarray, Factors]:
    """One factorization: asks for the sums of a pass, gets them, and ends with its factors."""
    h = yield from starting_factors(documents, terms, topics, seed)
    first_error = last_error = None
    for done in range(1, max_iter + 1):
        current = h

        def row_sums(row, term, weight, count, current=current):
            w = solve_rows(row, term, weight, count, current)
            parts = [(w.T @ w).ravel(), _transposed(w, row, term, weight, terms).ravel(), [weight @ weight]]
            return np.concatenate(parts)

        total = yield topics * topics + topics * terms + 1, row_sums
        inner = total[: topics * topics].reshape(topics, topics)
        cross = total[topics * topics : -1].reshape(topics, terms)
        h = h.copy()
        for _ in range(FACTOR_SWEEPS):
            for c in np.flatnonzero(np.diag(inner) > 0):
                h[c] = np.maximum(0.0, h[c] + (cross[c] - inner[c] @ h) / inner[c, c])
        error = max(total[-1] - 2 * (h * cross).sum() + (inner * (h @ h.T)).sum(), 0.0)
        first_error = error if first_error is None else first_error
        if last_error is not None and last_error - error <= 0.1 * tol * max(first_error, 1e-12):
            break
        last_error = error
    return Factors(h, math.sqrt(error), done)


def factorize_many(
    vectors: DataFrame, *, documents: int, terms: int, topics: int, seeds: Sequence[int], max_iter: int, tol: float
) -> tuple[list[Factors], int]:
    """Factorizations under several seeds side by side, and the number of passes over the vectors.

    Every pass makes the sums that all unfinished runs ask for, so the vectors
    are read as often as for the longest run, not once for each.
    """
    table = vectors.select("indices", "weights")
    partitions = table.rdd.getNumPartitions()
    runs = [_run(documents, terms, topics, seed, max_iter, tol) for seed in seeds]
    asked: dict[int, Request] = {k: next(run) for k, run in enumerate(runs)}
    found: dict[int, Factors] = {}
    passes = 0
    while asked:
        requests = list(asked.values())

        def sums(row, term, weight, count, requests=requests):
            return np.concatenate([make(row, term, weight, count) for _, make in requests])

        total = _distributed_sum(table, partitions, sum(size for size, _ in requests), sums)
        passes += 1
        parts = np.split(total, np.cumsum([size for size, _ in requests])[:-1])
        for k, part in zip(list(asked), parts):
            try:
                asked[k] = runs[k].send(part)
            except StopIteration as end:
                found[k] = end.value
                del asked[k]
    return [found[k] for k in range(len(runs))], passes


def factorize(
    vectors: DataFrame, *, documents: int, terms: int, topics: int, seed: int, max_iter: int, tol: float
) -> Factors:
    """Alternate exact row solves and factor sweeps until the error settles.

    ``vectors`` has columns ``indices`` and ``weights`` and should be a stored
    table: it is read once per pass.
    """
    found, _ = factorize_many(
        vectors, documents=documents, terms=terms, topics=topics, seeds=[seed], max_iter=max_iter, tol=tol
    )
    return found[0]
