"""Exact percentiles of a weighted value column by narrowing value ranges.

One pass counts rows in ``BUCKETS`` equal ranges between the least and greatest
value still in question; the range that holds a rank becomes the next pass's
interval, until it has one value.  The driver sees at most ``BUCKETS`` rows for
each rank and pass, whatever the number of values, and no pass sorts or
shuffles anything but those sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

BUCKETS = 256


def _bucket(value, low: float, high: float):
    """Number of the range; halves keep the span of the widest intervals finite."""
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).cast("int")


def values_at(counts: DataFrame, value: str, weight: str, ranks: Sequence[int]) -> dict[int, float]:
    """The value at each 0-based rank of a (value, weight) table of finite values."""
    column = F.col(value).cast("double")
    low, high = counts.agg(F.min(column), F.max(column)).first()
    # rank -> least value, greatest value and rows below of the interval that holds it
    open_ranks = {rank: (low, high, 0) for rank in set(ranks)}
    found: dict[int, float] = {}
    while True:
        found |= {rank: low for rank, (low, high, _) in open_ranks.items() if low == high}
        open_ranks = {rank: held for rank, held in open_ranks.items() if rank not in found}
        if not open_ranks:
            return found
        spans = sorted(set(open_ranks.values()))
        tests = [F.when(column.between(low, high), F.struct(F.lit(k).alias("span"), _bucket(column, low, high).alias("bucket"))) for k, (low, high, _) in enumerate(spans)]
        cells = counts.select(column.alias("v"), F.col(weight).alias("n"), F.explode(F.array(*tests)).alias("cell"))
        rows = (
            cells.where(F.col("cell").isNotNull()).groupBy("cell.span", "cell.bucket")
            .agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        )
        per_span = [sorted((r["bucket"], r["n"], r["low"], r["high"]) for r in rows if r["span"] == k) for k in range(len(spans))]
        for rank, held in open_ranks.items():
            before = held[2]
            for _, n, low, high in per_span[spans.index(held)]:
                if rank < before + n:
                    open_ranks[rank] = (low, high, before)
                    break
                before += n


def percentiles(counts: DataFrame, value: str, shares: Sequence[float], weight: str = "n") -> dict[float, float | None]:
    """Linear percentiles, None for an empty table.  ``counts`` should be stored, as several passes read it."""
    total = counts.agg(F.sum(weight)).first()[0]
    if not total:
        return dict.fromkeys(shares)
    places = {share: share * (total - 1) for share in shares}
    ranks = reduce(set.union, ({math.floor(x), math.ceil(x)} for x in places.values()), set())
    at = values_at(counts, value, weight, sorted(ranks))
    return {
        share: at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for share, x in places.items()
    }
