"""Hard negatives: rows of another label whose score lies below, but not far below, an anchor's positive.

Candidates are dealt to shards of bounded size: a bounded sample of pivots
(``MAX_PIVOTS`` rows with the smallest hashes) only decides which rows stand
together, a crowded pivot is split by row number, and every row is indexed.
Each shard becomes a cover tree in a file of the shared folder.  Anchors, the
stated query set, are packed in blocks of ``BLOCK``; every block meets every
group of shards in a task of its own, which searches its trees one after the
other and so carries the bounds along.  Spark merges the tasks' best rows.

Defined results: rows with a null label, a null vector, or a null or
non-finite component take no part.  Missing components of shorter vectors are
zero.  Scaled components are held within 2**26 in absolute value.  Rows with a
repeated id count each; a row is never the partner of an anchor with its id,
and equal rows make one anchor.  A null id counts as the largest and comes out
as null; it is never an anchor.  An anchor without positives has no rows.  An
empty table gives none.  Extra columns are ignored, also those named like
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voicegrid.llm.cover_tree import LOWEST, Search, build, load
from voicegrid.llm.shared_files import new_folder, open_file, write_file
from voicegrid.llm.text_arrays import column_of
from voicegrid.session import scratch_table

SHARD_ROWS, SHARD_CELLS = 16_384, 4_194_304
MAX_PIVOTS = 256
BLOCK, SHARDS_A_TASK = 512, 64
LARGEST = 1 << 26
NO_ID = (1 << 63) - 1


def scaled_rows(rows: DataFrame, id_col: Column, label: Column, vector: Column, scale: int) -> DataFrame:
    """Rows that take part: ``row`` (a number of its own), ``id``, ``label``, ``vector`` of whole numbers."""
    cells = rows.select(id_col.cast("bigint").alias("id"), label.cast("bigint").alias("label"), vector.cast("array<double>").alias("cells"))
    sound = F.forall("cells", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * scale))).cast("int")
    return cells.where(F.col("label").isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(NO_ID)).alias("id"), "label",
        F.transform("cells", whole).alias("vector"),
    )


def _matrix(lists: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter rows end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def write_trees(rows: DataFrame) -> DataFrame:
    """Writes a tree a shard and returns the manifest: ``shard``, ``path``, ``n_rows``."""
    total, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    per_shard = max(1, min(SHARD_ROWS, SHARD_CELLS // max(dim, 1)))
    wanted = max(1, min(MAX_PIVOTS, -(-total // per_shard)))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(wanted).select("vector").collect()
    pivots = np.zeros((max(1, len(sample)), dim), np.float64)
    for k, row in enumerate(sample):
        pivots[k, : len(row["vector"])] = row["vector"]
    lengths = np.sqrt((pivots**2).sum(1))
    pivots /= np.where(lengths > 0, lengths, 1)[:, None]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(column_of(batch, "vector"))
            chosen = (vectors @ pivots[:, : vectors.shape[1]].T).argmax(1)
            yield pa.RecordBatch.from_arrays([column_of(batch, "row"), pa.array(chosen, pa.int32())], ["row", "pivot"])

    dealt = scratch_table(rows.select("row", "vector").mapInArrow(nearest, "row long, pivot int"), "pivots")
    parts = {row["pivot"]: -(-row["n"] // per_shard) for row in dealt.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    split = F.get(F.array(*(F.lit(parts.get(k, 1)) for k in range(len(pivots)))), F.col("pivot"))
    shard = F.shiftleft(F.col("pivot").cast("bigint"), 32) + F.pmod(F.xxhash64("row"), split)
    folder = new_folder(rows.sparkSession, "trees")

    def one(key: tuple, group: pa.Table) -> pa.Table:
        content = build(_numbers(group["id"]), _numbers(group["label"]), _matrix(group["vector"]))
        return pa.table({"shard": [key[0].as_py()], "path": [write_file(folder, ".ctree", content)], "n_rows": [group.num_rows]})

    members = rows.join(dealt.select("row", shard.alias("shard")), "row").select("shard", "id", "label", "vector")
    return scratch_table(members.groupBy("shard").applyInArrow(one, "shard long, path string, n_rows long"), "trees-manifest")


def pack_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors in stored blocks; the anchor at place p of block b is number b * 2**20 + p."""
    blocks = max(1, -(-anchors.count() // BLOCK))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("bigint").alias("block")
    queries = F.collect_list(F.struct("id", "label", "vector")).alias("queries")
    return scratch_table(anchors.groupBy(block).agg(queries), "anchors")


def search_trees(manifest: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """The best ``k`` rows of each window: ``number``, ``slot``, ``id``, ``score``, ``rank``.

    ``blocks`` may have ``windows``, an array of (number, slot, low, high);
    without it each anchor has one window without bounds.
    """
    n_shards, n_blocks = manifest.count(), blocks.count()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n_shards, max(-(-n_shards // SHARDS_A_TASK), -(-2 * cores // max(1, n_blocks)))))
    bounded = "windows" in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield _search(batch.slice(at, 1))

    def _search(row: pa.RecordBatch) -> pa.RecordBatch:
        queries = column_of(row, "queries").flatten()
        ids, labels = (queries.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("id", "label"))
        block = column_of(row, "block")[0].as_py()
        if bounded:
            number, slot, low, high = (column_of(row, "windows").flatten().field(n).to_numpy(zero_copy_only=False) for n in ("number", "slot", "low", "high"))
            shape = (len(ids), int(slot.max(initial=0)) + 1)
            lows, highs = np.ones(shape, np.int64), np.zeros(shape, np.int64)
            lows[number - (block << 20), slot], highs[number - (block << 20), slot] = low, high
        else:
            lows, highs = np.full((len(ids), 1), LOWEST), np.full((len(ids), 1), -LOWEST)
        search = Search(ids, labels, _matrix(queries.field("vector")), lows, highs, k, same)
        for path in column_of(row, "paths")[0].as_py():
            with open_file(path) as handle:
                search.add(load(handle))
        groups, found, scores = search.found
        number, slot = np.divmod(groups, lows.shape[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(number + (block << 20)), pa.array(slot.astype(np.int32)), pa.array(found), pa.array(scores)],
            ["number", "slot", "id", "score"],
        )

    part = F.pmod(F.xxhash64("shard"), F.lit(parts)).alias("part")
    shards = manifest.groupBy(part).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    tasks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))).join(shards, "part")
    found = tasks.repartition(min(100_000, parts * max(1, n_blocks))).mapInArrow(run, "number long, slot int, id long, score long")
    best = Window.partitionBy("number", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchor: Column, *, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchor`` is a condition on ``id``.  Negatives satisfy
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    label = F.col("label") if label is None else label
    whole = scratch_table(scaled_rows(rows, F.col(id_col), label, F.col(vector_col), scale), "vectors")
    trees = write_trees(whole)
    chosen = whole.where((F.col("id") != NO_ID) & anchor).groupBy("id", "label", "vector").agg(F.min("row").alias("row"))
    blocks = pack_anchors(chosen)
    friends = scratch_table(search_trees(trees, blocks, positives, True).select("number", (F.col("rank") - 1).alias("slot"), "id", "score"), "positives")
    tens, rest = F.expr("score div 100"), F.col("score") % 100
    window = F.struct(
        "number", "slot", (low * tens + F.ceil(low * rest / 100)).cast("bigint").alias("low"),
        (high * tens + F.floor(high * rest / 100)).cast("bigint").alias("high"),
    )
    windows = friends.groupBy(F.shiftright("number", 20).alias("block")).agg(F.collect_list(window).alias("windows"))
    found = search_trees(trees, scratch_table(blocks.join(windows, "block"), "windows"), negatives, False)
    names = blocks.select("block", F.posexplode("queries").alias("place", "query")).select(
        (F.shiftleft("block", 20) + F.col("place")).alias("number"), F.col("query.id").alias("anchor_id")
    )
    pairs = friends.select("number", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    known = lambda name: F.nullif(F.col(name), F.lit(NO_ID)).alias(name)
    return (
        found.join(pairs, ["number", "slot"]).join(names, "number")
        .select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        .withColumn("negative_id", known("negative_id"))
    )
