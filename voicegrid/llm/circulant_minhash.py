"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard.

Two permutations make a whole signature.  The first (a 64-bit mix of the shingle
hash) sends a shingle to one of ``POSITIONS`` places; the second is one stored
permutation, and coordinate k is its minimum over the set read with a shift of
k places.  A shingle therefore adds one contiguous window of the second
permutation, and a set's signature is the elementwise minimum of its windows.

Jobs:

1. One pass over the texts: set size, set fingerprint, band hashes and one byte
   per coordinate.  Rows with equal sets become one node (exact copies cost
   one partially combined aggregate).
2. Nodes that share a band bucket are linked to the bucket's first node, and
   these pairs are confirmed on the full shingle sets of the whole texts.
   Confirmed pairs give components.
3. In buckets that still hold several components, members outside the largest
   one meet all of that component, and each other, on their full sets, in
   blocks of bounded size.  A bucket whose members are one component needs no
   more pairs, so a large group of near copies costs one pair for each member
   and bucket, not all pairs.

``BANDS`` bands of ``ROWS`` coordinates miss a pair at similarity 0.8 with a
chance of about 3e-6, and nearly never above.

Defined results: null texts and texts without words have an empty set, link
with nothing and form a component each; fewer words than the shingle size make
one shingle of the whole sequence; repeated rows are equal sets; a null id takes
part in linking but is never a smallest id (a component of null ids only has a
null component id and its rows are kept).  Empty tables give empty results.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voicegrid.llm.components import connected_components
from voicegrid.llm.text_arrays import NOT_SPACE, binaries, column_of, grams, in_chunks, mix, split_words
from voicegrid.llm.worker_state import kept, trim
from voicegrid.session import scratch_table

BANDS, ROWS = 32, 5
WIDTH = BANDS * ROWS
POSITIONS = 1 << 20
#: Shingles on one side of a block in which sets are compared with each other.
BLOCK = 100_000
#: Standard deviations below the threshold at which coordinate agreement still counts as promising.
SLACK = 5.0


def shifted_permutation() -> np.ndarray:
    """Row i holds the second permutation at i, i + 1, ... i + WIDTH - 1, around the end."""
    return kept("permutation", (POSITIONS, WIDTH), _make_permutation)


def _make_permutation() -> np.ndarray:
    order = np.argsort(mix(np.arange(POSITIONS, dtype=np.uint64) ^ np.uint64(0x5DEECE66D)))
    around = np.concatenate([order, order[:WIDTH]]).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(around, WIDTH)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = split_words(column, NOT_SPACE)
    hashes = grams(words.hashes, size)
    out = []
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if high - low >= size:
            out.append(np.unique(hashes[low : high - size + 1]))
        elif high > low:
            out.append(grams(words.hashes[low:high], high - low) ^ np.uint64(high - low))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(values: np.ndarray) -> int:
    """Fingerprint of a non-empty set."""
    total = mix(values).sum(dtype=np.uint64)
    return int(mix(np.array([total ^ np.uint64(len(values))], np.uint64)).view(np.int64)[0])


def signature(values: np.ndarray) -> np.ndarray:
    """Minimum of the shifted windows, in steps of bounded memory."""
    table = shifted_permutation()
    places = (mix(values ^ np.uint64(0xA5A5A5A5)) & np.uint64(POSITIONS - 1)).astype(np.int64)
    least = np.full(WIDTH, POSITIONS, np.uint32)
    for low in range(0, len(places), 2048):
        np.minimum(least, table[places[low : low + 2048]].min(axis=0), out=least)
    return least


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """One hash for each band; the band's number is part of it."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        out = mix(out ^ rows[:, :, k])
    return out.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``set_id``, ``bands`` and ``bytes``; the last three null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            sets = shingle_sets(column_of(batch, "text"), size)
            full = [k for k, values in enumerate(sets) if len(values)]
            signatures = np.stack([signature(sets[k]) for k in full]) if full else np.zeros((0, WIDTH), np.uint32)
            bands = band_hashes(signatures).tolist()
            coordinates = (mix(signatures.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
            ids, lists, packed = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for row, k in enumerate(full):
                ids[k], lists[k], packed[k] = set_id(sets[k]), bands[row], coordinates[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(ids, pa.int64()),
                    pa.array(lists, pa.list_(pa.int64())), binaries(packed),
                ],
                ["doc_id", "n_shingles", "set_id", "bands", "bytes"],
            )
        trim()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id long, bands array<long>, bytes binary")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (``u``, ``v`` set ids) with 100 * intersection >= percent * union, on the full sets of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "a"):
            keep = []
            left, right = shingle_sets(column_of(batch, "a"), size), shingle_sets(column_of(batch, "b"), size)
            for x, y in zip(left, right):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([column_of(batch, "u"), column_of(batch, "v")], ["u", "v"]).filter(
                pa.array(keep, pa.bool_())
            )

    a = texts.select(F.col("set_id").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("set_id").alias("v"), F.col("text").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def linked_in_block(table: pa.Table, percent: int) -> pa.Table:
    """Links between the ``small`` rows of a block and the others of another component, on full sets.

    Intersections are counted with matrix products over the shingles that both
    sides have.  For each small row and other component one link comes out.
    """
    small = table.column("small").to_numpy().astype(bool)
    ids, components = table.column("set_id").to_numpy(), table.column("component").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    sides = [np.flatnonzero(small), np.flatnonzero(~small)]
    values = [np.concatenate([sets[k] for k in side]) if len(side) else np.zeros(0, np.uint64) for side in sides]
    common = np.intersect1d(*values)
    counts = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    owners = [np.repeat(np.arange(len(side)), sizes[side]) for side in sides]
    places = [np.minimum(np.searchsorted(common, v), max(len(common) - 1, 0)) for v in values]
    known = [common[p] == v if len(common) else np.zeros(len(v), bool) for p, v in zip(places, values)]
    for low in range(0, len(common), 4096):
        width = min(4096, len(common) - low)
        halves = []
        for side in (0, 1):
            here = known[side] & (places[side] >= low) & (places[side] < low + width)
            half = np.zeros((len(sides[side]), width), np.float32)
            half[owners[side][here], places[side][here] - low] = 1
            halves.append(half)
        counts += halves[0] @ halves[1].T
    union = sizes[sides[0]][:, None] + sizes[sides[1]][None, :] - counts
    linked = (100 * counts >= percent * union) & (components[sides[0]][:, None] != components[sides[1]][None, :])
    left, right = np.nonzero(linked)
    first: dict[tuple[int, int], int] = {}
    for x, y in zip(ids[sides[0]][left].tolist(), sides[1][right]):
        first.setdefault((x, int(components[y])), int(ids[y]))
    return pa.table({"u": pa.array([x for x, _ in first], pa.int64()), "v": pa.array(list(first.values()), pa.int64())})


def _dealt(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Rows of both sides of each group, dealt into pairs of blocks of about ``BLOCK`` shingles a side.

    Both have ``group``, ``set_id``, ``component`` and ``n`` (the set's size).
    """
    blocks = left.groupBy(group).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("n_left")).join(
        right.groupBy(group).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("n_right")), group
    )
    place = F.pmod(F.xxhash64("set_id"), F.lit(1_000_003))
    columns = [group, "i", "j", "small", "set_id", "component"]
    a = left.join(blocks, group).withColumn("small", F.lit(True)).withColumn("i", (place % F.col("n_left")).cast("int"))
    a = a.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_right") - 1))).select(columns)
    b = right.join(blocks, group).withColumn("small", F.lit(False)).withColumn("j", (place % F.col("n_right")).cast("int"))
    b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1))).select(columns)
    return a.unionAll(b)


def _remaining_links(shared: DataFrame, components: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different components that share a bucket, beyond the pairs with the buckets' first nodes."""
    named = components.withColumnRenamed("node", "set_id")
    members = shared.where("n > 2").select("key", "set_id").join(named, "set_id", "left").select(
        "key", "set_id", F.coalesce("component", "set_id").alias("component")
    )
    members = scratch_table(members, "members")
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    mains = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where(
        "parts > 1"
    ).select("key", F.col("top.component").alias("main"), (F.col("top.n") > 1).alias("large"))
    mixed = members.join(mains, "key")
    outside = scratch_table(mixed.where("component <> main or not large"), "outside")
    # Members outside a bucket's largest component meet that whole component, once for all buckets.
    meets = outside.where("large").select(F.col("main").alias("group"), "set_id", "component").distinct()
    wholes = named.join(meets.select(F.col("group").alias("component")).distinct(), "component").select(
        F.col("component").alias("group"), "set_id", "component"
    )
    # And each other, within the bucket.
    alone = outside.select(F.col("key").alias("group"), "set_id", "component")
    several = alone.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    alone = alone.join(several.select("group"), "group")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            sets = [x.tobytes() for x in shingle_sets(column_of(batch, "text"), size)]
            yield pa.RecordBatch.from_arrays([column_of(batch, "set_id"), binaries(sets)], ["set_id", "shingles"])

    wanted = meets.select("set_id").unionAll(wholes.select("set_id")).unionAll(alone.select("set_id")).distinct()
    sets = scratch_table(
        texts.join(wanted, "set_id").select("set_id", "text").mapInArrow(shingles, "set_id long, shingles binary"), "sets"
    )
    sizes = sets.select("set_id", (F.length("shingles") / 8).cast("long").alias("n"))
    links = None
    for left, right in ((meets, wholes), (alone, alone)):
        dealt = _dealt(left.join(sizes, "set_id"), right.join(sizes, "set_id"), "group").join(sets, "set_id")
        found = dealt.groupBy("group", "i", "j").applyInArrow(
            lambda table: linked_in_block(table, percent), "u long, v long"
        )
        links = found if links is None else links.unionAll(found)
    return links


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Links join rows whose sets of distinct ``shingle``-word windows (A-Z
    lower-cased) share at least ``percent`` of their union; a component is what
    links reach; its smallest id names it and that row is kept.
    """
    rows = scratch_table(sketches(docs, id_col, text_col, shingle), "sketches")
    nodes = scratch_table(
        rows.where("set_id is not null").groupBy("set_id").agg(
            F.min("doc_id").alias("label"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes")
        ),
        "nodes",
    )
    buckets = nodes.select("set_id", F.explode("bands").alias("key"))
    # Stored, so that adaptive execution may split a crowded bucket when it is joined.
    pivots = scratch_table(
        buckets.groupBy("key").agg(F.min("set_id").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "pivots"
    )
    shared = scratch_table(buckets.join(pivots, "key"), "buckets")
    pairs = scratch_table(
        shared.where("set_id <> pivot").select(F.col("set_id").alias("u"), F.col("pivot").alias("v")).distinct(), "pairs"
    )
    similarity = percent / 100
    least = similarity - SLACK * (similarity * (1 - similarity) / WIDTH) ** 0.5
    texts = _node_texts(docs, id_col, text_col, nodes, pairs, shingle)
    links = scratch_table(confirm(_agreeing(pairs, nodes, least), texts, shingle, percent), "links")
    components = scratch_table(connected_components(links), "components")
    more = scratch_table(_remaining_links(shared, components, texts, shingle, percent), "links")
    components = scratch_table(connected_components(links.unionAll(more)), "components")
    # A component's id is the smallest document id of its nodes.
    grouped = nodes.select("set_id", "label").join(components.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "label", F.coalesce("component", "set_id").alias("component")
    )
    names = grouped.groupBy("component").agg(F.min("label").alias("component_id"))
    named = scratch_table(grouped.join(names, "component").select("set_id", "component_id"), "names")
    return rows.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _agreeing(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs whose coordinates agree often enough to be worth an exact check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (
                    np.frombuffer(b"".join(column_of(batch, c).to_pylist()), np.uint8).reshape(-1, WIDTH) for c in "ab"
                )
                keep = pa.array((x == y).mean(axis=1) >= least, pa.bool_())
                yield pa.RecordBatch.from_arrays([column_of(batch, "u"), column_of(batch, "v")], ["u", "v"]).filter(keep)

    a = nodes.select(F.col("set_id").alias("u"), F.col("bytes").alias("a"))
    b = nodes.select(F.col("set_id").alias("v"), F.col("bytes").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _node_texts(
    docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, pairs: DataFrame, size: int
) -> DataFrame:
    """One text for every node that is in a pair, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            sets = shingle_sets(column_of(batch, "text"), size)
            wanted = column_of(batch, "set_id").to_pylist()
            keep = pa.array([len(s) > 0 and set_id(s) == w for s, w in zip(sets, wanted)], pa.bool_())
            yield pa.RecordBatch.from_arrays([column_of(batch, "set_id"), column_of(batch, "text")], ["set_id", "text"]).filter(keep)

    wanted = pairs.select(F.col("u").alias("set_id")).unionAll(pairs.select("v")).distinct()
    ids = nodes.select("set_id", "label").join(wanted, "set_id")
    texts = docs.select(F.col(id_col).alias("label"), F.col(text_col).alias("text"))
    here = ids.alias("n").join(texts.alias("t"), F.col("n.label").eqNullSafe(F.col("t.label"))).select("set_id", "text")
    return scratch_table(here.mapInArrow(run, "set_id long, text string").dropDuplicates(["set_id"]), "texts")
