"""Near duplicates by SimHash, compared on vertical bit planes.

Fingerprints: ASCII letters lower-cased, words ``[^\\x20\\x09-\\x0D]+``, word shingles (repeats
included; a shorter text is one shingle; no word: fingerprint zero), 64-bit XXH64 of each
shingle, and a bit per position that is set in over half the hashes.

Search: if two fingerprints differ in at most r bits, then of the parts into which the 64 bits
are cut at least ``parts - r`` agree. Every distinct fingerprint is dealt out under each choice
of ``parts - r`` parts (with r = 2 and four parts: six keys of 32 bits), so no pair is missed.
A bucket beyond ``block`` members is split by hash into blocks, and every pair of its blocks
is a group of its own; no bucket, however large, meets in one task, and none is capped.

Comparison: 64 fingerprints form a lane word per bit position. For a query the planes are
XOR-ed with its bits and added up by carry-save counters, one bit of the counters per machine
word, so one operation advances 64 distances. A saturating counter marks the lanes beyond the
radius, and a word whose 64 lanes are all beyond it is dropped from the remaining planes.

Of the links inside a group only a spanning forest is returned: linked fingerprints stay
linked, and the output cannot grow with the square of a group. Equal fingerprints are merged
before the search.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import DEFAULT_LOG2_BITS, KeyFilter, stage, text_bytes, unwrap, whole_row
from riskloom.llm.components import connected_components

SEED = 42
BITS = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
STEP = 8  # planes between two looks at which words are still needed
TILE = 1 << 15  # words compared at a time
PIECE = 1 << 16  # hashes counted at a time


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a text in UTF-8, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: only A-Z change, and the six ASCII white spaces split
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    counts = np.zeros(BITS, dtype=np.int64)
    n = len(words) - shingle + 1
    for start in range(0, n, PIECE):
        piece = words[start : start + PIECE + shingle - 1]
        grams = zip(*[piece[k:] for k in range(shingle)], strict=False)
        hashes = np.array([xxh64_intdigest(b" ".join(g), SEED) for g in grams], dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in text_bytes(batch.column("_t"))]
            fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), fp], names=["_id", "_th", "_fp"])

    return run


class Lanes:
    """Fingerprints stored by bit plane; every group begins a new word of 64 lanes."""

    def __init__(self, fps: np.ndarray, sizes: np.ndarray):
        self.words = (sizes + 63) // 64
        self.first = np.concatenate(([0], np.cumsum(self.words)))[:-1]
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        slot = np.repeat(self.first * 64 - starts, sizes) + np.arange(len(fps))
        total = int(self.words.sum()) * 64
        padded = np.zeros(total, dtype=np.uint64)
        padded[slot] = fps
        empty = np.ones(total, dtype=np.uint8)
        empty[slot] = 0
        self.row = np.full(total, -1, dtype=np.int64)
        self.row[slot] = np.arange(len(fps))
        bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(total, BITS)
        self.planes = np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)
        self.empty = np.packbits(empty, bitorder="little").view(np.uint64)


def within(lanes: Lanes, queries: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``queries``, lane row) of all pairs within ``radius`` bits; ``words``: the lane word each query meets."""
    at = np.arange(len(queries))
    depth = int(radius + 1).bit_length()
    counters = [np.zeros(len(queries), dtype=np.uint64) for _ in range(depth)]
    beyond = lanes.empty[words]  # free lanes count as beyond
    for b in range(BITS):
        flip = (np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1)))
        carry = lanes.planes[b, words] ^ flip
        for c in range(depth):  # carry-save: add one bit to 64 counters
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        # a counter that reaches radius + 1 stays marked, whatever it wraps to
        reached = np.full(len(queries), ALL)
        for c in range(depth):
            reached &= counters[c] if (radius + 1) >> c & 1 else ~counters[c]
        beyond = beyond | reached
        if b % STEP == STEP - 1:
            live = beyond != ALL
            if not live.any():
                return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
            if live.mean() < 0.8:
                at, queries, words, beyond = at[live], queries[live], words[live], beyond[live]
                counters = [x[live] for x in counters]
    near = np.unpackbits((~beyond).view(np.uint8), bitorder="little").reshape(-1, 64)
    cell, lane = np.nonzero(near)
    return at[cell], lanes.row[words[cell] * 64 + lane]


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a and b: the smallest position of each linked set."""
    while True:
        open_ = labels[a] != labels[b]
        if not open_.any():
            return labels
        a, b = a[open_], b[open_]
        high, low = np.maximum(labels[a], labels[b]), np.minimum(labels[a], labels[b])
        np.minimum.at(labels, high, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def forest(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span all fingerprints of a group within the radius. Rows are sorted by group.

    ``side`` 0: compared with all of its group; 1 and 2: only rows of side 1 meet rows of side 2.
    """
    labels = np.arange(len(fps))
    _, index = np.unique(group, return_inverse=True)
    n_groups = int(index[-1]) + 1
    target, asks = np.flatnonzero(side != 1), np.flatnonzero(side != 2)
    lanes = Lanes(fps[target], np.bincount(index[target], minlength=n_groups))
    per_query = lanes.words[index[asks]]
    edges = np.concatenate(([0], np.cumsum(per_query)))
    start = 0
    while start < len(asks):
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + TILE, "right")) - 1)
        own = np.repeat(np.arange(start, stop), per_query[start:stop])
        offset = np.arange(len(own)) - (edges[own] - edges[start])
        rows = asks[own]
        at, lane = within(lanes, fps[rows], lanes.first[index[rows]] + offset, radius)
        labels = _merge(labels, rows[at], target[lane])
        start = stop
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[labels[moved]], fps[moved]


def _compare(radius: int, rows_at_once: int):
    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        fps = rows["_fp"].to_numpy().view(np.uint64)
        side = rows["_side"].to_numpy()
        keys = [rows[c].to_numpy() for c in ("_table", "_key", "_i", "_j")]
        new = np.ones(len(fps), dtype=bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        group = np.cumsum(new)
        met = np.bincount(group)[group] > 1  # a row alone has nothing to meet
        if not met.any():
            a = b = np.empty(0, dtype=np.uint64)
        else:
            a, b = forest(fps[met], group[met], side[met], radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < rows_at_once:
                continue
            # keep back the last group, which may go on in the next batch
            rows = pa.Table.from_batches(held)
            keys = [rows[c].to_numpy() for c in ("_table", "_key", "_i", "_j")]
            same = np.all([k == k[-1] for k in keys], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield flush(rows.slice(0, cut).to_batches())
            held = rows.slice(cut).to_batches()
            count = rows.num_rows - cut
        if count:
            yield flush(held)

    return run


def key_masks(radius: int, parts: int) -> list[int]:
    """One mask for each choice of the parts that agree; the bits are dealt to the parts in turn."""
    part = [sum(1 << b for b in range(BITS) if b % parts == p) for p in range(parts)]
    masks = [sum(chosen) for chosen in combinations(part, parts - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int, parts: int = 4, block: int = 1024) -> DataFrame:
    """Spanning links ``a, b`` between the distinct fingerprints ``_fp`` within ``radius`` bits."""
    masks = key_masks(radius, parts)
    keys = F.array(
        *[F.struct(F.lit(i).alias("_table"), F.col("_fp").bitwiseAND(F.lit(m)).alias("_key")) for i, m in enumerate(masks)]
    )
    keyed = nodes.select("_fp", F.explode(keys).alias("_k")).select("_fp", "_k.*")
    large = keyed.groupBy("_table", "_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
    large = stage(large.withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")).drop("_n"), "buckets")
    dealt = keyed.join(large, ["_table", "_key"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("_fp"), F.col("_blocks")).cast("int")
    dealt = dealt.withColumn("_mine", mine).withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    i, j = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    side = F.when(i == j, 0).when(F.col("_mine") == i, 1).otherwise(2).cast("int")
    dealt = dealt.select("_table", "_key", i.alias("_i"), j.alias("_j"), side.alias("_side"), "_fp")
    group = ["_table", "_key", "_i", "_j"]
    sorted_ = dealt.repartition(*group).sortWithinPartitions(*group)
    return sorted_.mapInArrow(_compare(radius, 1 << 15), "a long, b long")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """One row per input row: ``_id, _th, _fp, component_id``.

    ``component_id`` is the smallest id of all rows reachable over links, the row's own
    included (null ids are passed over). A null or empty text has fingerprint zero and links
    like any other. ``_th`` hashes the text, to tell rows of equal id apart. An empty table
    gives no rows.
    """
    texts = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"), F.col(text_col).alias("_t")
    )
    id_type = texts.schema["_id"].dataType.simpleString()
    rows = stage(texts.mapInArrow(_fingerprints(shingle), f"_id {id_type}, _th long, _fp long"), "fingerprints")
    nodes = stage(rows.groupBy("_fp").agg(F.min("_id").alias("_least")), "nodes")
    roots = connected_components(links(nodes, radius))
    rooted = nodes.join(roots, F.col("_fp") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_fp"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = stage(rooted.join(least, "_root").select("_fp", "component_id"), "components")
    return rows.join(named, "_fp")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 2,
    log2_bits: int = DEFAULT_LOG2_BITS,
) -> DataFrame:
    """The rows of ``docs`` with one row of each group kept: that of the smallest id (of equal ids, the smallest text hash).

    Rows that are alone pass through without a shuffle; the fixed-size filter tells them.
    """
    rows = stage(near_groups(docs, id_col, text_col, shingle, radius), "groups")
    order = F.struct(F.col("_id").isNull().alias("_no"), "_id", "_th")
    groups = rows.groupBy("_fp", "component_id").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    # components of null id only have no name: each fingerprint then stands for itself
    name = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("#"), F.col("_fp").cast("string")))
    groups = groups.groupBy(name.alias("_name")).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    groups = stage(groups.filter("_n > 1"), "groups")
    members = rows.withColumn("_name", name).join(groups, "_name")
    members = members.groupBy("_id", "_th").agg(F.max(order == F.col("_first")).alias("_stays"))
    members = stage(members, "members")

    key = F.xxhash64("_id", "_th")
    marked = docs.select(
        whole_row(docs), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th")
    )
    marked = KeyFilter(members, key, log2_bits).mark(marked, key, "_grouped")
    alone = marked.filter("not _grouped").select("_row")
    once = marked.filter("_grouped").groupBy("_id", "_th").agg(F.first("_row").alias("_row"))
    m = members.select(F.col("_id").alias("_mid"), F.col("_th").alias("_mth"), "_stays")
    same = once["_id"].eqNullSafe(m["_mid"]) & (once["_th"] == m["_mth"])
    kept = once.join(m, same, "left").filter(F.coalesce("_stays", F.lit(True))).select("_row")
    return unwrap(alone.unionAll(kept))
