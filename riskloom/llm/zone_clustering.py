"""Centroid clustering over zone maps: blocks of vectors along a Hilbert curve, and their boxes.

Components x become integers ``floor(scale * x)``; all that follows is exact. Every vector gets
its place on a Hilbert curve through all dimensions (``bits`` bits of each, between its least
and greatest value). The table is range partitioned and sorted by that place, and cut into
blocks of at most ``block`` rows, each with the least and greatest value of every dimension.

A round gives each vector its nearest centroid. For a block, the least and the greatest squared
distance of any centroid to its box are bounds for all its vectors: a centroid whose least
distance is beyond the smallest of the greatest distances is nearest to none of them. Only the
others, the block's candidates, are compared with the vectors, all at once.

A task sums its vectors per cluster, so a round shuffles at most k rows a task. The k centroids
(k times ``dims`` numbers) pass through the driver; vectors and assignments never do. Rows of one
place on the curve are dealt by a random number, so equal vectors do not meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import stage

LIMIT = 1 << 27  # of a component's integer: squared distances of 64 components stay within 63 bits
EXACT = 1 << 22  # below it, sums of 64 products are exact in doubles too


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve as big-endian bytes; ``cells``: (rows, dims), ``bits`` bits each.

    The curve of Skilling (2004): undo the turns from the coarsest bit on, then Gray code, then
    interleave the bits.
    """
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << b), np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the box, in ascending order."""
    gap = np.maximum(low - centroids, 0) + np.maximum(centroids - high, 0)
    reach = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((gap * gap).sum(axis=1) <= (reach * reach).sum(axis=1).min())


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; of equally near ones the first."""
    if max(np.abs(vectors).max(), np.abs(centroids).max()) <= EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        distances = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
        distances = distances.astype(np.int64)
    else:
        distances = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(best)), best]


def _places(low: list[int], high: list[int], bits: int):
    """Adds each vector's place on the curve, and keeps its integers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.array(low, dtype=np.int64)
        width = np.maximum(np.array(high, dtype=np.int64) - least, 1)
        for batch in batches:
            v = batch.column("_v").flatten().to_numpy().reshape(-1, len(least))
            cells = np.minimum(((v - least) << bits) // width, (1 << bits) - 1)
            place = [p.tobytes() for p in hilbert(cells, bits)]
            data = [r.tobytes() for r in v.astype("<i4")]
            columns = [batch.column("_id"), pa.array(place, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_place", "_v"])

    return run


def _blocks(dims: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            v = np.frombuffer(b"".join(batch.column("_v").to_pylist()), dtype="<i4").reshape(rows, dims)
            cuts = np.append(np.arange(0, rows, block), rows).astype(np.int32)
            parts = [v[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            boxes = [pa.array([getattr(p, f)(axis=0).tolist() for p in parts], pa.list_(pa.int32())) for f in ("min", "max")]
            columns = [pa.ListArray.from_arrays(cuts, batch.column("_id")), pa.array([p.tobytes() for p in parts], pa.binary()), *boxes]
            yield pa.RecordBatch.from_arrays(columns, names=["_ids", "_vs", "_low", "_high"])

    return run


def _of(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors, nearest centroids and distances of each block."""
    for data, low, high in zip(*(batch.column(c).to_pylist() for c in ("_vs", "_low", "_high")), strict=True):
        v = np.frombuffer(data, dtype="<i4").reshape(-1, centroids.shape[1]).astype(np.int64)
        near = candidates(np.array(low, dtype=np.int64), np.array(high, dtype=np.int64), centroids)
        best, distance = nearest(v, centroids[near])
        yield v, near[best], distance


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
        for batch in batches:
            for v, cluster, _ in _of(batch, centroids):
                counts += np.bincount(cluster, minlength=len(centroids))
                np.add.at(sums, cluster, v)
        some = np.flatnonzero(counts)
        columns = [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_of(batch, centroids))
            cluster = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
            distance = np.concatenate([f[2] for f in found]) if found else np.zeros(0, dtype=np.int64)
            columns = [batch.column("_ids").flatten(), pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "cluster", "distance"])

    return run


@dataclass
class Clustering:
    """``assigned``: id, cluster, squared distance of every kept vector; ``centroids``: k lists of integers."""

    assigned: DataFrame
    centroids: list[list[int]]
    blocks: DataFrame


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``_id`` and the integers ``_v`` of the vectors with ``dims`` components, all finite and within the limit."""
    v = F.col(f"`{vector_col}`")
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT)
    good = F.when(F.size(v) == dims, F.forall(v, fits)).otherwise(F.lit(False))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return vectors.filter(good).select(F.col(f"`{id_col}`").alias("_id"), whole.alias("_v"))


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    seed: str = "2",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    scale: int = 256,
    bits: int = 4,
    block: int = 128,
) -> Clustering:
    """k centroids after ``rounds`` rounds, and every kept vector's cluster and squared distance.

    The first centroids are the k vectors with the smallest hex SHA-256 of ``<seed>:<id>``; with
    fewer vectors there are as many centroids. Equal hashes (repeated ids) go by components. A
    centroid becomes the floor of its vectors' mean in every component; one without vectors stays.

    Kept are vectors with exactly ``dims`` components, none null or not finite. A component whose
    integer is beyond 2**27 (x of 524,288 at the scale of 256) is treated like one that is not finite, as squared
    distances would not fit a long. Null ids are kept and hash like an empty one; repeated rows
    count each. Other columns are not read, whatever their names. An empty table gives no
    centroids and no rows.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vector_col, dims, scale)
    ends = kept.agg(*[f(F.col("_v")[i]) for f in (F.min, F.max) for i in range(dims)]).first()
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = kept.select(order.alias("_h"), "_v").orderBy("_h", "_v").limit(k).collect()
    low, high = ([x or 0 for x in ends[at : at + dims]] for at in (0, dims))
    centroids = np.array([r["_v"] for r in first], dtype=np.int64).reshape(-1, dims)

    kind = kept.schema["_id"].dataType.simpleString()
    placed = stage(kept.mapInArrow(_places(low, high, bits), f"_id {kind}, _place binary, _v binary"), "places")
    dealt = placed.withColumn("_deal", F.rand(7)).repartitionByRange("_place", "_deal").sortWithinPartitions("_place", "_deal")
    shape = f"_ids array<{kind}>, _vs binary, _low array<int>, _high array<int>"
    blocks = stage(dealt.select("_id", "_v").mapInArrow(_blocks(dims, block), shape), "blocks")

    for _ in range(rounds if len(centroids) else 0):
        parts = blocks.mapInArrow(_sums(centroids), "cluster int, n bigint, sums array<bigint>")
        sums = [F.sum(F.col("sums")[i].cast("decimal(20,0)")) for i in range(dims)]
        for row in parts.groupBy("cluster").agg(F.sum("n"), *sums).collect():  # k rows
            centroids[row[0]] = [int(s) // row[1] for s in row[2:]]
    if len(centroids):
        assigned = blocks.mapInArrow(_assign(centroids), f"_id {kind}, cluster int, distance bigint")
    else:
        assigned = kept.select("_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    return Clustering(stage(assigned.withColumnRenamed("_id", id_col), "assigned"), centroids.tolist(), blocks)


def inertias(found: Clustering) -> tuple[dict[int, int], int]:
    """Squared distances summed over each cluster, and over all."""
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    each = {r[0]: int(r[1]) for r in found.assigned.groupBy("cluster").agg(total).collect()}  # k rows
    return each, sum(each.values())
