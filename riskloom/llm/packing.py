"""Best-fit packing after Martello-Toth dominance reduction.

Tasks tokenise the texts, cut them into pieces and number the pieces of each length. The whole
instance of the packing problem is then the number of pieces of each length, at most one entry
per length up to the capacity, whatever the input; this is all that reaches the driver. There

1. **dominance**: a set of lengths that contains length j and dominates every other set that
   does is fixed for good: a piece next to which nothing fits; two pieces that fill a sequence
   exactly; the largest partner where only one fits; the largest partner where at most two fit
   and no two of them exceed it; and a pair of partners that covers all others. Fixed pieces
   leave the instance, and the rules run again until none applies;
2. **best fit**, by falling length, packs what is left: each piece goes into the fullest
   sequence that has room. Equal sequences are handled together, so the work depends on the
   capacity and not on the number of pieces.

The plan is a table of rank ranges per length; each piece finds its place by its rank. Ranks
are local numbers plus the counts of the tasks before, so no order over all pieces is needed.

A null text counts as empty and is one piece of the end id alone. Repeated rows and ids are
packed like any others, each row for itself. An empty table gives no rows. Columns other than
id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.llm.common import stage
from riskloom.llm.tokens import crc32_of, encode

Pattern = tuple[tuple[int, int], ...]  # (length, pieces of this length), in order of place


def _smallest(counts: np.ndarray, without: int, n: int) -> list[int]:
    """The n smallest lengths left, each as often as it occurs, one piece of ``without`` left out."""
    out: list[int] = []
    for s in np.flatnonzero(counts).tolist():
        out += [s] * min(int(counts[s]) - (s == without), n - len(out))
        if len(out) >= n:
            break
    return out


def _largest(counts: np.ndarray, limit: int, without: tuple[int, ...] = ()) -> int:
    """The largest length up to ``limit`` of which a piece is left beside those of ``without``; 0: none."""
    for s in np.flatnonzero(counts[: limit + 1])[::-1].tolist():
        if counts[s] > without.count(s):
            return s
    return 0


def _best_pair(counts: np.ndarray, j: int, room: int) -> int:
    """The largest sum of two pieces, beside one of j, that fits ``room``; 0: none."""
    best = 0
    for a in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        if 2 * a <= best:
            break
        if counts[a] > (a == j):
            b = _largest(counts, min(a, room - a), (j, a))
            best = max(best, a + b if b else 0)
    return best


def _dominating(counts: np.ndarray, j: int, capacity: int) -> Pattern | None:
    """Partners of a piece of length j that dominate all other choices; None: no rule applies."""
    room = capacity - j
    k = _largest(counts, room, (j,))
    if not k:
        return ()
    if k == room:
        return ((k, 1),)
    few = _smallest(counts, j, 3)
    if len(few) < 2 or few[0] + few[1] > room:
        return ((k, 1),)
    if len(few) < 3 or sum(few) > room:
        if k >= _best_pair(counts, j, room):
            return ((k, 1),)
        b = _largest(counts, min(k, room - k), (j, k))
        if b:
            # {k, b} must cover every pair: piece by piece, or both in the place of k
            covered = True
            for y in np.flatnonzero(counts[: room // 2 + 1]).tolist():
                if y > b and counts[y] > (y == j):
                    x = _largest(counts, room - y, (j, y))
                    covered &= not x or x + y <= k
            if covered:
                return ((k, 1), (b, 1)) if k != b else ((k, 2),)
    return None


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """Fix dominating sets and take their pieces from ``counts``: (times, pattern) pairs."""
    fixed: list[tuple[int, Pattern]] = []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                partners = _dominating(counts, j, capacity)
                if partners is None:
                    break
                need: dict[int, int] = {j: 1}
                for s, t in partners:
                    need[s] = need.get(s, 0) + t
                # the same set again while the rule's ground stays: an exact or single partner always does
                often = len(partners) == 0 or (len(partners) == 1 and partners[0][1] == 1)
                times = min(int(counts[s]) // t for s, t in need.items()) if often else 1
                pattern = ((j, 1), *partners)
                fixed.append((times, pattern))
                for s, t in need.items():
                    counts[s] -= times * t
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """Best fit by falling length over groups of equal sequences: (times, pattern) pairs."""
    open_: dict[int, list[tuple[int, Pattern]]] = {}
    rooms = np.zeros(capacity + 1, dtype=np.int64)

    def put(times: int, pattern: Pattern, room: int) -> None:
        if times:
            open_.setdefault(room, []).append((times, pattern))
            rooms[room] += 1

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            fitting = np.flatnonzero(rooms[s:])
            room = s + int(fitting[0]) if len(fitting) else capacity
            each = room // s
            if len(fitting):
                times, pattern = open_[room].pop()
                rooms[room] -= 1
            else:
                times, pattern = max(1, n // each), ()
            whole = min(times, n // each)
            if whole:
                put(whole, (*pattern, (s, each)), room - s * each)
                put(times - whole, pattern, room)
                n -= whole * each
            else:
                put(1, (*pattern, (s, n)), room - s * n)
                put(times - 1, pattern, room)
                n = 0
    return [group for groups in open_.values() for group in groups]


def plan(counts: np.ndarray, capacity: int) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, pieces per sequence, first sequence, offset), by rank."""
    left = counts.copy()
    groups = reduce_dominated(left, capacity)
    groups += best_fit(left, capacity)
    used = np.zeros(capacity + 1, dtype=np.int64)
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, pattern in groups:
        offset = 0
        for s, t in pattern:
            out.setdefault(s, []).append((int(used[s]), t, sequence, offset))
            used[s] += times * t
            offset += s * t
        sequence += times
    return {s: np.array(rows, dtype=np.int64) for s, rows in out.items()}


def locate(places: dict[int, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, by length and rank."""
    sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
    for s in np.unique(length).tolist():
        at = np.flatnonzero(length == s)
        rows = places[s]
        first, each, base, off = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1].T
        copy, slot = np.divmod(rank[at] - first, each)
        sequence[at], offset[at] = base + copy, off + slot * s
    return sequence, offset


def _pieces(capacity: int, end_id: int, vocabulary: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            at, piece, start, length, crc, rank = [], [], [], [], [], []
            for row, text in enumerate(batch.column("_t").to_pylist()):
                ids = np.array([*encode(text, **vocabulary), end_id], dtype=np.uint32)
                begin, size = 0, len(ids) % capacity or capacity
                for k in range(-(-len(ids) // capacity)):
                    at.append(row)
                    piece.append(k)
                    start.append(begin)
                    length.append(size)
                    crc.append(crc32_of(ids[begin : begin + size]))
                    rank.append(int(seen[size]))
                    seen[size] += 1
                    begin, size = begin + size, capacity
            columns = [batch.column("_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, rank)]
            columns.append(pa.array(np.full(len(at), part, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "piece", "start", "length", "ids_crc32", "_r", "_part"])

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, **vocabulary: str
) -> DataFrame:
    """Per piece: id, ``piece, start, length, ids_crc32, sequence_id, offset``.

    Only a document longer than ``capacity`` is cut; its first piece takes the odd rest.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    kind = texts.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long, _r long, _part int"
    pieces = stage(texts.mapInArrow(_pieces(capacity, end_id, vocabulary), schema), "pieces")

    counts = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = stage(counts, "counts")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most one row per length
        histogram[row["length"]] = row["n"]
    places = plan(histogram, capacity)

    @F.arrow_udf("struct<sequence_id long, offset long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = locate(places, length.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    ranked = pieces.join(counts.select("_part", "length", "_before"), ["_part", "length"])
    placed = ranked.withColumn("_p", place(F.col("length"), F.col("_before") + F.col("_r")))
    return placed.select(
        F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset"
    )
