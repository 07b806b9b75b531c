"""Isotonic regression on the lower convex hull of the cumulative sums, without a central table.

With scores in rising order, the fitted values are the slopes of the greatest convex function below
the points (rows so far, positives so far). Every range of scores finds the hull of its own
points. The hull of all points is made of stretches of those and of bridges between ranges. A
first set of points, the ends of each range's hull and their neighbours, gives first bridges;
then, round by round, each range reports its point farthest below the line of every bridge that
touches it, until there is none. The driver holds a few points per range of ``rows_per_task``
scores; the blocks stay in a table of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from riskloom.plans.staging import stage

Point = tuple[int, int]
Bridge = tuple[int, int, int, int, int, int]  # x and y of both ends, first and last range it may touch


def depth(a: Point, p: Point, b: Point) -> int:
    """How far p lies below the line through a and b, times their distance in x; exact."""
    return (p[0] - a[0]) * (b[1] - a[1]) - (p[1] - a[1]) * (b[0] - a[0])


def lower_hull(points: Sequence[Point]) -> list[int]:
    """Positions of the corners of the lower hull of points in the order of x."""
    out: list[int] = []
    for i, p in enumerate(points):
        while len(out) > 1 and depth(points[out[-2]], points[out[-1]], p) <= 0:
            out.pop()
        out.append(i)
    return out


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corners of one sorted range, counted from its beginning, with first and last score of the block each one ends."""
    part = TaskContext.get().partitionId()
    # every corner as (x, y, first score, last score) after a start of its own
    corners: list[tuple] = [(0, 0, None, None)]
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("score", "n", "pos")], strict=True)
        for score, n, pos in rows:
            x, y, first = corners[-1][0] + n, corners[-1][1] + pos, score
            while len(corners) > 1 and depth(corners[-2][:2], corners[-1][:2], (x, y)) <= 0:
                first = corners.pop()[2]
            corners.append((x, y, first, score))
    names = ("x", "y", "lo", "hi")
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    for at in range(1, len(corners), 1 << 16):
        piece = corners[at : at + (1 << 16)]
        before = corners[at - 1 : at - 1 + len(piece)]
        columns = [pa.array([c[i] for c in piece], kind) for i, kind in enumerate(kinds)]
        steps = [pa.array([c[i] - b[i] for c, b in zip(piece, before, strict=True)], pa.int64()) for i in (0, 1)]
        place = pa.array(np.full(len(piece), part, dtype=np.int32))
        number = pa.array(np.arange(at, at + len(piece), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([place, number, *columns, *steps], names=["part", "number", *names, "n", "pos"])


HULLS = "part int, number long, x long, y long, lo double, hi double, n long, pos long"


def _touching(bridges: list[Bridge], starts: dict[int, Point]):
    """For each bridge, the range's point farthest below its line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for part in np.unique(parts).tolist():
                own = parts == part
                x = batch.column("x").to_numpy()[own] + starts[part][0]
                y = batch.column("y").to_numpy()[own] + starts[part][1]
                for b, (x0, y0, x1, y1, first, last) in enumerate(bridges):
                    if not first <= part <= last:
                        continue
                    below = (x - x0).astype(np.float64) * float(y1 - y0) - (y - y0).astype(np.float64) * float(x1 - x0)
                    i = int(below.argmax())
                    p = (int(x[i]), int(y[i]))
                    d = depth((x0, y0), p, (x1, y1))
                    if d > best.get((b, part), (0,))[0]:
                        best[b, part] = (d, *p)
        rows = [(part, x, y) for (_, part), (_, x, y) in best.items()]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "x", "y"])

    return run


def _under(bridges: list[Bridge], starts: dict[int, Point]):
    """Blocks with the number of the bridge that replaces them, or -1; those of one bridge are merged per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.array([b[0] for b in bridges], dtype=np.int64)
        end = np.array([b[2] for b in bridges], dtype=np.int64)
        merged: dict[int, list[float]] = {}
        for batch in batches:
            parts = batch.column("part").to_numpy()
            shift = {p: starts[p][0] for p in np.unique(parts).tolist()}
            x = batch.column("x").to_numpy() + np.array([shift[p] for p in parts.tolist()], dtype=np.int64)
            at = np.searchsorted(begin, x, "left") - 1  # the last bridge that begins before x
            under = (at >= 0) & (x <= end[at]) if len(bridges) else np.zeros(len(x), dtype=bool)
            lo, hi, n, pos = (batch.column(c).to_numpy() for c in ("lo", "hi", "n", "pos"))
            for b in np.unique(at[under]).tolist():
                own = under & (at == b)
                known = merged.setdefault(b, [np.inf, -np.inf])
                known[:] = min(known[0], lo[own].min()), max(known[1], hi[own].max())
            free = ~under
            columns = [np.full(int(free.sum()), -1, dtype=np.int32), lo[free], hi[free], pos[free] / n[free]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bridge", "lo", "hi", "value"])
        rows = [(b, lo, hi, (bridges[b][3] - bridges[b][1]) / (bridges[b][2] - bridges[b][0])) for b, (lo, hi) in merged.items()]
        kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bridge", "lo", "hi", "value"])

    return run


def isotonic_blocks(weights: DataFrame, rows_per_task: int = 1 << 18) -> DataFrame:
    """``lo, hi, value``: runs of scores with one fitted value, for distinct ``(score, n, pos)`` rows; no rows, no blocks."""
    tasks = max(1, -(-weights.count() // rows_per_task))
    ranged = weights.select("score", "n", "pos").repartitionByRange(tasks, "score").sortWithinPartitions("score")
    hulls = ranged.mapInArrow(_hulls, HULLS)
    if tasks == 1:
        return hulls.select("lo", "hi", (F.col("pos") / F.col("n")).alias("value"))
    hulls = stage(hulls, "hulls")
    corner = F.struct("number", "x", "y")
    ends = hulls.groupBy("part").agg(F.min(corner).alias("a"), F.max("number").alias("m"), F.max(corner).alias("z"))
    last = hulls.join(ends.select("part", F.col("m").alias("_m")), "part").filter(F.col("number") >= F.col("_m") - 1)
    facts = {r["part"]: r for r in ends.collect()}
    starts: dict[int, Point] = {}
    places: dict[Point, set[int]] = {(0, 0): {min(facts)}}  # known points and the ranges they belong to
    at, parts = (0, 0), sorted(facts)
    for k, part in enumerate(parts):
        starts[part] = at
        at = (at[0] + facts[part]["z"]["x"], at[1] + facts[part]["z"]["y"])
        places.setdefault(at, set()).update(parts[k : k + 2])
    near = [(r["part"], r["a"]["x"], r["a"]["y"]) for r in facts.values()]
    near += [(r["part"], r["x"], r["y"]) for r in last.select("part", "x", "y").collect()]
    while True:
        for part, x, y in near:
            places.setdefault((x + starts[part][0], y + starts[part][1]), set()).add(part)
        points = sorted(places)
        corners = [points[i] for i in lower_hull(points)]
        bridges = [
            (*a, *b, min(places[a]), max(places[b]))
            for a, b in zip(corners, corners[1:], strict=False)
            if not places[a] & places[b]
        ]
        if not bridges:
            break
        found = [tuple(r) for r in hulls.mapInArrow(_touching(bridges, starts), "part int, x long, y long").collect()]
        near = [(p, x - starts[p][0], y - starts[p][1]) for p, x, y in found if (x, y) not in places]
        if not near:
            break
    blocks = hulls.mapInArrow(_under(bridges, starts), "bridge int, lo double, hi double, value double")
    crossed = blocks.filter("bridge >= 0").groupBy("bridge", "value").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return blocks.filter("bridge < 0").select("lo", "hi", "value").unionByName(crossed.select("lo", "hi", "value"))


def break_points(blocks: DataFrame) -> DataFrame:
    """``(x, y)``: both ends of every block."""
    ends = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    return blocks.select(F.explode(ends).alias("x"), F.col("value").alias("y"))


def interpolate(df: DataFrame, column: str, points: DataFrame, out: str, rows_per_task: int = 1 << 18) -> DataFrame:
    """``out``: the line through sorted ``(x, y)`` points at the column's value, flat outside them.

    For points too many for one place. Distinct values and points are sorted together by
    ranges, each range takes the last point before and the first after it, and the rows look their
    value up by an equi-join. NULL and NaN give NULL.
    """
    value = F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))
    asked = df.select(value.alias("x")).filter("x IS NOT NULL").distinct().withColumn("y", F.lit(None).cast("double"))
    both = stage(asked.unionByName(points.select("x", "y")), "points")
    tasks = max(1, -(-both.count() // rows_per_task))
    ranged = both.repartitionByRange(tasks, "x")
    placed = stage(ranged.select(F.spark_partition_id().alias("part"), "x", "y"), "placed")
    known = placed.filter("y IS NOT NULL").groupBy("part").agg(F.min(F.struct("x", "y")), F.max(F.struct("x", "y"))).collect()
    edges = {r[0]: (tuple(r[1]), tuple(r[2])) for r in known}  # two points per range

    def of_range(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        own = ~np.isnan(y)
        order = np.argsort(x[own], kind="stable")
        px, py = x[own][order].tolist(), y[own][order].tolist()
        earlier = max((e[1] for p, e in edges.items() if p < part), default=None)
        later = min((e[0] for p, e in edges.items() if p > part), default=None)
        px = ([earlier[0]] if earlier else []) + px + ([later[0]] if later else [])
        py = ([earlier[1]] if earlier else []) + py + ([later[1]] if later else [])
        wanted = x[~own]
        return pa.table({"_x": wanted, "_y": np.interp(wanted, px, py)}, schema=pa.schema([("_x", pa.float64()), ("_y", pa.float64())]))

    looked = stage(placed.groupBy("part").applyInArrow(of_range, "_x double, _y double"), "interpolated")
    return df.withColumn("_v", value).join(looked, F.col("_v") == F.col("_x"), "left").withColumn(out, F.col("_y")).drop("_v", "_x", "_y")
