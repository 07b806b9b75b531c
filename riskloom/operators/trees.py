"""Spark's gradient-boosted trees, grown over blocks of binned rows.

Cut points, gains, leaves, residuals and stopping are those of ``GBTClassifier`` for log loss, and the
result is its model. Rows are read once, as blocks of one byte per feature; a level of the trees of all
classes is one pass over the blocks with one table of sums per task. Rows of equal bins and label
cannot be told apart by any tree: where so few can differ that a task holds them, they are merged with
their weights and one task grows all trees.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.plans.staging import new_stage_path, stage

if TYPE_CHECKING:  # tasks import this module, and need none of it
    from pyspark.ml.classification import GBTClassificationModel, GBTClassifier

EPSILON = 2.0**-52
BLOCK_ROWS = 1 << 16
REFRESH = 8  # trees that a pass may add to the margins of the blocks

BLOCKS = "held boolean, bins binary, y binary, w binary, margins binary"
CELLS = "cell long, w double"
SUMS = "tree int, node int, feature int, sums binary"
GROWN = "tree int, grown binary"


@dataclass
class Tree:
    """Nodes in lists; ``stats`` are the sums of weight, residual and its square. A node without cut has feature -1."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    stats: list[tuple[float, float, float]] = field(default_factory=list)

    def add(self, stats: tuple[float, float, float]) -> int:
        for values, v in zip((self.feature, self.bin, self.left, self.right, self.gain, self.stats), (-1, 0, -1, -1, -1.0, stats)):
            values.append(v)
        return len(self.feature) - 1

    def value(self, node: int) -> float:
        w, s, _ = self.stats[node]
        return s / w if w else 0.0

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf, or node still without cut, of each row."""
        kind = np.uint8 if len(self.feature) < 256 else np.uint16 if len(self.feature) < 1 << 16 else np.int64
        at = np.zeros(bins.shape[1], dtype=kind)
        for node, f in enumerate(self.feature):  # parents come before their children
            if f >= 0:
                here = at == node
                at += here.astype(kind) * kind(self.left[node] - node)
                here &= bins[f] > self.bin[node]
                at += here.astype(kind) * kind(self.right[node] - self.left[node])
        return at

    def values_of(self, bins: np.ndarray) -> np.ndarray:
        return np.array([self.value(n) for n in range(len(self.feature))]).take(self.nodes_of(bins))


@dataclass
class Block:
    held: bool
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray | None
    margins: np.ndarray | None


@dataclass(frozen=True)
class Growth:
    rounds: int
    max_depth: int
    step_size: float
    tolerance: float


@dataclass(frozen=True)
class Binned:
    """Blocks or cells of all rows, with the cut points of each feature."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    labels: int
    rows: DataFrame
    weighted: bool
    validated: bool
    cells: bool
    small: bool


# ---- cut points


def cuts_of(values: np.ndarray, weights: np.ndarray, expected: float, n_cuts: int) -> tuple[float, ...]:
    """Cut points of one feature from the drawn rows, as ``RandomForest.findSplitsForContinuousFeature`` chooses them.

    ``expected`` is the weight that the draw stands for; what the rows other than zero lack of it counts as zeros.
    """
    some = values != 0.0
    found, place = np.unique(values[some], return_inverse=True)
    if not len(found):
        return ()
    n = np.bincount(place, weights[some])
    lack = expected - float(n.sum())
    if lack > EPSILON * int(some.sum()) * 100:
        at = int(np.searchsorted(found, 0.0))
        found, n = np.insert(found, at, 0.0), np.insert(n, at, lack)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= n_cuts:
        return tuple(middles.tolist())
    stride = target = expected / (n_cuts + 1)
    upto = np.cumsum(n).tolist()
    cuts = []
    for i in range(1, len(found)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            cuts.append(float(middles[i - 1]))
            target += stride
    return tuple(cuts)


def drawn(df: DataFrame, n: int, max_bins: int, seed: int) -> tuple[DataFrame, float]:
    """The rows by which Spark's trees choose their cut points, and their share: its own draw, all rows of up to 10,000."""
    share = min(1.0, max(max_bins * max_bins, 10000) / n)
    if share == 1.0:
        return df, share
    spark = df.sparkSession
    start = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    rows = df._jdf.queryExecution().toRdd().sample(False, share, start)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark), share


# ---- rows to blocks or cells


def _binned(batches: Iterator[pa.RecordBatch], cuts: Sequence[Sequence[float]], labels: int, weighted: bool, validated: bool) -> Iterator[Block]:
    """Blocks of up to ``BLOCK_ROWS`` rows; a block has only held rows, or none."""
    cuts = [np.array(c) for c in cuts]
    kind = np.uint8 if labels <= 256 else np.int32

    def made(parts: list[pa.RecordBatch]) -> Iterator[Block]:
        table = pa.Table.from_batches(parts)
        columns = [c.to_numpy().astype(np.float64, copy=False) for c in table.columns]
        values, y = columns[: len(cuts)], columns[len(cuts)]
        w = columns[len(cuts) + 1] if weighted else None
        for v in values:
            if not np.isfinite(v).all():
                raise ValueError("a feature has missing or infinite values")
        if not ((y >= 0) & (y == np.floor(y)) & (y < labels)).all():
            raise ValueError(f"labels must be whole numbers from 0 to {labels - 1}")
        if weighted and not ((w >= 0) & np.isfinite(w)).all():
            raise ValueError("weights must be numbers that are not negative")
        bins = np.stack([np.searchsorted(c, v).astype(np.uint8) for c, v in zip(cuts, values, strict=True)])
        held = columns[-1] > 0 if validated else np.zeros(len(y), dtype=bool)
        for side in (False, True):
            at = held == side
            if at.any():
                yield Block(side, bins[:, at], y[at].astype(kind), w[at] if weighted else None, None)

    parts: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            if rows and rows + part.num_rows > BLOCK_ROWS:
                yield from made(parts)
                parts, rows = [], 0
            parts.append(part)
            rows += part.num_rows
    if rows:
        yield from made(parts)


def _packed(block: Block) -> pa.RecordBatch:
    parts = (block.bins, block.y, block.w, block.margins)
    row = [pa.array([block.held]), *[pa.array([None if p is None else np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]]
    return pa.RecordBatch.from_arrays(row, names=["held", "bins", "y", "w", "margins"])


def _blocks(batch: pa.RecordBatch, n_features: int, labels: int) -> Iterator[Block]:
    kind = np.uint8 if labels <= 256 else np.int32
    for i in range(batch.num_rows):
        bins, y, w, margins = (batch.column(c)[i].as_buffer() for c in range(1, 5))
        y = np.frombuffer(y, dtype=kind)
        yield Block(
            batch.column(0)[i].as_py(), np.frombuffer(bins, dtype=np.uint8).reshape(n_features, len(y)), y,
            None if w is None else np.frombuffer(w, dtype=np.float64),
            None if margins is None else np.frombuffer(margins, dtype=np.float64).reshape(-1, len(y)),
        )


def _sides(cuts: Sequence[Sequence[float]], labels: int) -> list[int]:
    """Number of values of each digit of a cell: bins by feature, label, held or not."""
    return [*[len(c) + 1 for c in cuts], labels, 2]


def _to_cells(cuts, labels: int, weighted: bool, validated: bool):
    """Per task, the weight of each combination of bins, label and flag that occurs."""
    sides = _sides(cuts, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(math.prod(sides)), np.zeros(math.prod(sides), dtype=bool)
        for block in _binned(batches, cuts, labels, weighted, validated):
            digits = (*block.bins.astype(np.int64), block.y.astype(np.int64), np.full(len(block.y), int(block.held)))
            cell = np.ravel_multi_index(digits, sides)
            found, place = np.unique(cell, return_inverse=True)
            total[found] += np.bincount(place, block.w)
            met[found] = True
        cells = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "w"])

    return run


def _of_cells(batches: Iterator[pa.RecordBatch], cuts, labels: int) -> Iterator[Block]:
    sides = _sides(cuts, labels)
    kind = np.uint8 if labels <= 256 else np.int32
    table = pa.Table.from_batches(list(batches), pa.schema([("cell", pa.int64()), ("w", pa.float64())]))
    for start in range(0, table.num_rows, BLOCK_ROWS):
        part = table.slice(start, BLOCK_ROWS)
        *bins, y, held = np.unravel_index(part.column(0).to_numpy(), sides)
        w = part.column(1).to_numpy()
        for side in (0, 1):
            at = held == side
            if at.any():
                yield Block(bool(side), np.stack([b[at].astype(np.uint8) for b in bins]), y[at].astype(kind), w[at], None)


def bin_rows(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    weight: str | None,
    validation: str | None,
    n_classes: int,
    max_bins: int,
    seed: int,
    held_rows: int,
) -> Binned:
    """All rows as blocks, or as cells where at most ``held_rows`` can differ; the rows themselves are made once."""
    features = tuple(features)
    doubles = [F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    rows = df.select(
        *doubles,
        F.col(f"`{label}`").cast("double").alias("y"),
        *([F.col(f"`{weight}`").cast("double").alias("w")] if weight else []),
        *([F.col(f"`{validation}`").cast("boolean").alias("held")] if validation else []),
    )
    rows = stage(rows, "tree_rows")
    w, own = F.col("w") if weight else F.lit(1.0), ~F.col("held") if validation else F.lit(True)
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(own).alias("n_own"), F.sum(F.when(own, w)).alias("w"), F.max("y").alias("top")
    ).first()
    if not facts["n_own"]:
        raise ValueError("there are no rows to grow trees from")
    labels = 2 if n_classes == 2 else int(facts["top"] or 0) + 1
    names = [f"f{i}" for i in range(len(features))]
    grown = rows.filter(own) if validation else rows
    draw, share = drawn(grown.select(*names, *(["w"] if weight else [])), facts["n_own"], max_bins, seed)
    table = draw.toArrow()
    weights = table.column("w").to_numpy() if weight else np.ones(table.num_rows)
    n_cuts = min(max_bins, facts["n_own"]) - 1
    cuts = tuple(cuts_of(np.nan_to_num(table.column(n).to_numpy().astype(np.float64)), weights, share * (facts["w"] or 0.0), n_cuts) for n in names)
    if validation:
        rows = rows.filter("held IS NOT NULL")
    args = (cuts, labels, bool(weight), bool(validation))
    most = math.prod(_sides(cuts, labels)[:-1]) * (2 if validation else 1)
    cells, small = most <= held_rows, facts["n"] <= held_rows or most <= held_rows
    if cells:
        met = rows.mapInArrow(_to_cells(*args), CELLS).groupBy("cell").agg(F.sum("w").alias("w"))
        packed = stage(met.repartition(1).sortWithinPartitions("cell"), "cells")
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from map(_packed, _binned(batches, *args))

        packed = stage(rows.mapInArrow(run, BLOCKS), "binned")
    return Binned(features, cuts, labels, packed, bool(weight), bool(validation), cells, small)


# ---- sums and trees

Looked = tuple[dict[tuple[int, int], np.ndarray], dict[int, tuple[float, float]]]


def _margins(block: Block, classes: Sequence[int], newest: Sequence[Sequence[tuple[float, Tree]]]) -> list[np.ndarray | None]:
    out = []
    for k in range(len(classes)):
        m = None if block.margins is None else block.margins[k]
        for scale, tree in newest[k]:
            added = scale * tree.values_of(block.bins)
            m = added if m is None else m + added
        out.append(m)
    return out


class Sums:
    """Sums of weight, residual and its square by open node, feature and bin, and the log loss of the held rows."""

    def __init__(self, used: Sequence[int], width: int, classes: Sequence[int], growing: Sequence[Tree], open_: Sequence[Sequence[int]], losses: bool):
        self.used, self.width, self.classes, self.growing, self.open, self.losses = used, width, classes, growing, open_, losses
        self.total = [np.zeros((len(used), 3, (len(nodes) + 1) * width)) for nodes in open_]  # closed nodes share the last place
        self.loss = np.zeros((len(classes), 2))

    def add(self, block: Block, margins: Sequence[np.ndarray | None]) -> None:
        for k, label in enumerate(self.classes):
            if block.held and not self.losses or not block.held and not self.open[k]:
                continue
            sign = np.where(block.y == label, 1.0, -1.0)
            m = margins[k]
            if block.held:
                if m is not None:
                    loss = 2.0 * np.logaddexp(0.0, -2.0 * sign * m)
                    self.loss[k] += (loss.sum(), len(loss)) if block.w is None else ((loss * block.w).sum(), block.w.sum())
                continue
            r = sign
            if m is not None:
                with np.errstate(over="ignore"):
                    r = 4.0 * sign / (1.0 + np.exp(2.0 * sign * m))
            wr = r if block.w is None else block.w * r
            sums = (block.w, wr, wr * r)
            nodes, tree = self.open[k], self.growing[k]
            place = None
            if len(tree.feature) > 1:
                slot = np.full(len(tree.feature), len(nodes) * self.width)
                slot[list(nodes)] = np.arange(len(nodes)) * self.width
                place = slot.take(tree.nodes_of(block.bins))
            size = self.total[k].shape[2]
            for j, f in enumerate(self.used):
                cell = block.bins[f].astype(np.int64) if place is None else place + block.bins[f]
                for d, values in enumerate(sums):
                    self.total[k][j, d] += np.bincount(cell, values, size)

    def tables(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        for k, nodes in enumerate(self.open):
            cells = self.total[k].reshape(len(self.used), 3, len(nodes) + 1, self.width)
            for i, node in enumerate(nodes):
                for j in range(len(self.used)):
                    yield k, node, j, cells[j, :, i]


def variance(w: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.where(w == 0, 0.0, (q - s * s / np.where(w == 0, 1.0, w)) / np.where(w == 0, 1.0, w))


def best_cut(sums: np.ndarray, n_cuts: np.ndarray, parent: tuple[float, float, float] | None) -> tuple[float, int, int, tuple, tuple, tuple]:
    """(gain, feature, bin, own sums, left sums, right sums) of the first best cut of ``sums[feature, kind, bin]``; gain -inf where none is valid."""
    upto = np.cumsum(sums, axis=2)
    left, total = upto[:, :, :-1], upto[:, :, -1:]
    right = total - left
    some = np.flatnonzero(n_cuts)
    own = parent or tuple(total[some[0] if len(some) else 0, :, 0].tolist())
    lw, rw = left[:, 0], right[:, 0]
    n = np.where(lw + rw == 0, 1.0, lw + rw)
    gain = float(variance(*map(np.float64, own))) - lw / n * variance(*left.transpose(1, 0, 2)) - rw / n * variance(*right.transpose(1, 0, 2))
    valid = (np.arange(gain.shape[1]) < n_cuts[:, None]) & (lw > 0) & (rw > 0) & (gain >= 0)
    gain = np.where(valid, gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[f, b]), int(f), int(b), own, tuple(left[f, :, b].tolist()), tuple(right[f, :, b].tolist())


def _cut_nodes(tree: Tree, nodes: Sequence[int], found: dict[int, np.ndarray], used: Sequence[int], n_cuts: np.ndarray, last: bool) -> list[int]:
    """Cut the open nodes where it pays; the children to look at next."""
    opened = []
    for node in nodes:
        known = tree.stats[node] if len(tree.feature) > 1 else None
        gain, f, b, own, *sides = best_cut(found[node], n_cuts, known)
        tree.stats[node], tree.gain[node] = own, gain
        if not gain > 0:
            continue
        tree.feature[node], tree.bin[node] = used[f], b
        tree.left[node], tree.right[node] = children = [tree.add(side) for side in sides]
        opened += [c for c in children if not last and abs(float(variance(*map(np.float64, tree.stats[c])))) >= EPSILON]
    return opened


def boost(look: Callable[..., Looked], added: Callable[[list], None], used, cuts, classes: Sequence[int], params: Growth, validated: bool) -> list[list[tuple[float, Tree]]]:
    """The trees of each class with their weights. ``look`` gives the sums of the open nodes and the held rows' losses, ``added`` takes new trees.

    With held rows a class ends as soon as its loss no longer falls by ``tolerance``, and keeps the trees up to the best.
    """
    n_cuts = np.array([len(cuts[f]) for f in used])
    done: list[list[tuple[float, Tree]]] = [[] for _ in classes]
    best: list[tuple[float, int] | None] = [None] * len(classes)
    live = set(range(len(classes)))

    def judge(losses: dict[int, tuple[float, float]]) -> None:
        for k in sorted(live & losses.keys()):
            total, weight = losses[k]
            now = total / weight if weight else float("nan")
            if best[k] is None:
                best[k] = (now, 1)
            elif best[k][0] - now < params.tolerance * max(now, 0.01):
                live.discard(k)
            elif now < best[k][0]:
                best[k] = (now, len(done[k]))

    for m in range(params.rounds):
        growing = [Tree() for _ in classes]
        open_ = [[t.add((0.0, 0.0, 0.0))] if k in live else [] for k, t in enumerate(growing)]
        for level in range(params.max_depth):
            wanted = validated and level == 0 and m > 0
            found, losses = look(growing, open_, wanted)
            if wanted:
                judge(losses)
                open_ = [nodes if k in live else [] for k, nodes in enumerate(open_)]
            open_ = [
                _cut_nodes(growing[k], nodes, {n: found[k, n] for n in nodes}, used, n_cuts, level + 1 == params.max_depth) if nodes else []
                for k, nodes in enumerate(open_)
            ]
            if not any(open_):
                break
        if not live:
            break
        new = [[(params.step_size if m else 1.0, growing[k])] if k in live else [] for k in range(len(classes))]
        for k, trees in enumerate(new):
            done[k] += trees
        added(new)
    if validated and live and params.rounds > 1:
        judge(look([Tree() for _ in classes], [[] for _ in classes], True)[1])
    return [trees[: best[k][1]] if best[k] else trees for k, trees in enumerate(done)]


def _width(binned: Binned) -> int:
    return max(2, 1 + max(map(len, binned.cuts)))


def _in_task(binned: Binned, used: Sequence[int], classes: Sequence[int], params: Growth):
    """Grow all trees in the task that gets all rows."""
    cuts, labels, n_features = binned.cuts, binned.labels, len(binned.cuts)
    cells, validated, width = binned.cells, binned.validated, _width(binned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cells:
            blocks = list(_of_cells(batches, cuts, labels))
        else:
            blocks = [block for batch in batches for block in _blocks(batch, n_features, labels)]
        if not blocks:
            return

        def look(growing, open_, losses):
            sums = Sums(used, width, classes, growing, open_, losses)
            for block in blocks:
                sums.add(block, block.margins if block.margins is not None else [None] * len(classes))
            found: dict[tuple[int, int], list] = {}
            for k, node, _, table in sums.tables():
                found.setdefault((k, node), []).append(table)
            return {key: np.stack(tables) for key, tables in found.items()}, {k: tuple(v) for k, v in enumerate(sums.loss.tolist())}

        def added(new):
            for block in blocks:
                zeros = np.zeros(len(block.y))
                block.margins = np.stack([zeros if m is None else m for m in _margins(block, classes, new)])

        grown = boost(look, added, used, cuts, classes, params, validated)
        for k, trees in enumerate(grown):
            said = json.dumps([(scale, vars(tree)) for scale, tree in trees]).encode()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([said], pa.binary())], names=["tree", "grown"])

    return run


def _merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, dtype=np.float64) for b in rows.column("sums").to_pylist()], axis=0)
    columns = [*[pa.array([k.as_py()], pa.int32()) for k in key], pa.array([total.tobytes()], pa.binary())]
    return pa.table(columns, names=["tree", "node", "feature", "sums"])


def _over_tasks(binned: Binned, used: Sequence[int], classes: Sequence[int], params: Growth) -> list[list[tuple[float, Tree]]]:
    """Grow trees level by level, with one pass of all tasks each."""
    labels, n_features, width = binned.labels, len(binned.cuts), _width(binned)
    rows, newest = binned.rows, [[] for _ in classes]

    def look(growing, open_, losses):
        base = [list(trees) for trees in newest]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(used, width, classes, growing, open_, losses)
            for batch in batches:
                for block in _blocks(batch, n_features, labels):
                    sums.add(block, _margins(block, classes, base))
            out = [*sums.tables(), *[(k, -1, -1, sums.loss[k]) for k in range(len(classes)) if losses]]
            columns = [pa.array([r[i] for r in out], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[3].tobytes() for r in out], pa.binary())], names=["tree", "node", "feature", "sums"])

        wanted = rows if losses and any(open_) else rows.filter("held" if losses else "NOT held")
        tables = wanted.mapInArrow(run, SUMS).groupBy("tree", "node", "feature").applyInArrow(_merged, SUMS).collect()
        found: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        lost = {}
        for r in tables:
            sums = np.frombuffer(bytes(r["sums"]), dtype=np.float64)
            if r["node"] < 0:
                lost[r["tree"]] = tuple(sums.tolist())
            else:
                found.setdefault((r["tree"], r["node"]), {})[r["feature"]] = sums.reshape(3, width)
        return {key: np.stack([by[j] for j in range(len(used))]) for key, by in found.items()}, lost

    def added(new):
        nonlocal rows, newest
        newest = [old + trees for old, trees in zip(newest, new, strict=True)]
        if max(map(len, newest)) < REFRESH:
            return
        base = newest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in _blocks(batch, n_features, labels):
                    block.margins = np.stack(_margins(block, classes, base))
                    yield _packed(block)

        rows, newest = stage(rows.mapInArrow(run, BLOCKS), "binned"), [[] for _ in classes]

    return boost(look, added, used, binned.cuts, classes, params, binned.validated)


# ---- Spark's model


def node_rows(tree: Tree, cuts: Sequence[Sequence[float]], at: dict[int, int], weighted: bool) -> list[dict]:
    """Nodes in the saved form of Spark's models, numbered in preorder; leaves of equal value are drawn together."""

    def leaf(node: int) -> bool:
        if tree.feature[node] < 0:
            return True
        a, b = tree.left[node], tree.right[node]
        return leaf(a) and leaf(b) and tree.value(a) == tree.value(b)

    out: list[dict] = []

    def put(node: int) -> int:
        stats = tree.stats[node]
        here = len(out)
        row = {
            "id": here, "prediction": tree.value(node), "impurity": float(variance(*map(np.float64, stats))), "impurityStats": list(stats),
            "rawCount": -1 if weighted else round(stats[0]), "gain": -1.0, "leftChild": -1, "rightChild": -1,
            "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1},
        }
        out.append(row)
        if not leaf(node):
            f = tree.feature[node]
            row["gain"] = tree.gain[node]
            row["split"] = {"featureIndex": at[f], "leftCategoriesOrThreshold": [cuts[f][tree.bin[node]]], "numCategories": -1}
            row["leftChild"], row["rightChild"] = put(tree.left[node]), put(tree.right[node])
        return here

    put(0)
    return out


NODES = pa.struct(
    [
        ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
        ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
        ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
    ]
)


def to_model(spark, gbt: GBTClassifier, trees: Sequence[tuple[float, Tree]], binned: Binned, used: Sequence[int]) -> GBTClassificationModel:
    """Spark's model of the trees, by way of its saved form."""
    from pyspark.ml.classification import GBTClassificationModel

    path, at = new_stage_path(spark, "trees"), {f: i for i, f in enumerate(used)}

    def facts(kind: str, uid: str, **more) -> str:
        own = {"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid}
        return json.dumps(own | {"paramMap": {}, "defaultParamMap": {}} | more)

    named = [{p.name: v for p, v in values.items()} for values in (gbt._paramMap, gbt._defaultParamMap)]
    own = facts("classification.GBTClassificationModel", gbt.uid, paramMap=named[0], defaultParamMap=named[1], numFeatures=len(used), numTrees=len(trees))
    texts = [facts("regression.DecisionTreeRegressionModel", f"dtr_{gbt.uid}_{i}") for i in range(len(trees))]
    nodes = [(i, row) for i, (_, t) in enumerate(trees) for row in node_rows(t, binned.cuts, at, binned.weighted)]
    ids = pa.array(range(len(trees)), pa.int32())
    tables = {
        "treesMetadata": pa.table([ids, pa.array(texts), pa.array([scale for scale, _ in trees])], names=["_1", "_2", "_3"]),
        "data": pa.table([pa.array([i for i, _ in nodes], pa.int32()), pa.array([row for _, row in nodes], NODES)], names=["treeID", "nodeData"]),
    }
    spark.createDataFrame(pa.table([pa.array([own])], names=["value"])).coalesce(1).write.text(f"{path}/metadata")
    for name, rows in tables.items():
        spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/{name}")
    return GBTClassificationModel.load(path)


def fit(binned: Binned, features: Sequence[str], gbt: GBTClassifier, params: Growth, n_classes: int) -> list[GBTClassificationModel]:
    """One model of the given features, or one against the rest per label from 0 to the highest."""
    spark = binned.rows.sparkSession
    used = [binned.features.index(f) for f in features]
    classes = [1] if n_classes == 2 else list(range(binned.labels))
    if binned.small:
        rows = binned.rows.coalesce(1).mapInArrow(_in_task(binned, used, classes, params), GROWN).collect()
        grown = {r["tree"]: [(scale, Tree(**nodes)) for scale, nodes in json.loads(bytes(r["grown"]))] for r in rows}
        trees = [grown[k] for k in range(len(classes))]
    else:
        trees = _over_tasks(binned, used, classes, params)
    return [to_model(spark, gbt, t, binned, used) for t in trees]
