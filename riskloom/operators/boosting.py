"""Second-order boosted trees over quantile bins.

Features are cut at merged quantile sketches into at most ``max_bins`` bins, with a bin of its own for
missing values, and the binned rows are staged as column blocks. A level of a tree is one pass
and one shuffle: every task sums first and second derivatives per (node, feature, bin), and the
sums of a node and feature meet to find its best cut, with missing values on the better side.
Derivatives are summed as whole numbers of 2**-26, so a fit does not depend on how rows are dealt
(total weight below 10**11). Several classes are one softmax model with a tree per class and round.

The driver holds the trees and one candidate per node and feature. Margins of the rows are staged
with the blocks every ``refresh`` rounds; between, the newest trees are added up anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators.binning import approximate_quantile_edges
from riskloom.plans.lookup import local_table
from riskloom.plans.staging import stage

MISSING = 255
UNIT = float(1 << 26)


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 100
    eta: float = 0.1
    max_depth: int = 6
    gamma: float = 0.0  # least gain of a cut
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0  # share of the features per round
    early_stopping: int = 10  # rounds without a better loss on validation rows
    max_bins: int = 128
    refresh: int = 8
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number; ``feature`` is -1 at leaves. Values up to the cut of ``bin`` go left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for values, x in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1)):
            values.append(x)
        self.value.append(value)
        self.gain.append(0.0)
        self.cover.append(cover)
        return len(self.feature) - 1

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of ``bins`` (features, rows) ends in."""
        feature, cut, missing_left, left, right = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        at = np.zeros(bins.shape[1], dtype=np.int64)
        rows = np.arange(bins.shape[1])
        while (inner := feature[at] >= 0).any():
            own = rows[inner]
            node = at[inner]
            b = bins[feature[node], own]
            goes_left = np.where(b == MISSING, missing_left[node], b <= cut[node])
            at[inner] = np.where(goes_left, left[node], right[node])
        return at


def shrink(g: float | np.ndarray, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def probabilities(margins: np.ndarray) -> np.ndarray:
    """(rows, classes) from (rows, 1) log odds or (rows, classes) softmax margins."""
    if margins.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-margins))
        return np.concatenate((1.0 - p, p), axis=1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class BoostedTrees:
    features: list[str]
    cuts: list[list[float]]
    n_classes: int
    trees: list[list[Tree]]  # per round, one per margin
    losses: list[float]  # on validation rows, before the first round and after each

    @property
    def outputs(self) -> int:
        return 1 if self.n_classes == 2 else self.n_classes

    def bins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        out = np.empty((len(columns), len(columns[0]) if len(columns) else 0), dtype=np.uint8)
        for i, (values, cuts) in enumerate(zip(columns, self.cuts, strict=True)):
            out[i] = np.where(np.isnan(values), MISSING, np.searchsorted(np.array(cuts), values, "left"))
        return out

    def margins(self, bins: np.ndarray, rounds: Sequence[list[Tree]] | None = None) -> np.ndarray:
        out = np.zeros((bins.shape[1], self.outputs))
        for trees in self.trees if rounds is None else rounds:
            for k, tree in enumerate(trees):
                out[:, k] += np.array(tree.value)[tree.nodes_of(bins)]
        return out

    def score(self, df: DataFrame, out: str = "probs") -> DataFrame:
        """Probability array per row; NULL, NaN and text that is no number are missing values."""

        @F.arrow_udf("array<double>")
        def probs(*columns: pa.Array) -> pa.Array:
            values = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]
            p = probabilities(self.margins(self.bins(values)))
            offsets = np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))

        return df.withColumn(out, probs(*[F.col(f"`{f}`").try_cast("double") for f in self.features]))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The trees as a table."""
        rows = []
        for r, trees in enumerate(self.trees):
            for k, t in enumerate(trees):
                for n, f in enumerate(t.feature):
                    split = (None,) * 5
                    if f >= 0:  # beyond the last cut all values go left, and missing ones right
                        cut = self.cuts[f][t.bin[n]] if t.bin[n] < len(self.cuts[f]) else float("inf")
                        split = (self.features[f], cut, t.missing_left[n], t.left[n], t.right[n])
                    rows.append((r, k, n, *split, None if f >= 0 else t.value[n], t.gain[n], t.cover[n]))
        return local_table(
            spark, rows,
            "round int, class int, node int, feature string, cut double, missing_left boolean, left int, right int, value double, gain double, cover double",
        )

    def importance(self, spark: SparkSession) -> DataFrame:
        """Gain per feature, as a share of all."""
        gains = dict.fromkeys(self.features, 0.0)
        for trees in self.trees:
            for t in trees:
                for f, g in zip(t.feature, t.gain, strict=True):
                    if f >= 0:
                        gains[self.features[f]] += g
        total = sum(gains.values()) or 1.0
        return local_table(spark, [(f, g / total) for f, g in gains.items()], "feature string, importance double")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack(model: BoostedTrees):
    """Rows to blocks: bins by feature, label, weight and validation flag as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, f = TaskContext.get().partitionId(), len(model.features)
        for i, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            values = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in range(f + 3)]
            parts = [model.bins(values[:f]), values[f], values[f + 1], values[f + 2].astype(np.uint8)]
            margins = np.zeros((batch.num_rows, model.outputs))
            row = [pa.array([(part << 32) | i]), *[pa.array([p.tobytes()], pa.binary()) for p in (*parts, margins)]]
            yield pa.RecordBatch.from_arrays(row, names=BLOCK)

    return run


BLOCK = ["block", "bins", "y", "w", "held", "margins"]
BLOCKS = "block long, bins binary, y binary, w binary, held binary, margins binary"


def _blocks(batch: pa.RecordBatch, model: BoostedTrees) -> Iterator[tuple]:
    for block, bins, y, w, held, margins in zip(*[batch.column(c).to_pylist() for c in BLOCK], strict=True):
        y = np.frombuffer(y, dtype=np.float64)
        yield (
            block, np.frombuffer(bins, dtype=np.uint8).reshape(-1, len(y)), y, np.frombuffer(w, dtype=np.float64),
            np.frombuffer(held, dtype=np.uint8) > 0, np.frombuffer(margins, dtype=np.float64).reshape(len(y), -1),
        )


def _refresh(model: BoostedTrees, newest: list[list[Tree]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = [(m + model.margins(bins, newest)).tobytes() for _, bins, _, _, _, m in _blocks(batch, model)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in BLOCK[:-1]], pa.array(added, pa.binary())], names=BLOCK)

    return run


def _sums(model: BoostedTrees, params: BoostParams, newest: list[list[Tree]], growing: list[Tree], open_: list[list[int]], used: list[int]):
    """Per task: derivatives summed by (tree, node, feature, bin); and the loss of the held rows, as feature -1."""
    salt = np.uint64((params.seed << 32) + len(model.trees))
    width = MISSING + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, len(nodes) * len(used) * width), dtype=np.int64) for nodes in open_]
        loss = weight = 0.0
        for batch in batches:
            for block, bins, y, w, held, margins in _blocks(batch, model):
                margins = margins + model.margins(bins, newest)
                p = probabilities(margins)
                if held.any():
                    right = np.clip(p[held, y[held].astype(np.int64)], 1e-15, 1.0)
                    loss += float(-(w[held] * np.log(right)).sum())
                    weight += float(w[held].sum())
                taken = ~held
                if params.subsample < 1.0:
                    key = _mix(np.arange(len(y), dtype=np.uint64) + _mix(np.array([block], dtype=np.uint64) ^ salt))
                    taken &= (key >> np.uint64(11)).astype(np.float64) * 2.0**-53 < params.subsample
                for k, (tree, nodes) in enumerate(zip(growing, open_, strict=True)):
                    if not nodes:
                        continue
                    label = 1 if model.outputs == 1 else k
                    own = p[:, label]
                    g = np.rint(w * (own - (y == label)) * UNIT)
                    h = np.rint(w * np.maximum(own * (1.0 - own), 1e-16) * UNIT)
                    slot = np.full(len(tree.feature), -1)
                    slot[nodes] = np.arange(len(nodes))
                    place = slot[tree.nodes_of(bins)]
                    rows = np.flatnonzero(taken & (place >= 0))
                    for j, f in enumerate(used):
                        cell = (place[rows] * len(used) + j) * width + bins[f, rows]
                        for d, values in enumerate((g, h)):
                            total[k][d] += np.bincount(cell, values[rows], total[k].shape[1]).astype(np.int64)
        out = [(k, n, f, *total[k].reshape(2, len(nodes), len(used), width)[:, i, j].tolist()) for k, nodes in enumerate(open_) for i, n in enumerate(nodes) for j, f in enumerate(used)]
        # the loss travels as whole numbers too
        out.append((-1, 0, -1, [round(loss * UNIT)], [round(weight * UNIT)]))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["tree", "node", "feature", "g", "h"])

    return run


SUMS = "tree int, node int, feature int, g array<long>, h array<long>"
CUTS = "tree int, node int, feature int, bin int, missing_left boolean, gain double, gl double, hl double, g double, h double"


def best_cut(g: np.ndarray, h: np.ndarray, params: BoostParams) -> tuple[int, bool, float, float, float]:
    """(bin, missing left, gain, left sums) of the best cut; gain -inf where none is allowed. Of equal gains the first bin, missing right."""
    gm, hm = g[MISSING], h[MISSING]
    total_g, total_h = g.sum(), h.sum()
    cum_g, cum_h = np.cumsum(g[:MISSING]), np.cumsum(h[:MISSING])
    worth = lambda a, b: shrink(a, params.reg_alpha) ** 2 / (b + params.reg_lambda)
    best = (0, False, -np.inf, 0.0, 0.0)
    for missing_left in (False, True):
        gl, hl = cum_g + (gm if missing_left else 0.0), cum_h + (hm if missing_left else 0.0)
        gr, hr = total_g - gl, total_h - hl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 0.5 * (worth(gl, hl) + worth(gr, hr) - worth(total_g, total_h)) - params.gamma
        gain[(hl < params.min_child_weight) | (hr < params.min_child_weight) | (hl <= 0) | (hr <= 0)] = -np.inf
        i = int(np.nanargmax(np.where(np.isnan(gain), -np.inf, gain)))
        if gain[i] > best[2]:
            best = (i, missing_left, float(gain[i]), float(gl[i]), float(hl[i]))
    return best


def _cuts(params: BoostParams):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tree, node, feature = (k.as_py() for k in key)
        g, h = (np.array(rows.column(c).to_pylist(), dtype=np.int64).sum(axis=0) / UNIT for c in ("g", "h"))
        if feature < 0:
            best = (0, False, 0.0, 0.0, 0.0)
        else:
            best = best_cut(g, h, params)
        row = (tree, node, feature, *best, float(g.sum()), float(h.sum()))
        names = ("tree", "node", "feature", "bin", "missing_left", "gain", "gl", "hl", "g", "h")
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 5)
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=list(names))

    return run


def fit_boosted_trees(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    params: BoostParams = BoostParams(),
    weight: str | None = None,
    validation: str | None = None,
    n_classes: int = 2,
) -> BoostedTrees:
    """Trees for labels 0 to ``n_classes - 1``; rows without label or with a weight of zero are left out.

    Rows flagged by ``validation`` do not grow trees. With them, growing ends after
    ``early_stopping`` rounds without a better loss, and the rounds up to the best are kept.
    """
    if not 2 <= params.max_bins <= MISSING - 1:
        raise ValueError(f"max_bins must be between 2 and {MISSING - 1}")
    features, spark = list(features), df.sparkSession
    numbers = {f"f{i}": F.col(f"`{f}`").try_cast("double") for i, f in enumerate(features)}
    rows = df.select(
        *[c.alias(n) for n, c in numbers.items()],
        F.col(f"`{label}`").cast("double").alias("y"),
        (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"),
        (F.coalesce(F.col(f"`{validation}`").cast("double"), F.lit(0.0)) if validation else F.lit(0.0)).alias("held"),
    ).filter("y >= 0 AND w > 0")
    edges = {r["var"]: r["edges"] for r in approximate_quantile_edges(rows.filter("held = 0"), list(numbers), params.max_bins).collect()}
    cuts = [[e for e in edges[n] if np.isfinite(e)][:-1] for n in numbers]
    model = BoostedTrees(features, cuts, n_classes, [], [])
    blocks = stage(rows.mapInArrow(_pack(model), BLOCKS), "binned")
    draw = np.random.default_rng(params.seed)
    newest: list[list[Tree]] = []

    def look(growing: list[Tree], open_: list[list[int]], used: list[int]) -> tuple[list, float | None]:
        sums = blocks.mapInArrow(_sums(model, params, newest, growing, open_, used), SUMS)
        found = sums.groupBy("tree", "node", "feature").applyInArrow(_cuts(params), CUTS).collect()
        held = next((r for r in found if r["feature"] < 0), None)
        return [r for r in found if r["feature"] >= 0], held["g"] / held["h"] if held and held["h"] else None

    for _ in range(params.rounds):
        n_used = max(1, round(params.colsample * len(features)))
        used = sorted(draw.choice(len(features), n_used, replace=False).tolist())
        growing = [Tree() for _ in range(model.outputs)]
        open_ = [[t.add(0.0, 0.0)] for t in growing]
        for level in range(params.max_depth):
            found, loss = look(growing, open_, used)
            if level == 0 and loss is not None:
                model.losses.append(loss)
                best = int(np.argmin(model.losses))
                if len(model.losses) - 1 - best >= params.early_stopping:
                    model.trees = model.trees[:best]
                    return model
            open_ = _grow(growing, found, params, level)
            if not any(open_):
                break
        model.trees.append(growing)
        newest.append(growing)
        if len(newest) == params.refresh:
            blocks = stage(blocks.mapInArrow(_refresh(model, newest), BLOCKS), "binned")
            newest = []
    _, loss = look([Tree() for _ in range(model.outputs)], [[] for _ in range(model.outputs)], [])
    if loss is not None:
        model.losses.append(loss)
        model.trees = model.trees[: int(np.argmin(model.losses))]
    return model


def _grow(growing: list[Tree], found: list, params: BoostParams, level: int) -> list[list[int]]:
    """Cut the open nodes where it pays; returns the new open nodes of each tree."""
    leaf = lambda g, h: float(-shrink(g, params.reg_alpha) / (h + params.reg_lambda) * params.eta) if h > 0 else 0.0
    best: dict[tuple[int, int], object] = {}
    for r in sorted(found, key=lambda r: (-r["gain"], r["feature"])):
        best.setdefault((r["tree"], r["node"]), r)
    opened: list[list[int]] = [[] for _ in growing]
    for (k, node), r in sorted(best.items()):
        tree = growing[k]
        tree.value[node], tree.cover[node] = leaf(r["g"], r["h"]), r["h"]
        if not r["gain"] > 0:
            continue
        tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = r["feature"], r["bin"], r["missing_left"], r["gain"]
        gr, hr = r["g"] - r["gl"], r["h"] - r["hl"]
        tree.left[node] = tree.add(leaf(r["gl"], r["hl"]), r["hl"])
        tree.right[node] = tree.add(leaf(gr, hr), hr)
        if level + 1 < params.max_depth:
            opened[k] += [tree.left[node], tree.right[node]]
    return opened
