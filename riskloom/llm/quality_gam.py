"""Quality classifier: a generalised additive model with pairwise interactions.

Fit: every feature is cut into bins at quantiles of the training rows. Boosting goes round the
features in turn; each turn fits a tree of depth two to the log-loss gradient of one feature
and adds its leaves to that feature's lookup table. Then the pairs of features with most to
explain beyond the single tables are found, and trees that split on both features of a pair add
to its two-dimensional table. A score is the sum of one entry per table, all rows at a time.

The training sample is bounded: at most ``max_rows`` labelled rows in the order of a hash of
their id (a documented parameter); only these rows' features are computed for the fit, and only
their bounded list is broadcast. Scores are computed for every row over its whole text.

Features see the text alone. A null or empty text has all-zero features and gets a score like
any other. Without labels of both kinds the model is constant (their mean, or 0.5 with none).
Several labels of one id are averaged; null labels and null ids teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom.llm.common import hash_sample, stage, text_bytes

FEATURES = (
    "log_bytes",
    "log_words",
    "word_length",
    "longest_word",
    "upper_share",
    "digit_share",
    "high_byte_share",
    "symbol_rate",
    "exclamation_rate",
    "bar_rate",
    "stop_rate",
    "comma_rate",
    "newline_rate",
    "distinct_share",
    "distinct_pair_share",
    "adjacent_repeats",
    "most_common_share",
    "distinct_line_share",
    "symbol_word_share",
)
SYMBOLS = b"#$%&*@~^_=+<>/\\{}[]"


def features(text: bytes) -> list[float]:
    """The numbers named in ``FEATURES``, over the whole text."""
    n = len(text)
    words = text.split()
    m = len(words)
    if not m:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    # capital letters of the Latin-1 range are C3 80 to C3 9E in UTF-8, small ones C3 9F to C3 BF
    capital, small = counts[0x80:0x9F].sum(), counts[0x9F:0xC0].sum()
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = set(zip(words, words[1:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = list(map(len, words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(1 for w in seen if w[-1] in SYMBOLS)
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        sum(lengths) / m,
        float(np.log1p(max(lengths))),
        float((upper + capital) / max(1, upper + lower + capital + small)),
        float(counts[48:58].sum() / n),
        float(counts[128:].sum() / n),
        float(sum(counts[b] for b in SYMBOLS) / m),
        float(counts[33] / m),
        float(counts[124] / m),
        float(counts[46] / m),
        float(counts[44] / m),
        float(counts[10] / m),
        len(seen) / m**0.7,
        len(pairs) / max(1, m - 1),
        same / m,
        max(seen.values()) / m,
        len(set(lines)) / max(1, len(lines)),
        marked / len(seen),
    ]


@F.arrow_udf(T.BinaryType())
def packed_features(texts: pa.Array) -> pa.Array:
    """Features as 32-bit floats, packed."""
    return pa.array([np.array(features(t), dtype=np.float32).tobytes() for t in text_bytes(texts)], pa.binary())


def unpack(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.float32).reshape(len(rows), len(FEATURES))


@dataclass
class Gam:
    """Bin edges per feature, a table per feature, and a table per pair on coarser bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.logit(x)))


def _best_cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + lam) + gr**2 / (hr + lam) - g.sum() ** 2 / (h.sum() + lam)
    gain[(hl < 1e-9) | (hr < 1e-9)] = 0.0
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-12 else (0.0, 0)


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, lam: float) -> np.ndarray:
    """Leaf values, per bin, of a tree over ordered bins."""
    gain, at = _best_cut(g, h, lam) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), g.sum() / (h.sum() + lam))
    return np.concatenate([_leaves(g[:at], h[:at], depth - 1, lam), _leaves(g[at:], h[at:], depth - 1, lam)])


def _pair_leaves(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts one feature, then the other on each side."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    whole = g.sum() ** 2 / (h.sum() + lam)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(a)):
            parts, gain = [], -whole
            for side in (slice(None, at), slice(at, None)):
                gs, hs = a[side].sum(axis=0), b[side].sum(axis=0)
                leaf = _leaves(gs, hs, 1, lam)
                gain += float((2 * leaf * gs - leaf**2 * (hs + lam / len(hs))).sum())
                parts.append(np.repeat(leaf[None, :], len(a[side]), axis=0))
            if gain > best[0]:
                out = np.concatenate(parts)
                best = (gain, out.T if turned else out)
    return best


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 40,
    n_pairs: int = 8, rate: float = 0.15, lam: float = 3.0,
) -> Gam:
    """Cyclic boosting of the single tables, then of the tables of the strongest pairs."""
    n_features = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        base = float(np.log(mean / (1 - mean)))
        return Gam(base, [np.empty(0)] * n_features, [np.zeros(1)] * n_features)
    grid = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], grid)) for f in range(n_features)]
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    sizes = [len(e) + 1 for e in edges]
    coarse = [np.minimum(np.arange(s) * coarse_bins // s, coarse_bins - 1) for s in sizes]
    base = float(np.log(y.mean() / (1 - y.mean())))
    model = Gam(base, edges, [np.zeros(s) for s in sizes], coarse)
    logit = np.full(len(y), base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(n_features):
            g, h = gradients()
            leaf = _leaves(np.bincount(at[f], g, sizes[f]), np.bincount(at[f], h, sizes[f]), 2, lam)
            model.tables[f] += rate * leaf
            logit += rate * leaf[at[f]]

    wide = [c[a] for c, a in zip(coarse, at, strict=True)]

    def grids(f: int, g: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[f] * coarse_bins + wide[g], v, coarse_bins**2).reshape(coarse_bins, coarse_bins)

    grad, hess = gradients()
    gains = [(_pair_leaves(grids(f, g, grad), grids(f, g, hess), lam)[0], (f, g)) for f, g in combinations(range(n_features), 2)]
    model.pairs = [p for gain, p in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((coarse_bins, coarse_bins)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for k, (f, g) in enumerate(model.pairs):
            grad, hess = gradients()
            leaf = _pair_leaves(grids(f, g, grad), grids(f, g, hess), lam)[1]
            model.pair_tables[k] += rate * leaf
            logit += rate * leaf[wide[f], wide[g]]
    return model


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True for rows whose crc32(id as text) is a multiple of ``folds``; null ids are held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 20_000,
    folds: int = 5,
) -> Gam:
    """Fit on at most ``max_rows`` labelled texts outside the held-out fold.

    A labelled id teaches once per distinct text, however often its row is repeated; of more
    texts than ``max_rows`` those first in hash order are taken, so no more reach the driver.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).dropna()
    known = known.filter(~held_out(F.col("_id"), folds)).groupBy("_id").agg(F.avg("_y").alias("_y"))
    chosen = hash_sample(known, max_rows, "_id")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    found = texts.join(F.broadcast(chosen), "_id")
    found = found.select("_id", F.xxhash64(F.coalesce(F.col("_t").cast("string"), F.lit(""))).alias("_h"), packed_features("_t").alias("x"), "_y")
    once = stage(found.groupBy("_id", "_h").agg(F.first("x").alias("x"), F.first("_y").alias("_y")), "taught")
    rows = hash_sample(once, max_rows, "_id", "_h").select("x", "_y").toArrow()
    # the order of rows does not change the sums beyond rounding, so sort them
    x, y = unpack(rows["x"].to_pylist()), (rows["_y"].to_numpy() >= 0.5).astype(float)
    order = np.lexsort((y, *x.T)) if len(y) else np.empty(0, dtype=int)
    return fit(x[order].astype(float), y[order])


def score(model: Gam, text: Column) -> Column:
    """The model's probability that the label is 1."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in text_bytes(texts)], dtype=np.float32).reshape(-1, len(FEATURES))
        return pa.array(model.score(x.astype(float)))

    return run(text)
