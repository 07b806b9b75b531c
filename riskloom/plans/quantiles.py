"""Exact quantiles with linear interpolation, by histograms that are refined where the ranks fall.

The bits of a double, mapped so that they rise with the number, are its key. The first round
counts values by the leading bits of the key; the buckets that hold the wanted ranks are counted by
the next bits in the next round, until the values of a bucket are equal. That takes three rounds
at most, mostly two, and each is one scan with a count per task and bucket: values are neither
sorted nor shuffled, and no round shuffles more than the distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.plans.lookup import local_table

STEPS = (44, 22, 0)  # bits that are left aside in each round
GATHERED = 1 << 18  # buckets a task holds before it merges equal ones


def numeric_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(var, v)`` of the non-missing values of the columns."""
    doubles = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    long = df.select(*doubles).unpivot([], list(columns), "var", "v")
    return long.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def value_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return numeric_long(df, columns).groupBy("var", "v").agg(F.count(F.lit(1)).alias("n"))


def keys_of(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; the two zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def value_of(key: int) -> float:
    k = np.array([key], dtype=np.int64)
    return float((k ^ ((k >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (bucket, n, lo, hi): one per bucket."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    starts = np.flatnonzero(np.diff(rows[0], prepend=rows[0][0] - 1))
    return np.stack([rows[0][starts], np.add.reduceat(rows[1], starts), np.minimum.reduceat(rows[2], starts), np.maximum.reduceat(rows[3], starts)])


def _count(shift: int, above: int, inside: Mapping[int, Sequence[int]] | None):
    """Counts of each column's values by ``key >> shift``; ``inside``: only buckets ``key >> above`` listed for the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if inside is None else {i: np.array(sorted(b), dtype=np.int64) for i, b in inside.items()}
        found: dict[int, list[np.ndarray]] = {}
        held: dict[int, int] = {}
        for batch in batches:
            for i, column in enumerate(batch.columns):
                if wanted is not None and i not in wanted:
                    continue
                values = column.drop_null().to_numpy(zero_copy_only=False)
                keys = keys_of(values[~np.isnan(values)])
                if wanted is not None:
                    buckets = keys >> above
                    at = np.searchsorted(wanted[i], buckets)
                    keys = keys[wanted[i][np.minimum(at, len(wanted[i]) - 1)] == buckets]
                if not len(keys):
                    continue
                keys = np.sort(keys)
                bucket = keys >> shift
                starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
                ends = np.append(starts[1:], len(keys))
                found.setdefault(i, []).append(np.stack([bucket[starts], ends - starts, keys[starts], keys[ends - 1]]))
                held[i] = held.get(i, 0) + len(starts)
                if held[i] > GATHERED:
                    found[i] = [_merged(found[i])]
                    held[i] = found[i][0].shape[1] // 2
        for i, parts in found.items():
            rows = _merged(parts)
            var = pa.array(np.full(rows.shape[1], i, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([var, *[pa.array(r) for r in rows]], names=["var", "bucket", "n", "lo", "hi"])

    return run


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(var, prob, value)``: the value at rank ``prob * (n - 1)``, interpolated; a small local table.

    NULL and NaN are left out; a column without values has no row. What comes to the driver are at
    most two rows per column and prob, in each round.
    """
    columns, probs = list(dict.fromkeys(columns)), list(dict.fromkeys(float(p) for p in probs))
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    positions: dict[tuple[int, float], float] = {}
    resolved: dict[tuple[int, int], float] = {}  # (column, rank): value
    ranks: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (column, bucket): (rank, rank in the bucket)
    for step, shift in enumerate(STEPS):
        above = STEPS[step - 1] if step else 63
        inside: dict[int, list[int]] | None = None
        if step:
            inside = {}
            for i, bucket in ranks:
                inside.setdefault(i, []).append(bucket)
        counts = values.mapInArrow(_count(shift, above, inside), "var int, bucket long, n long, lo long, hi long")
        # tasks have merged their buckets already, so one shuffle serves both the sums and the order
        counts = counts.withColumn("parent", F.shiftright("bucket", above - shift) if step else F.lit(0).cast("long"))
        merged = counts.repartition("var", "parent").groupBy("var", "parent", "bucket")
        merged = merged.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        group = Window.partitionBy("var", "parent")
        placed = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
        if step:
            wanted = [(i, b, at, inner) for (i, b), places in ranks.items() for at, inner in places]
            asked = local_table(df.sparkSession, wanted, "var int, parent long, rank long, inside long")
            hits = placed.join(asked, ["var", "parent"])
        else:
            position = F.col("prob") * (F.col("total") - 1)
            hits = placed.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
            hits = hits.withColumns({"rank": F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position))))})
            hits = hits.withColumn("inside", F.col("rank"))
        hits = hits.filter((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
        inner = (F.col("inside") - F.col("upto") + F.col("n")).alias("inner")
        ranks = {}
        for r in set(hits.select("var", "bucket", "lo", "hi", "rank", inner, "total").collect()):
            if not step:
                positions.update({(r["var"], p): p * (r["total"] - 1) for p in probs})
            if r["lo"] == r["hi"]:
                resolved[r["var"], r["rank"]] = value_of(r["lo"])
            else:
                ranks.setdefault((r["var"], r["bucket"]), []).append((r["rank"], r["inner"]))
        if not ranks:
            break
    out = []
    for (i, p), at in sorted(positions.items()):
        low, high = resolved[i, math.floor(at)], resolved[i, math.ceil(at)]
        out.append((columns[i], p, low + (high - low) * (at - math.floor(at)) if high != low else low))
    return local_table(df.sparkSession, out, "var string, prob double, value double")
