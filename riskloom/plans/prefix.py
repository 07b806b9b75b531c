"""Running totals over a global order without sending all rows to one task.

Rows are range partitioned and sorted on the order, one shuffle. Each task sums
its own sorted partition, and the partitions are staged with their number. The
partition totals, one row per partition and group, give the offset to add.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskloom.plans.staging import stage

PART = "_part"


def _sum_sorted(by: list[str], values: list[str]):
    """Per partition: running sums that restart with each group. A window would shuffle the rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last_key: tuple | None = None
        carry = dict.fromkeys(values, 0)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = [batch.column(b).to_numpy(zero_copy_only=False) for b in by]
            starts = np.zeros(n, dtype=bool)
            starts[0] = last_key != tuple(k[0] for k in keys)
            for k in keys:
                starts[1:] |= k[1:] != k[:-1]
            # position of the row's group start in this batch, -1 where the group began earlier
            start = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            columns, names = list(batch.columns), list(batch.schema.names)
            for v in values:
                array = batch.column(v)
                total = np.cumsum(array.to_numpy(zero_copy_only=False))
                before = np.where(start > 0, total[start - 1], 0)
                sums = total - np.where(start < 0, -carry[v], before)
                carry[v] = sums[-1]
                columns.append(pa.array(sums, type=array.type))
                names.append(f"_c_{v}")
            last_key = tuple(k[-1] for k in keys)
            columns.append(pa.array(np.full(n, part, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, PART])

    return run


def sorted_parts(
    df: DataFrame,
    order: Sequence[str],
    values: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The rows with their running sums inside a part (``_c_<v>``), and per part and group
    the sum before it (``_o_<v>``), its own sum (``_t_<v>``) and the group's total (``tot_<v>``).

    ``(by, order)`` must identify a row, and the ``by`` columns must not be NULL.
    """
    by, values = list(by), list(values)
    keys: list[Column] = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    sort = [*[F.col(c).asc() for c in by], *keys]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    fields = [
        *df.schema.fields,
        *[T.StructField(f"_c_{v}", df.schema[v].dataType) for v in values],
        T.StructField(PART, T.IntegerType()),
    ]
    staged = stage(ranged.mapInArrow(_sum_sorted(by, values), T.StructType(fields)), "prefix")

    totals = staged.groupBy(*by, PART).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    # one row per range partition (and group): the ordered window is over these only
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    facts = []
    for v in values:
        zero = F.lit(0).cast(df.schema[v].dataType)
        facts += [
            F.coalesce(F.sum(f"_t_{v}").over(before), zero).alias(f"_o_{v}"),
            F.col(f"_t_{v}"),
            F.sum(f"_t_{v}").over(group).alias(f"tot_{v}"),
        ]
    return staged, stage(totals.select(*by, PART, *facts), "offsets")


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    values: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<v>`` (inclusive) and ``tot_<v>`` for each value column (whole numbers or doubles)."""
    staged, offsets = sorted_parts(df, order, values, by, descending)
    return staged.join(offsets, [*by, PART]).select(
        *df.columns,
        *[(F.col(f"_o_{v}") + F.col(f"_c_{v}")).alias(f"cum_{v}") for v in values],
        *[f"tot_{v}" for v in values],
    )


def ordered_index(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """Number rows 0, 1, 2 … in the given order; rows must be distinct on ``(by, order)``."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], by)
    return counted.withColumn(name, F.col("cum__one") - 1).drop("_one", "cum__one", "tot__one")
