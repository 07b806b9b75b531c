"""Composition of steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

Step = Callable[[DataFrame], DataFrame]


def chain(*steps: Step) -> Step:
    """One step that runs the others in order."""
    return lambda df: reduce(lambda d, s: d.transform(s), steps, df)


def column_chains(
    df: DataFrame, chains: Mapping[str, Sequence[Callable[[Column], Column]]], drop: Sequence[str] = ()
) -> DataFrame:
    """``<col>_processed`` for each column from its list of Column functions; listed columns drop."""
    made = {f"{c}_processed": reduce(lambda acc, fn: fn(acc), fns, F.col(c)) for c, fns in chains.items()}
    return df.withColumns(made).drop(*drop)
