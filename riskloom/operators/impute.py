"""Missing numbers: fit one value per column, fill later."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.plans.lookup import local_table
from riskloom.plans.quantiles import exact_quantiles, numeric_long, value_histogram


def impute_fit(
    df: DataFrame, strategies: Mapping[str, str], given: Mapping[str, float] | None = None
) -> DataFrame:
    """``(var, value)`` for strategy mean, median or mode (smallest of ties); a given value wins.

    A column without any number gets no row, and stays unfilled.
    """
    given = dict(given or {})
    spark = df.sparkSession
    parts = []

    def of(kind: str) -> Sequence[str]:
        return [v for v, s in strategies.items() if s == kind and v not in given]

    unknown = set(strategies.values()) - {"mean", "median", "mode"}
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    if of("mean"):
        parts.append(numeric_long(df, of("mean")).groupBy("var").agg(F.avg("v").alias("value")))
    if of("median"):
        parts.append(exact_quantiles(df, of("median"), [0.5]).select("var", "value"))
    if of("mode"):
        counts = value_histogram(df, of("mode"))
        parts.append(counts.groupBy("var").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("value")))
    if given:
        parts.append(local_table(spark, [(k, float(v)) for k, v in given.items()], "var string, value double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def impute_apply(df: DataFrame, fitted: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Fill the listed columns; others are untouched. One row of fitted values, read once."""
    missing = [v for v in variables if v not in df.columns]
    if missing:
        raise ValueError(f"columns to impute are missing: {missing}")
    values = fitted.agg(F.map_from_entries(F.collect_list(F.struct("var", "value"))).alias("m"))
    row = values.select("m").scalar()
    filled = {}
    for v in variables:
        number = F.col(f"`{v}`").cast("double")
        filled[v] = F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.try_element_at(row, F.lit(v)))
    return df.withColumns(filled)


def zscore_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median impute, then subtract the mean and divide by the population deviation."""
    filled = impute_apply(df, impute_fit(df, {c: "median" for c in columns}), columns)
    stats = filled.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("st")
    ).scalar()
    scaled = {}
    for c in columns:
        spread = stats.getField(c).getField("s")
        scaled[c] = (F.col(c) - stats.getField(c).getField("m")) / F.when(spread == 0, 1.0).otherwise(spread)
    return filled.withColumns(scaled)
