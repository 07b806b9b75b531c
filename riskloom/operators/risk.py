"""Smoothed risk tables for categorical columns; four definitions kept apart by name.

All fits unpivot to ``(var, key, label)`` and aggregate once for all columns, so a
hot category is combined on the map side and no category list reaches the driver.
The counts are staged: the data is read once, and totals come from the counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.plans.lookup import lookup_with_default, local_table
from riskloom.plans.staging import stage


@dataclass(frozen=True)
class RiskTables:
    """``bins(var, key, value)`` and ``defaults(var, default_value)``."""

    bins: DataFrame
    defaults: DataFrame

    def staged(self) -> "RiskTables":
        return RiskTables(stage(self.bins, "bins"), stage(self.defaults, "defaults"))

    def default_of(self, var: str) -> Column:
        return self.defaults.filter(F.col("var") == var).select("default_value").scalar()


def label_crosstab(df: DataFrame, category: str, label: str) -> DataFrame:
    """Category by label counts with a ``_count_`` margin column and row."""
    known = df.filter(F.col(category).isNotNull() & F.col(label).isNotNull()).select(
        F.col(category).cast("string").alias("category"), F.col(label).alias("_y")
    )
    cells = known.rollup("category").agg(
        F.grouping("category").alias("g"),
        F.count_if(F.col("_y") == 0).alias("label_0"),
        F.count_if(F.col("_y") == 1).alias("label_1"),
        F.count(F.lit(1)).alias("n_all"),
    )
    name = F.when(F.col("g") == 1, "_count_").otherwise(F.col("category"))
    return cells.select(name.alias("category"), "label_0", "label_1", "n_all")


def labelled_counts(df: DataFrame, variables: Sequence[str], label: str) -> DataFrame:
    """Counts per variable, key and label, from one scan."""
    y = F.col(label)
    rows = df.filter(y.isNotNull() & (y != -1)).select(
        y.cast("double").alias("_y"), *[F.col(f"`{v}`").cast("string").alias(v) for v in variables]
    )
    long = rows.unpivot(["_y"], list(variables), "var", "key")
    return long.groupBy("var", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_y") == 1).alias("n1"),
        F.count_if(F.col("_y") == 0).alias("n0"),
        F.sum("_y").alias("sum_y"),
    )


def _variables(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return local_table(df.sparkSession, [(v,) for v in variables], "var string")


def risk_table_fit(
    df: DataFrame, variables: Sequence[str], label: str, smooth_factor: float = 0.0, count_threshold: int = 0
) -> RiskTables:
    """Rows without a category take no part, neither in the bins nor in the default."""
    counts = stage(labelled_counts(df, variables, label), "counts")
    with_key = F.col("key").isNotNull()
    totals = counts.groupBy("var").agg(
        F.sum(F.when(with_key, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(with_key, F.col("sum_y"))).alias("y_known"),
        F.sum("sum_y").alias("y_all"),
        F.sum("n").alias("n_all"),
    )
    default = F.coalesce(
        F.try_divide("y_known", "n_known"), F.try_divide("y_all", "n_all"), F.lit(0.5)
    )
    # one row per listed column
    defaults = (
        _variables(df, variables)
        .join(totals, "var", "left")
        .select(
            "var",
            default.alias("default_value"),
            F.floor(F.coalesce("n_known", F.lit(0)) * F.lit(float(smooth_factor))).alias("s"),
        )
    )
    risk = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + F.col("n0")), F.lit(0.0))
    smooth = (F.col("n") * risk + F.col("s") * F.col("default_value")) / (F.col("n") + F.col("s"))
    value = F.when((F.col("n") >= count_threshold) & (F.col("n") + F.col("s") > 0), smooth).otherwise(
        F.col("default_value")
    )
    bins = (
        counts.filter(with_key)
        .join(F.broadcast(defaults), "var")
        .select("var", "key", "n", risk.alias("risk"), value.alias("value"))
    )
    return RiskTables(bins, defaults.select("var", "default_value"))


def risk_table_fit_script(
    df: DataFrame, variables: Sequence[str], label: str, smooth_factor: float = 0.01, count_threshold: int = 5
) -> RiskTables:
    """Rows without a category count in the smoothing size and the default; a category with
    neither label 0 nor 1 has no risk of its own and ends at the default."""
    counts = stage(labelled_counts(df, variables, label), "counts")
    # every labelled row is in the counts of each column, under its key or under NULL
    overall = counts.filter(F.col("var") == variables[0]).agg(
        F.try_divide(F.sum("sum_y"), F.sum("n")).alias("default_value"),
        F.floor(F.sum("n") * F.lit(float(smooth_factor))).alias("s"),
    )
    one = overall.select(F.struct("default_value", "s")).scalar()
    risk = F.try_divide(F.col("n1"), F.col("n1") + F.col("n0"))
    smooth = F.try_divide(
        F.col("n") * risk + one.getField("s") * one.getField("default_value"), F.col("n") + one.getField("s")
    )
    value = F.when(F.col("n") >= count_threshold, smooth)
    bins = counts.filter("key is not null").select(
        "var", "key", "n", F.coalesce(value, one.getField("default_value")).alias("value")
    )
    defaults = _variables(df, variables).select("var", one.getField("default_value").alias("default_value"))
    return RiskTables(bins, defaults)


def risk_map_apply(df: DataFrame, tables: RiskTables, variables: Sequence[str], suffix: str = "") -> DataFrame:
    """Replace each category by its risk; unknown and missing categories get the default."""
    for v in variables:
        bins = tables.bins.filter(F.col("var") == v)
        df = lookup_with_default(df, bins, F.col(f"`{v}`").cast("string"), "value", tables.default_of(v), f"{v}{suffix}")
    return df


def category_risk_ratio(
    df: DataFrame,
    category: str,
    tag: str,
    positive: int = 1,
    smoothing: float = 10.0,
    cnt_threshold: int = 5,
    default_risk: float = 0.001,
) -> DataFrame:
    """``(key, risk, n_positive)`` with the formula chosen by the number of distinct tags."""
    t = F.col(tag)
    per_tag = stage(
        df.filter(t.isNotNull())
        .groupBy(F.col(category).cast("string").alias("key"), t.alias("t"))
        .agg(F.count(F.lit(1)).alias("c")),
        "tags",
    )
    prior = per_tag.agg(F.sum(F.when(F.col("t") == positive, F.col("c")).otherwise(0)) / F.sum("c")).scalar()
    stats = per_tag.filter("key is not null").groupBy("key").agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("t") == positive, F.col("c")).otherwise(0)).alias("n_positive"),
        F.count(F.lit(1)).alias("d"),
        F.min_by("c", "t").alias("n_lowest"),
    )
    k = F.lit(float(smoothing))
    shifted = F.col("n_positive") + k * prior
    ratio = (
        F.when(F.col("n_positive") == 0, prior)
        .when(F.col("d") == 2, shifted / (F.col("n") + k))
        .when(F.col("d") > 2, shifted / (F.col("n") - F.col("n_lowest") + k))
        .otherwise(F.col("n_positive") * k / F.col("n"))
    )
    risk = F.when(F.col("n") < cnt_threshold, F.lit(float(default_risk))).otherwise(ratio)
    return stats.select("key", risk.alias("risk"), "n_positive")
