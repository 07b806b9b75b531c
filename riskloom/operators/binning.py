"""Numeric bins: fitted edges per column, right-closed assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.operators.impute import impute_apply, impute_fit
from riskloom.operators.risk import RiskTables, risk_map_apply, risk_table_fit
from riskloom.plans.lookup import local_table
from riskloom.plans.quantiles import exact_quantiles, numeric_long
from riskloom.plans.staging import stage


def _with_all_columns(df: DataFrame, columns: Sequence[str], fitted: DataFrame, edges: Column) -> DataFrame:
    """One row per listed column; a column without values, or with fewer than two edges, gets one open bin."""
    listed = local_table(df.sparkSession, [(c,) for c in columns], "var string").join(fitted, "var", "left")
    everything = F.array(F.lit(float("-inf")), F.lit(float("inf")))
    usable = F.when(F.col("lo").isNotNull() & (F.size(edges) >= 2), edges).otherwise(everything)
    return listed.withColumn("edges", usable).select(
        "var", "edges", (F.size("edges") - 1).alias("n_bins"), "lo", "hi"
    )


def quantile_edges(df: DataFrame, columns: Sequence[str], n_bins: int) -> DataFrame:
    """``(var, edges, n_bins, lo, hi)`` with equal-count edges, duplicates dropped."""
    points = exact_quantiles(df, columns, [i / n_bins for i in range(n_bins + 1)])
    # n_bins + 1 values per column
    fitted = points.groupBy("var").agg(
        F.array_sort(F.collect_set("value")).alias("_e"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    return _with_all_columns(df, columns, fitted, F.col("_e"))


def approximate_quantile_edges(df: DataFrame, columns: Sequence[str], n_bins: int, k: int = 4096) -> DataFrame:
    """One pass, by KLL sketches of bounded size that are merged; an edge's rank is off by about 2.3 / k of the rows."""
    columns = list(columns)
    probs = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
    nothing = F.lit(None).cast("double")
    number = {c: F.nanvl(F.col(f"`{c}`").cast("double"), nothing) for c in columns}
    facts = [
        F.struct(
            F.lit(c).alias("var"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"),
            F.min(v).alias("lo"), F.max(v).alias("hi"),
        )
        for c, v in number.items()
    ]
    rows = df.agg(F.array(*facts).alias("facts")).select(F.inline("facts")).filter(F.col("lo").isNotNull())
    fitted = rows.select("var", F.kll_sketch_get_quantile_double("sketch", probs).alias("_q"), "lo", "hi")
    return _with_all_columns(df, columns, fitted, F.array_sort(F.array_distinct("_q")))


def equal_width_edges(df: DataFrame, columns: Sequence[str], n_bins: int) -> DataFrame:
    """Edges at equal steps; the first is lowered by 0.1 % of the range so the minimum falls inside."""
    fitted = numeric_long(df, columns).groupBy("var").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    eps = F.greatest(F.lit(1e-9), F.abs(lo * 1e-6))
    step = (hi - lo) / n_bins
    inner = [lo + step * i for i in range(1, n_bins)]
    spread = F.array(lo - (hi - lo) * 0.001, *inner, hi)
    edges = F.when(lo == hi, F.array(lo - eps, lo + eps)).otherwise(spread)
    return _with_all_columns(df, columns, fitted, edges)


def bin_index(value: Column, edges: Column) -> Column:
    """Bin of ``(e_i, e_i+1]`` (the first also holds its low edge), or NULL outside the edges."""
    below = F.size(F.filter(edges, lambda e: e < value))
    inside = (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
    return F.when(inside, F.greatest(below - 1, F.lit(0)))


def bin_apply(
    df: DataFrame,
    fitted: DataFrame,
    column: str,
    out: str,
    labels: Sequence[str] | bool | None = None,
    missing: str = "as_is",
    out_of_range: str = "boundary_bins",
) -> DataFrame:
    """Label each value with its bin. ``labels`` = names (used when the count matches),
    None/True for ``Bin_i``, False for the bare bin number."""
    row = fitted.filter(F.col("var") == column).select(F.struct("edges", "n_bins", "lo", "hi")).scalar()
    # a subquery may not stand inside a lambda, so the fitted row becomes a column first
    fitted_df = df.withColumn("_p", row)
    edges, n_bins, lo, hi = (F.col(f"_p.{x}") for x in ("edges", "n_bins", "lo", "hi"))
    number = F.col(f"`{column}`").cast("double")
    v = F.nanvl(number, F.lit(None).cast("double"))
    idx = bin_index(v, edges)
    outside = (v < lo) | (v > hi)
    if out_of_range == "boundary_bins":
        if labels is not False:
            idx = F.when(v < lo, F.lit(0)).when(v > hi, n_bins - 1).otherwise(idx)
            idx = F.coalesce(idx, F.when(v <= F.element_at(edges, 1), 0).when(v >= F.element_at(edges, -1), n_bins - 1))
    plain = F.concat(F.lit("Bin_"), idx.cast("string"))
    if labels is False:
        name = idx.cast("string")
    elif isinstance(labels, (list, tuple)):
        names = F.array(*[F.lit(x) for x in labels])
        name = F.when(n_bins == len(labels), F.try_element_at(names, idx + 1)).otherwise(plain)
    else:
        name = plain
    if out_of_range != "boundary_bins":
        name = F.when(outside | (v.isNotNull() & name.isNull()), F.lit(out_of_range)).otherwise(name)
    if missing != "as_is":
        name = F.when(v.isNull(), F.lit(missing)).otherwise(name)
    return fitted_df.withColumn(out, name).drop("_p")


def bin_then_risk(
    df: DataFrame, column: str, label: str, n_bins: int = 10, smooth_factor: float = 0.0, count_threshold: int = 0
) -> tuple[DataFrame, RiskTables]:
    """Median impute, cut at quantiles, replace the bin by its smoothed risk."""
    medians = stage(impute_fit(df, {column: "median"}), "median")
    filled = impute_apply(df, medians, [column])
    edges = stage(quantile_edges(filled, [column], n_bins), "edges")
    binned = bin_apply(filled, edges, column, f"{column}_bin")
    tables = risk_table_fit(binned, [f"{column}_bin"], label, smooth_factor, count_threshold).staged()
    return risk_map_apply(binned, tables, [f"{column}_bin"], "_risk"), tables
