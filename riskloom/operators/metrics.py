"""Classification metrics over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.operators.curves import ranking_of, score_points
from riskloom.plans.prefix import running_totals


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2tp / (2tp + fp + fn), 0 where nothing is positive."""
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def f1_at_thresholds(df: DataFrame, score: str, label: str, thresholds: Sequence[float] = (0.3, 0.5, 0.7)) -> DataFrame:
    """``(metric, f1)``: the main F1 of ``p > 0.5`` and one F1 of ``p >= t`` per threshold; one scan."""
    y = F.col(label) > 0
    s = F.col(score)
    rules = {"f1_score": s > 0.5, **{f"f1_score_at_{t}": s >= t for t in thresholds}}

    def row(name: str, hit: Column) -> Column:
        counts = [F.count_if(hit & y), F.count_if(hit & ~y), F.count_if(~hit & y)]
        return F.struct(F.lit(name).alias("metric"), f1(*counts).alias("f1"))

    return df.agg(F.array(*[row(n, h) for n, h in rules.items()]).alias("r")).select(F.inline("r"))


def pr_at_start(df: DataFrame, score: str, label: str) -> DataFrame:
    """First point of the precision-recall curve (base rate, recall 1), and the true pair at 0.5."""
    y = F.col(label) > 0
    hit = F.col(score) >= 0.5
    return df.agg(
        F.avg(y.cast("double")).alias("precision_start"),
        F.max(F.lit(1.0)).alias("recall_start"),
        _ratio(F.count_if(hit & y), F.count_if(hit)).alias("precision_at_05"),
        _ratio(F.count_if(hit & y), F.count_if(y)).alias("recall_at_05"),
    )


def argmax(probs: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def class_rows(df: DataFrame, probs: str, label: str) -> DataFrame:
    """One row per (row, class): ``class, p, y, pred``; rows = rows × classes."""
    rows = df.select(
        F.col(label).alias("_y"), argmax(F.col(probs)).alias("_a"), F.posexplode(probs).alias("class", "p")
    )
    return rows.select(
        "class",
        "p",
        (F.col("_y") == F.col("class")).cast("int").alias("y"),
        (F.col("_a") == F.col("class")).cast("int").alias("pred"),
    )


def _per_class(df: DataFrame, probs: str, label: str) -> tuple[DataFrame, DataFrame]:
    rows = class_rows(df, probs, label)
    points = score_points(rows, "p", "y", ["class"])
    counts = rows.groupBy("class").agg(
        F.count_if((F.col("p") > 0.5) & (F.col("y") == 1)).alias("tp"),
        F.count_if((F.col("p") > 0.5) & (F.col("y") == 0)).alias("fp"),
        F.count_if((F.col("p") <= 0.5) & (F.col("y") == 1)).alias("fn"),
        F.count_if((F.col("pred") == 1) & (F.col("y") == 1)).alias("atp"),
        F.count_if((F.col("pred") == 1) & (F.col("y") == 0)).alias("afp"),
        F.count_if((F.col("pred") == 0) & (F.col("y") == 1)).alias("afn"),
        F.count_if((F.col("pred") == 0) & (F.col("y") == 0)).alias("atn"),
    )
    return points, counts


def ovr_metrics(df: DataFrame, probs: str, label: str) -> DataFrame:
    """Per class against the rest: AUC, average precision, F1 of ``p > 0.5``."""
    points, counts = _per_class(df, probs, label)
    return (
        ranking_of(points, ["class"])
        .join(counts, "class")
        .select("class", "auc", "ap", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), F.col("n_pos").alias("support"))
    )


def macro_weighted_metrics(df: DataFrame, probs: str, label: str) -> DataFrame:
    """One row: macro, weighted and micro averages of the per-class metrics."""
    points, counts = _per_class(df, probs, label)
    per_class = ranking_of(points, ["class"]).join(counts, "class")
    averaged = per_class.agg(
        F.avg("auc").alias("auc_macro"),
        (F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("auc_weighted"),
        F.avg("ap").alias("ap_macro"),
        f1(F.sum("atp"), F.sum("afp"), F.sum("afn")).alias("f1_micro"),
        F.avg(f1(F.col("atp"), F.col("afp"), F.col("afn"))).alias("f1_macro"),
    )
    # micro: all (row, class) pairs in one ranking, from the per-class histograms
    merged = points.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pooled = running_totals(merged, ["score"], ["pos", "neg"], descending=True)
    micro = ranking_of(pooled).select(F.struct("auc", "ap")).scalar()
    return averaged.withColumns({"auc_micro": micro.getField("auc"), "ap_micro": micro.getField("ap")})


def confusion_metrics(df: DataFrame, score: str, label: str, stage_name: str | None = None) -> DataFrame:
    """Binary ``(metric, value)`` at ``p > 0.5``, names optionally prefixed ``stage/``."""
    y = F.col(label) > 0
    hit = F.col(score) > 0.5
    tp, fp = F.count_if(hit & y), F.count_if(hit & ~y)
    fn, tn = F.count_if(~hit & y), F.count_if(~hit & ~y)
    return _metric_rows(df, tp, fp, fn, tn, tp + tn, F.count(F.lit(1)), stage_name)


def multiclass_confusion_metrics(df: DataFrame, probs: str, label: str, stage_name: str | None = None) -> DataFrame:
    """Micro-averaged ``(metric, value)`` on the argmax class."""
    rows = class_rows(df, probs, label)
    y, hit = F.col("y") == 1, F.col("pred") == 1
    tp, fp = F.count_if(hit & y), F.count_if(hit & ~y)
    fn, tn = F.count_if(~hit & y), F.count_if(~hit & ~y)
    return _metric_rows(rows, tp, fp, fn, tn, tp, tp + fn, stage_name)


def _metric_rows(df, tp, fp, fn, tn, right, n, stage_name) -> DataFrame:
    prefix = f"{stage_name}/" if stage_name else ""
    values = {
        "accuracy": _ratio(right, n),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "specificity": _ratio(tn, tn + fp),
        "f1_score": f1(tp, fp, fn),
    }
    rows = F.array(
        *[F.struct(F.lit(prefix + k).alias("metric"), v.alias("value")) for k, v in values.items()]
    )
    return df.agg(rows.alias("r")).select(F.inline("r"))


def kl_divergence(p: Column, q: Column) -> Column:
    """Per row: sum of p·ln(p/q) with both normalised; average it over rows for the metric."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    sp, sq = total(p), total(q)

    def term(x: Column, y: Column) -> Column:
        px, qx = x / sp, y / sq
        return F.when(px == 0, 0.0).otherwise(px * F.ln(px / qx))

    return total(F.zip_with(p, q, term))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.withColumn("ratio", F.col("n") / total)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    known = df.filter(F.col(column).isNotNull())
    return known.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def array_stats(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    inf = float("inf")
    return df.agg(
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(v).alias("mean_value"),
        F.stddev_pop(v).alias("std_value"),
        F.count_if(F.isnan(v) | v.isNull()).alias("n_nan"),
        F.count_if((v == inf) | (v == -inf)).alias("n_inf"),
    )


def score_histogram(df: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """Counts per equal bin on [0, 1]; the last bin is closed."""
    bin_no = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    inside = df.filter(F.col(score).between(0.0, 1.0))
    return inside.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
