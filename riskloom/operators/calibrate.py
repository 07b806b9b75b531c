"""Calibration: error reports, and isotonic, logistic and monotone-spline calibrators.

Calibrators are fitted on the histogram of distinct scores with row counts as
weights, which gives the same optimum as fitting on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.operators.curves import auc_roc
from riskloom.operators.isotonic import break_points, interpolate, isotonic_blocks
from riskloom.operators.metrics import class_rows
from riskloom.operators.splines import fit_spline
from riskloom.plans.staging import stage


def calibration_bins(df: DataFrame, score: str, label: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Non-empty bins ``min(9, floor(10 p))``: count, mean score, mean label, gap, range."""
    bin_no = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return (
        df.groupBy(*by, bin_no.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(score).alias("mean_score"),
            F.avg(F.col(label).cast("double")).alias("mean_label"),
        )
        .withColumns(
            {
                "gap": F.abs(F.col("mean_score") - F.col("mean_label")),
                "bin_start": F.col("bin") / bins,
                "bin_end": (F.col("bin") + 1) / bins,
            }
        )
    )


def ece_mce_brier(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Expected and maximum calibration error and Brier score, from one scan."""
    bin_no = F.least(F.floor(F.col(score) * 10), F.lit(9))
    y = F.col(label).cast("double")
    per_bin = df.groupBy(*by, bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(score).alias("sp"),
        F.sum(y).alias("sy"),
        F.sum((F.col(score) - y) * (F.col(score) - y)).alias("sq"),
    )
    gap = F.abs(F.col("sp") - F.col("sy"))
    return per_bin.groupBy(*by).agg(
        (F.sum(gap) / F.sum("n")).alias("ece"),
        F.max(gap / F.col("n")).alias("mce"),
        (F.sum("sq") / F.sum("n")).alias("brier"),
        F.sum("n").alias("n"),
    )


def reliability_curve(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score and mean label per bin; a score on an edge belongs to the lower bin."""
    bin_no = F.greatest(F.ceil(F.col(score) * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(bin_no.alias("bin")).agg(
        F.avg(score).alias("prob_pred"), F.avg(F.col(label).cast("double")).alias("prob_true")
    )


def multiclass_calibration_metrics(df: DataFrame, probs: str, label: str) -> DataFrame:
    """One row: macro ECE and MCE, largest MCE, and the summed-square Brier score."""
    rows = class_rows(df, probs, label)
    per_class = ece_mce_brier(rows, "p", "y", ["class"])
    return per_class.agg(
        F.avg("ece").alias("macro_ece"),
        F.avg("mce").alias("macro_mce"),
        F.max("mce").alias("max_mce"),
        F.sum("brier").alias("multiclass_brier"),
    )


@dataclass(frozen=True)
class Calibrator:
    """A fitted map from a score column to a calibrated column."""

    kind: str
    transform: Callable[[DataFrame, str, str], DataFrame]

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        return self.transform(df, score, out)


def _from_column(kind: str, curve: Callable[[Column], Column]) -> Calibrator:
    return Calibrator(kind, lambda df, score, out: df.withColumn(out, curve(F.col(score))))


def score_weights(df: DataFrame, score: str, label: str) -> DataFrame:
    """``(score, n, pos)`` per distinct score; NaN counts as missing."""
    return (
        df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) > 0).alias("pos"))
    )


def _two_class_rows(weights: DataFrame) -> DataFrame:
    """``(score, label, weight)``: at most two rows per distinct score."""
    cases = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("pos").cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("pos")).cast("double").alias("weight")),
    )
    return weights.select("score", F.inline(cases)).filter("weight > 0")


#: blocks of a fit that a model may hold, by two points each; beyond them they stay a table
MODEL_BLOCKS = 100_000


def isotonic_fit(
    df: DataFrame, score: str, label: str, rows_per_task: int = 1 << 18, model_blocks: int = MODEL_BLOCKS
) -> Calibrator:
    """Isotonic regression, linear between blocks and flat outside the fitted range.

    Up to ``model_blocks`` blocks become a model that each row is looked up in; beyond that the
    blocks stay a staged table and scores meet them in sorted ranges.
    """
    weights = stage(score_weights(df, score, label), "weights")
    points = break_points(isotonic_blocks(weights, rows_per_task))
    found = points.limit(2 * model_blocks + 1).toArrow()
    if found.num_rows > 2 * model_blocks:
        points = stage(points, "points")
        return Calibrator("isotonic", lambda d, column, out: interpolate(d, column, points, out, rows_per_task))
    rows = df.sparkSession.createDataFrame(found.rename_columns(["feature", "label"]))
    model = IsotonicRegression(featuresCol="feature", labelCol="label", isotonic=True).fit(rows)

    def transform(d: DataFrame, column: str, out: str) -> DataFrame:
        # the model interpolates by binary search and is flat outside the fitted range
        return model.copy().setFeaturesCol(column).setPredictionCol(out).transform(d)

    return Calibrator("isotonic", transform)


def platt_fit(df: DataFrame, score: str, label: str, c: float = 1e5) -> Calibrator:
    """Logistic regression on the score with a very weak ridge penalty."""
    w = stage(score_weights(df, score, label), "weights")
    total = w.agg(F.sum("n")).first()[0]
    rows = _two_class_rows(w).withColumn("features", array_to_vector(F.array("score")))
    model = LogisticRegression(
        weightCol="weight", regParam=1.0 / (c * total), standardization=False, maxIter=200, tol=1e-10
    ).fit(rows)
    a, b = float(model.coefficients[0]), float(model.intercept)
    return _from_column("platt", lambda s: 1.0 / (1.0 + F.exp(-(s * a + b))))


def gam_fit(
    df: DataFrame, score: str, label: str, n_splines: int = 10, monotone: bool = True, penalty: float = 0.6
) -> Calibrator:
    """Penalised spline of the log odds; with ``monotone`` it never falls. Flat outside the fitted range."""
    return _from_column("gam", fit_spline(stage(score_weights(df, score, label), "weights"), n_splines, penalty, monotone))


_FITTERS = {"isotonic": isotonic_fit, "platt": platt_fit, "gam": gam_fit}


def fit_calibrator(df: DataFrame, score: str, label: str, method: str = "isotonic") -> Calibrator:
    if method not in _FITTERS:
        raise ValueError(f"unknown calibration method: {method}")
    return _FITTERS[method](df, score, label)


def multiclass_calibrate_fit(
    df: DataFrame, probs: str, label: str, n_classes: int, method: str = "isotonic"
) -> list[Calibrator]:
    """One calibrator per class against the rest."""
    rows = stage(class_rows(df, probs, label).select("class", "p", "y"), "classes")
    return [fit_calibrator(rows.filter(F.col("class") == i), "p", "y", method) for i in range(n_classes)]


def multiclass_calibrate_apply(
    df: DataFrame, probs: str, calibrators: Sequence[Calibrator | None], out: str
) -> DataFrame:
    """Calibrate each class (raw score where a class has no calibrator), then divide by the row sum."""
    k = len(calibrators)
    work = df.withColumns({f"_p{i}": F.element_at(probs, i + 1) for i in range(k)})
    for i, c in enumerate(calibrators):
        work = c.apply(work, f"_p{i}", f"_c{i}") if c else work.withColumn(f"_c{i}", F.col(f"_p{i}"))
    total = sum((F.col(f"_c{i}") for i in range(1, k)), F.col("_c0"))
    scaled = F.array(*[F.try_divide(F.col(f"_c{i}"), total) for i in range(k)])
    return work.withColumn(out, scaled).drop(*[f"_{x}{i}" for i in range(k) for x in "pc"])


def binary_calibrate_apply(df: DataFrame, probs: str, calibrator: Calibrator | None, out: str) -> DataFrame:
    """``[1 - c, c]`` of the positive-class score; without a calibrator the raw scores."""
    if calibrator is None:
        return df.withColumn(out, F.col(probs))
    work = calibrator.apply(df.withColumn("_p", F.element_at(probs, 2)), "_p", "_c")
    return work.withColumn(out, F.array(1.0 - F.col("_c"), F.col("_c"))).drop("_p", "_c")


def calibration_report(df: DataFrame, before: str, after: str, label: str) -> DataFrame:
    """ECE, MCE, Brier and AUC before and after, change and improvement in per cent; one row per metric."""
    both = df.select(
        F.col(label).alias("y"),
        F.inline(
            F.array(
                F.struct(F.lit("before").alias("phase"), F.col(before).alias("p")),
                F.struct(F.lit("after").alias("phase"), F.col(after).alias("p")),
            )
        ),
    )
    errors = ece_mce_brier(both, "p", "y", ["phase"])
    wide = errors.join(auc_roc(both, "p", "y", ["phase"]), "phase")
    long = wide.unpivot(["phase"], ["ece", "mce", "brier", "auc"], "metric", "value")
    pivoted = long.groupBy("metric").pivot("phase", ["before", "after"]).agg(F.first("value"))
    better = (1 - F.col("after") / F.greatest(F.col("before"), F.lit(1e-10))) * 100
    return pivoted.withColumns(
        {
            "change": F.col("after") - F.col("before"),
            "improvement_pct": F.when(F.col("metric") != "auc", better),
        }
    )
