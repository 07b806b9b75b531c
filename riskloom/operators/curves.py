"""Exact ROC and precision-recall curves, from score histograms and running totals.

Rows are first merged per distinct score (map-side combine), so equal scores cost
one row; the order over scores is handled by ``running_totals``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.plans.prefix import running_totals


def score_points(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), amount: str | None = None
) -> DataFrame:
    """Per distinct score, from high to low: counts at the score and at or above it."""
    y = F.col(label) > 0
    aggs = [F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")]
    values = ["pos", "neg"]
    if amount:
        aggs.append(F.coalesce(F.sum(F.when(y, F.col(amount))), F.lit(0.0)).alias("amt"))
        values.append("amt")
    known = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull()
    for b in by:
        known = known & F.col(b).isNotNull()
    hist = df.filter(known).groupBy(*by, F.col(score).cast("double").alias("score")).agg(*aggs)
    return running_totals(hist, ["score"], values, by, descending=True)


def roc_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, threshold, fpr, tpr)``, with the starting point at threshold infinity; a rate is NULL without rows to rate."""
    curve = points.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide("cum_neg", "tot_neg").alias("fpr"),
        F.try_divide("cum_pos", "tot_pos").alias("tpr"),
    )
    totals = points.select(*by, "tot_neg", "tot_pos")
    start = totals.distinct() if by else totals.limit(1)
    zero = [F.when(F.col(t) > 0, 0.0).alias(rate) for t, rate in (("tot_neg", "fpr"), ("tot_pos", "tpr"))]
    origin = start.select(*by, F.lit(float("inf")).alias("threshold"), *zero)
    return curve.unionByName(origin)


def roc_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return roc_points(score_points(df, score, label, by), by)


def _auc() -> list[Column]:
    below = F.col("tot_neg") - F.col("cum_neg") + F.col("neg") * 0.5
    wins = F.sum(F.col("pos") * below)
    pairs = F.max("tot_pos").cast("double") * F.max("tot_neg")
    return [F.try_divide(wins, pairs).alias("auc"), F.max("tot_pos").alias("n_pos"), F.max("tot_neg").alias("n_neg")]


def auc_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs ranked right; ties count one half."""
    return points.groupBy(*by).agg(*_auc())


def auc_roc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return auc_of(score_points(df, score, label, by), by)


def pr_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.select(
        *by,
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide("cum_pos", "tot_pos").alias("recall"),
    )


def pr_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return pr_points(score_points(df, score, label, by), by)


def ap_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the step in recall, no interpolation."""
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    step = F.try_divide(F.col("pos"), F.col("tot_pos"))
    return points.groupBy(*by).agg(F.coalesce(F.sum(step * precision), F.lit(0.0)).alias("ap"))


def ranking_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUC and average precision from one aggregate."""
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    step = F.try_divide(F.col("pos"), F.col("tot_pos"))
    return points.groupBy(*by).agg(*_auc(), F.coalesce(F.sum(step * precision), F.lit(0.0)).alias("ap"))


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return ap_of(score_points(df, score, label, by), by)


def recall_at_precision(
    df: DataFrame, score: str, label: str, floor: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Highest recall whose precision reaches the floor, and the threshold (highest of ties);
    recall 0 where none does."""
    pr = pr_points(score_points(df, score, label, by), by)
    ok = F.col("precision") >= floor
    key = F.struct(F.col("recall"), F.col("threshold"))
    best = F.max(F.when(ok, key)).alias("b")
    return pr.groupBy(*by).agg(best).select(
        *by, F.coalesce(F.col("b.recall"), F.lit(0.0)).alias("recall"), F.col("b.threshold").alias("threshold")
    )


def _at_fpr(points: DataFrame, target: float, amount: bool = False) -> tuple[Column, list[Column]]:
    """Over a segment's points: the one whose false-positive rate is nearest the target (first of
    ties from the top), and its columns. The starting point competes without being a row; a
    segment with one class has NULLs."""
    fpr, tpr = F.try_divide("cum_neg", "tot_neg"), F.try_divide("cum_pos", "tot_pos")
    fields = [F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr")]
    if amount:
        fields.append(F.col("cum_amt").alias("amt"))
    key = F.when(fpr.isNotNull() & tpr.isNotNull(), F.struct(F.abs(fpr - target), -F.col("score")))
    nearest = F.min_by(F.struct(*fields), key).alias("p")
    start = F.col("p").isNotNull() & (F.abs(F.lit(0.0 - target)) <= F.abs(F.col("p.fpr") - target))
    first = {"threshold": float("inf"), "fpr": 0.0, "tpr": 0.0, "amt": 0.0}
    names = ["threshold", "fpr", "tpr", *(["amt"] if amount else [])]
    return nearest, [F.when(start, first[n]).otherwise(F.col(f"p.{n}")).alias(n) for n in names]


def at_fpr(points: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """The curve point whose false-positive rate is nearest the target (first of ties from the top)."""
    nearest, columns = _at_fpr(points, target)
    return points.groupBy(*by).agg(nearest).select(*by, *columns)


def recall_at_fpr(df: DataFrame, score: str, label: str, target: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    points = score_points(df, score, label, by)
    return at_fpr(points, target, by).select(*by, "threshold", "fpr", F.col("tpr").alias("recall"))


def dollar_recall(
    df: DataFrame, score: str, label: str, amount: str, target: float = 0.05, by: Sequence[str] = ()
) -> DataFrame:
    """Share of the positives' amount at or above the threshold of ``recall_at_fpr``."""
    return segment_metrics(df, score, label, amount, target, by).select(*by, "threshold", "dollar_recall")


def segment_metrics(
    df: DataFrame, score: str, label: str, amount: str | None = None, target: float = 0.05, by: Sequence[str] = ()
) -> DataFrame:
    """AUC, recall at the target rate, and amount-weighted recall, for all segments in one job."""
    by = list(by)
    points = score_points(df, score, label, by, amount)
    nearest, columns = _at_fpr(points, target, amount is not None)
    total = [F.max("tot_amt").alias("all_amt")] if amount else []
    out = points.groupBy(*by).agg(*_auc(), nearest, *total).select(*by, "n_pos", "n_neg", "auc", *columns, *(["all_amt"] if amount else []))
    out = out.withColumnRenamed("tpr", "recall")
    if not amount:
        return out
    # the amount at or above the threshold is the running total at the point
    return out.withColumn("dollar_recall", F.try_divide("amt", "all_amt")).drop("amt", "all_amt")


def champion_challenger(
    df: DataFrame, scores: Sequence[str], label: str, amount: str, by: Sequence[str] = (), target: float = 0.05
) -> DataFrame:
    """``segment_metrics`` per score column, over rows that have every score."""
    both: Column = F.lit(True)
    for s in scores:
        both = both & F.col(s).isNotNull()
    long = df.filter(both).select(
        *by,
        label,
        amount,
        F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("score")) for s in scores])).alias("m"),
    )
    flat = long.select(*by, label, amount, F.col("m.model").alias("model"), F.col("m.score").alias("_s"))
    return segment_metrics(flat, "_s", label, amount, target, ["model", *by])
