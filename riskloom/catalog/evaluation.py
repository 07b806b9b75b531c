"""Queries on curves, classification metrics and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.inputs import MULTI_SQL, PREDS_SQL, class_scores, predictions
from riskloom.catalog.registry import query, rounded, table
from riskloom.operators import calibrate, curves, metrics, splines
from riskloom.plans.staging import stage

# per distinct score, from high to low
POINTS_SQL = """
hist AS (SELECT {score} AS score, count(*) FILTER (y > 0) AS pos, count(*) FILTER (NOT y > 0) AS neg FROM {src} GROUP BY 1),
pts AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn
        FROM hist WINDOW w AS (ORDER BY score DESC))"""


def points(score: str = "score", src: str = "preds") -> str:
    return POINTS_SQL.format(score=score, src=src)


@query(
    "roc_curve",
    f"""WITH {PREDS_SQL}, {points("old_score")}
    SELECT round(score, 6) AS threshold, round(cn / tn::DOUBLE, 6) AS fpr, round(cp / tp::DOUBLE, 6) AS tpr FROM pts
    UNION ALL SELECT 'Infinity'::DOUBLE, 0.0, 0.0""",
)
def roc_curve(spark, sf):
    return rounded(curves.roc_curve(predictions(spark, sf), "old_score", "y"), "threshold", "fpr", "tpr")


@query(
    "auc_roc",
    f"""WITH {PREDS_SQL}, {points()}
    SELECT round(sum(pos * (tn - cn + neg * 0.5::DOUBLE)) / (max(tp)::DOUBLE * max(tn)), 6) AS auc,
           CAST(max(tp) AS BIGINT) AS n_pos, CAST(max(tn) AS BIGINT) AS n_neg FROM pts""",
)
def auc_roc(spark, sf):
    return rounded(curves.auc_roc(predictions(spark, sf), "score", "y"), "auc")


@query(
    "pr_curve",
    f"""WITH {PREDS_SQL}, {points("old_score")}
    SELECT round(score, 6) AS threshold, round(cp / (cp + cn)::DOUBLE, 6) AS precision, round(cp / tp::DOUBLE, 6) AS recall FROM pts""",
)
def pr_curve(spark, sf):
    return rounded(curves.pr_curve(predictions(spark, sf), "old_score", "y"), "threshold", "precision", "recall")


@query(
    "average_precision",
    f"""WITH {PREDS_SQL}, {points()} SELECT round(sum(pos / tp::DOUBLE * cp / (cp + cn)::DOUBLE), 6) AS ap FROM pts""",
)
def average_precision(spark, sf):
    return rounded(curves.average_precision(predictions(spark, sf), "score", "y"), "ap")


@query(
    "f1_at_thresholds",
    f"""WITH {PREDS_SQL}, t(metric, lo, closed) AS (VALUES ('f1_score', 0.5::DOUBLE, 0), ('f1_score_at_0.3', 0.3::DOUBLE, 1),
      ('f1_score_at_0.5', 0.5::DOUBLE, 1), ('f1_score_at_0.7', 0.7::DOUBLE, 1)),
    c AS (SELECT metric, CASE WHEN closed = 1 THEN score >= lo ELSE score > lo END AS hit, y = 1 AS pos FROM preds, t)
    SELECT metric, round(2.0::DOUBLE * count(*) FILTER (hit AND pos)
        / (2 * count(*) FILTER (hit AND pos) + count(*) FILTER (hit <> pos)), 6) AS f1 FROM c GROUP BY metric""",
)
def f1_at_thresholds(spark, sf):
    return rounded(metrics.f1_at_thresholds(predictions(spark, sf), "score", "y"), "f1")


@query(
    "pr_at_start",
    f"""WITH {PREDS_SQL} SELECT round(avg(y), 6) AS precision_start, 1.0::DOUBLE AS recall_start,
      round(count(*) FILTER (score >= 0.5 AND y = 1) / (count(*) FILTER (score >= 0.5))::DOUBLE, 6) AS precision_at_05,
      round(count(*) FILTER (score >= 0.5 AND y = 1) / (count(*) FILTER (y = 1))::DOUBLE, 6) AS recall_at_05 FROM preds""",
)
def pr_at_start(spark, sf):
    out = metrics.pr_at_start(predictions(spark, sf), "score", "y")
    return rounded(out, "precision_start", "precision_at_05", "recall_at_05")


CLASS_SQL = """
cls AS (SELECT CAST(i AS INTEGER) AS class, probs[i + 1] AS p, CAST(m.y = i AS INTEGER) AS y,
               CAST(list_position(probs, list_max(probs)) - 1 = i AS INTEGER) AS pred
        FROM multi m, range(3) t(i)),
hist AS (SELECT class, p AS score, count(*) FILTER (y > 0) AS pos, count(*) FILTER (NOT y > 0) AS neg FROM cls GROUP BY ALL),
pts AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY class) AS tp,
               sum(neg) OVER (PARTITION BY class) AS tn FROM hist WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
area AS (SELECT class, sum(pos * (tn - cn + neg * 0.5::DOUBLE)) / (max(tp)::DOUBLE * max(tn)) AS auc,
                sum(pos / tp::DOUBLE * cp / (cp + cn)::DOUBLE) AS ap, max(tp) AS support FROM pts GROUP BY class),
fone AS (SELECT class, 2.0::DOUBLE * count(*) FILTER (p > 0.5 AND y = 1)
                / (2 * count(*) FILTER (p > 0.5 AND y = 1) + count(*) FILTER ((p > 0.5) <> (y = 1))) AS f1,
                count(*) FILTER (pred = 1 AND y = 1) AS atp, count(*) FILTER (pred = 1 AND y = 0) AS afp,
                count(*) FILTER (pred = 0 AND y = 1) AS afn, count(*) FILTER (pred = 0 AND y = 0) AS atn
         FROM cls GROUP BY class)"""


@query(
    "ovr_metrics",
    f"""WITH {MULTI_SQL}, {CLASS_SQL}
    SELECT class, round(auc, 6) AS auc, round(ap, 6) AS ap, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
    FROM area JOIN fone USING (class)""",
)
def ovr_metrics(spark, sf):
    return rounded(metrics.ovr_metrics(class_scores(spark, sf), "probs", "y"), "auc", "ap", "f1")


@query(
    "macro_weighted_metrics",
    f"""WITH {MULTI_SQL}, {CLASS_SQL},
    mh AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM hist GROUP BY score),
    mp AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn
           FROM mh WINDOW w AS (ORDER BY score DESC)),
    micro AS (SELECT sum(pos * (tn - cn + neg * 0.5::DOUBLE)) / (max(tp)::DOUBLE * max(tn)) AS auc,
                     sum(pos / tp::DOUBLE * cp / (cp + cn)::DOUBLE) AS ap FROM mp)
    SELECT round(avg(area.auc), 6) AS auc_macro, round(sum(area.auc * support) / sum(support), 6) AS auc_weighted,
           round(max(micro.auc), 6) AS auc_micro, round(avg(area.ap), 6) AS ap_macro, round(max(micro.ap), 6) AS ap_micro,
           round(2.0::DOUBLE * sum(atp) / (2 * sum(atp) + sum(afp) + sum(afn)), 6) AS f1_micro,
           round(avg(2.0::DOUBLE * atp / (2 * atp + afp + afn)), 6) AS f1_macro
    FROM area JOIN fone USING (class), micro""",
)
def macro_weighted_metrics(spark, sf):
    out = metrics.macro_weighted_metrics(class_scores(spark, sf), "probs", "y")
    return rounded(out, *out.columns)


@query(
    "confusion_metrics",
    f"""WITH {PREDS_SQL}, {MULTI_SQL}, {CLASS_SQL},
    b AS (SELECT count(*) FILTER (score > 0.5 AND y = 1) AS tp, count(*) FILTER (score > 0.5 AND y = 0) AS fp,
                 count(*) FILTER (score <= 0.5 AND y = 1) AS fn, count(*) FILTER (score <= 0.5 AND y = 0) AS tn FROM preds),
    m AS (SELECT sum(atp) AS tp, sum(afp) AS fp, sum(afn) AS fn, sum(atn) AS tn FROM fone),
    r AS (SELECT 'val/accuracy' AS metric, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS value FROM b
      UNION ALL SELECT 'val/precision', tp / (tp + fp)::DOUBLE FROM b UNION ALL SELECT 'val/recall', tp / (tp + fn)::DOUBLE FROM b
      UNION ALL SELECT 'val/specificity', tn / (tn + fp)::DOUBLE FROM b
      UNION ALL SELECT 'val/f1_score', 2.0::DOUBLE * tp / (2 * tp + fp + fn) FROM b
      UNION ALL SELECT 'multi/accuracy', tp / (tp + fn)::DOUBLE FROM m
      UNION ALL SELECT 'multi/precision', tp / (tp + fp)::DOUBLE FROM m UNION ALL SELECT 'multi/recall', tp / (tp + fn)::DOUBLE FROM m
      UNION ALL SELECT 'multi/specificity', tn / (tn + fp)::DOUBLE FROM m
      UNION ALL SELECT 'multi/f1_score', 2.0::DOUBLE * tp / (2 * tp + fp + fn) FROM m)
    SELECT metric, round(value, 6) AS value FROM r""",
)
def confusion_metrics(spark, sf):
    two = metrics.confusion_metrics(predictions(spark, sf), "score", "y", "val")
    many = metrics.multiclass_confusion_metrics(class_scores(spark, sf), "probs", "y", "multi")
    return rounded(two.unionByName(many), "value")


@query(
    "kl_divergence",
    f"""WITH {MULTI_SQL}, k AS (SELECT list_sum(list_transform(range(3), lambda i:
          CASE WHEN probs[i + 1] = 0 THEN 0.0::DOUBLE
               ELSE probs[i + 1] / list_sum(probs) * ln(probs[i + 1] / list_sum(probs) * 3.0::DOUBLE) END)) AS kl FROM multi)
    SELECT round(avg(kl), 6) AS kl_divergence FROM k""",
)
def kl_divergence(spark, sf):
    uniform = F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    row = metrics.kl_divergence(F.col("probs"), uniform)
    return class_scores(spark, sf).agg(F.round(F.avg(row), 6).alias("kl_divergence"))


@query(
    "recall_at_precision",
    f"""WITH {MULTI_SQL}, {CLASS_SQL},
    ok AS (SELECT class, cp / tp::DOUBLE AS recall, score FROM pts WHERE cp / (cp + cn)::DOUBLE >= 0.5),
    best AS (SELECT class, max({{'r': recall, 's': score}}) AS b FROM ok GROUP BY class)
    SELECT CAST(i AS INTEGER) AS class, round(coalesce(b.r, 0.0), 6) AS recall, round(b.s, 6) AS threshold
    FROM range(3) t(i) LEFT JOIN best ON best.class = i""",
)
def recall_at_precision(spark, sf):
    rows = metrics.class_rows(class_scores(spark, sf), "probs", "y")
    return rounded(curves.recall_at_precision(rows, "p", "y", 0.5, ["class"]), "recall", "threshold")


FPR_SQL = """
curve AS (SELECT score AS threshold, cn / tn::DOUBLE AS fpr, cp / tp::DOUBLE AS tpr FROM pts
          UNION ALL SELECT 'Infinity'::DOUBLE, 0.0, 0.0),
edge AS (SELECT * FROM curve ORDER BY abs(fpr - 0.05::DOUBLE), threshold DESC LIMIT 1)"""


@query(
    "recall_at_fpr",
    f"""WITH {PREDS_SQL}, {points()}, {FPR_SQL}
    SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS recall FROM edge""",
)
def recall_at_fpr(spark, sf):
    return rounded(curves.recall_at_fpr(predictions(spark, sf), "score", "y"), "threshold", "fpr", "recall")


@query(
    "dollar_recall",
    f"""WITH {PREDS_SQL}, {points()}, {FPR_SQL}
    SELECT round(max(threshold), 6) AS threshold,
           round(coalesce(sum(amount) FILTER (y = 1 AND score >= threshold), 0.0) / sum(amount) FILTER (y = 1), 6) AS dollar_recall
    FROM preds, edge""",
)
def dollar_recall(spark, sf):
    return rounded(curves.dollar_recall(predictions(spark, sf), "score", "y", "amount"), "threshold", "dollar_recall")


def segment_sql(src: str, keys: str) -> str:
    """Metrics per group of the columns in ``keys``."""
    join = " AND ".join(f"p.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    return f"""
    hist AS (SELECT {keys}, score, count(*) FILTER (y > 0) AS pos, count(*) FILTER (NOT y > 0) AS neg FROM {src} GROUP BY ALL),
    pts AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY {keys}) AS tp,
                   sum(neg) OVER (PARTITION BY {keys}) AS tn FROM hist WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
    area AS (SELECT {keys}, CAST(max(tp) AS BIGINT) AS n_pos, CAST(max(tn) AS BIGINT) AS n_neg,
                    sum(pos * (tn - cn + neg * 0.5::DOUBLE)) / (max(tp)::DOUBLE * max(tn)) AS auc FROM pts GROUP BY {keys}),
    curve AS (SELECT {keys}, score AS threshold, cn / tn::DOUBLE AS fpr, cp / tp::DOUBLE AS tpr FROM pts
              UNION ALL SELECT DISTINCT {keys}, 'Infinity'::DOUBLE, 0.0, 0.0 FROM pts),
    edge AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY abs(fpr - 0.05::DOUBLE), threshold DESC) AS rn
             FROM curve) WHERE rn = 1),
    money AS (SELECT {", ".join("p." + k.strip() for k in keys.split(","))},
                     coalesce(sum(amount) FILTER (y = 1 AND score >= threshold), 0.0) / sum(amount) FILTER (y = 1) AS dollar_recall
              FROM {src} p JOIN edge e ON {join} GROUP BY ALL)
    SELECT {keys}, n_pos, n_neg, round(auc, 6) AS auc, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr,
           round(tpr, 6) AS recall, round(dollar_recall, 6) AS dollar_recall
    FROM area JOIN edge USING ({keys}) JOIN money USING ({keys})"""


MARKET_SQL = """
market AS (SELECT p.*, n_name AS marketplace FROM preds p JOIN supplier ON l_suppkey = s_suppkey
           JOIN nation ON s_nationkey = n_nationkey)"""


def with_marketplace(spark, sf):
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("marketplace"))
    suppliers = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    keyed = suppliers.select("s_suppkey", "marketplace")
    return predictions(spark, sf).join(keyed, F.col("l_suppkey") == F.col("s_suppkey"))


@query("segment_metrics", f"WITH {PREDS_SQL}, {MARKET_SQL}, {segment_sql('market', 'marketplace, network')}")
def segment_metrics(spark, sf):
    out = curves.segment_metrics(
        with_marketplace(spark, sf), "score", "y", "amount", by=["marketplace", "network"]
    )
    return rounded(out, "auc", "threshold", "fpr", "recall", "dollar_recall")


@query(
    "champion_challenger",
    f"""WITH {PREDS_SQL}, {MARKET_SQL},
    stacked AS (SELECT 'score' AS model, score, y, amount, network FROM market
             UNION ALL SELECT 'old_score', old_score, y, amount, network FROM market),
    {segment_sql('stacked', 'model, network')}""",
)
def champion_challenger(spark, sf):
    out = curves.champion_challenger(
        with_marketplace(spark, sf), ["score", "old_score"], "y", "amount", by=["network"]
    )
    return rounded(out, "auc", "threshold", "fpr", "recall", "dollar_recall")


@query(
    "score_histogram",
    f"""WITH {PREDS_SQL} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM preds
    WHERE score BETWEEN 0 AND 1 GROUP BY 1""",
)
def score_histogram(spark, sf):
    return metrics.score_histogram(predictions(spark, sf), "score")


# ---- calibration


@query(
    "calibration_bins",
    f"""WITH {PREDS_SQL}, b AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n,
        avg(score) AS ms, avg(CAST(y AS DOUBLE)) AS ml FROM preds GROUP BY 1)
    SELECT bin, n, round(ms, 6) AS mean_score, round(ml, 6) AS mean_label, round(abs(ms - ml), 6) AS gap,
           round(bin / 10.0, 6) AS bin_start, round((bin + 1) / 10.0, 6) AS bin_end FROM b""",
)
def calibration_bins(spark, sf):
    out = calibrate.calibration_bins(predictions(spark, sf), "score", "y")
    return rounded(out, "mean_score", "mean_label", "gap", "bin_start", "bin_end")


ERROR_SQL = """
bins AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS ms, avg(CAST(y AS DOUBLE)) AS ml,
                sum((score - y) * (score - y)) AS sq FROM preds GROUP BY 1)"""


@query(
    "ece_mce_brier",
    f"""WITH {PREDS_SQL}, {ERROR_SQL}
    SELECT round(sum(n * abs(ms - ml)) / sum(n), 6) AS ece, round(max(abs(ms - ml)), 6) AS mce,
           round(sum(sq) / sum(n), 6) AS brier, CAST(sum(n) AS BIGINT) AS n FROM bins""",
)
def ece_mce_brier(spark, sf):
    return rounded(calibrate.ece_mce_brier(predictions(spark, sf), "score", "y"), "ece", "mce", "brier")


@query(
    "reliability_curve",
    f"""WITH {PREDS_SQL} SELECT CAST(greatest(ceil(score * 10) - 1, 0) AS INTEGER) AS bin, round(avg(score), 6) AS prob_pred,
      round(avg(y), 6) AS prob_true FROM preds GROUP BY 1""",
)
def reliability_curve(spark, sf):
    return rounded(calibrate.reliability_curve(predictions(spark, sf), "score", "y"), "prob_pred", "prob_true")


@query(
    "multiclass_calibration_metrics",
    f"""WITH {MULTI_SQL}, {CLASS_SQL},
    b AS (SELECT class, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(CAST(y AS DOUBLE))) AS gap,
                 sum((p - y) * (p - y)) AS sq FROM cls GROUP BY ALL),
    c AS (SELECT class, sum(n * gap) / sum(n) AS ece, max(gap) AS mce, sum(sq) / sum(n) AS brier FROM b GROUP BY class)
    SELECT round(avg(ece), 6) AS macro_ece, round(avg(mce), 6) AS macro_mce, round(max(mce), 6) AS max_mce,
           round(sum(brier), 6) AS multiclass_brier FROM c""",
)
def multiclass_calibration_metrics(spark, sf):
    out = calibrate.multiclass_calibration_metrics(class_scores(spark, sf), "probs", "y")
    return rounded(out, *out.columns)


def curve_of(calibrator, df, score):
    """Calibrated value per distinct score: what the fit did, in a table."""
    return calibrator.apply(df.select(F.col(score).alias("score")).distinct(), "score", "calibrated")


# the isotonic fit at i is max over j <= i of min over k >= i of the mean label of j..k;
# old_score has eleven values, so the twin can try all of them
ISO_SQL = """
g AS (SELECT old_score AS s, count(*) AS n, sum(y) AS p, row_number() OVER (ORDER BY old_score) AS i FROM preds GROUP BY 1),
span AS (SELECT a.i AS j, b.i AS k, (SELECT sum(p) / sum(n)::DOUBLE FROM g WHERE g.i BETWEEN a.i AND b.i) AS m
         FROM g a JOIN g b ON a.i <= b.i),
low AS (SELECT g.i, j, min(m) AS m FROM g JOIN span ON j <= g.i AND k >= g.i GROUP BY g.i, j),
iso AS (SELECT g.s, max(low.m) AS c FROM g JOIN low USING (i) GROUP BY g.s)"""


@query(
    "isotonic_calibrate",
    f"WITH {PREDS_SQL}, {ISO_SQL} SELECT s AS score, round(c, 6) AS calibrated FROM iso",
)
def isotonic_calibrate(spark, sf):
    df = predictions(spark, sf)
    return rounded(curve_of(calibrate.isotonic_fit(df, "old_score", "y"), df, "old_score"), "calibrated")


# Newton's method on slope a and intercept b of the penalised log-loss (penalty a * a / 2e5)
PLATT_SQL = """
g AS (SELECT old_score AS s, count(*) AS n, sum(y) AS p FROM preds GROUP BY 1),
xs AS (SELECT list(struct_pack(s := s, n := n::DOUBLE, p := p::DOUBLE)) AS x FROM g),
newton(i, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT i, a, b,
      list_sum(list_transform(x, lambda r: (r.n / (1 + exp(-(a * r.s + b))) - r.p) * r.s)) + a / 1e5 AS ga,
      list_sum(list_transform(x, lambda r: r.n / (1 + exp(-(a * r.s + b))) - r.p)) AS gb,
      list_sum(list_transform(x, lambda r: r.n * r.s * r.s / (2 + exp(a * r.s + b) + exp(-(a * r.s + b))))) + 1e-5 AS haa,
      list_sum(list_transform(x, lambda r: r.n * r.s / (2 + exp(a * r.s + b) + exp(-(a * r.s + b))))) AS hab,
      list_sum(list_transform(x, lambda r: r.n / (2 + exp(a * r.s + b) + exp(-(a * r.s + b))))) AS hbb
    FROM newton, xs WHERE i < 25)),
best AS (SELECT a, b FROM newton WHERE i = 25)"""


@query(
    "platt_calibrate",
    f"WITH RECURSIVE {PREDS_SQL}, {PLATT_SQL} SELECT s AS score, round(1 / (1 + exp(-(a * s + b))), 4) AS calibrated FROM g, best",
)
def platt_calibrate(spark, sf):
    df = predictions(spark, sf)
    return rounded(curve_of(calibrate.platt_fit(df, "old_score", "y"), df, "old_score"), "calibrated", places=4)


@query("gam_calibrate")
def gam_calibrate(spark, sf):
    df = predictions(spark, sf)
    return rounded(curve_of(calibrate.gam_fit(df, "old_score", "y"), df, "old_score"), "calibrated", places=4)


@query(
    "gam_calibrate_checks",
    f"""WITH {PREDS_SQL} SELECT count(DISTINCT old_score) AS scores, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives,
      1 AS in_range, 1 AS rising, 1 AS balanced FROM preds""",
)
def gam_calibrate_checks(spark, sf):
    """What any monotone fit with a free intercept must show: values rise in (0, 1) and sum to the positives."""
    df = predictions(spark, sf)
    curve = curve_of(calibrate.gam_fit(df, "old_score", "y"), df, "old_score").withColumnRenamed("score", "old_score")
    # eleven rows, one per score
    sums = df.join(curve, "old_score").groupBy("old_score", "calibrated").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    c = F.col("calibrated")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("old_score", "calibrated"))), lambda x: x["calibrated"])
    return sums.agg(
        F.count(F.lit(1)).alias("scores"),
        F.sum("n").alias("n"),
        F.sum("p").alias("positives"),
        F.min((c > 0) & (c < 1)).cast("int").alias("in_range"),
        (F.array_sort(steps) == steps).cast("int").alias("rising"),
        (F.abs(F.sum(c * F.col("n")) - F.sum("p")) / F.sum("n") < 1e-4).cast("int").alias("balanced"),
    )


@query("spline_optimum", "SELECT CAST(i AS INTEGER) AS i, 1 AS stationary, 1 AS rising FROM range(10) t(i)")
def spline_optimum(spark, sf):
    """The conditions of the constrained minimum, from the emitted coefficients and fresh sums over the rows.

    The derivative by the level is zero; that by each increment is zero where it is positive, and not negative else.
    """
    df = predictions(spark, sf)
    fit = splines.fit_spline(stage(calibrate.score_weights(df, "score", "y"), "weights"), 10, 0.6, True)
    score, lo, step = F.col("score"), fit.lo, (fit.hi - fit.lo) / 7
    u = (F.least(F.greatest(score, F.lit(fit.lo)), F.lit(fit.hi)) - lo) / step
    # the basis as fourth differences of cut cubes, not as the fit has it
    cubes = [F.pow(F.greatest(u - i, F.lit(0.0)), 3) for i in range(-3, 11)]
    rows = df.select("y", fit(score).alias("p"), *[c.alias(f"t{i}") for i, c in enumerate(cubes)])
    b = [sum((w * F.col(f"t{j + m}") for m, w in enumerate((1, -4, 6, -4, 1)) if j + m < 14), F.lit(0.0)) / 6 for j in range(10)]
    found = rows.agg(*[F.sum(b[j] * (F.col("p") - F.col("y"))).alias(f"g{j}") for j in range(10)])
    c = [F.lit(x) for x in fit.coefficients]
    # second differences, and from them the derivative of the penalty
    d = [c[j] - 2 * c[j + 1] + c[j + 2] for j in range(8)]
    zero = F.lit(0.0)
    at = lambda j: d[j] if 0 <= j < 8 else zero
    own = [F.col(f"g{j}") + 0.6 * (at(j) - 2 * at(j - 1) + at(j - 2)) for j in range(10)]
    facts = []
    for i in range(10):
        slope = own[i]
        for k in range(i + 1, 10):
            slope = slope + own[k]
        step = c[i] - c[i - 1] if i else F.lit(1.0)
        fine = F.when(step > 1e-9, F.abs(slope) < 1e-3).otherwise(slope > -1e-3)
        facts.append(F.struct(F.lit(i).alias("i"), fine.cast("int").alias("stationary"), (step >= 0).cast("int").alias("rising")))
    return found.select(F.inline(F.array(*facts)))


def isotonic_sql(rows: str) -> str:
    """``iso(g, s, c)``: slopes of the greatest convex minorant of the cumulative sums of ``rows(g, s, y)``.

    From one corner the next one is the point of smallest slope, of ties the farthest.
    """
    return f"""
cums AS (SELECT g, s, row_number() OVER o AS k, sum(n) OVER o AS w, sum(p) OVER o AS p FROM
           (SELECT g, s, count(*) AS n, sum(y) AS p FROM {rows} GROUP BY g, s) WINDOW o AS (PARTITION BY g ORDER BY s)),
points AS (SELECT g, list(struct_pack(w := w::DOUBLE, p := p::DOUBLE) ORDER BY k) AS xs, count(*) AS m FROM cums GROUP BY g),
corners(g, j, k, w, p, c) AS (
  SELECT g, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM points
  UNION ALL
  SELECT g, k, -best.i, xs[-best.i].w, xs[-best.i].p, best.c
  FROM (SELECT h.g, h.k, xs, list_min(list_transform(xs[h.k + 1:],
          lambda x, i: struct_pack(c := (x.p - h.p) / (x.w - h.w), i := -(i + h.k)))) AS best
        FROM corners h JOIN points ON points.g = h.g WHERE h.k < m)),
iso AS (SELECT cums.g, cums.s, c FROM cums JOIN corners h ON h.g = cums.g AND cums.k > h.j AND cums.k <= h.k)"""


@query(
    "multiclass_calibrate",
    f"""WITH RECURSIVE {MULTI_SQL},
    numbered AS (SELECT row_number() OVER () AS r, y AS label, probs FROM multi),
    cls AS (SELECT r, label, i AS g, probs[i + 1] AS s, CASE WHEN label = i THEN 1 ELSE 0 END AS y
            FROM numbered, (SELECT unnest(range(3)) AS i)), {isotonic_sql("cls")},
    cal AS (SELECT r, label, g, c / nullif(sum(c) OVER (PARTITION BY r), 0) AS c FROM cls JOIN iso USING (g, s))
    SELECT label AS y, count(*) FILTER (g = 0) AS n, round(avg(c) FILTER (g = 0), 4) AS cal_0,
           round(avg(c) FILTER (g = 1), 4) AS cal_1, round(avg(c) FILTER (g = 2), 4) AS cal_2 FROM cal GROUP BY label""",
)
def multiclass_calibrate(spark, sf):
    df = class_scores(spark, sf)
    fits = calibrate.multiclass_calibrate_fit(df, "probs", "y", 3, "isotonic")
    out = calibrate.multiclass_calibrate_apply(df, "probs", fits, "cal")
    return out.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.element_at("cal", i + 1)), 4).alias(f"cal_{i}") for i in range(3)]
    )


@query(
    "binary_calibrate_apply",
    f"""WITH {PREDS_SQL}, {ISO_SQL},
    b AS (SELECT CAST(least(floor(c * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(c) AS ms, avg(CAST(y AS DOUBLE)) AS ml
          FROM preds JOIN iso ON s = old_score GROUP BY 1)
    SELECT bin, n, round(ms, 6) AS mean_score, round(ml, 6) AS mean_label, round(abs(ms - ml), 6) AS gap,
           bin / 10.0 AS bin_start, (bin + 1) / 10.0 AS bin_end FROM b""",
)
def binary_calibrate_apply(spark, sf):
    df = predictions(spark, sf).withColumn("probs", F.array(1 - F.col("old_score"), F.col("old_score")))
    fit = calibrate.isotonic_fit(df, "old_score", "y")
    out = calibrate.binary_calibrate_apply(df, "probs", fit, "cal")
    bins = calibrate.calibration_bins(out.withColumn("c", F.element_at("cal", 2)), "c", "y")
    return rounded(bins, "mean_score", "mean_label", "gap")


@query(
    "calibration_report",
    f"""WITH RECURSIVE {PREDS_SQL}, one AS (SELECT 0 AS g, score AS s, y FROM preds), {isotonic_sql("one")},
    both_rows AS (SELECT 'before' AS phase, s AS q, y FROM one UNION ALL SELECT 'after', c, y FROM one JOIN iso USING (g, s)),
    b AS (SELECT phase, least(floor(q * 10), 9) AS bin, count(*) AS n, abs(sum(q) - sum(y)) AS gap, sum((q - y) * (q - y)) AS sq
          FROM both_rows GROUP BY ALL),
    e AS (SELECT phase, sum(gap) / sum(n) AS ece, max(gap / n) AS mce, sum(sq) / sum(n) AS brier FROM b GROUP BY phase),
    h AS (SELECT phase, q, sum(y) AS pos, count(*) - sum(y) AS neg FROM both_rows GROUP BY phase, q),
    below AS (SELECT *, sum(neg) OVER (PARTITION BY phase ORDER BY q) - neg * 0.5::DOUBLE AS beaten FROM h),
    a AS (SELECT phase, sum(pos * beaten) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM below GROUP BY phase),
    long AS (SELECT phase, unnest(['ece', 'mce', 'brier', 'auc']) AS metric, unnest([ece, mce, brier, auc]) AS v FROM e JOIN a USING (phase)),
    wide AS (SELECT metric, max(v) FILTER (phase = 'before') AS before, max(v) FILTER (phase = 'after') AS after FROM long GROUP BY metric)
    SELECT metric, round(before, 5) AS before, round(after, 5) AS after, round(after - before, 5) AS change,
           CASE WHEN metric <> 'auc' THEN round((1 - after / greatest(before, 1e-10::DOUBLE)) * 100, 3) END AS improvement_pct FROM wide""",
)
def calibration_report(spark, sf):
    df = predictions(spark, sf)
    fit = calibrate.isotonic_fit(df, "score", "y")
    out = fit.apply(stage(df.select("score", "y")), "score", "calibrated")
    report = calibrate.calibration_report(out, "score", "calibrated", "y")
    return rounded(rounded(report, "before", "after", "change", places=5), "improvement_pct", places=3)
