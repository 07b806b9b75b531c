"""Second-order boosted trees on generated tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting, model
from riskloom.operators.curves import auc_roc

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 4000
    x = rng.normal(size=(n, 4))
    x[rng.random((n, 4)) < 0.1] = np.nan
    z = 2 * np.nan_to_num(x[:, 0]) - np.nan_to_num(x[:, 1], nan=3.0) + np.nan_to_num(x[:, 2]) ** 2 - 1
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    kind = np.digitize(np.nan_to_num(x[:, 0]), [-0.5, 0.5])
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(t), int(k), i % 4 == 0) for i, (r, t, k) in enumerate(zip(x, y, kind, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int, kind int, held boolean").cache()


def auc(scored, label="y"):
    return auc_roc(scored.select(label, F.element_at("probs", 2).alias("s")), "s", label).first()["auc"]


def test_not_below_spark_trees_on_new_rows(spark, frame):
    params = boosting.BoostParams(rounds=20, eta=0.3, max_depth=3, early_stopping=5, refresh=4)
    ours = boosting.fit_boosted_trees(frame, NAMES, "y", params, validation="held")
    filled = frame.fillna(0.0)
    theirs = model.train_boosted_trees(filled.filter("not held"), NAMES, "y", model.TreeParams(step_size=0.3, max_depth=3, rounds=20))
    ours_auc = auc(ours.score(frame.filter("held")))
    assert ours_auc > 0.85 and ours_auc > auc(model.score_frame(filled.filter("held"), theirs))
    # stops at the best round on the held rows
    assert len(ours.trees) == int(np.argmin(ours.losses)) and ours.losses[0] == pytest.approx(np.log(2))
    importance = {r.feature: r.importance for r in ours.importance(spark).collect()}
    assert sum(importance.values()) == pytest.approx(1) and importance["d"] == min(importance.values())
    nodes = ours.nodes(spark)
    assert nodes.filter("feature IS NULL AND value IS NULL").isEmpty() and nodes.select("round").distinct().count() == len(ours.trees)


def test_same_trees_however_rows_are_dealt(spark, frame):
    params = boosting.BoostParams(rounds=2, max_depth=3, refresh=1, max_bins=16)
    cuts = [sorted(map(str, boosting.fit_boosted_trees(frame.repartition(k, "id"), NAMES, "y", params).nodes(spark).drop("cut").collect())) for k in (1, 7)]
    assert cuts[0] == cuts[1]


def test_best_cut_against_all_cuts():
    rng = np.random.default_rng(2)
    for alpha, least in ((0.0, 0.0), (0.7, 2.0)):
        params = boosting.BoostParams(reg_alpha=alpha, min_child_weight=least, reg_lambda=1.5, gamma=0.1)
        g, h = np.zeros(256), np.zeros(256)
        at = [0, 1, 2, 5, 9, 255]
        g[at], h[at] = rng.normal(size=6) * 3, rng.random(6) * 4
        worth = lambda x, y: max(abs(x) - alpha, 0) ** 2 / (y + 1.5)
        best = -np.inf
        for b in range(255):
            for side in (0.0, 1.0):
                gl, hl = g[: b + 1].sum() + side * g[255], h[: b + 1].sum() + side * h[255]
                if min(hl, h.sum() - hl) >= max(least, 1e-12):
                    best = max(best, 0.5 * (worth(gl, hl) + worth(g.sum() - gl, h.sum() - hl) - worth(g.sum(), h.sum())) - 0.1)
        assert boosting.best_cut(g, h, params)[2] == pytest.approx(best)
    assert boosting.best_cut(np.zeros(256), np.zeros(256), boosting.BoostParams())[2] == -np.inf


def test_weights_samples_and_softmax(frame):
    params = boosting.BoostParams(rounds=4, eta=0.5, max_depth=2, subsample=0.7, colsample=0.5, seed=3)
    weighted = frame.withColumn("w", F.when(F.col("y") == 1, 3.0).otherwise(1.0))
    mean = lambda m, df: m.score(df).agg(F.avg(F.element_at("probs", 2))).first()[0]
    plain = mean(boosting.fit_boosted_trees(frame, NAMES, "y", params), frame)
    assert mean(boosting.fit_boosted_trees(weighted, NAMES, "y", params, weight="w"), frame) > plain + 0.05
    three = boosting.fit_boosted_trees(frame, NAMES, "kind", boosting.BoostParams(rounds=4, eta=0.5, max_depth=2), n_classes=3)
    hit = three.score(frame).select((F.array_position("probs", F.array_max("probs")) - 1 == F.col("kind")).cast("int").alias("h"))
    assert hit.agg(F.avg("h")).first()[0] > 0.95


def test_awkward_columns(spark):
    rows = [(i, None, 5.0, str(i % 2), i % 2) for i in range(40)] + [(99, float("nan"), 5.0, "x", None)]
    df = spark.createDataFrame(rows, "i int, gone double, same double, text string, y int")
    m = boosting.fit_boosted_trees(df, ["gone", "same", "text"], "y", boosting.BoostParams(rounds=2, max_depth=2, min_child_weight=0.0))
    out = m.score(df).collect()
    assert len(out) == 41 and all((r.probs[1] > 0.5) == bool(r.y) for r in out if r.y is not None)
    assert {n.feature for n in m.nodes(spark).collect()} <= {"text", None}
