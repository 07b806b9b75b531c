"""Plan helpers: correctness under skew, and the shapes of the physical plans."""

from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import calibrate, curves, isotonic, model, quality, risk, split
from riskloom.plans import partitions
from riskloom.plans.cutoffs import hash_fraction
from riskloom.plans.prefix import ordered_index, running_totals
from riskloom.plans.quantiles import exact_quantiles
from riskloom.plans.staging import shared_dir, stage, staged_job


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_totals_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(1)
        rows = [(int(g), i, int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 4, 500), rng.integers(0, 9, 500)))]
        rows += [(9, i, 1) for i in range(500, 1000)]  # one group holds half of the rows
        df = spark.createDataFrame(rows, "g int, o int, v long")
        got = {(r.g, r.o): (r.cum_v, r.tot_v) for r in running_totals(df, ["o"], ["v"], ["g"]).collect()}
        for g in (0, 1, 2, 3, 9):
            total, want = 0, {}
            for _, o, v in sorted(r for r in rows if r[0] == g):
                total += v
                want[(g, o)] = total
            assert {k: x[0] for k, x in got.items() if k[0] == g} == want
            assert {x[1] for k, x in got.items() if k[0] == g} == {total}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ordered_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = [(r.k, r.idx) for r in ordered_index(df, ["k"]).orderBy("k").collect()]
    assert got == [(i, i) for i in range(1000)]


def test_quantiles_of_a_hot_value(spark):
    values = [1.0] * 400 + [float(i) for i in range(2, 60)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.prob: r["value"] for r in exact_quantiles(df, ["x"], [0, 0.5, 0.9, 0.95, 1]).collect()}
    assert got == pytest.approx({p: np.quantile(values, p) for p in (0, 0.5, 0.9, 0.95, 1)})


def test_split_counts_per_class(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y"))
    out = split.stratified_split(df, "y", "id")
    counts = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert counts == {
        (0, "train"): 1260, (0, "test"): 270, (0, "val"): 270, (1, "train"): 140, (1, "test"): 30, (1, "val"): 30,
    }


def test_split_does_not_shuffle_rows(spark):
    df = stage(spark.range(2000).select("id", (F.col("id") % 2).alias("y")))
    text = plan(split.stratified_split(df, "y", "id"))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_downsample_keeps_every_positive(spark):
    df = spark.range(1000).select("id", (F.col("id") < 100).cast("int").alias("y"))
    out = split.downsample_negatives(df, "y", "id", 50).groupBy("y").count()
    assert {r.y: r["count"] for r in out.collect()} == {0: 50, 1: 100}
    more = split.downsample_negatives(df, "y", "id", 5000).count()
    assert more == 1000


def test_hash_fraction_is_uniform(spark):
    row = spark.range(20000).agg(F.avg(hash_fraction(42, "id")).alias("m"), F.max(hash_fraction(42, "id")).alias("x")).first()
    assert abs(row.m - 0.5) < 0.02 and row.x < 1


def test_dedup_is_an_aggregate(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, o int, v string")
    out = quality.dedup_keep_first(df, "k", ["o"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "a"), (2, 5, "c")]
    assert "partial_min_by" in plan(out) and "Window" not in plan(out)


def test_fit_is_one_pass(spark):
    df = stage(spark.range(100).select((F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 2).alias("b"), F.lit(1).alias("y")))
    counts = plan(risk.labelled_counts(df, ["a", "b"], "y"))
    assert "partial_count" in counts and counts.count("FileScan") == 1
    text = plan(risk.risk_table_fit(df, ["a", "b"], "y").bins)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_staged_tables_have_an_owner(spark):
    kept = stage(spark.range(3), "kept")
    with staged_job(spark):
        inner = stage(spark.range(4), "inner")
        files = [urlsplit(f).path for f in inner.inputFiles()]
        assert inner.count() == 4 and all(Path(f).exists() for f in files)
    assert kept.count() == 3 and not any(Path(f).exists() for f in files)


def test_split_loses_no_row(spark):
    """A class of one row, a NULL label, and ratios that want nothing."""
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b")], "id int, y string")
    for ratio in (0.7, 0.0):
        out = {r.id: r.split for r in split.stratified_split(df, "y", "id", train_ratio=ratio).collect()}
        assert sorted(out) == [1, 2, 3, 4] and out[2] == "unlabelled" and out[4] == "val"


def test_columns_without_values_are_counted(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "n int, e int, s string")
    assert {r.column_name: r.n_distinct for r in quality.distinct_per_column(df, df.columns).collect()} == {"n": 2, "e": 0, "s": 2}
    assert {r.column_name: r.eligible for r in quality.categorical_eligibility(df, ["n", "e", "s"], limit=2).collect()} == {"n": 0, "e": 1, "s": 1}


def test_one_class_segment_has_no_rates(spark):
    rows = [("a", 0.9, 1, 5.0), ("a", 0.2, 0, 1.0), ("a", 0.1, 0, 1.0), ("b", 0.5, 1, 2.0), ("c", float("nan"), 1, 1.0), ("c", 0.3, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, s double, y int, m double")
    out = {r.g: r for r in curves.segment_metrics(df, "s", "y", "m", 0.05, ["g"]).collect()}
    # the starting point is as near to the target as the first score, and comes first
    assert (out["a"].threshold, out["a"].recall, out["a"].dollar_recall, out["a"].auc) == (float("inf"), 0.0, 0.0, 1.0)
    for g in "bc":
        assert out[g].auc is None and out[g].threshold is None and out[g].recall is None
    assert out["c"].n_pos == 0


def test_shared_dir_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")


def test_large_lookup_is_not_broadcast(spark):
    """Above the threshold the planner shuffles both sides; nothing forces a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        df = spark.range(1000).select((F.col("id") % 5).cast("string").alias("c"), (F.col("id") % 2).alias("y"))
        tables = risk.risk_table_fit(df, ["c"], "y").staged()
        out = risk.risk_map_apply(df, tables, ["c"])
        assert "SortMergeJoin" in plan(out)
        assert out.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def pooled(n, pos):
    """Fitted value per row by pooling neighbours."""
    blocks = []
    for k, p in zip(n, pos, strict=True):
        blocks.append([k, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            k2, p2, m = blocks.pop()
            blocks[-1] = [blocks[-1][0] + k2, blocks[-1][1] + p2, blocks[-1][2] + m]
    return np.repeat([p / k for k, p, _ in blocks], [m for *_, m in blocks])


def isotonic_cases():
    rng = np.random.default_rng(4)
    m = 600
    ones = np.ones(m, dtype=int)
    yield "noise", ones, (rng.random(m) < np.arange(m) / m).astype(int)
    yield "rising", ones * 10_000, np.arange(m)
    yield "falling", ones * 10_000, np.arange(m)[::-1]
    yield "equal", ones * 7, ones * 3
    yield "two rising halves", ones * 10_000, np.concatenate((np.arange(m // 2) + 500, np.arange(m // 2)))
    yield "a late low", ones * 10_000, np.append(np.arange(m - 1) + 9, 0)
    yield "an early high", ones * 10_000, np.append(9_000, np.arange(m - 1))
    yield "steps", ones * 100, (np.arange(m) // 37 * 5 + rng.integers(0, 3, m)).clip(0, 100)
    yield "weights", (w := rng.integers(1, 1000, m)), (w * rng.random(m)).astype(int)
    yield "waves", ones * 1000, (500 + 0.5 * np.arange(m) + 150 * np.sin(np.arange(m) / 20)).astype(int)


@pytest.mark.parametrize("case", list(isotonic_cases()), ids=lambda c: c[0])
@pytest.mark.parametrize("rows_per_task", [25, 130])
def test_isotonic_blocks_of_ranges(spark, case, rows_per_task):
    _, n, pos = case
    rows = [(float(i), int(k), int(p)) for i, (k, p) in enumerate(zip(n, pos, strict=True))]
    blocks = isotonic.isotonic_blocks(spark.createDataFrame(rows, "score double, n long, pos long"), rows_per_task).collect()
    got = np.full(len(n), np.nan)
    for b in blocks:
        assert np.isnan(got[int(b.lo) : int(b.hi) + 1]).all()
        got[int(b.lo) : int(b.hi) + 1] = b["value"]
    assert np.allclose(got, pooled(n, pos), rtol=1e-12)


@pytest.mark.parametrize(("rows_per_task", "model_blocks"), [(64, 100_000), (64, 3), (1 << 18, 100_000)])
def test_isotonic_fit_with_a_score_per_row(spark, rows_per_task, model_blocks):
    rng = np.random.default_rng(4)
    scores = rng.permutation(3000) / 3000.0
    labels = (rng.random(3000) < scores).astype(int)
    df = spark.createDataFrame(list(zip(scores.tolist(), labels.tolist())) + [(None, 1), (float("nan"), 1), (0.5, None)], "s double, y int")
    fit = calibrate.isotonic_fit(df, "s", "y", rows_per_task, model_blocks)
    got = fit.apply(df.filter("s is not null and not isnan(s) and y is not null"), "s", "c").orderBy("s").toPandas()["c"]
    order = np.argsort(scores)
    want = pooled(np.ones(3000, dtype=int), labels[order])
    assert np.allclose(got, want)
    other = spark.createDataFrame([(x,) for x in (-1.0, 0.00001, 0.50001, 0.77777, 2.0)], "s double")
    lines = np.interp([-1.0, 0.00001, 0.50001, 0.77777, 2.0], scores[order], want)
    assert np.allclose(fit.apply(other, "s", "c").orderBy("s").toPandas()["c"], lines)


def test_isotonic_lookup_keeps_rows_without_score(spark):
    points = spark.createDataFrame([(float(i), i / 10) for i in range(8)], "x double, y double")
    df = spark.createDataFrame([(None,), (float("nan"),), (3.5,), (3.5,), (-2.0,), (99.0,)], "s double")
    out = isotonic.interpolate(df, "s", points, "c", 3)
    assert out.columns == ["s", "c"]
    assert sorted((str(r.s), r.c) for r in out.collect()) == sorted([("None", None), ("nan", None), ("3.5", 0.35), ("3.5", 0.35), ("-2.0", 0.0), ("99.0", 0.7)])


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_by_refined_histograms(spark, seed):
    rng = np.random.default_rng(seed)
    near = 1.0 + np.arange(300) * 2.0**-52  # resolved by the last bits only
    columns = {
        "a": np.concatenate((rng.normal(size=700) * 10.0 ** rng.integers(-200, 200, 700), [0.0, -0.0, np.inf, -np.inf])),
        "b": np.concatenate((near, near[:200], -near[:204])),
        "c": rng.integers(0, 5, 704).astype(float),
        "d": np.full(704, 5.0),
    }
    columns = {k: rng.permutation(v) for k, v in columns.items()}
    rows = [tuple(float(x) for x in r) for r in zip(*columns.values(), strict=True)]
    rows += [(None, float("nan"), None, 5.0), (None, None, float("nan"), 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double".replace(", e double", "")).withColumn("e", F.lit(None).cast("int"))
    probs = [0, 0.1, 1 / 3, 0.5, 0.999, 1]
    got = {(r["var"], r.prob): r["value"] for r in exact_quantiles(df, ["a", "b", "c", "d", "e"], probs).collect()}
    assert {v for v, _ in got} == set("abcd")
    for v, values in columns.items():
        values = np.sort(np.append(values, [5.0, 5.0]) if v == "d" else values)
        for p in probs:
            at = p * (len(values) - 1)
            low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
            want = low if low == high else low + (high - low) * (at - np.floor(at))
            assert got[v, p] == want or (np.isnan(want) and np.isnan(got[v, p]))


def test_tree_training_tasks_hold_bounded_rows(spark, monkeypatch):
    """One split of many rows is dealt out before the trees keep it; few rows stay where they are."""
    rows = spark.range(5000).selectExpr("id * 1.0 AS a", "id % 7 * 1.0 AS b", "CAST(id % 2 AS double) AS y").coalesce(1)
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sizes(partitions.bounded(rows, 5000)) == [5000]
    assert max(sizes(partitions.bounded(rows, 1000))) <= 1100 and sum(sizes(partitions.bounded(rows, 1000))) == 5000
    assert partitions.bounded(rows.limit(0), 10).count() == 0
    held = []
    monkeypatch.setattr(model, "TREE_ROWS", 1000)
    monkeypatch.setattr(model, "bounded", lambda df, n: held.append(partitions.bounded(df, n)) or held[-1])
    small = model.TreeParams(max_depth=2, rounds=1)
    assert model.train_boosted_trees(rows, ["a", "b"], "y", small).transform(rows).count() == 5000
    assert held[0].columns == ["a", "b", "y"] and max(sizes(held[0])) <= 1100


def test_doubles_are_not_read_from_text(spark):
    """``safe_numeric`` keeps doubles as they are, text and other numbers by their text."""
    rows = [(0.1, 0.1, "Default", 7), (float("nan"), None, " 2.5", None), (float("inf"), float("nan"), None, 3), (5e-324, 1.5, "x", 0)]
    df = spark.createDataFrame(rows, "d double, f float, s string, i int")
    out = quality.safe_numeric(df, ["d", "f", "s", "i"], -1.0)
    assert [tuple(r) for r in out.collect()] == [(0.1, 0.1, -1.0, 7.0), (-1.0, -1.0, 2.5, -1.0), (float("inf"), -1.0, -1.0, 3.0), (5e-324, 1.5, -1.0, 0.0)]
    assert "cast(d" not in plan(quality.safe_numeric(df.select("d"), ["d"]))
