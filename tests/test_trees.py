"""Trees over blocks of binned rows, against Spark's own learner."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.catalog import models
from riskloom.operators import model, trees

NAMES = ["a", "b", "c", "same"]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """30,000 rows, more than the 10,000 by which Spark chooses cut points; one column is mostly zeros, one constant."""
    path = f"{tmp_path_factory.mktemp('trees')}/rows"
    df = spark.range(30000, numPartitions=2).selectExpr(
        "id", "rand(1) * 10 AS a", "floor(randn(2) * 3) * 1.0D AS b", "greatest(0.0D, randn(3)) AS c", "1.0D AS same",
        "rand(5) < 0.2 AS held", "if(rand(6) < 0.3, 2.5D, 1.0D) AS w", "rand(4) AS noise",
    )
    df = df.selectExpr("*", "CAST(a + b * c + 3 * noise > 8 AS double) AS y", "CASE WHEN a + b > 6 THEN 2.0D WHEN c + noise > 1 THEN 1.0D ELSE 0.0D END AS kind")
    df.write.parquet(path)
    return spark.read.parquet(path)


def assembler(names):
    return VectorAssembler(inputCols=names, outputCol="features")


def chances(fitted, df):
    return np.array([r[0] for r in fitted.transform(df).orderBy("id").select(F.element_at(vector_to_array("probability"), 2)).collect()])


@pytest.mark.parametrize("held_rows", [1 << 20, 50])
@pytest.mark.parametrize("weight, validation", [(None, None), ("w", "held")])
def test_trees_are_those_of_sparks_learner(spark, rows, monkeypatch, held_rows, weight, validation):
    """In one task or over many, and with margins written anew after every second tree."""
    monkeypatch.setattr(model, "TREE_ROWS", held_rows)
    monkeypatch.setattr(model, "bounded", lambda df, n: df)
    monkeypatch.setattr(trees, "REFRESH", 2)
    params = model.TreeParams(max_depth=3, rounds=4, step_size=0.3)
    learner = model.tree_learner("y", params)
    if weight:
        learner = learner.setWeightCol(weight).setValidationIndicatorCol(validation)
    theirs = Pipeline(stages=[assembler(NAMES), learner]).fit(rows)
    ours = model.train_boosted_trees(rows, NAMES, "y", params, weight, validation)
    assert type(ours.stages[-1]) is type(theirs.stages[-1])
    assert ours.stages[-1].getNumTrees == theirs.stages[-1].getNumTrees and ours.stages[-1].treeWeights == theirs.stages[-1].treeWeights
    assert np.allclose(ours.stages[-1].featureImportances.toArray(), theirs.stages[-1].featureImportances.toArray(), atol=1e-9)
    assert np.abs(chances(ours, rows) - chances(theirs, rows)).max() < 1e-9


@pytest.mark.parametrize("held_rows", [1 << 20, 50])
def test_growing_stops_where_spark_stops(spark, monkeypatch, held_rows):
    """Labels without a pattern: the held rows' loss does not fall."""
    monkeypatch.setattr(model, "TREE_ROWS", held_rows)
    monkeypatch.setattr(model, "bounded", lambda df, n: df)
    df = spark.range(600, numPartitions=1).selectExpr("id", "pmod(hash(id), 97) * 1.0D AS a", "CAST(pmod(hash(id, 1), 2) AS double) AS y", "id % 4 = 0 AS held")
    params = model.TreeParams(max_depth=3, rounds=6, step_size=0.3)
    theirs = Pipeline(stages=[assembler(["a"]), model.tree_learner("y", params).setValidationIndicatorCol("held")]).fit(df)
    ours = model.train_boosted_trees(df, ["a"], "y", params, validation="held")
    assert ours.stages[-1].getNumTrees == theirs.stages[-1].getNumTrees < 6
    assert np.abs(chances(ours, df) - chances(theirs, df)).max() < 1e-9


@pytest.mark.parametrize("held_rows", [1 << 20, 5000, 50])
def test_classes_share_the_blocks(spark, rows, monkeypatch, held_rows):
    """One against the rest, from merged cells (few bins), and from blocks."""
    monkeypatch.setattr(model, "TREE_ROWS", held_rows)
    monkeypatch.setattr(model, "bounded", lambda df, n: df)
    names, params = ["b", "c"], model.TreeParams(max_depth=3, rounds=3)
    assert model.binned_rows(rows, names, "kind", params, n_classes=3).cells == (held_rows > 50)
    theirs = Pipeline(stages=[assembler(names), OneVsRest(classifier=model.tree_learner("kind", params), labelCol="kind", featuresCol="features")]).fit(rows)
    ours = model.train_boosted_trees(rows, names, "kind", params, n_classes=3)
    for a, b in zip(ours.stages[-1].models, theirs.stages[-1].models, strict=True):
        assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), atol=1e-9)
    counts = lambda m: sorted(map(tuple, m.transform(rows).groupBy("kind", "prediction").count().collect()))
    assert counts(ours) == counts(theirs)


def test_training_rows_are_made_once(spark, monkeypatch):
    """Neither the cut points, nor a tree, nor the next round of the selection makes the rows again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return float(x % 13)

    df = spark.range(4000, numPartitions=2).select(
        seen("id").alias("a"), (F.col("id") % 7 * 1.0).alias("b"), F.lit(1.0).alias("same"), (F.col("id") % 13 % 2 * 1.0).alias("y")
    )
    for held_rows in (1 << 20, 2000):
        monkeypatch.setattr(model, "TREE_ROWS", held_rows)
        before = made.value
        _, kept = model.feature_selection_loop(df, ["a", "b", "same"], "y", model.TreeParams(max_depth=2, rounds=2), max_iter=2)
        assert "a" in kept and "same" not in kept
        assert made.value - before == 4000


def test_rows_that_cannot_be_learned_from_fail(spark):
    params = model.TreeParams(max_depth=2, rounds=1)
    fine = [(float(i % 5), float(i % 2), 1.0) for i in range(20)]
    schema = "a double, y double, w double"
    for bad in [(None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (float("inf"), 1.0, 1.0), (1.0, None, 1.0), (1.0, 2.0, 1.0), (1.0, 0.5, 1.0), (1.0, 1.0, -1.0), (1.0, 1.0, None)]:
        with pytest.raises(Exception, match="missing or infinite|labels must be|weights must be"):
            model.train_boosted_trees(spark.createDataFrame([*fine, bad], schema), ["a"], "y", params, weight="w")
    with pytest.raises(ValueError, match="no rows"):
        model.train_boosted_trees(spark.createDataFrame([], schema), ["a"], "y", params)


def test_columns_that_tell_nothing_give_one_leaf(spark):
    df = spark.range(30).selectExpr("id", "1.0D AS a", "0.0D AS b", "CAST(id % 3 = 0 AS double) AS y")
    ours = model.train_boosted_trees(df, ["a", "b"], "y", model.TreeParams(max_depth=2, rounds=2))
    theirs = Pipeline(stages=[assembler(["a", "b"]), model.tree_learner("y", model.TreeParams(max_depth=2, rounds=2))]).fit(df)
    assert ours.stages[-1].totalNumNodes == theirs.stages[-1].totalNumNodes == 2
    assert np.abs(chances(ours, df) - chances(theirs, df)).max() < 1e-12


def test_draws_of_rows_or_features_stay_with_spark(spark, rows):
    """A share of the rows or features per tree: the trees of Spark's learner, with its draws."""
    params = model.TreeParams(max_depth=2, rounds=2, subsample=0.5, feature_fraction="onethird")
    ours = model.train_boosted_trees(rows, NAMES, "y", params)
    theirs = Pipeline(stages=[assembler(NAMES), model.tree_learner("y", params)]).fit(rows.select(*NAMES, "y"))
    assert np.abs(chances(ours, rows) - chances(theirs, rows)).max() < 1e-9


def test_the_multiclass_query_trains_in_full(spark, tmp_path, monkeypatch):
    """A hundred rounds of six levels for each class, as the learner does unasked; each row is counted under the class its model gives."""
    items = spark.range(1500, numPartitions=1).selectExpr(
        "floor(rand(1) * 50) * 1.0D AS l_quantity", "round(rand(2) * 9000, 2) AS l_extendedprice", "floor(rand(3) * 9) / 100 AS l_tax",
        "CASE WHEN rand(4) < 0.3 THEN 'A' WHEN rand(5) < 0.5 THEN 'N' ELSE 'R' END AS l_returnflag",
    )
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    fitted, train = [], model.train_boosted_trees
    monkeypatch.setattr(model, "train_boosted_trees", lambda *a, **k: fitted.append(train(*a, **k)) or fitted[-1])
    got = {(r["y"], r["prediction"]): r["n"] for r in models.multiclass_trees(spark, str(tmp_path)).collect()}
    parts = fitted[0].stages[-1].models
    assert [m.getNumTrees for m in parts] == [100] * 3 and [max(t.depth for t in m.trees) for m in parts] == [6] * 3
    flag = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    each = fitted[0].transform(spark.read.parquet(f"{tmp_path}/lineitem.parquet").withColumn("y", flag)).groupBy("y", "prediction").count()
    assert got == {(r["y"], r["prediction"]): r["count"] for r in each.collect()} and sum(got.values()) == 1500


def test_merged_rows_keep_sides_of_cuts(spark):
    """Values at a cut, next to it and at the ends get the sides that the trees give them; nothing is lost."""
    up = float(np.nextafter(2.5, 3))
    rows = [(x, 1.0, y) for x in (-1e300, 2.0, 2.5, up, 3.0, 4.5, 1e300) for y in (0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    binned = trees.Binned(("a", "b"), ((2.5, 4.5), ()), 2, df, False, False, True, True)
    got = sorted((r["y"], r["a"], r["n"]) for r in model.merged_rows(df, binned, ["y"]).collect())
    assert [(y, n) for y, _, n in got] == [(0.0, 3), (0.0, 3), (0.0, 1), (1.0, 6), (1.0, 6), (1.0, 2)]
    assert [np.searchsorted([2.5, 4.5], a) for _, a, _ in got] == [0, 1, 2, 0, 1, 2]
    with pytest.raises(Exception):
        model.merged_rows(spark.createDataFrame([(float("nan"), 1.0, 0.0)], df.schema), binned, ["y"]).collect()
