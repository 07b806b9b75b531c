"""Training and scoring with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel
from pyspark.ml.feature import Bucketizer, HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom.operators import trees
from riskloom.operators.curves import auc_roc
from riskloom.operators.impute import impute_apply, impute_fit
from riskloom.operators.quality import safe_numeric
from riskloom.operators.risk import RiskTables, risk_map_apply, risk_table_fit
from riskloom.plans.lookup import local_table
from riskloom.plans.partitions import bounded
from riskloom.plans.staging import stage


#: training rows of one partition, and rows from which one task grows all trees
TREE_ROWS = 3 << 18


@dataclass(frozen=True)
class TreeParams:
    step_size: float = 0.1
    max_depth: int = 6
    rounds: int = 100
    subsample: float = 1.0
    feature_fraction: str = "all"
    seed: int = 42


def train_boosted_trees(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    params: TreeParams = TreeParams(),
    weight: str | None = None,
    validation: str | None = None,
    n_classes: int = 2,
    binned: trees.Binned | None = None,
) -> PipelineModel:
    """Boosted trees on assembled numeric features; rows with the validation flag stop training early.

    More than two classes are trained one against the rest. A task holds at most ``TREE_ROWS`` rows.
    ``binned``: the same rows, with these features and others, from ``binned_rows``. Subsets of rows or
    features per tree are drawn by Spark's own learner.
    """
    gbt = tree_learner(label, params)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    if binned_alone(df, features, params):
        if binned is None:
            binned = binned_rows(df, features, label, params, weight, validation, n_classes)
        growth = trees.Growth(params.rounds, params.max_depth, params.step_size, gbt.getValidationTol())
        models = trees.fit(binned, features, gbt, growth, n_classes)
        if n_classes == 2:
            return PipelineModel([assembler, models[0]])
        return PipelineModel([assembler, OneVsRestModel(models).setFeaturesCol("features")])
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    learner = gbt if n_classes == 2 else OneVsRest(classifier=gbt, labelCol=label, featuresCol="features")
    return Pipeline(stages=[assembler, learner]).fit(training_columns(df, features, label, weight, validation))


def tree_learner(label: str, params: TreeParams) -> GBTClassifier:
    return GBTClassifier(
        labelCol=label,
        featuresCol="features",
        stepSize=params.step_size,
        maxDepth=params.max_depth,
        maxIter=params.rounds,
        subsamplingRate=params.subsample,
        featureSubsetStrategy=params.feature_fraction,
        seed=params.seed,
    )


def training_columns(df: DataFrame, features: Sequence[str], label: str, weight: str | None, validation: str | None) -> DataFrame:
    return bounded(df.select(*dict.fromkeys([*features, label, *filter(None, (weight, validation))])), TREE_ROWS)


def binned_alone(df: DataFrame, features: Sequence[str], params: TreeParams) -> bool:
    """Whether ``trees`` can grow them: all rows and features for every tree, and a number per feature."""
    whole = params.subsample >= 1.0 and params.feature_fraction == "all" and params.max_depth > 0 and params.rounds > 0
    return whole and all(isinstance(df.schema[f].dataType, (T.NumericType, T.BooleanType)) for f in features)


def binned_rows(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    params: TreeParams = TreeParams(),
    weight: str | None = None,
    validation: str | None = None,
    n_classes: int = 2,
) -> trees.Binned:
    """Training rows by the bins of their features, to train with any of these features."""
    rows, bins = training_columns(df, features, label, weight, validation), tree_learner(label, params).getMaxBins()
    return trees.bin_rows(rows, features, label, weight, validation, n_classes, bins, params.seed, TREE_ROWS)


def merged_rows(df: DataFrame, binned: trees.Binned, keep: Sequence[str] = ()) -> DataFrame:
    """Rows that no tree over these bins tells apart as one, with their number ``n``; a feature becomes a value of its bin.

    Scoring then costs a model run per row of this table, at most one for each combination of bins and kept values.
    """
    names = [f"_bin_{i}" for i in range(len(binned.features))]
    cuts = [sorted({*c}) or [0.0] for c in binned.cuts]
    # a value equal to a cut belongs to the bin below
    splits = [[-math.inf, *[math.nextafter(x, math.inf) for x in c], math.inf] for c in cuts]
    values = [F.col(f"`{f}`").cast("double").alias(f) for f in binned.features]
    bins = Bucketizer(inputCols=list(binned.features), outputCols=names, splitsArray=splits, handleInvalid="error")
    counts = bins.transform(df.select(*keep, *values)).groupBy(*keep, *names).agg(F.count(F.lit(1)).alias("n"))

    def value(name: str, c: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in (*c, math.nextafter(c[-1], math.inf))]), F.col(name).cast("int") + 1)

    return counts.select(*keep, *[value(n, c).alias(f) for n, c, f in zip(names, cuts, binned.features, strict=True)], "n")


def score_frame(df: DataFrame, model: PipelineModel, out: str = "probs") -> DataFrame:
    """Probability array per row; both classes for a binary model."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")).drop("features", "rawPrediction", "probability")


def feature_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    return local_table(spark, rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def feature_selection_loop(
    df: DataFrame, features: Sequence[str], label: str, params: TreeParams = TreeParams(), max_iter: int = 5
) -> tuple[PipelineModel, list[str]]:
    """Retrain without the features of zero importance until all count, or ``max_iter``."""
    kept = list(features)
    training, binned = df.select(label, *kept), None
    if binned_alone(training, kept, params):
        binned = binned_rows(training, kept, label, params)
    else:
        training = stage(training, "training")
    for _ in range(max_iter):
        model = train_boosted_trees(training, kept, label, params, binned=binned)
        weights = model.stages[-1].featureImportances.toArray()
        useful = [f for f, w in zip(kept, weights) if w > 0]
        if len(useful) == len(kept) or not useful:
            break
        kept = useful
    else:
        model = train_boosted_trees(training, kept, label, params, binned=binned)
    return model, kept


def train_test_oot_report(df: DataFrame, model: PipelineModel, label: str, split: str = "split") -> DataFrame:
    """AUC per split."""
    scored = score_frame(df, model).select(split, label, F.element_at("probs", 2).alias("score"))
    return auc_roc(scored, "score", label, [split])


def text_classifier(
    text: str, label: str, numeric: Sequence[str] = (), n_features: int = 1 << 14, reg: float = 1e-3
) -> Pipeline:
    """Hashed TF-IDF of the text next to the numeric columns, into logistic regression."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=n_features),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=2),
        VectorAssembler(inputCols=["_tfidf", *numeric], outputCol="features", handleInvalid="error"),
        LogisticRegression(labelCol=label, featuresCol="features", regParam=reg, maxIter=30),
    ]
    return Pipeline(stages=stages)


@dataclass(frozen=True)
class FeatureState:
    """Everything fitted before the model: risk tables, fill values, column order."""

    risk: RiskTables
    fills: DataFrame
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]

    @property
    def order(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def fit_features(
    train: DataFrame,
    label: str,
    categorical: Sequence[str],
    numeric: Sequence[str],
    smooth_factor: float = 0.0,
    count_threshold: int = 0,
) -> FeatureState:
    risk = risk_table_fit(train, categorical, label, smooth_factor, count_threshold).staged()
    fills = stage(impute_fit(train, {c: "median" for c in numeric}), "fills")
    return FeatureState(risk, fills, tuple(categorical), tuple(numeric))


def eval_feature_frame(df: DataFrame, state: FeatureState, keep: Sequence[str] = ()) -> DataFrame:
    """Map risks, fill gaps, force numbers, and project id, label and features in model order."""
    mapped = risk_map_apply(df, state.risk, state.categorical)
    filled = impute_apply(mapped, state.fills, state.numeric)
    return safe_numeric(filled, state.order).select(*keep, *state.order)
