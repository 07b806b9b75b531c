"""Scoring request bodies: parse, map features, predict, calibrate, format. The same on tables and streams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from riskloom.functions.formats import prediction_csv, prediction_json
from riskloom.operators.calibrate import Calibrator, binary_calibrate_apply, isotonic_fit
from riskloom.operators.model import FeatureState, TreeParams, fit_features, score_frame, train_boosted_trees
from riskloom.operators.quality import to_number
from riskloom.plans.staging import stage
from riskloom.sources.readers import parse_request_records


def literals(state: FeatureState) -> tuple[dict[str, float], dict[str, float]]:
    """Fill values and risk defaults of a fitted state: one number per column."""
    fills = {r["var"]: r["value"] for r in state.fills.collect()}
    defaults = {r["var"]: r["default_value"] for r in state.risk.defaults.collect()}
    return fills, defaults


def literal_features(
    df: DataFrame, state: FeatureState, fills: dict[str, float], defaults: dict[str, float]
) -> DataFrame:
    """Map risks and fill numbers, stateless.

    Risk bins are joined stream-static. Fill values and defaults (one per column)
    are literals, as a stream plan cannot hold a scalar subquery. A column that had no number
    when fitted has no fill value; its gaps become 0.
    """
    for c in state.categorical:
        bins = state.risk.bins.filter(F.col("var") == c).select(F.col("key").alias("_k"), F.col("value").alias("_v"))
        df = df.join(bins, F.col(c).cast("string") == F.col("_k"), "left")
        df = df.withColumn(c, F.coalesce("_v", F.lit(defaults[c]))).drop("_k", "_v")
    return df.withColumns({c: F.coalesce(to_number(F.col(c)), F.lit(fills.get(c, 0.0))) for c in state.numeric})


@dataclass(frozen=True)
class Scorer:
    """Everything fitted that scoring needs, and the schema of one record."""

    state: FeatureState
    fills: dict[str, float]
    defaults: dict[str, float]
    model: PipelineModel
    calibrator: Calibrator
    schema: str

    def score(self, requests: DataFrame, key: str, body: str = "body", content_type: str = "media") -> DataFrame:
        """``(key, pos, error, score, calibrated, json, csv)``, one row per record of a body.

        A record that cannot be scored keeps its row, with its error and nothing else.
        """
        rows = parse_request_records(requests, body, content_type, key, self.schema)
        mapped = literal_features(rows, self.state, self.fills, self.defaults)
        scored = binary_calibrate_apply(score_frame(mapped, self.model, "_raw"), "_raw", self.calibrator, "_cal")
        raw, cal = F.col("_raw"), F.col("_cal")
        result = {
            "score": F.element_at(raw, 2),
            "calibrated": F.element_at(cal, 2),
            "json": prediction_json(raw, cal, 2),
            "csv": prediction_csv(raw, cal, 2),
        }
        fine = F.col("error").isNull()
        return scored.select(key, "pos", "error", *[F.when(fine, c).alias(name) for name, c in result.items()])


def fit_scorer(
    train: DataFrame,
    label: str,
    categorical: Sequence[str],
    numeric: Sequence[str],
    schema: str,
    params: TreeParams = TreeParams(),
    smooth_factor: float = 0.0,
    count_threshold: int = 0,
) -> Scorer:
    """Fit features, boosted trees and an isotonic calibrator on labelled rows."""
    state = fit_features(train, label, categorical, numeric, smooth_factor, count_threshold)
    fills, defaults = literals(state)
    frame = stage(literal_features(train, state, fills, defaults).select(label, *state.order), "training")
    model = train_boosted_trees(frame, state.order, label, params)
    scored = score_frame(frame, model).select(label, F.element_at("probs", 2).alias("score"))
    return Scorer(state, fills, defaults, model, isotonic_fit(scored, "score", label), schema)
