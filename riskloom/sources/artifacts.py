"""Fitted tables on disk: Parquet folders with a checked schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators.model import FeatureState
from riskloom.operators.risk import RiskTables

REQUIRED = {
    "bins": ("var", "key", "value"),
    "defaults": ("var", "default_value"),
    "fills": ("var", "value"),
    "features": ("pos", "feature", "role"),
    "edges": ("var", "edges", "n_bins", "lo", "hi"),
}


def save_table(df: DataFrame, root: str, kind: str) -> None:
    check(df, kind)
    df.write.parquet(f"{root.rstrip('/')}/{kind}")


def load_table(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return check(spark.read.parquet(f"{root.rstrip('/')}/{kind}"), kind)


def check(df: DataFrame, kind: str) -> DataFrame:
    missing = [c for c in REQUIRED[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"fitted table {kind} lacks {missing}")
    return df


def save_features(spark: SparkSession, state: FeatureState, root: str) -> None:
    save_table(state.risk.bins, root, "bins")
    save_table(state.risk.defaults, root, "defaults")
    save_table(state.fills, root, "fills")
    roles = ["numeric"] * len(state.numeric) + ["categorical"] * len(state.categorical)
    rows = [(i, f, r) for i, (f, r) in enumerate(zip(state.order, roles))]
    save_table(spark.createDataFrame(rows, "pos int, feature string, role string"), root, "features")


def load_features(spark: SparkSession, root: str) -> FeatureState:
    listed = load_table(spark, root, "features").orderBy("pos").collect()
    return FeatureState(
        RiskTables(load_table(spark, root, "bins"), load_table(spark, root, "defaults")),
        load_table(spark, root, "fills"),
        tuple(r.feature for r in listed if r.role == "categorical"),
        tuple(r.feature for r in listed if r.role == "numeric"),
    )
