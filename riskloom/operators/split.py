"""Train, test and validation splits by hash order; reproducible and free of row shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.plans.cutoffs import HASH, at_or_before, hash_cutoffs, hash_fraction, hash_key


def stratified_split(
    df: DataFrame, label: str, id_col: str, train_ratio: float = 0.7, test_val_ratio: float = 0.5, seed: int = 42
) -> DataFrame:
    """``split`` = train / test / val; each class is cut at the same ratios (to the row).

    No row is lost: a class too small for a train or test row goes to val, and rows
    without label are ``unlabelled``.
    """
    total = F.col("total")
    n_train = F.floor(total * F.lit(train_ratio))
    n_test = F.floor((total - n_train) * F.lit(test_val_ratio))
    cuts = hash_cutoffs(df, label, id_col, seed, {"c_train": n_train, "c_test": n_train + n_test})
    keyed = df.withColumn(HASH, hash_key(seed, id_col)).join(cuts, label, "left")
    # with no training rows at all the test cut-off still applies
    split = (
        F.when(F.col(label).isNull(), "unlabelled")
        .when(at_or_before(F.col("c_train"), id_col), "train")
        .when(at_or_before(F.col("c_test"), id_col), "test")
        .otherwise("val")
    )
    return keyed.withColumn("split", split).select(*df.columns, "split")


def random_split(df: DataFrame, id_col: str, test_ratio: float, seed: int = 42) -> DataFrame:
    part = F.when(hash_fraction(seed, id_col) < test_ratio, "test").otherwise("train")
    return df.withColumn("split", part)


def downsample_negatives(df: DataFrame, label: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """All positives and the first n negatives in hash order."""
    cuts = hash_cutoffs(df.filter(F.col(label) == 0), label, id_col, seed, {"cut": F.least(F.lit(n), F.col("total"))})
    keyed = df.withColumn(HASH, hash_key(seed, id_col)).join(cuts, label, "left")
    keep = (F.col(label) == 1) | ((F.col(label) == 0) & at_or_before(F.col("cut"), id_col))
    return keyed.filter(keep).select(*df.columns)


def resplit_after_transform(df: DataFrame, transform, label: str, id_col: str, **ratios) -> DataFrame:
    """Forget the present split, transform all rows together, split again."""
    return stratified_split(df.drop("split").transform(transform), label, id_col, **ratios)
