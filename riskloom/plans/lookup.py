"""Equi-joins the jobs are made of. No hints: lookup sides are staged, so their
size is known and the planner broadcasts them only below its threshold; above it
the join is shuffled and adaptive execution splits skewed keys."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def lookup_with_default(
    df: DataFrame, table: DataFrame, key: Column, value: str, default: Column, out: str, table_key: str = "key"
) -> DataFrame:
    """``out`` = the table's value for ``key``, else ``default``; the table has unique keys."""
    side = table.select(F.col(table_key).alias("_lk"), F.col(value).alias("_lv"))
    joined = df.withColumn("_k", key).join(side, F.col("_k") == F.col("_lk"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_lv"), default)).drop("_k", "_lk", "_lv")


def attach_results(df: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """All input rows, with result columns or NULL where a row has no result."""
    return df.join(results, key, "left")


def merge_new_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that takes from the right only the columns the left lacks."""
    fresh = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(key, *fresh), key, "inner")


def resume_pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no entry in the table of finished rows."""
    return df.join(done.select(key), key, "left_anti")


def decode_codes(df: DataFrame, codes: DataFrame, code: str, out: str, default: str = "MISSING") -> DataFrame:
    return lookup_with_default(df, codes, F.col(code), "name", F.lit(default), out, table_key="code")


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A short table from the driver, as a local relation, so that the planner knows its size."""
    names = [field.split()[0] for field in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(names)
    arrays = [pa.array(list(c)) for c in columns]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=names)).select(
        *[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")]
    )
