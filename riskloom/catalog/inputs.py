"""Inputs that the queries derive from the given tables, with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.catalog.registry import table

# line items as a risk frame: returned = bad, accepted = good, the rest unlabelled
RISK_SQL = """
risk AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, nullif(l_tax, 0.0) AS l_tax,
         nullif(l_discount, 0.0) AS l_discount, l_shipdate,
         CAST(l_suppkey AS VARCHAR) AS supp, CAST(l_partkey AS VARCHAR) AS part,
         nullif(CAST(l_linenumber AS VARCHAR), '7') AS line, l_linestatus AS status,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS y
  FROM lineitem)"""


def risk_frame(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        "l_shipdate",
        F.col("l_suppkey").cast("string").alias("supp"),
        F.col("l_partkey").cast("string").alias("part"),
        F.nullif(F.col("l_linenumber").cast("string"), F.lit("7")).alias("line"),
        F.col("l_linestatus").alias("status"),
        F.when(flag == "R", 1).when(flag == "A", 0).otherwise(-1).alias("y"),
    )


# two scores, an amount and a segment per line item
PREDS_SQL = """
preds AS (
  SELECT l_extendedprice / 105000.0 AS score, l_discount * 10.0 AS old_score,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         l_extendedprice AS amount, l_linestatus AS network, l_suppkey
  FROM lineitem)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 105000.0).alias("score"),
        (F.col("l_discount") * 10.0).alias("old_score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_linestatus").alias("network"),
        "l_suppkey",
    )


# three class scores per line item
MULTI_SQL = """
raw AS (
  SELECT l_quantity / 50.0 AS a, l_discount * 10.0 AS b, l_tax * 12.0 + 0.05 AS c,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y
  FROM lineitem),
multi AS (
  SELECT y, [a / (a + b + c), b / (a + b + c), c / (a + b + c)] AS probs FROM raw)"""


def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    a, b, c = F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 12.0 + 0.05
    s = a + b + c
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("y"),
        F.array(a / s, b / s, c / s).alias("probs"),
    )
