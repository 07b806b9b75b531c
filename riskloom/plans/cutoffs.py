"""Exact "first k rows in hash order" per group, without sorting the table.

A histogram of the leading hash digits locates the bucket that holds the k-th
row of a group; only that bucket (1/65536 of the group) is ranked. The table
itself is then split by comparing each row with its group's cut-off, with no
shuffle of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.plans.staging import stage

HASH = "_hash"
BUCKET_DIGITS = 4


def hash_key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_fraction(seed: int, id_col: str) -> Column:
    """Uniform number in [0, 1) from the first eight hash digits."""
    head = F.conv(F.substring(hash_key(seed, id_col), 1, 8), 16, 10).cast("long")
    return head / F.lit(float(2**32))


def hash_cutoffs(df: DataFrame, group: str, id_col: str, seed: int, targets: Mapping[str, Column]) -> DataFrame:
    """One row per group: for each target name, struct ``(hash, id)`` of its k-th row.

    A target is an expression over ``total`` (the group's row count) giving k;
    k = 0 leaves the cut-off NULL, and a group of which nothing is wanted has only
    NULLs. ``id_col`` must be unique. Rows without group have no cut-offs.
    """
    keyed = df.select(F.col(group).alias("_g"), F.col(id_col).alias("_id"), hash_key(seed, id_col).alias(HASH))
    keyed = keyed.filter(F.col("_g").isNotNull()).withColumn("_b", F.substring(HASH, 1, BUCKET_DIGITS))
    histogram = stage(keyed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("c")), "histogram")
    # at most 16**BUCKET_DIGITS rows per group
    per_group = Window.partitionBy("_g")
    upto = per_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counted = histogram.select(
        "_g", "_b", "c", F.sum("c").over(upto).alias("cum"), F.sum("c").over(per_group).alias("total")
    )
    wanted = F.array(
        *[F.struct(F.lit(name).alias("target"), expr.cast("long").alias("k")) for name, expr in targets.items()]
    )
    edge = (
        counted.select("_g", "_b", "c", "cum", F.explode(wanted).alias("w"))
        .filter((F.col("w.k") > F.col("cum") - F.col("c")) & (F.col("w.k") <= F.col("cum")))
        .select("_g", "_b", F.col("w.target").alias("target"), (F.col("w.k") - F.col("cum") + F.col("c")).alias("need"))
    )
    edge = stage(edge, "edges")
    in_edge = keyed.join(edge, ["_g", "_b"])
    ranked = in_edge.withColumn(
        "rn", F.row_number().over(Window.partitionBy("_g", "_b", "target").orderBy(HASH, "_id"))
    ).filter(F.col("rn") == F.col("need"))
    cut = [
        F.max(F.when(F.col("target") == name, F.struct(F.col(HASH), F.col("_id")))).alias(name) for name in targets
    ]
    found = histogram.select("_g").distinct().join(ranked.groupBy("_g").agg(*cut), "_g", "left")
    return stage(found.withColumnRenamed("_g", group), "cutoffs")


def at_or_before(cut: Column, id_col: str) -> Column:
    """True for rows whose (hash, id) is not after the cut-off; NULL cut-off is never reached."""
    here = F.struct(F.col(HASH), F.col(id_col).alias("_id"))
    return F.coalesce(here <= cut, F.lit(False))
