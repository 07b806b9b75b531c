"""Parallelism of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SETTING = "spark.riskloom.scanPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over as many partitions as the session's ``spark.riskloom.scanPartitions`` names.

    Set it only for inputs of few row groups, which fewer tasks read than there are cores.
    Unset, as it should be on large tables, the scan is not shuffled.
    """
    wanted = df.sparkSession.conf.get(SETTING, None)
    return df.repartition(int(wanted)) if wanted else df


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """No partition of many more than ``rows`` rows, whatever the size of the input's splits; one count, and a shuffle only then.

    For learners that keep what they make of a partition and read it again in one task.
    """
    part = F.spark_partition_id().alias("part")
    sizes = df.groupBy(part).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (sizes[0] or 0) <= rows:
        return df
    # by row number, as dealing rows out in turn would sort every partition first
    return df.repartition(-(-sizes[1] // rows), F.monotonically_increasing_id())
