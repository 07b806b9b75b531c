"""Staged tables: intermediate results written to the shared folder and read back.

A staged table cuts lineage, survives the loss of an executor, and has a known
size, so the planner picks a broadcast join only when the files are really small.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_owners: list[list[str]] = []
_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.conf.get("spark.app.id")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.TemporaryDirectory(prefix="riskloom-")
    return _local_dirs[app].name


def new_stage_path(spark: SparkSession, name: str = "stage") -> str:
    path = f"{shared_dir(spark)}/riskloom/{name}-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    return path


@contextmanager
def staged_job(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end of the block, the tables staged inside it.

    Write the job's result inside the block: DataFrames built there read staged tables.
    """
    _owners.append([])
    try:
        yield
    finally:
        for path in _owners.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
