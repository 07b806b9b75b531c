"""Writers: splits, batches, result sets, predictions and metrics."""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskloom.operators.metrics import value_counts
from riskloom.functions.numbers import fixed_text
from riskloom.functions.responses import run_summary


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # the folder name of a NULL


def sink_splits(df: DataFrame, root: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per split."""
    writer = df.write.partitionBy("split").mode(mode)
    writer.option("header", True).csv(root) if fmt == "csv" else writer.parquet(root)


def _array_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def join_lists(df: DataFrame, sep: str = ";") -> DataFrame:
    """List columns as text, items joined."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), sep, "None") for c in _array_columns(df)})


def sink_batch_partitioned(
    df: DataFrame, root: str, batch_id: str, partition_cols: Sequence[str] = (), compression: str = "snappy"
) -> str:
    path = f"{root.rstrip('/')}/batch_{batch_id}"
    writer = join_lists(df).write.option("compression", compression)
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)
    return path


def batch_names(spark: SparkSession, root: str) -> list[str]:
    """The names of the batches under a root, in order; lists files, reads none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/batch_*")
    # the last folder called batch_…: the root may have such a name too
    name = F.regexp_extract("path", r".*/(batch_[^/]*)(?:/[^/]*=[^/]*)*/[^/]*$", 1)
    return sorted(row["name"] for row in files.select(name.alias("name")).distinct().collect())


def _partition_values(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, Column]:
    """The columns that the folders ``name=value`` below the batches stand for, typed as all their values allow."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{root.rstrip('/')}/{n}" for n in names])
    pairs = files.select(F.explode(F.regexp_extract_all(_folders(F.col("path")), F.lit("/[^/]+"), 0)).alias("p")).distinct()
    found: dict[str, list[str]] = {}
    for row in pairs.collect():  # one row per folder name
        name, _, value = unquote(row["p"][1:]).partition("=")
        if value != NO_VALUE:
            found.setdefault(name, []).append(value)
        else:
            found.setdefault(name, [])

    def fits(values: list[str], kind: type) -> bool:
        try:
            return bool(values) and all(str(kind(v)) is not None for v in values)
        except ValueError:
            return False

    columns = {}
    for name, values in sorted(found.items()):
        kind = "string"
        if fits(values, int):
            kind = "int" if all(-(1 << 31) <= int(v) < 1 << 31 for v in values) else "bigint"
        elif fits(values, float):
            kind = "double"
        text = _decoded(F.regexp_extract(_folders(_decoded(F.col("_metadata.file_path"))), rf"/{re.escape(name)}=([^/]*)", 1))
        columns[name] = F.nullif(F.nullif(text, F.lit("")), F.lit(NO_VALUE)).cast(kind)
    return columns


def _folders(path: Column) -> Column:
    """The folders ``name=value`` between a batch and its file."""
    return F.regexp_extract(path, r".*/batch_[^/]*((?:/[^/]+=[^/]*)*)/[^/]*$", 1)


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def merge_batches(
    spark: SparkSession,
    root: str,
    exclude: str | None = None,
    skip_corrupt: bool = False,
    to: str | None = None,
    partition_cols: Sequence[str] = (),
    compression: str = "snappy",
) -> DataFrame:
    """All batches stacked by column name, partition columns included, each file read once.

    Batches with ``exclude`` in their own name are not read. Unreadable files fail the
    job unless ``skip_corrupt`` is set. With ``to`` the result is written there and read back.
    """
    names = [n for n in batch_names(spark, root) if not exclude or exclude not in n]
    if not names:
        raise ValueError(f"no batch to merge under {root}")
    reader = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", skip_corrupt)
    # one scan whatever the number of batches; folders of partition values are read as columns below
    df = reader.option("recursiveFileLookup", True).parquet(*[f"{root.rstrip('/')}/{n}" for n in names])
    for name, value in _partition_values(spark, root, names).items():
        # a batch that is not partitioned holds the column in its files
        df = df.withColumn(name, F.coalesce(value, F.col(name).cast("string")) if name in df.columns else value)
    if to is None:
        return df
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(to)
    return spark.read.parquet(to)


def gzip_files(spark: SparkSession, source: str, target: str, pattern: str = "*") -> int:
    """Copies of the files of a folder, each compressed by gzip as a whole and named ``<name>.gz``.

    The target is reached through Arrow's file systems (a local or shared path, HDFS, S3, GCS).
    """

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, root = fs.FileSystem.from_uri(target if "://" in target or target.startswith("file:") else f"file://{target}")
        to.create_dir(root, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                end = f"{root}/{path.rsplit('/', 1)[-1]}.gz"
                part = f"{root}/.{uuid.uuid4().hex}"  # a task that runs twice leaves whole files only
                with to.open_output_stream(part, compression=None) as out:
                    out.write(gzip.compress(content.as_py(), mtime=0))
                to.move(part, end)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(source).select("path", "content")
    return files.mapInArrow(copy, "files long").agg(F.sum("files")).first()[0] or 0


def sink_multi_format(df: DataFrame, root: str, status: str = "processing_status") -> None:
    """The same rows as Parquet, CSV and JSON Lines, and a summary."""
    root = root.rstrip("/")
    df.write.parquet(f"{root}/results.parquet")
    # the others come from the written file, so no row is computed twice
    kept = df.sparkSession.read.schema(df.schema).parquet(f"{root}/results.parquet")
    nested = [f.name for f in kept.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    flat = kept.withColumns({c: F.to_json(c) for c in nested}) if nested else kept
    flat.write.option("header", True).csv(f"{root}/results.csv")
    kept.write.json(f"{root}/results.jsonl")
    if status in kept.columns:
        run_summary(kept, status).write.json(f"{root}/summary.json")
        value_counts(kept, "category").write.json(f"{root}/categories.json")


def prediction_columns(df: DataFrame, id_col: str, label: str, probs: str, n_classes: int) -> DataFrame:
    """``id, label, prob_class_0 …``."""
    scores = [F.element_at(probs, i + 1).alias(f"prob_class_{i}") for i in range(n_classes)]
    return df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), *scores)


def sink_predictions(df: DataFrame, path: str, id_col: str, label: str, probs: str, n_classes: int, sep: str = ",") -> None:
    prediction_columns(df, id_col, label, probs, n_classes).write.csv(path, header=True, sep=sep)


def metrics_long(df: DataFrame) -> DataFrame:
    """One row of metrics as ``(metric, value)``."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    return doubles.unpivot([], df.columns, "metric", "value")


def sink_metrics(df: DataFrame, path: str) -> None:
    long = metrics_long(df)
    long.write.option("ignoreNullFields", False).json(f"{path.rstrip('/')}/metrics.json")
    line = F.concat(F.col("metric"), F.lit(": "), F.coalesce(fixed_text(F.col("value"), 4), F.lit("NULL")))
    long.select(line.alias("value")).write.text(f"{path.rstrip('/')}/metrics.txt")
