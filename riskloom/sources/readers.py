"""Readers: mixed shards, role-typed files, prediction sets, request bodies."""

from __future__ import annotations

import csv
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from riskloom.operators.quality import RoleSpec
from riskloom.sources.shards import detect_json, detect_separator, heads, read_wrapped, stack

K = TypeVar("K")

# file name endings per format
SHARD_ENDINGS = {
    "csv": ("csv", "csv.gz", "tsv", "tsv.gz"),
    "json": ("json", "json.gz"),
    "parquet": ("parquet",),
    "wrapped": ("parquet.gz",),
}


def _has_files(spark: SparkSession, folder: str, pattern: str) -> bool:
    """Lists names only; no file content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return not files.select("path").isEmpty()


def scan_shards(
    spark: SparkSession,
    folder: str,
    sep: str | None = None,
    multi_line: bool | None = None,
    schemas: Mapping[str, T.StructType | str] | None = None,
) -> DataFrame:
    """All ``part-*`` shards of a folder stacked on the union of their columns.

    Delimited text (csv, tsv), JSON and Parquet, each also compressed by gzip. The separator and
    header of a text shard, and whether a JSON shard has one object per line or is one array or object,
    are found from its first two lines; ``sep`` and ``multi_line`` state them for all shards instead.
    There is one read per separator and header, so columns meet by name whatever their order.

    ``schemas`` by format (csv, json, parquet). Without one, the schema of text shards is
    inferred, which reads them once more; with one, columns it lacks are left out. Empty text shards have no rows.
    """
    frames: list[DataFrame] = []
    schemas = schemas or {}
    for fmt, endings in SHARD_ENDINGS.items():
        pattern = f"part-*.{{{','.join(endings)}}}"
        if not _has_files(spark, folder, pattern):
            continue
        reader = spark.read.option("pathGlobFilter", pattern)
        given = schemas.get("parquet" if fmt == "wrapped" else fmt)
        if fmt == "csv":
            kinds = _by_dialect(heads(spark, folder, pattern), lambda x: (sep or detect_separator(x), x[0]), folder)
            frames += [_read_text(reader, paths, *kind, given) for kind, paths in kinds.items()]
        elif fmt == "json":
            reader = reader.schema(given) if given is not None else reader
            stated = {"whole" if multi_line else "lines": [folder]}
            kinds = stated if multi_line is not None else _by_dialect(heads(spark, folder, pattern), detect_json, folder)
            for kind, paths in kinds.items():
                rows = reader.json(paths, multiLine=kind == "whole")
                frames.append(flatten(rows) if kind == "whole" else rows)
        elif fmt == "parquet":
            reader = reader.schema(given) if given is not None else reader.option("mergeSchema", True)
            frames.append(reader.parquet(folder))
        else:
            frames.append(read_wrapped(spark, folder, pattern, given))
    if not frames:
        raise FileNotFoundError(f"no shards in {folder}")
    return stack(frames)


def _by_dialect(found: Mapping[str, Sequence[str]], detect: Callable[[Sequence[str]], K], folder: str) -> dict[K, list[str]]:
    """Paths by dialect; the whole folder where all files have the same."""
    groups: dict[K, list[str]] = {}
    for path, lines in sorted(found.items()):
        groups.setdefault(detect(lines), []).append(path)
    return dict.fromkeys(groups, [folder]) if len(groups) == 1 else groups


def _read_text(reader: DataFrameReader, paths: list[str], sep: str, header: str, given: T.StructType | str | None) -> DataFrame:
    if given is None:
        return reader.csv(paths, header=True, sep=sep, inferSchema=True)
    kinds = {f.name: f.dataType for f in (T._parse_datatype_string(given) if isinstance(given, str) else given).fields}
    names = next(csv.reader([header], delimiter=sep))
    schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    return reader.schema(schema).csv(paths, header=True, sep=sep).select(*[f"`{n}`" for n in names if n in kinds])


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields as dotted columns (quote them with back-ticks)."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            out += leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [here]
        return out

    def expr(path: tuple[str, ...]) -> Column:
        return F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path))

    return df.select(*[expr(p) for p in leaves(df.schema, ())])


def restore_dots(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("__DOT__", ".") for c in df.columns])


def scan_json(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """JSON Lines (an object or an array of objects per line); with ``multi_line`` one
    array or object per file. Nested objects become dotted columns."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return flatten(spark.read.option("multiLine", multi_line).json(paths))


def scan_role_typed(
    spark: SparkSession, path: str, roles: RoleSpec, names: Sequence[str] | None = None
) -> DataFrame:
    """CSV, TSV or Parquet by ending; ``names`` replace the header. Numbers are typed by role."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.toDF(*names) if names else df
    if not path.endswith((".csv", ".tsv")):
        raise ValueError(f"unsupported file type: {path}")
    sep = "\t" if path.endswith(".tsv") else ","
    reader = spark.read.option("header", True).option("sep", sep)
    if names is None:
        names = reader.csv(path).columns
    return reader.option("enforceSchema", True).schema(roles.struct_type(names)).csv(path)


def scan_with_signature(
    spark: SparkSession, data: str, signature: str, label: str, sep: str = ","
) -> DataFrame:
    """Columns named by the header of a second file; the label column is renamed ``TAG``."""
    names = spark.read.csv(signature, header=True, sep=sep).columns
    schema = T.StructType([T.StructField("TAG" if n == label else n, T.StringType()) for n in names])
    return spark.read.schema(schema).csv(data, header=True, sep=sep, escape="\\", enforceSchema=True)


def scan_cases(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    if path.endswith(".json"):
        return spark.read.json(path, multiLine=True)
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def scan_split_dirs(spark: SparkSession, root: str, splits: Sequence[str] = ("train", "test", "val")) -> DataFrame:
    """The table written by ``sink_splits``; other splits are pruned at the scan."""
    return spark.read.parquet(root).filter(F.col("split").isin(*splits))


def scan_tagged_predictions(sets: Mapping[str, DataFrame]) -> DataFrame:
    """Prediction sets stacked on their common columns, with ``dataset_origin``."""
    frames = list(sets.values())
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    if not common:
        raise ValueError("the prediction sets have no column in common")
    tagged = [f.select(*common, F.lit(name).alias("dataset_origin")) for name, f in sets.items()]
    return reduce(DataFrame.unionByName, tagged)


def scan_rank_predictions(spark: SparkSession, folder: str, skip_corrupt: bool = False) -> DataFrame:
    """All ``test_result_*.tsv``; ``prob`` is a number or a list, read as an array. Unreadable files fail unless skipped."""
    schema = "id string, label string, prob string"
    rows = spark.read.option("ignoreCorruptFiles", skip_corrupt).schema(schema).csv(
        f"{folder.rstrip('/')}/test_result_*.tsv", sep="\t", header=True
    )
    number = F.col("prob").try_cast("double")
    vector = F.from_json("prob", "array<double>")
    return rows.withColumn("probs", F.when(number.isNotNull(), F.array(1 - number, number)).otherwise(vector))


def parse_request_records(df: DataFrame, body: str, content_type: str, key: str, schema: str) -> DataFrame:
    """Request bodies to ``(key, pos, record, error)`` rows.

    A CSV body has no header; a JSON body is an object, an array, or one object per
    line. A line that does not parse, an empty body, or an unknown type is an error row.
    """
    text = F.trim(F.coalesce(F.col(body), F.lit("")))
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: F.trim(s) != "")
    kind = F.col(content_type)
    one_line = ~F.contains(text, F.lit("\n"))
    listed = F.from_json(text, "array<string>")
    is_array = (kind == "application/json") & one_line & text.startswith("[")
    supported = kind.isin("text/csv", "application/json")
    # nothing is split that has one line
    records = (
        F.when(~supported | kind.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(is_array, F.coalesce(listed, F.array(text)))
        .when(one_line, F.array(text))
        .otherwise(lines)
    )
    found = df.select(key, kind.alias("_k"), records.alias("_rs"))
    items = F.when(F.size("_rs") > 0, F.col("_rs")).otherwise(F.array(F.lit(None).cast("string")))
    rows = found.select(key, "_k", F.posexplode(items).alias("pos", "_r"))
    struct = T._parse_datatype_string(schema)
    checked = T.StructType([*struct.fields, T.StructField("_bad", T.StringType())])
    opts = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    as_csv = F.from_csv("_r", checked.simpleString()[len("struct<"):-1].replace(":", " "), opts)
    as_json = F.from_json("_r", checked, opts)
    parsed = rows.withColumn("_p", F.when(F.col("_k") == "text/csv", as_csv).otherwise(as_json))
    error = (
        F.when(~F.col("_k").isin("text/csv", "application/json") | F.col("_k").isNull(), "unsupported content type")
        .when(F.col("_r").isNull(), "empty input")
        .when(F.col("_p._bad").isNotNull() | F.col("_p").isNull(), "invalid record")
    )
    fields = [F.when(error.isNull(), F.col(f"_p.`{f.name}`")).alias(f.name) for f in struct.fields]
    return parsed.select(key, "pos", *fields, error.alias("error"))
