"""What a folder of mixed shards holds: the dialect of each text file, and gzip-wrapped Parquet.

Files are reached through Spark's readers only, so any store that Spark reads will do.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# separators a text shard may use; of equally consistent ones the earlier is taken
SEPARATORS = (",", "\t", ";", "|", ":")
HEAD_LINES = 2
BATCH_ROWS = 65_536


def fields_of(line: str, sep: str, quote: str = '"') -> int:
    """Number of fields; separators inside quotes do not count."""
    outside = line.split(quote)[::2]
    return 1 + sum(part.count(sep) for part in outside)


def detect_separator(lines: Sequence[str]) -> str:
    """The separator by which all lines have the same number of fields, the more fields the better.

    Without one that splits all lines alike, the one that splits the header most; comma if none does.
    """
    counts = {s: [fields_of(line, s) for line in lines] for s in SEPARATORS}
    alike = [s for s in SEPARATORS if counts[s] and min(counts[s]) == max(counts[s]) > 1]
    split = alike or [s for s in SEPARATORS if counts[s] and counts[s][0] > 1]
    return max(split, key=lambda s: counts[s][0], default=",")


def detect_json(lines: Sequence[str]) -> str:
    """``lines`` if the first line is a whole JSON object, else ``whole``: one array or object per file."""
    import json

    first = next((x.strip() for x in lines if x.strip()), "")
    try:
        return "lines" if first.startswith("{") and isinstance(json.loads(first), dict) else "whole"
    except ValueError:
        return "whole"


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first lines of the task's only file; the rest of the file is not read."""
    lines: list[str] = []
    path = None
    for batch in batches:
        path = path or (batch.column(0)[0].as_py() if batch.num_rows else None)
        lines += batch.column(1).to_pylist()
        if len(lines) >= HEAD_LINES:
            break
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([lines[:HEAD_LINES]], pa.list_(pa.string()))], names=["path", "lines"])


def heads(spark: SparkSession, folder: str, pattern: str) -> dict[str, list[str]]:
    """The first lines of every file that matches, by path; one task per file, which stops after them.

    An empty file has no entry. A session of its own holds the settings that put one whole file
    in each task, so those of the caller stay as they are.
    """
    peek = spark.newSession()
    whole = str(1 << 61)
    for name, value in {
        "spark.sql.files.maxPartitionBytes": whole,
        "spark.sql.files.openCostInBytes": whole,
        "spark.sql.files.minPartitionNum": "1",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(HEAD_LINES),
    }.items():
        peek.conf.set(name, value)
    lines = peek.read.option("pathGlobFilter", pattern).text(folder).select("_metadata.file_path", "value")
    found = lines.mapInArrow(_first_rows, "path string, lines array<string>").collect()  # one row per file
    return {unquote(r["path"]): r["lines"] for r in found}


# gzip-wrapped Parquet


def _plain(kind: pa.DataType) -> pa.DataType:
    """The type that Spark can take for an Arrow type."""
    if pa.types.is_dictionary(kind):
        return _plain(kind.value_type)
    if pa.types.is_null(kind) or pa.types.is_large_string(kind):
        return pa.string()
    if pa.types.is_large_binary(kind):
        return pa.binary()
    if pa.types.is_unsigned_integer(kind):
        return {8: pa.int16(), 16: pa.int32(), 32: pa.int64()}.get(kind.bit_width, pa.decimal128(20, 0))
    if pa.types.is_float16(kind):
        return pa.float32()
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return pa.list_(_plain(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _plain(f.type)) for f in kind])
    return kind


def plain_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, _plain(f.type)) for f in schema])


def _unwrapped(content: bytes) -> pq.ParquetFile:
    return pq.ParquetFile(io.BytesIO(gzip.decompress(content)))


def _schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [plain_schema(_unwrapped(c.as_py()).schema_arrow).serialize().to_pybytes() for c in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["schema"])


def _rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for rows in _unwrapped(content.as_py()).iter_batches(BATCH_ROWS):
                    own = {f.name: i for i, f in enumerate(rows.schema)}
                    columns = [
                        rows.column(own[f.name]).cast(_plain(rows.schema.field(f.name).type)).cast(f.type) if f.name in own else pa.nulls(rows.num_rows, f.type)
                        for f in schema
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def read_wrapped(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of Parquet files that were compressed as a whole.

    Files cannot be split: a task unpacks its files one after the other, each in memory (Spark
    reads files of up to 2 GB this way), and sends rows on in batches. Without a schema the files'
    own are gathered first, which unpacks them once more, and united: a column that some files lack is
    NULL there, and numbers get the widest type.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("content")
    if schema is None:
        found = files.mapInArrow(_schemas, "schema binary").distinct().collect()  # the distinct schemas
        own = sorted((bytes(r[0]) for r in found))
        united = pa.unify_schemas([pa.ipc.read_schema(pa.py_buffer(s)) for s in own], promote_options="permissive")
    else:
        given = spark.createDataFrame([], schema)
        united = plain_schema(given.toArrow().schema)
    kind = spark.createDataFrame(united.empty_table()).schema if schema is None else given.schema
    return files.mapInArrow(_rows(united), kind)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames on the union of their columns; where types differ, numbers widen and all else becomes text."""
    kinds: dict[str, list[T.DataType]] = {}
    for f in frames:
        for field in f.schema:
            known = kinds.setdefault(field.name, [])
            if field.dataType not in known:
                known.append(field.dataType)

    def common(found: list[T.DataType]) -> T.DataType | None:
        if len(found) == 1:
            return None
        if all(isinstance(k, T.IntegralType) for k in found):
            return T.LongType()
        return T.DoubleType() if all(isinstance(k, T.NumericType) for k in found) else T.StringType()

    casts = {name: kind for name, found in kinds.items() if (kind := common(found)) is not None}
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    same = [f.withColumns({c: quoted(c).cast(casts[c]) for c in f.columns if c in casts}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)
