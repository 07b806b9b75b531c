"""Token counts by a separator scan over flat token files without an index.

``write_tokens`` writes token ids of texts as unsigned 16-bit numbers, a separator after each
document, and a side table of which document stands where. ``scan`` reads such files knowing
nothing but the separator: every block of ``block_bytes`` is searched on its own for the
separator in one vector comparison, and gives the lengths of the documents that lie inside,
the tokens before its first separator and those after its last. A prefix scan over the block
summaries then adds up, per file, how many separators came before a block and where the last
one was, which joins the document that crosses into a block with its beginning, through as many
blocks without separator as it takes.

The scan has two levels (runs of blocks, then blocks), so a file of any size needs no window
over all its blocks. Documents without tokens have length 0. Tokens after a file's last
separator are a document that is not ended (``ended`` false). Null texts count as empty; ids
may be null or repeated; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskloom.llm.common import new_stage_path, stage
from riskloom.llm.tokens import encode

DTYPE = np.dtype("<u2")
END_OF_TEXT = 50256
RUN = 1024  # blocks summed in one window


def _writer(root: str, end_id: int, file_bytes: int, vocabulary: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(root)
        files.create_dir(folder, recursive=True)
        task = TaskContext.get()
        prefix = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        out, name, number, written, ordinal = None, "", 0, 0, 0
        for batch in batches:
            paths, places = [], []
            for text in batch.column("_t").to_pylist():
                if out is None:
                    name, number, written, ordinal = f"{prefix}-{number:04d}.bin", number + 1, 0, 0
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                ids = encode(text, special=False, **vocabulary)
                data = np.array([*ids, end_id], dtype=DTYPE).tobytes()
                out.write(data)
                written += len(data)
                paths.append(f"{root}/{name}")
                places.append(ordinal)
                ordinal += 1
                if written >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(places, pa.int64()), batch.column("_id")], names=["path", "ordinal", "_id"]
            )
        if out is not None:
            out.close()

    return run


def write_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_OF_TEXT, file_bytes: int = 256 << 20, **vocabulary: str
) -> DataFrame:
    """Write token files into the shared folder; returns ``path, ordinal, _id`` per document."""
    root = new_stage_path(docs.sparkSession, "tokens")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    kind = texts.schema["_id"].dataType.simpleString()
    return stage(texts.mapInArrow(_writer(root, end_id, file_bytes, vocabulary), f"path string, ordinal long, _id {kind}"), "documents")


def summarise(tokens: np.ndarray, end_id: int) -> dict:
    """What a block tells: tokens, separators, tokens before the first and after the last, lengths between."""
    at = np.flatnonzero(tokens == end_id)
    if not len(at):
        return {"n": len(tokens), "ends": 0, "head": len(tokens), "tail": len(tokens), "inner": []}
    return {
        "n": len(tokens),
        "ends": len(at),
        "head": int(at[0]),
        "tail": len(tokens) - int(at[-1]) - 1,
        "inner": (np.diff(at) - 1).tolist(),
    }


SUMMARY = "path string, block long, n long, ends long, head long, tail long, inner array<long>"


def _scanner(end_id: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                files, inner = fs.FileSystem.from_uri(path)
                with files.open_input_file(inner) as file:
                    data = file.read_at(min(block_bytes, file.size() - block * block_bytes), block * block_bytes)
                row = {"path": path, "block": block} | summarise(np.frombuffer(data, dtype=DTYPE), end_id)
                arrays = [pa.array([row[k]], pa.string() if k == "path" else pa.list_(pa.int64()) if k == "inner" else pa.int64()) for k in row]
                yield pa.RecordBatch.from_arrays(arrays, names=list(row))

    return run


def _file_blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, inner = fs.FileSystem.from_uri(path)
                count = -(-files.get_file_info(inner).size // block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([path] * count), pa.array(range(count), pa.int64())], names=["path", "block"])

    return run


def scan(spark: SparkSession, paths: DataFrame, end_id: int = END_OF_TEXT, block_bytes: int = 1 << 20) -> DataFrame:
    """``path, ordinal, n_tokens, ended`` per document of the token files named in ``paths(path)``."""
    if block_bytes % DTYPE.itemsize:
        raise ValueError("a block must hold whole tokens")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = stage(paths.repartition(tasks, "path").mapInArrow(_file_blocks(block_bytes), "path string, block long"), "blocks")
    found = blocks.repartition(tasks, "path", "block").mapInArrow(_scanner(end_id, block_bytes), SUMMARY)
    found = stage(found.withColumn("run", F.floor(F.col("block") / RUN)), "summaries")

    # inside a run of blocks: tokens and ends before the block, and where the last end before it was
    own = Window.partitionBy("path", "run").orderBy("block")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    local = local.withColumn("seen", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    last_end = F.when(F.col("ends") > 0, F.col("at") + F.col("n") - F.col("tail"))
    local = local.withColumn("end", last_end).withColumn("end_before", F.max("end").over(before))

    # over the runs of a file
    runs = local.groupBy("path", "run").agg(F.sum("n").alias("run_n"), F.sum("ends").alias("run_ends"), F.max("end").alias("run_end"))
    order = Window.partitionBy("path").orderBy("run")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_at", F.coalesce(F.sum("run_n").over(earlier), F.lit(0)))
    runs = runs.withColumn("run_seen", F.coalesce(F.sum("run_ends").over(earlier), F.lit(0)))
    runs = runs.withColumn("run_last", F.coalesce(F.max(F.col("run_at") + F.col("run_end")).over(earlier), F.lit(0)))
    runs = runs.withColumn("last_run", F.lead("run").over(order).isNull())

    joined = local.join(runs.drop("run_n", "run_ends", "run_end"), ["path", "run"])
    begin = F.greatest("run_last", F.col("run_at") + F.coalesce("end_before", F.lit(0)))
    begin = F.when(F.col("end_before").isNull(), F.col("run_last")).otherwise(begin)
    position = F.col("run_at") + F.col("at")
    carry = position - begin
    joined = joined.withColumn("first", F.col("seen") + F.col("run_seen")).withColumn("carry", carry)
    inside = joined.filter("ends > 0").select(
        "path", "first", F.posexplode(F.concat(F.array(F.col("head") + F.col("carry")), F.col("inner"))).alias("k", "n_tokens")
    )
    ended = inside.select("path", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    final = Window.partitionBy("path", "run").orderBy("block").rowsBetween(1, 1)
    last = joined.withColumn("after", F.max("block").over(final)).filter("last_run and after is null")
    left_over = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("n"))
    open_end = last.select("path", (F.col("first") + F.col("ends")).alias("ordinal"), left_over.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionAll(open_end.filter("n_tokens > 0"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 20, **vocabulary: str) -> DataFrame:
    """Tokens per row, counted by scanning the token files that are written from the texts."""
    places = write_tokens(docs, id_col, text_col, **vocabulary)
    counts = scan(docs.sparkSession, places.select("path").distinct(), block_bytes=block_bytes)
    return places.join(counts, ["path", "ordinal"]).select(F.col("_id").alias(id_col), "n_tokens", "ended")
