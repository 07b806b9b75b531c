"""Helpers shared by the operators: row structs, fixed-size key filters and bounded Arrow chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.plans.staging import new_stage_path, stage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BITS = 32768  # a row of bitmap_construct_agg
DEFAULT_LOG2_BITS = 24


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole_row(df: DataFrame, name: str = "_row") -> Column:
    """All columns as one struct, so that helper columns cannot clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unwrap(df: DataFrame, name: str = "_row") -> DataFrame:
    return df.select(f"{name}.*")


class KeyFilter:
    """A bitmap over hashed keys, of fixed size whatever the number of keys.

    ``2 ** log2_bits`` bits, kept as a table of at most ``2 ** log2_bits / 32768`` rows of
    4 KiB (2 MiB at the default), so it may be broadcast. A set bit means that the key may be
    among the keys, an unset bit that it is not. With more keys than bits it lets all rows
    through: results stay the same and only the saving is lost.
    """

    def __init__(self, keys: DataFrame, key: Column, log2_bits: int = DEFAULT_LOG2_BITS):
        self.bits = 1 << log2_bits
        at = keys.select(F.pmod(key, F.lit(self.bits)).alias("_p"))
        blocks = at.groupBy((F.col("_p") / BLOCK_BITS).cast("int").alias("_kf_block")).agg(
            F.bitmap_construct_agg(F.col("_p") % BLOCK_BITS).alias("_kf_bits")
        )
        self.blocks = stage(blocks, "filter")

    def mark(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """Add the boolean column ``name``: the row's key may be among the keys."""
        keyed = df.withColumn("_kf_pos", F.pmod(key, F.lit(self.bits)))
        keyed = keyed.withColumn("_kf_block", (F.col("_kf_pos") / BLOCK_BITS).cast("int"))
        byte = "cast(conv(hex(substring(_kf_bits, cast((_kf_pos % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
        bit = F.expr(f"getbit({byte}, cast(_kf_pos % 8 as int)) = 1")
        joined = keyed.join(F.broadcast(self.blocks), "_kf_block", "left")
        return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_kf_pos", "_kf_block", "_kf_bits")


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows that come first in the order of a hash of their keys; all rows of a smaller table.

    Rows are counted first, and only about 2 n of them, those with the smallest hashes, are
    sorted, so what tasks send on does not grow with the table.
    """
    share = min(1.0, 2.0 * n / max(1, df.count()))
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 32))
    near = df.withColumn("_hs", place).filter(F.col("_hs") <= int(share * (1 << 32)))
    return near.orderBy("_hs", *keys).limit(n).drop("_hs")


def text_bytes(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in array.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


__all__ = ["WORD", "KeyFilter", "chunks", "hash_sample", "new_stage_path", "stage", "table", "text_bytes", "unwrap", "whole_row"]
