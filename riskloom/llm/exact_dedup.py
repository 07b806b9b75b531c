"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each level reads more of a text, and only for texts whose group of the level before holds
more than one row:

1. octet lengths of all rows are counted; lengths met once are settled;
2. rows of the other lengths are counted by (length, hash of the first ``prefix_chars``);
3. only rows whose (length, prefix) group has company get a SHA-256 of the whole text.

Between levels the surviving groups travel as a bitmap of fixed size, so texts are never
shuffled to learn whether they survive, and no table grows on the driver. Groups are
aggregated before the shuffle, so a group of any size costs one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.common import DEFAULT_LOG2_BITS, KeyFilter, stage, unwrap, whole_row


def _refined(rows: DataFrame, prefix_chars: int, log2_bits: int) -> DataFrame:
    """Add ``_full``: SHA-256 of ``_t`` where the row may have an equal, else null."""
    rows = rows.withColumn("_len", F.octet_length("_t"))
    by_length = rows.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    length_key = F.xxhash64("_len")
    rows = KeyFilter(by_length, length_key, log2_bits).mark(rows, length_key, "_same_len")

    prefix = F.xxhash64(F.substring("_t", 1, prefix_chars))
    by_prefix = (
        rows.filter("_same_len").groupBy("_len", prefix.alias("_pre")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    )
    alive = KeyFilter(by_prefix, F.xxhash64("_len", "_pre"), log2_bits)
    rows = rows.withColumn("_pre", F.when(F.col("_same_len"), prefix))
    rows = alive.mark(rows, F.coalesce(F.xxhash64("_len", "_pre"), F.lit(0)), "_same_pre")
    full = F.when(F.col("_same_len") & F.col("_same_pre"), F.sha2("_t", 256))
    return rows.withColumn("_full", full).drop("_len", "_pre", "_same_len", "_same_pre")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Mapping[str, Column] | None = None,
    prefix_chars: int = 256,
    log2_bits: int = DEFAULT_LOG2_BITS,
) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and the carried expressions.

    Of equal texts the row with the largest id stays (a null id is the smallest); of rows equal
    in text and id, one stays. A null text counts as empty. An empty table gives no rows. Other
    columns of the input, whatever their names, are neither read nor returned unless carried.
    """
    carry = dict(carry or {})
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_t"),
        *[c.alias(f"_c_{name}") for name, c in carry.items()],
    )
    refined = _refined(rows, prefix_chars, log2_bits).drop("_t")
    # written once, so that the row number stays the same for all readers
    tagged = stage(refined.withColumn("_r", F.monotonically_increasing_id()), "exact")
    settled, hashed = tagged.filter(F.col("_full").isNull()), tagged.filter(F.col("_full").isNotNull())
    groups = hashed.groupBy("_full").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_r")).alias("_keep"))
    # written first: a join of two plain scans can be split where one text has very many copies
    groups = stage(groups.filter("_n > 1"), "groups")
    carried = [F.col(f"_c_{name}").alias(name) for name in carry]
    alone = settled.select(
        F.col("_id").alias(id_col),
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        *carried,
    )
    lone = F.col("_n").isNull()
    met = hashed.join(groups, "_full", "left").select(
        F.col("_id").alias(id_col),
        F.when(lone, F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("_keep._r") == F.col("_r"))).alias("kept"),
        *carried,
    )
    return alone.unionAll(met)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    log2_bits: int = DEFAULT_LOG2_BITS,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in ``exact_groups``.

    Rows settled before the full hash pass through without a shuffle. The others are
    aggregated by full hash, each task sending one row per hash.
    """
    rows = docs.select(
        whole_row(docs), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")
    )
    refined = _refined(rows, prefix_chars, log2_bits).drop("_t")
    settled = refined.filter(F.col("_full").isNull()).select("_row")
    grouped = refined.filter(F.col("_full").isNotNull()).groupBy("_full")
    stays = grouped.agg(F.max_by("_row", F.struct("_id")).alias("_row")).select("_row")
    return unwrap(settled.unionAll(stays))
