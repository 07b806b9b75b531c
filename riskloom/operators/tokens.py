"""Token ids, masks and vectors of text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.text import squeeze, text_normalize, tokens
from riskloom.plans.prefix import ordered_index
from riskloom.plans.staging import stage

UNKNOWN, PAD = 1, 0


def token_rows(df: DataFrame, key: str, text: str, max_length: int | None = None, lower: bool = True) -> DataFrame:
    """``(key, pos, token)`` in order, in lower case or as written; texts without a token give no row."""
    words = tokens((text_normalize if lower else squeeze)(F.col(text)))
    if max_length:
        words = F.slice(words, 1, max_length)
    return df.select(key, F.posexplode(words).alias("pos", "token"))


def token_vocabulary(df: DataFrame, key: str, text: str, lower: bool = True) -> DataFrame:
    """``(token, token_id, n)``: ids follow the sorted tokens, after pad 0 and unknown 1."""
    counts = token_rows(df, key, text, lower=lower).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return ordered_index(counts, ["token"], name="token_id").withColumn("token_id", F.col("token_id") + 2)


def tokenize_chunks(df: DataFrame, key: str, text: str, vocabulary: DataFrame, max_length: int = 512) -> DataFrame:
    """``(key, input_ids, attention_mask)`` for non-blank texts, cut at ``max_length`` tokens.

    ``key`` must be unique, so a group is one text and at most ``max_length`` long.
    """
    rows = token_rows(df, key, text, max_length)
    coded = rows.join(vocabulary.select("token", "token_id"), "token", "left")
    code = F.coalesce(F.col("token_id"), F.lit(UNKNOWN))
    ordered = F.array_sort(F.collect_list(F.struct("pos", code.alias("id"))))
    return (
        coded.groupBy(key)
        .agg(ordered.alias("t"))
        .select(
            key,
            F.transform("t", lambda x: x["id"]).alias("input_ids"),
            F.transform("t", lambda x: F.lit(1)).alias("attention_mask"),
        )
    )


def embed_tokens(
    df: DataFrame,
    key: str,
    text: str,
    vectors: DataFrame,
    dim: int,
    max_length: int = 100,
    pad: bool = True,
    lower: bool = True,
) -> DataFrame:
    """``(key, embeddings, mask)``: a zero vector and mask 0 where unknown, padded to ``max_length`` if asked.

    ``vectors(token, vector)``, with tokens in lower case or, without ``lower``, as written in the
    texts; one group is one text, at most ``max_length`` long.
    """
    rows = token_rows(df, key, text, max_length, lower).join(vectors, "token", "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    item = F.struct("pos", F.coalesce("vector", zero).alias("v"), F.col("vector").isNotNull().cast("int").alias("m"))
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("t"))
    all_rows = df.select(key).join(found, key, "left")
    have = F.coalesce(F.size("t"), F.lit(0))
    have = F.when(have < 0, 0).otherwise(have)
    listed = F.coalesce(F.col("t"), F.array().cast(found.schema["t"].dataType))
    missing = F.lit(max_length) - have if pad else F.lit(0)
    return all_rows.select(
        key,
        F.concat(F.transform(listed, lambda x: x["v"]), F.array_repeat(zero, missing)).alias("embeddings"),
        F.concat(F.transform(listed, lambda x: x["m"]), F.array_repeat(F.lit(0), missing)).alias("mask"),
    )


def token_vectors(embeddings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Give vocabulary entry i the vector of id i; tokens past the last vector stay unknown."""
    return vocabulary.join(embeddings, vocabulary.token_id - 2 == embeddings.vec_id).select(
        "token", F.col("embedding").alias("vector")
    )


def pad_batch(df: DataFrame, column: str, batch: Column, fill: int = PAD) -> DataFrame:
    """Pad an array of integers to the longest of its batch."""
    keyed = df.withColumn("_b", batch)
    longest = stage(keyed.groupBy("_b").agg(F.max(F.size(column)).alias("_n")), "lengths")
    short = F.col("_n") - F.size(column)
    padded = F.concat(F.col(column), F.array_repeat(F.lit(fill), short.cast("int")))
    return keyed.join(longest, "_b").withColumn(column, padded).drop("_b", "_n")


def pad_chunks(df: DataFrame, column: str, batch: Column, fill: int = PAD) -> DataFrame:
    """Pad an array of token lists to the batch's longest list and largest number of lists."""
    keyed = df.withColumn("_b", batch)
    widest = F.max(F.array_max(F.transform(column, lambda x: F.size(x))))
    sizes = stage(keyed.groupBy("_b").agg(F.max(F.size(column)).alias("_n"), widest.alias("_w")), "lengths")
    wide = keyed.join(sizes, "_b")
    rows = F.transform(
        F.col(column), lambda x: F.concat(x, F.array_repeat(F.lit(fill), F.col("_w") - F.size(x)))
    )
    blank = F.array_repeat(F.array_repeat(F.lit(fill), F.col("_w")), F.col("_n") - F.size(column))
    return wide.withColumn(column, F.concat(rows, blank)).drop("_b", "_n", "_w")
