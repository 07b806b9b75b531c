"""Category codes, one-hot vectors, class weights and feature vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.plans.lookup import lookup_with_default
from riskloom.plans.prefix import ordered_index
from riskloom.plans.staging import stage


def vocabulary(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """``(key, code)``: sorted distinct values over all frames, numbered from 0."""
    every = reduce(DataFrame.unionByName, [f.select(F.col(column).alias("key")) for f in frames])
    return ordered_index(every.filter("key is not null").distinct(), ["key"], name="code")


def label_encode_sorted(df: DataFrame, column: str, out: str) -> DataFrame:
    vocab = stage(vocabulary([df], column), "vocabulary")
    return lookup_with_default(df, vocab, F.col(column), "code", F.lit(None).cast("long"), out)


def first_seen_codes(df: DataFrame, column: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """``(key, code)``: known values keep their code, new ones follow in order of first appearance.

    ``order`` must be unique per row.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.min(order).alias("_o"))
    if known is None:
        return ordered_index(values, ["_o"], name="code").select("key", "code")
    start = F.coalesce(known.agg(F.max("code") + 1).scalar(), F.lit(0))
    fresh = ordered_index(values.join(known, "key", "left_anti"), ["_o"], name="code")
    return known.select("key", "code").unionByName(fresh.select("key", (F.col("code") + start).alias("code")))


def label_encode_first_seen(df: DataFrame, column: str, order: str, out: str) -> DataFrame:
    codes = stage(first_seen_codes(df, column, order), "codes")
    return lookup_with_default(df, codes, F.col(column), "code", F.lit(None).cast("long"), out)


def fixed_code(value: Column, codes: Mapping[str, int], unknown: int = -1) -> Column:
    """Code from a short fixed list, ``unknown`` for anything else."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value.cast("string")), F.lit(unknown))


def multiclass_encode(df: DataFrame, column: str, codes: DataFrame, out: str, strict: bool = True) -> DataFrame:
    """Code of the value's text. Strict mode fails on an unknown value; else it is left NULL
    (extend the codes with ``first_seen_codes`` first)."""
    text = F.col(column).cast("string")
    default: Column = F.lit(None).cast("long")
    if strict:
        default = F.when(
            text.isNotNull(), F.raise_error(F.concat(F.lit("unknown label: "), text)).cast("long")
        )
    return lookup_with_default(df, codes, text, "code", default, out)


def one_hot(code: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == code).cast("float"))


def class_weight_column(label: Column, weights: Sequence[float], n_classes: int) -> Column:
    """Binary: positives weigh w1/w0 against 1. More classes: one weight each."""
    if len(weights) != n_classes:
        raise ValueError("one weight per class is needed")
    if n_classes == 2:
        return F.when(label == 1, weights[1] / weights[0]).otherwise(1.0)
    # element_at takes a NULL index into an array without NULLs for the last place
    return F.when(label.isNotNull(), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), label.cast("int") + 1))


def assemble_features(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], out: str = "features"
) -> DataFrame:
    """Numeric columns, then mapped categorical ones, in the listed order."""
    columns = [*numeric, *categorical]
    floats = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(floats)
