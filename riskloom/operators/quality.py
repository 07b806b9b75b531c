"""Typing columns by role, cleaning labels, and quality predicates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom.functions.numbers import exact_round
from riskloom.plans.lookup import local_table, lookup_with_default
from riskloom.plans.prefix import ordered_index
from riskloom.plans.staging import stage


@dataclass(frozen=True)
class RoleSpec:
    """Which columns are the id, the label, categorical text and numbers."""

    label: str
    id: str | None = None
    categorical: Sequence[str] = field(default_factory=tuple)
    numeric: Sequence[str] = field(default_factory=tuple)

    def struct_type(self, columns: Sequence[str]) -> T.StructType:
        def kind(c: str) -> T.DataType:
            return T.DoubleType() if c in self.numeric else T.StringType()

        return T.StructType([T.StructField(c, kind(c)) for c in columns])


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def to_number(c: Column) -> Column:
    """Number or NULL; NaN counts as missing."""
    number = c.try_cast("double")
    return F.when(F.isnan(number), F.lit(None).cast("double")).otherwise(number)


def label_clean(df: DataFrame, label: str) -> DataFrame:
    """Integer label: numbers are kept, a text label becomes its index in sorted order; NULLs drop."""
    require_columns(df, [label])
    if isinstance(df.schema[label].dataType, T.StringType):
        values = df.select(F.col(label).alias("key")).filter("key is not null").distinct()
        codes = stage(ordered_index(values, ["key"], name="code"), "labels")
        # an unmatched label can only be NULL, and NULL labels are dropped
        coded = lookup_with_default(df, codes, F.col(label), "code", F.lit(None).cast("long"), "_code")
        out = coded.withColumn(label, F.col("_code")).drop("_code")
    else:
        out = df.withColumn(label, to_number(F.col(label)).cast("long"))
    return out.filter(F.col(label).isNotNull())


def role_typed_coerce(df: DataFrame, roles: RoleSpec) -> DataFrame:
    """Categorical columns as text (missing becomes ``None``), every other column a number or -1.0."""
    if not roles.categorical:
        return df
    return df.select(
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c)
            if c in roles.categorical
            else F.coalesce(to_number(F.col(c)), F.lit(-1.0)).alias(c)
            for c in df.columns
        ]
    )


def fill_missing_by_role(df: DataFrame, roles: RoleSpec) -> DataFrame:
    def expr(c: str) -> Column:
        if c == roles.label:
            return F.coalesce(to_number(F.col(c)), F.lit(0.0)).cast("int")
        if c in roles.categorical:
            return F.coalesce(F.col(c).cast("string"), F.lit("None"))
        return F.coalesce(to_number(F.col(c)), F.lit(-1.0))

    return df.select(*[expr(c).alias(c) for c in df.columns])


def safe_numeric(df: DataFrame, columns: Sequence[str], default: float = 0.0) -> DataFrame:
    """Text that does not parse, the word ``Default`` and missing values become the default."""
    present = [c for c in columns if c in df.columns]
    kinds = dict(df.dtypes)  # a number of double precision is the number its text says

    def number(c: str) -> Column:
        return to_number(F.col(c) if kinds[c] == "double" else F.col(c).cast("string"))

    return df.withColumns({c: F.coalesce(number(c), F.lit(default)) for c in present})


def feature_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, nulls, nans, infs, ok)`` for numeric features, from one scan."""
    inf = float("inf")

    def counts(c: str) -> Column:
        v = F.col(f"`{c}`").cast("double")
        return F.struct(
            F.lit(c).alias("feature"),
            F.count_if(v.isNull()).alias("nulls"),
            F.count_if(F.isnan(v)).alias("nans"),
            F.count_if((v == inf) | (v == -inf)).alias("infs"),
        )

    rows = df.agg(F.array(*[counts(c) for c in columns]).alias("r")).select(F.inline("r"))
    return rows.withColumn("ok", (F.col("nulls") + F.col("nans") + F.col("infs") == 0).cast("int"))


def reject_bad_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = feature_quality(df, columns).filter("ok = 0").limit(1).collect()
    if bad:
        raise ValueError(f"feature {bad[0].feature} has missing or infinite values")
    return df


def validate_cases(df: DataFrame, date: str = "max_estimated_arrival_date") -> DataFrame:
    require_columns(df, ["dialogue", "shiptrack"])
    out = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("dialogue", "shiptrack")})
    if date in df.columns:
        out = out.withColumn(date, F.nullif(F.col(date).cast("string"), F.lit("")))
    return out


def enum_and_range_check(df: DataFrame, category: str, confidence: str, codes: Sequence[str]) -> DataFrame:
    """``valid`` flag, ``reject_reason`` and the confidence rounded to two places."""
    score = F.col(confidence)
    reason = (
        F.when(F.col(category).isNull() | ~F.col(category).isin(*codes), "category")
        .when(score.isNull() | (score < 0) | (score > 1), "confidence_score")
        .otherwise(F.lit(None).cast("string"))
    )
    return df.withColumns(
        {"reject_reason": reason, "valid": reason.isNull().cast("int"), confidence: exact_round(score, 2)}
    )


def unexpected_fields(allowed: Sequence[str], keys: Column) -> Column:
    """Field names that a record must not carry."""
    return F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))


def column_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, n_values, is_constant)`` from min, max and count only, so one cheap pass."""

    def facts(c: str) -> Column:
        v = F.col(f"`{c}`")
        return F.struct(
            F.lit(c).alias("column_name"),
            F.count(v).alias("n_values"),
            F.coalesce((F.min(v) == F.max(v)).cast("int"), F.lit(0)).alias("is_constant"),
        )

    return df.agg(F.array(*[facts(c) for c in columns]).alias("r")).select(F.inline("r"))


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Drop columns with exactly one distinct value; all-missing columns stay."""
    constant = [r.column_name for r in column_facts(df, df.columns).filter("is_constant = 1").collect()]
    return df.drop(*constant)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    empty = [r.column_name for r in column_facts(df, df.columns).filter("n_values = 0").collect()]
    return df.drop(*empty)


def dedup_keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key. An aggregate, not a window: a task sends on one row per key, and sorts by the key alone."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def oot_split(df: DataFrame, ts: str, label: str, cutoff: str) -> DataFrame:
    """``part``: oot from the cut-off date on, else good (label 0) or bad (label 1)."""
    when = F.to_timestamp(F.col(ts))
    part = (
        F.when(when >= F.lit(cutoff).cast("timestamp"), "oot")
        .when(F.col(label) == 1, "bad")
        .when(F.col(label) == 0, "good")
    )
    return df.withColumn("part", part).filter(F.col("part").isNotNull())


def date_range(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(F.to_timestamp(ts)).alias("first_ts"), F.max(F.to_timestamp(ts)).alias("last_ts"))


def distinct_per_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, n_distinct)``, 0 for a column without values: de-duplicated in a shuffle, then counted."""
    text = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    pairs = df.select(*text).unpivot([], list(columns), "column_name", "v").filter("v is not null")
    counts = pairs.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    names = local_table(df.sparkSession, [(c,) for c in columns], "column_name string")
    return names.join(counts, "column_name", "left").select("column_name", F.coalesce("n", F.lit(0)).alias("n_distinct"))


def _few_distinct(limit: int):
    """Per task and column at most ``limit`` distinct values; a column stops being looked at when it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, set] = {}
        for batch in batches:
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                known = found.setdefault(name, set())
                if len(known) < limit:
                    known.update(column.unique().drop_null().to_pylist())
        rows = [(name, v) for name, known in found.items() for v in sorted(known)[:limit]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["column_name", "v"])

    return run


def capped_distinct(df: DataFrame, columns: Sequence[str], limit: int = 100) -> DataFrame:
    """``(column_name, n_distinct)``, counted up to the limit: a task shuffles at most that many values of a column."""
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    pairs = text.mapInArrow(_few_distinct(limit), "column_name string, v string").distinct()
    counts = pairs.groupBy("column_name").agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("n"))
    names = local_table(df.sparkSession, [(c,) for c in columns], "column_name string")
    return names.join(counts, "column_name", "left").select("column_name", F.coalesce("n", F.lit(0)).alias("n_distinct"))


def capped_eligibility(df: DataFrame, columns: Sequence[str], limit: int = 100) -> DataFrame:
    """As ``categorical_eligibility``, without counting beyond the limit; text columns are not counted at all."""
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    other = [c for c in columns if c not in text]
    named = local_table(df.sparkSession, [(c, 1) for c in text], "column_name string, eligible int")
    if not other:
        return named
    counted = capped_distinct(df, other, limit).select("column_name", (F.col("n_distinct") < limit).cast("int").alias("eligible"))
    return named.unionByName(counted)


def categorical_eligibility(df: DataFrame, columns: Sequence[str], limit: int = 100) -> DataFrame:
    """Text columns are eligible; others when they have fewer distinct values than the limit."""
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    return distinct_per_column(df, columns).withColumn(
        "eligible", (F.col("column_name").isin(*text) | (F.col("n_distinct") < limit)).cast("int")
    )
