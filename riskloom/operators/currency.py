"""Amounts in a common currency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.plans.lookup import lookup_with_default


def currency_convert(
    df: DataFrame,
    marketplace: str,
    amounts: Sequence[str],
    marketplaces: DataFrame,
    rates: DataFrame,
    currency: str | None = None,
    default_currency: str = "USD",
    skip_invalid: bool = False,
    out: str = "currency_code",
) -> DataFrame:
    """Divide each existing amount by the rate of the row's currency (unknown rate = 1).

    ``marketplaces(key long, currency_code)``, ``rates(key string, rate)``.
    """
    rows = df.filter(F.col(marketplace).isNotNull())
    # the id may be text or a fraction; its whole part is looked up
    number = F.col(marketplace).try_cast("double")
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    rows = lookup_with_default(rows, marketplaces, whole, "currency_code", F.lit(default_currency), "_derived")
    final = F.col("_derived")
    if currency and currency in df.columns:
        final, out = F.coalesce(F.col(currency), F.col("_derived")), currency
    rows = rows.withColumn(out, final).drop("_derived")
    if skip_invalid:
        rows = rows.withColumn(out, F.coalesce(F.col(out), F.lit(default_currency)))
    else:
        rows = rows.filter(F.col(out).isNotNull())
    present = [a for a in amounts if a in df.columns]
    if not present:
        return rows
    rows = lookup_with_default(rows, rates, F.col(out), "rate", F.lit(1.0), "_rate")
    return rows.withColumns({a: F.col(a) / F.col("_rate") for a in present}).drop("_rate")
