"""Decimal rounding of the exact binary value, as C and Python do it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

_SPLIT = 134217729.0  # 2^27 + 1


def exact_units(x: Column, places: int) -> Column:
    """``x`` in units of 10^-places, rounded to the nearest, ties to even; for |x| below 2^40.

    The product with the scale is taken with its rounding error, so that 0.62645,
    which is stored a little lower, does not round up.
    """
    scale = float(10**places)
    a = F.abs(x)
    product = a * scale
    high = a * _SPLIT - (a * _SPLIT - a)
    error = (high * scale - product) + (a - high) * scale
    low = F.floor(product)
    rest = (product - low - 0.5) + error
    up = (rest > 0) | ((rest == 0) & (low % 2 == 1))
    units = low + F.when(up, 1).otherwise(0)
    return F.when(x < 0, -units).otherwise(units)


def exact_round(x: Column, places: int) -> Column:
    return exact_units(x, places) / float(10**places)


def _size_units(a: Column, places: int) -> Column:
    """``exact_units`` of ``a >= 0``, short enough to be compiled.

    The product decides wherever it is not itself half way between two units: rounding it never
    carries it over such a point. Only there, and where it has no places left, the whole
    expression is evaluated, on a bound value.
    """
    product = a * float(10**places)
    near = F.rint(product)
    tie = F.get(F.transform(F.array(a), lambda v: exact_units(v, places)), F.lit(0))
    hard = (F.abs(product - near) == 0.5) | (product >= float(2**52))
    return F.when(hard, tie).otherwise(F.floor(near))


def fixed_text(x: Column, places: int) -> Column:
    """``%.<places>f``; ``nan`` and ``inf`` by name, NULL for NULL. Exact below 2^40, beyond it as Java formats."""
    sign = F.when(x < 0, "-").otherwise("")
    # the units as a decimal number: its text has the point and the leading zeros
    number = _size_units(F.abs(x), places).cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-places))
    return (
        F.when(F.abs(x) < float(2**40), F.concat(sign, number.cast("string")))
        .when(F.isnan(x), "nan")
        .when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf")))
        .when(x.isNotNull(), F.format_string(f"%.{places}f", x))
    )


def number_text(p: Column) -> Column:
    """Shortest decimal text of a number, with exponents only below 1e-4 or from 1e16 (``0.00012``, ``1e-05``)."""
    s = p.cast("string")
    mantissa = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", "")
    exponent = F.substring_index(s, "E", -1).try_cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    sign = F.when(exponent < 0, "-").otherwise("+")
    short = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = F.call_function("format_number", p, F.lit("0.0###############"))
    return (
        F.when(~F.contains(s, F.lit("E")), s)
        .when((exponent == -4) & ~s.startswith("-"), F.concat(F.lit("0.000"), digits))
        .when((exponent >= 7) & (exponent < 16), plain)
        .otherwise(short)
    )
