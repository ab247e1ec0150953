"""Numbers as charts show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _units(x: Column, places: int) -> Column:
    """``x`` times 10**places, rounded by its exact binary value, halves up.

    The product with the power of ten is taken together with its rounding error (Dekker's
    splitting, exact up to 10**11), so that values next to a half fall on the right side.
    """
    scale = float(10**places)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product)
    return (below + F.when((product - below - 0.5) + error >= 0, 1).otherwise(0)).cast("long")


def fixed(x: Column, places: int) -> Column:
    """``x`` (not negative, below 2**52 / 10**places) with ``places`` decimals."""
    units, scale = _units(x, places), 10**places
    return F.format_string(f"%d.%0{places}d", F.floor(units / scale).cast("long"), units % scale)


def _exponential(x: Column, exponent: int) -> Column:
    """``x`` from 10**exponent on, below the next power, as 1.23e-5."""
    units = _units(x, 2 - exponent)
    over = units >= 1000  # rounded up to the next power
    digits = F.when(over, 100).otherwise(units)
    return F.format_string("%d.%02de%d", F.floor(digits / 100).cast("long"), (digits % 100).cast("long"), F.when(over, exponent + 1).otherwise(exponent))


def format_count(n: Column) -> Column:
    """1.2M from a million on, 1.2K from a thousand on, else the number."""
    return F.when(n >= 1_000_000, F.concat(fixed(n / 1e6, 1), F.lit("M"))).when(n >= 1_000, F.concat(fixed(n / 1e3, 1), F.lit("K"))).otherwise(n.cast("long").cast("string"))


def format_frequency(v: Column) -> Column:
    """Null as a dash, 0, small numbers with an exponent (never padded), else 5 or 4 places."""
    v = v.cast("double")
    exponent = F.regexp_replace(F.format_string("%.2e", v), r"e-0+(\d)", "e-$1")  # below 1e-9 by the decimal digits
    for power in range(-9, -4):
        exponent = F.when(v >= float(f"1e{power}"), _exponential(v, power)).otherwise(exponent)
    return F.when(v.isNull(), F.lit("—")).when(v == 0, F.lit("0")).when(v < 0.0001, exponent).when(v < 0.01, fixed(v, 5)).otherwise(fixed(v, 4))


def log_scale(v: Column) -> Column:
    """Null where a logarithmic axis has no place for the value."""
    return F.when(v > 0, v)


def phrase_set_key(phrases: Column) -> Column:
    """An identity for a set of phrases: trimmed, lower-cased, sorted, joined by a pipe."""
    return F.array_join(F.array_sort(F.transform(phrases, lambda p: F.lower(F.trim(p)))), "|")
