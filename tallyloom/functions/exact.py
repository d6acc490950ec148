"""Exact money, rounding half away from zero, and null-skipping names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def cents(money: Column) -> Column:
    """Money with two decimals as a whole number of cents."""
    return (money * 100).cast(WIDE)


def as_double(money: Column) -> Column:
    """The output form of an exact sum."""
    return money.cast("double")


def exact_ratio(numerator: Column, denominator: Column, digits: int = 2, scale: int = 1) -> Column:
    """``round(scale * numerator / denominator, digits)`` in whole-number arithmetic.

    Both inputs must be whole numbers (counts, cents). Rounds half away from
    zero. NULL when an input is NULL or the denominator is zero.
    """
    n, d = numerator.cast(WIDE), denominator.cast(WIDE)
    doubled = F.nullif(F.abs(d) * 2, F.lit(0).cast(WIDE)).cast(WIDE)
    shifted = (F.abs(n) * (2 * scale * 10**digits)).cast(WIDE) + F.abs(d)
    units = F.call_function("div", shifted.cast(WIDE), doubled)
    return F.signum(n) * F.signum(d) * units.cast("double") / F.lit(float(10**digits))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Exact percentage of two whole numbers."""
    return exact_ratio(part, whole, digits, scale=100)


def full_name(first: str = "first_name", last: str = "last_name") -> Column:
    """``first + ' ' + last``; a missing part counts as empty and keeps the blank."""
    empty = F.lit("")
    return F.concat(F.coalesce(F.col(first), empty), F.lit(" "), F.coalesce(F.col(last), empty))


def micros(timestamp: Column, data_type: str) -> Column:
    """Microseconds since the epoch.

    A zone-free timestamp is taken apart by calendar fields, so that a session
    zone with daylight saving cannot stretch or shrink an interval.
    """
    if data_type == "timestamp":
        return F.unix_micros(timestamp)
    seconds = F.unix_date(F.to_date(timestamp)).cast("long") * 86_400 + F.hour(timestamp) * 3_600 + F.minute(timestamp) * 60
    fraction = F.extract(F.lit("SECOND"), timestamp) * 1_000_000
    return seconds * 1_000_000 + fraction.cast("long")
