"""Numbers, sizes and ages as a report shows them. Ties round away from zero, by the number's shortest decimal notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sign of a price, and what stands for a missing amount.
RUPEE, MISSING = "₹", "—"


def _rounded(c: Column, decimals: int) -> Column:
    return F.round(c.cast("decimal(38,12)"), decimals)


def decimal_text(c: Column, decimals: int = 1) -> Column:
    """A number with exactly so many decimals; null for null."""
    return _rounded(c, decimals).cast(f"decimal(38,{decimals})").cast("string")


def rupees(c: Column) -> Column:
    return F.concat(F.lit(RUPEE), decimal_text(c, 2))


def percent(c: Column, decimals: int = 1) -> Column:
    return F.concat(decimal_text(c, decimals), F.lit("%"))


def amount(c: Column, unit: str = "") -> Column:
    """At most two decimals, no trailing zeros, then the unit; a dash for null."""
    plain = F.regexp_replace(F.regexp_replace(decimal_text(c, 2), "0+$", ""), r"\.$", "")
    return F.coalesce(F.concat(plain, F.lit(unit)), F.lit(MISSING))


def file_size(n_bytes: Column) -> Column:
    """Thousands of bytes, from a million bytes on millions with one decimal."""
    return F.when(n_bytes >= 1_000_000, F.concat(decimal_text(n_bytes / 1e6), F.lit(" MB"))).otherwise(F.concat(decimal_text(n_bytes / 1e3, 0), F.lit(" KB")))


def age(then: Column, now: Column) -> Column:
    """How long ago a time was, in the largest whole unit up to days; a time to come is "just now"."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 60_000_000)
    in_units = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, in_units(minutes, "m")).when(minutes < 24 * 60, in_units(minutes / 60, "h")).otherwise(in_units(minutes / (24 * 60), "d"))
