"""Numbers as the product sheet holds them: text with a numeric prefix, rounded half up, printed without a trailing .0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A signed decimal number at the start of a cell, after white space.
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def parse_float(c: Column) -> Column:
    """The number that a text starts with, else null ("12abc" is 12; "NaN" and "" are null)."""
    return F.regexp_extract(c, NUMBER_PREFIX, 1).try_cast("double")


def num(c: Column) -> Column:
    """A required number: 0 if the cell has none."""
    return F.coalesce(parse_float(c), F.lit(0.0))


def num_or_null(c: Column) -> Column:
    """An optional number: null if the cell has none."""
    return parse_float(c)


def round_half_up(c: Column, places: int = 0) -> Column:
    """Ties go toward positive infinity, unlike ``round``."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def number_text(c: Column) -> Column:
    """A number in plain notation with up to 3 decimals and no trailing zeros: 10.0 -> "10", 0.50 -> "0.5"."""
    rounded = round_half_up(c, 3).cast("decimal(30,3)").cast("string")
    return F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def positive(c: Column) -> Column:
    """A user's number if it is greater than 0, else null."""
    n = parse_float(c)
    return F.when(n > 0, n)
