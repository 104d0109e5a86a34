"""Text expressions: normalised words, pattern hits, splits outside brackets, table cells and price lists."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.numbers import parse_float


def _folds() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b != a]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()


def normalize(c: Column) -> Column:
    """Accents dropped, lower case, everything but a-z and 0-9 one space, trimmed."""
    return F.trim(loosened(c))


def loosened(c: Column) -> Column:
    """As ``normalize``, but not trimmed: texts joined from such parts normalise to what the joined text does."""
    plain = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[\x{300}-\x{36F}]", "")
    return F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " ")


def words(c: Column) -> Column:
    """The normalised words in order; none for a blank text."""
    return F.array_remove(F.split(normalize(c), " "), "")


def has_phrase(view: Column, phrase: Column) -> Column:
    """Whether a normalised text holds a normalised phrase on word boundaries; never for an empty phrase."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (F.length(phrase) > 0) & F.contains(pad(view), pad(phrase))


def find_all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), group)


def split_outside_brackets(c: Column, separator: str) -> Column:
    """Parts between separators (one plain character) at bracket depth 0; unbalanced closers count as depth 0.

    A pattern splits texts whose brackets are closed and not nested; others go through a fold over their characters.
    """
    text = F.coalesce(c, F.lit(""))
    flat = ~F.regexp_replace(text, r"[(\[][^()\[\]]*[)\]]", "").rlike(r"[()\[\]]")
    return F.when(flat, F.split(text, rf"[{separator}](?![^(\[]*[)\]])")).otherwise(_split_nested(text, separator))


def _split_nested(text: Column, separator: str) -> Column:
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(acc: Column, ch: Column) -> Column:
        depth = F.when(ch.isin("(", "["), acc["depth"] + 1).when(ch.isin(")", "]"), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        cut = (ch == separator) & (depth == 0)
        last = F.element_at(acc["parts"], -1)
        grown = F.concat(F.slice(acc["parts"], F.lit(1), F.size(acc["parts"]) - 1), F.array(F.concat(last, ch)))
        return F.struct(depth.alias("depth"), F.when(cut, F.concat(acc["parts"], F.array(F.lit("")))).otherwise(grown).alias("parts"))

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["parts"])


def split_list(c: Column, separator: str = r"\|") -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def is_cell(c: Column) -> Column:
    """Whether a token is a nutrition table cell at all."""
    t = F.trim(c)
    unit = r"(?:kcal|kj|g|gm|mg|mcg|%)?"
    return t.rlike(r"^[-\x{2013}\x{2014}]$") | t.rlike("(?i)^(nil|blq|nd|trace)$") | _below_limit(t) | t.rlike(rf"(?i)^[<\x{{2264}}]?\s*\d+(?:\.\d+)?\s*{unit}$")


def _below_limit(t: Column) -> Column:
    return t.rlike(r"(?i)^(?:nd|blq|bql)\s*[<\x{FF1C}\x{2264}\-\x{2013}]\s*\d+(?:\.\d+)?\s*(?:g|mg|mcg|kcal)?$")


def cell_value(c: Column) -> Column:
    """A cell's number; null for a dash and for what is no cell (see is_cell)."""
    t = F.trim(c)
    zero = t.rlike("(?i)^(nil|blq|nd|trace)$") | _below_limit(t)
    return F.when(zero, 0.0).when(is_cell(c), parse_float(F.regexp_replace(t, r"^[<\x{2264}]\s*", "")))


def ocr_fix(c: Column) -> Column:
    """10:2 -> 10.2, Og and Omg -> 0g and 0mg."""
    return F.regexp_replace(F.regexp_replace(c, r"^(\d+):(\d+)", "$1.$2"), "^[Oo](m?g)?$", "0$1")


def ocr_alternatives(c: Column) -> Column:
    """Readings of a token that lost its unit to a trailing 9 or its decimal point."""
    digits = F.regexp_extract(c, r"(?i)^(\d{2,5})(?:kcal|kj|mg|mcg|gm|g)?$", 1)
    unit = F.regexp_extract(c, r"(?i)^\d{2,5}(kcal|kj|mg|mcg|gm|g)?$", 1)
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1))), lambda i: F.concat(F.substring(digits, F.lit(1), i), F.lit("."), F.substring(digits, i + 1, F.length(digits)), unit))
    points = F.when(F.length(digits) >= 2, cuts).otherwise(F.array().cast("array<string>"))
    nine = F.when(c.rlike(r"^\d+(\.\d+)?9$"), F.array(F.substring(c, F.lit(1), F.length(c) - 1))).otherwise(F.array().cast("array<string>"))
    return F.concat(nine, points)


def ao_key(c: Column) -> Column:
    """Words that OCR can't tell apart get one key: n-tilde read as fi, ii or ri before o, and a read as o."""
    return F.translate(F.regexp_replace(c, "(?<=[a-z])(fi|ii|ri)(?=o)", "n"), "o", "a")


def mrp_entries(c: Column) -> Column:
    """Packs of a free-text price cell, one a line: array of (grams, price)."""
    lines = F.split(F.coalesce(c, F.lit("")), "\r?\n")

    def entry(raw: Column) -> Column:
        line = F.regexp_replace(F.regexp_replace(raw, r"\([^)]*\)", " "), r"(?i)rs\.?|\x{20B9}", " ")
        weight = r"(?i)(\d+(?:\.\d+)?)\s*(?:gms?|grams?|g)(?![A-Za-z0-9_])"
        grams = F.regexp_extract(line, weight, 1)
        rest = F.concat(F.regexp_extract(line, rf"(?is)^(.*?){weight[4:]}", 1), F.lit(" "), F.regexp_extract(line, rf"(?is)^.*?{weight[4:]}(.*)$", 2))
        price = F.regexp_extract(rest, r"(\d+(?:\.\d+)?)", 1)
        return F.struct(grams.try_cast("double").alias("grams"), price.try_cast("double").alias("price"))

    return F.filter(F.transform(lines, entry), lambda e: (e["grams"] > 0) & (e["price"] > 0))


def absence_target(c: Column) -> Column:
    """What a claim says is absent ("No Maida", "Trans fat free"), normalised; else null."""
    t = F.trim(c)
    lead, tail = F.regexp_extract(t, r"(?i)^(?:no|without|zero)\s+(.+)$", 1), F.regexp_extract(t, r"(?i)^(.+?)[\s-]free$", 1)
    return F.when(lead != "", normalize(lead)).when(tail != "", normalize(tail))


def made_with_target(c: Column) -> Column:
    """What a claim says the product is made with, normalised; else null."""
    t = F.regexp_extract(F.trim(c), r"(?i)^made\s+(?:with|from|using)\s+(.+)$", 1)
    return F.when(t != "", normalize(t))


def json_between_braces(c: Column) -> Column:
    """From the first { to the last } of a reply, else null."""
    t = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(t != "", t)


def cut(c: Column, n: int) -> Column:
    """White space collapsed, at most n characters and then three dots; "Not provided" for a blank text."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(t == "", "Not provided").when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)
