"""Lookups and matches: first rule, nearest and band blocks, last-wins lookup, fuzzy terms, anti-joins, priority unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.distance import osa_distance

#: Rule and block tables are fixed lists in code; they are broadcast as such.
RULES_AT_MOST = 10_000


def rule_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed list as a DataFrame with its order in ``ord``."""
    if len(rows) > RULES_AT_MOST:
        raise ValueError("not a fixed list")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {schema}")


def first_rule_in_list(value: Column, rules: list[tuple[str, int]], otherwise: str | None = None) -> Column:
    """The name of the first keyword rule that a text contains, as one expression: no join for a fixed list."""
    return reduce(lambda acc, r: F.when(F.contains(value, F.lit(r[0])), F.lit(r[1])).otherwise(acc), reversed(rules), F.lit(otherwise))


def nearest_block(value: Column, blocks: Column, position: str) -> Column:
    """Of an array of blocks the one nearest to a value; ties go to the earlier one."""
    ranked = F.transform(blocks, lambda b, i: F.struct(F.abs(b[position] - value).alias("gap"), i.alias("i"), b.alias("block")))
    return F.array_min(F.filter(ranked, lambda r: r["gap"].isNotNull()))["block"]


def band_block(value: Column, blocks: Column, position: str, width: float = 0.5) -> Column:
    """Of an array of blocks the first within a band around a value; null for none."""
    return F.get(F.filter(blocks, lambda b: F.abs(b[position] - value) < width), 0)


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def priority_union(*parts: DataFrame, key: list[str]) -> DataFrame:
    """All parts' rows of a key from the first part that has the key, one row a key and part: the first by its other columns."""
    rest = [c for c in parts[0].columns if c not in key]
    rows = reduce(DataFrame.unionByName, [p.withColumn("prio", F.lit(i)) for i, p in enumerate(parts)])
    best = F.min(F.struct("prio", *rest)).alias("_best")
    return rows.groupBy(*key).agg(best).select(*key, F.col("_best.prio").alias("prio"), *[F.col(f"_best.{c}").alias(c) for c in rest])


def fuzzy_blocks(terms: DataFrame, col: str, most: int) -> DataFrame:
    """terms with their blocking keys: first character, and each length that a partner may have."""
    return terms.withColumn("first_char", F.substring(col, 1, 1)).withColumn("length", F.explode(F.sequence(F.length(col) - most, F.length(col) + most)))


def fuzzy_pairs(left: DataFrame, right: DataFrame, left_col: str, right_col: str, most: int = 2, distance=None) -> DataFrame:
    """(left, right, distance) of terms with one first character, near lengths and at most so many edits; an equi-join on the blocks."""
    distance = distance or (lambda a, b: F.levenshtein(a, b))
    a = fuzzy_blocks(left.select(left_col).distinct(), left_col, most)
    b = right.select(right_col).distinct().withColumn("first_char", F.substring(right_col, 1, 1)).withColumn("length", F.length(right_col))
    pairs = a.join(b, ["first_char", "length"]).withColumn("distance", distance(F.col(left_col), F.col(right_col)))
    return pairs.filter(F.col("distance").between(0, most)).select(left_col, right_col, "distance")


def deletions(word: Column, most: int) -> Column:
    """A word with none, one, ... ``most`` of its letters left out: words within ``most`` edits, swaps included, have one in common."""
    one = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    level, out = F.array(word), F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, one)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def osa_pairs(left: DataFrame, right: DataFrame, left_col: str, right_col: str, most: int = 2) -> DataFrame:
    """(left, right, distance) of terms with one first character and at most so many edits under the OSA distance.

    An equi-join on deletions: a term has as many keys as its length allows, whatever the number of terms, so no block
    grows with their square; only pairs that share a deletion reach the distance.
    """
    keyed = lambda df, c: df.select(c).distinct().select(c, F.substring(c, 1, 1).alias("_first"), F.explode(deletions(F.col(c), most)).alias("_key"))
    pairs = keyed(left, left_col).join(keyed(right, right_col), ["_first", "_key"]).select(left_col, right_col).distinct()
    return pairs.withColumn("distance", osa_distance(F.col(left_col), F.col(right_col), most)).filter(F.col("distance") <= most)


def best_suggestion(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, suggestion) of words of 6 letters or more that the vocabulary lacks but nearly has; least distance, then earlier entry (ord)."""
    usable = words.filter(F.col("word").rlike("^[a-z]{6,}$")).select("word").distinct()
    known = vocabulary.select(F.explode(F.array("term", F.concat("term", F.lit("s")))).alias("word")).unionByName(vocabulary.filter(F.col("term").endswith("s")).select(F.expr("substring(term, 1, length(term) - 1)").alias("word")))
    unknown = usable.join(known.distinct(), "word", "left_anti")
    pairs = osa_pairs(unknown, vocabulary, "word", "term", 2).join(vocabulary.select("term", "ord"), "term")
    allowed = F.when(F.length("word") >= 9, 2).otherwise(1)
    best = F.min_by("term", F.struct("distance", "ord")).alias("suggestion")
    return pairs.filter((F.col("distance") <= allowed) & (F.abs(F.length("word") - F.length("term")) <= allowed)).groupBy("word").agg(best)


def interval_anti_join(rows: DataFrame, other: DataFrame, key: list[str], lo: str, hi: str, share: float = 0.0) -> DataFrame:
    """rows whose interval no interval of ``other`` with the same key overlaps by more than a share of its own length."""
    o = other.select(*key, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    overlap = F.least(F.col(hi), F.col("_hi")) - F.greatest(F.col(lo), F.col("_lo"))
    cond = reduce(lambda x, y: x & y, [rows[k] == o[k] for k in key])
    return rows.join(o, cond & (overlap > share * (F.col(hi) - F.col(lo))), "left_anti")


def first_seen(rows: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct values with the first place where each occurs."""
    return rows.groupBy(col).agg(F.min(order).alias("first_at"))


def running_before(value: Column, partition: list[str], order: list[str]) -> Column:
    """The sum of all earlier rows; 0 for the first."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def inversions(position: Column, partition: list[str], order: list[str]) -> Column:
    """Whether a row's position is before that of the row ahead of it."""
    return position < F.lag(position).over(Window.partitionBy(*partition).orderBy(*order))
