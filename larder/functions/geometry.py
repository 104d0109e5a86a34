"""Anchored clusters: sorted positions fold into groups around the first position of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchored_clusters(sorted_items: Column, position: str, tolerance: Column | float) -> Column:
    """Array of (anchor, cluster) for an array of structs sorted by a field: an item joins the last cluster if it lies within
    the tolerance of that cluster's first position, else it starts the next one."""
    tol = F.lit(float(tolerance)) if isinstance(tolerance, (int, float)) else tolerance
    empty = F.array().cast("array<struct<anchor:double,cluster:int>>")

    def step(acc: Column, item: Column) -> Column:
        at = item[position].cast("double")
        last = F.try_element_at(acc, F.lit(-1))
        joins = last.isNotNull() & (F.abs(last["anchor"] - at) <= tol)
        anchor = F.when(joins, last["anchor"]).otherwise(at)
        number = F.when(joins, last["cluster"]).otherwise(F.coalesce(last["cluster"], F.lit(0)) + 1)
        return F.concat(acc, F.array(F.struct(anchor.alias("anchor"), number.cast("int").alias("cluster"))))

    return F.aggregate(sorted_items, empty, step)


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of the sorted non-null values; null for none."""
    some = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.get(some, F.floor(F.size(some) / 2).cast("int"))


def upper_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys with median: the upper median of the non-null values by key, from counts of distinct values; no group is collected."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = counts.withColumn("_upto", upto).join(total, keys)
    return ranked.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def row_sharpness(boxes: DataFrame, keys: list[str], slopes: Sequence[float], bin_height: float) -> DataFrame:
    """(keys, slope, sharpness) of boxes (x, y, width): the sum of squared widths of the rows that boxes fall into at each slope.

    Boxes are dealt by keys before they are multiplied by slopes: a task then sums the rows of its own keys only, where
    a task over a part of the input would hold nearly all keys' rows and send them on. A key's boxes are streamed.
    """
    rows = boxes.repartition(*keys).withColumn("slope", F.explode(F.array(*(F.lit(float(s)) for s in slopes))))
    at = F.floor((F.col("y") - F.col("slope") * F.col("x")) / F.lit(float(bin_height)) + 0.5)
    widths = rows.groupBy(*keys, "slope", at.alias("_bin")).agg(F.sum("width").alias("_w"))
    return widths.groupBy(*keys, "slope").agg(F.sum(F.col("_w").cast("double") * F.col("_w").cast("double")).alias("sharpness"))
