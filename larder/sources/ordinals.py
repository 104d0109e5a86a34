"""One sequence over all rows of a table, without a window that holds them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.tables import cut_lineage


def running_sum(rows: DataFrame, order: list[str], size: Column, name: str) -> DataFrame:
    """rows with ``name``: the sum of ``size`` over all rows ahead in ``order``, whose values are distinct; 0 for the first.

    Rows are dealt to ranges of the order and written with the number of their range. A window over one range at a time
    gives the sums within it; the ranges' own sums, a number each, come to the driver and go back as a small table.
    """
    dealt = rows.withColumn("_size", size).repartitionByRange(*order)
    ranged = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))
    ahead, starts = 0, []
    for r in ranged.groupBy("_range").agg(F.sum("_size").alias("sum")).orderBy("_range").collect():
        starts.append((r["_range"], ahead))
        ahead += r["sum"] or 0
    spark = rows.sparkSession
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("_size").over(before), F.lit(0))
    start = F.broadcast(spark.createDataFrame(starts, "_range int, _start bigint"))
    return ranged.join(start, "_range").withColumn(name, F.col("_start") + own).drop("_range", "_start", "_size")


def ordinal(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with ``name``: their place in ``order``, whose values are distinct, from 0."""
    return running_sum(rows, order, F.lit(1).cast("bigint"), name)
