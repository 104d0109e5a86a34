"""Tables between the steps of a job, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over four tasks a core or more, which aren't merged again: for work that is heavy by the row, where few bytes hold many rows and Spark would make a task or two of them."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def listed(df: DataFrame, array: str, name: str) -> DataFrame:
    """The elements of an array column, a row each, without null ones.

    By explode_outer: for explode Spark infers a filter on the array's size and pushes it below the projections that make
    the array, which are then worked out twice, and not once a column but as one expression.
    """
    columns = [c for c in df.columns if c != array]
    return df.select(*columns, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a Parquet table below spark.checkpoint.dir (a temporary folder only where driver and executors are one process, as in tests); delete ``larder-tables`` there after a job."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="larder-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where}/larder-tables/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
