"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Work on at most about so many text bytes at once inside a task; a longer text is taken alone.
SLICE_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one, but only if driver and executors are one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="larder-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a table written once to the shared folder; unlike a checkpoint it is compressed and computed once. Delete ``larder-tables`` there after a job."""
    path = f"{shared_dir(df.sparkSession)}/larder-tables/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of a job in the shared folder that grow by ``add`` and go by ``drop``; within ``with``, shuffle files go when their query ends, and in the end all tables but those ``kept``."""

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._names, self.kept = spark, {}, set[str]()

    def __enter__(self) -> Scratch:
        self._before = self._spark.conf.get(self._CLEANUP, None)
        self._spark.conf.set(self._CLEANUP, "true")
        return self

    def __exit__(self, *_: object) -> None:
        for name in set(self._names) - self.kept:
            self.drop(name)
        if self._before is None:
            self._spark.conf.unset(self._CLEANUP)
        else:
            self._spark.conf.set(self._CLEANUP, self._before)

    def add(self, name: str, df: DataFrame, key: str | None = None, buckets: int = 1) -> DataFrame:
        """The table with df's rows added, in buckets by key if there is one: groups of the key are then read without a shuffle."""
        at = self._names.setdefault(name, uuid.uuid4().hex)
        writer = df.write.mode("append").format("parquet").option("path", f"{shared_dir(self._spark)}/larder-tables/{at}")
        (writer.bucketBy(buckets, key) if key else writer).saveAsTable(f"larder_{at}")
        return self._spark.table(f"larder_{at}")

    def drop(self, name: str) -> None:
        at = self._names.pop(name)
        self._spark.sql(f"DROP TABLE larder_{at}")
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self._spark)}/larder-tables/{at}")
        path.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of whole texts that cross to Python at once, where jobs run in ``small_batches``.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within send Python BATCH_ROWS rows at once: texts are wide, and a task holds a batch in the JVM and again in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A key with this part of all rows has its rows dealt apart.
HOT_PART = 1000


def with_facts(rows: DataFrame, facts: DataFrame, key: str, n_rows: int, spread: str) -> DataFrame:
    """rows left-joined with the facts (key, copies, ...) of their key, of which copies are the rows that have it.

    Keys that hold a HOT_PART-th of all rows, at most HOT_PART of them, come by broadcast, and their rows are dealt by ``spread``.
    """
    names = [c for c in facts.columns if c not in (key, "copies")]
    much = facts.filter(F.col("copies") * HOT_PART >= n_rows).select(key, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_{c}") for c in names))
    rows = rows.join(F.broadcast(much), key, "left").withColumn("_apart", F.coalesce("_hot", F.col(key).isNull()))
    rows = rows.withColumn("_key", F.when(F.col("_apart"), F.xxhash64(spread).cast("string")).otherwise(F.col(key).cast("string")))
    rest = facts.select(F.col(key).cast("string").alias("_key"), F.lit(False).alias("_apart"), *names)
    rows = rows.join(rest.hint("merge"), ["_key", "_apart"], "left")
    return rows.withColumns({c: F.when(F.col("_hot"), F.col(f"_{c}")).otherwise(F.col(c)) for c in names}).drop("_key", "_apart", "_hot", *(f"_{c}" for c in names))


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string column holding about ``most`` bytes each."""
    sizes = pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) as one array, and the row offsets into it."""
    col = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
