"""The product sheet as files: one row per product and pack size, all text, with the row order kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.numbers import number_text
from larder.sources.schema import NUTRIENT_COLUMNS, PCT_COLUMNS, ROWNUM, SHEET_COLUMNS, SHEET_SCHEMA, TEXT_COLUMNS


def read_sheet_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export by position: its header is skipped, missing cells are empty; rows are numbered in file order."""
    rows = spark.read.csv(path, header=True, schema=SHEET_SCHEMA, enforceSchema=True, multiLine=True, escape='"')
    return numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """Blank for null, and ascending row numbers (gaps between partitions) unless the rows have them."""
    filled = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in SHEET_COLUMNS], *([ROWNUM] if ROWNUM in rows.columns else []))
    return filled if ROWNUM in rows.columns else filled.withColumn(ROWNUM, F.monotonically_increasing_id())


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet copy that holds its row numbers."""
    return spark.read.parquet(path)


def write_sheet(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(path)


def write_tab(rows: DataFrame, workbook: str, gid: int, title: str, mode: str = "overwrite") -> None:
    """One tab of a workbook folder: its rows under ``rows/gid=...``, its title under ``titles/gid=...``."""
    write_sheet(rows, f"{workbook}/rows/gid={gid}", mode)
    rows.sparkSession.sql("SELECT :title AS title", {"title": title}).write.mode("overwrite").parquet(f"{workbook}/titles/gid={gid}")


def tab_title(spark: SparkSession, workbook: str, gid: int) -> str:
    """The title of a tab; an error names a gid that the workbook hasn't."""
    titles = spark.read.schema("title string, gid long").parquet(f"{workbook}/titles").filter(F.col("gid") == gid).head(1)  # one row a tab
    if not titles:
        raise ValueError(f"{workbook} has no tab with gid={gid}")
    return titles[0]["title"]


def read_tab(spark: SparkSession, workbook: str, gid: int) -> DataFrame:
    """The rows of the tab that has this gid, with its title as ``tab``."""
    title = tab_title(spark, workbook, gid)
    return read_sheet(spark, f"{workbook}/rows/gid={gid}").withColumn("tab", F.lit(title))


def _cell(c: Column, kind: str) -> Column:
    return F.coalesce(number_text(c) if kind == "double" else c, F.lit(""))


def product_rows(products: DataFrame, start: Column | None = None) -> DataFrame:
    """Products back to sheet rows: one for each nutrition block, percentages of the last RDA block of equal grammage."""
    block = F.explode("nutrition").alias("b")
    rows = products.select("*", block) if start is None else products.withColumn("_start", start).select("*", F.posexplode("nutrition").alias("_at", "b"))
    rda = F.try_element_at(F.filter("rda", lambda r: r["grammage"] == F.col("b.grammage")), F.lit(-1))
    rows = rows.withColumn("_rda", rda)
    kinds = dict(products.dtypes)

    def cell(c: str) -> Column:
        if c == "brand_usp":
            return F.concat_ws(" | ", "brand_usp")
        if c in TEXT_COLUMNS:
            return _cell(F.col(c), kinds[c])
        if c == "grammage" or c in NUTRIENT_COLUMNS:
            return _cell(F.col(f"b.{c}"), "double")
        assert c in PCT_COLUMNS
        return _cell(F.col(f"_rda.{c}"), "double")

    out = rows.select(*[cell(c).alias(c) for c in SHEET_COLUMNS], *([(F.col("_start") + F.col("_at")).alias(ROWNUM)] if start is not None else []))
    return out
