"""Queries of the operators on photographed labels, over pages laid out from the tables' own words and numbers.

The turns of a conversation are the lines of a page, tilted by its number; a part has a tilted nutrition table. The
layouts are stated once, in SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import labels, photo
from larder.plans.registry import query, table
from larder.sources import detection
from larder.sources.schema import NUTRIENTS
from larder.sources.tables import spread

#: Of a word's middle (number of the word in its line, from 0) and of its line.
_X, _LINE, _SLOPE = "CAST(k * 12 AS DOUBLE)", "CAST(turn * -14 AS DOUBLE)", "((conv_id % 13 - 6) * CAST(0.025 AS DOUBLE))"


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every conversation as a label item; a turn is a line."""
    words = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", r"posexplode(filter(split(text, '[ \n]+'), w -> w <> '')) AS (k, s)")
    at = words.selectExpr("conv_id AS label_id", "CAST(turn * 1000000 + k AS bigint) AS ord", "s", f"{_X} AS x", f"{_LINE} + {_SLOPE} * ({_X} + 5.0D) AS y", "10.0D AS w", "7.0D AS h", "1 AS page", "false AS rotated")
    return at


@query(f"""
WITH w AS (SELECT conv_id, turn, unnest(range(len(s))) AS k FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS s FROM conversations)),
p AS (SELECT conv_id, {_X} + 5 AS x, {_LINE} + {_SLOPE} * ({_X} + 5) AS y FROM w),
b AS (SELECT conv_id, i, floor((y - i * 0.005::DOUBLE * x) / 3.5::DOUBLE + 0.5) AS bin, count(*) * 10 AS w FROM p, (SELECT unnest(range(-60, 61)) AS i) GROUP BY ALL),
s AS (SELECT conv_id, i, sum(w * w)::DOUBLE AS sharp FROM b GROUP BY ALL),
n AS (SELECT conv_id, count(*)::BIGINT AS n_words FROM p GROUP BY 1)
SELECT conv_id, n_words, CASE WHEN n_words < 10 THEN 0 ELSE slope END AS slope, CASE WHEN n_words < 10 THEN 0 ELSE round(peak, 9) END AS peak
FROM n JOIN (SELECT conv_id, arg_max(i, sharp * 1000 - i) * 0.005::DOUBLE AS slope, max(sharp) / (sum(sharp) / 121) AS peak FROM s GROUP BY 1) USING (conv_id)""")
def q69_page_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = photo.page_slopes(page_items(spark, sf_dir))
    return found.select(F.col("label_id").alias("conv_id"), "n_words", "slope", F.round("peak", 9).alias("peak"))


@query()
def q70_levelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = page_items(spark, sf_dir)
    heads = items.select("label_id").distinct().withColumn("source", F.lit("ocr"))
    return photo.levelled_items(items, heads).select(F.col("label_id").alias("conv_id"), "ord", F.round("y", 6).alias("y"))


#: Nutrients of a part's table, top down, and their values.
TABLE = (
    ("energy_kcal", "Energy", "100 + p_partkey % 300"), ("protein_g", "Protein", "p_partkey % 29 + 1"), ("carbohydrate_g", "Carbohydrate", "p_partkey % 60 + 5"), ("total_sugar_g", "Total Sugar", "p_partkey % 25 + 2"),
    ("total_fat_g", "Total Fat", "p_partkey % 31 + 3"), ("saturated_fat_g", "Saturated Fat", "p_partkey % 9 + 1"), ("sodium_mg", "Sodium", "p_partkey % 700 + 50"),
)
#: A third of the tables have an unreadable "Total Fat": position and sheet give its value away.
_UNREAD = "p_partkey % 3 = 0"
_FILLER = ("keep", "in", "a", "cool", "and", "dry", "place")


def _table_words() -> str:
    """An array of (s, x, line, w), for SQL over part."""
    out = []
    for k, (_, title, value) in enumerate(TABLE):
        x = 20.0
        for part in title.split():
            s = f"CASE WHEN {_UNREAD} THEN '#' ELSE '{part}' END" if title == "Total Fat" else f"'{part}'"
            out.append(f"named_struct('s', {s}, 'x', {x}D, 'line', {300 - 13 * k}D, 'w', {5.0 * len(part)}D)")
            x += 5.0 * len(part) + 3
        out.append(f"named_struct('s', CAST({value} AS STRING), 'x', 150D - 2.5D * length(CAST({value} AS STRING)), 'line', {300 - 13 * k}D, 'w', 5D * length(CAST({value} AS STRING)))")
    out += [f"named_struct('s', '{t}', 'x', {20.0 + 40 * i}D, 'line', 100D, 'w', 30D)" for i, t in enumerate(_FILLER)]
    return f"array({', '.join(out)})"


def table_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").selectExpr("p_partkey AS label_id", "(p_partkey % 21 - 10) * 0.01D AS slope", f"posexplode({_table_words()}) AS (ord, it)")
    return words.selectExpr("label_id", "CAST(ord AS bigint) AS ord", "it.s AS s", "it.x AS x", "it.line + slope * (it.x + it.w / 2) AS y", "it.w AS w", "7.0D AS h", "1 AS page", "false AS rotated")


@query("SELECT p_partkey, key, value::DOUBLE AS value FROM (" + " UNION ALL ".join(f"SELECT p_partkey, '{key}' AS key, {value} AS value FROM part" for key, _, value in TABLE) + ")")
def q71_tilted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spread(table_items(spark, sf_dir), "label_id")  # a part's few bytes become some thirty words
    heads = table(spark, sf_dir, "part").selectExpr("p_partkey AS label_id").distinct().withColumn("source", F.lit("ocr"))
    sheet = table(spark, sf_dir, "part").selectExpr("p_partkey AS label_id", "explode(array(" + ", ".join(f"named_struct('key', '{key}', 'values', array(CAST({value} AS double)))" for key, _, value in TABLE) + ")) AS e").select("label_id", "e.*")
    found = photo.photo_cells(labels.rows(items, heads), sheet)
    return found.filter("values IS NOT NULL").select(F.col("label_id").alias("p_partkey"), "key", F.get("values", 0).alias("value"))


def score_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score map for every vector: 0.5 and half the product of two of its parts over the greatest square."""
    top = "array_max(transform(embedding, e -> CAST(e AS double) * e))"
    scores = f"flatten(transform(embedding, a -> transform(embedding, b -> 0.5D + CAST(a AS double) * b / (2 * {top}))))"
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "size(embedding) AS map_width", f"{scores} AS scores", "size(embedding) * 4 AS width", "size(embedding) * 4 AS height")


@query()
def q72_detected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(f"{p}_{c}", 6).alias(f"{p}_{c}") for p in ("tl", "tr", "bl") for c in "xy"]
    return detection.boxes(score_maps(spark, sf_dir), "vec_id").select("vec_id", "box", "pixels", F.round("score", 9).alias("score"), *rounded)


assert {key for key, *_ in TABLE} <= {key for key, *_ in NUTRIENTS}
