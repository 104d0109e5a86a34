"""Queries of displayed numbers, audit briefs and stored search results, over fields made from ``documents``.

The oracles state texts and numbers by SQL's own decimals and joins of strings.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import display
from larder.operators import briefs, market
from larder.operators.checks import STEP_NAMES
from larder.plans.registry import query, table


@query("""WITH d AS (SELECT doc_id, n_chars AS n, doc_id * 1237 % 1000000 AS s FROM documents)
SELECT doc_id, round(n::DECIMAL(18, 3) / 8, 1)::DECIMAL(18, 1)::VARCHAR AS one, '₹' || round(n::DECIMAL(18, 3) / 8, 2)::DECIMAL(18, 2)::VARCHAR AS price, (n / 4 - 0.5)::DECIMAL(18, 1)::VARCHAR || '%' AS share,
  CASE WHEN doc_id % 7 = 0 OR n IS NULL THEN '—' ELSE rtrim(rtrim((n % 97 / 4)::DECIMAL(18, 2)::VARCHAR, '0'), '.') || 'mg' END AS amount,
  CASE WHEN n * 500 >= 1000000 THEN round((n * 500)::DECIMAL(18, 3) / 1000000, 1)::DECIMAL(18, 1)::VARCHAR || ' MB' ELSE round((n * 500)::DECIMAL(18, 3) / 1000)::BIGINT::VARCHAR || ' KB' END AS size,
  CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm ago' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h ago' ELSE (s // 86400)::VARCHAR || 'd ago' END AS age FROM d""")
def q80_display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths and quarters of a document's length as numbers, prices, shares, amounts and sizes, and ages of up to a million seconds."""
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    n, then = F.col("n_chars"), F.timestamp_seconds(1_700_000_000 - F.col("doc_id") * 1237 % 1_000_000)
    own = F.when(F.col("doc_id") % 7 != 0, n % 97 / 4)
    return table(spark, sf_dir, "documents").select(
        "doc_id", display.decimal_text(n / 8).alias("one"), display.rupees(n / 8).alias("price"), display.percent(n / 4 - 0.5).alias("share"),
        display.amount(own, "mg").alias("amount"), display.file_size(n * 500).alias("size"), display.age(then, now).alias("age"),
    )


def _cut_sql(c: str, n: int) -> str:
    plain = rf"trim(regexp_replace(coalesce({c}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
    return f"CASE WHEN {plain} = '' THEN 'Not provided' WHEN length({plain}) > {n} THEN substring({plain}, 1, {n}) || '...' ELSE {plain} END"


def _shape_sql() -> str:
    """The report's shape as text with {size} in it, written out by plain JSON."""
    steps = {}
    for n, label, expected, sop in briefs.ASKED:
        steps.setdefault(n, []).append({"label": label, "status": "fail|warn|pass|skip", "expected": expected, "found": "", "note": "", "sop_rule": sop})
    shape = {"product": "", "pack_size": "", "overall": "", "steps": [{"step": n, "name": STEP_NAMES[n], "checks": own} for n, own in steps.items()]}
    return json.dumps(shape, separators=(",", ":"))


_SIZE, _MRP = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 40 + 1 END", "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 90 + 10 END"
_LINES = {"version": (120, "source"), "usps": (300, "'Baked | ' || coalesce(lang, '')"), "ingredients": (500, "text"), "nutrition_text": (700, "text"), "allergens": (200, "lang"), "manufacturer": (300, "CAST(NULL AS VARCHAR)")}
_LITERAL = lambda s: "'" + s.replace("'", "''") + "'"


@query(rf"""WITH d AS (SELECT *, {_SIZE} AS size, {_MRP} AS mrp, coalesce(CAST({_SIZE} AS VARCHAR), 'unknown') AS shown FROM documents)
SELECT doc_id, concat_ws(chr(10), {_LITERAL(briefs.OPENING)}, 'Product: Item ' || doc_id || ' | Pack: ' || shown || 'g | Price: ' || CASE WHEN mrp = 0 THEN 'not provided' ELSE '₹' || mrp END,
  {", ".join(f"'{head}: ' || {_cut_sql(_LINES[c][1], _LINES[c][0])}" for c, head in briefs.HEADS.items())}, {", ".join(map(_LITERAL, briefs.RULES))}, 'A serving above ' || shown || 'g warns.',
  CASE WHEN mrp = 0 OR size IS NULL THEN 'Put the printed price in note.' ELSE 'A gram costs about ₹' || round(mrp::DECIMAL(18, 8) / size, 3)::DECIMAL(18, 3)::VARCHAR || '; two decimals, rounded either way, will do.' END,
  replace({_LITERAL(_shape_sql())}, '{{size}}', shown)) AS brief FROM d""")
def q81_audit_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brief whose ingredients and nutrition are whole documents, to be cut, with packs and prices known or not."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "'Item ' || doc_id AS product_name", f"CAST({_SIZE} AS DOUBLE) AS pack_size_g", f"CAST({_MRP} AS DOUBLE) AS expected_mrp", "source AS version", "array('Baked', coalesce(lang, '')) AS usps",
        "text AS ingredients", "text AS nutrition_text", "lang AS allergens", "CAST(NULL AS STRING) AS manufacturer",
    )
    return briefs.with_brief(rows).select("doc_id", "brief")


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 0 ELSE (doc_id % 6) END::INTEGER AS n_competitors, n_chars::DOUBLE AS avg_price, (doc_id % 101)::INTEGER AS positive, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE coalesce(len(string_split(text, chr(10))), 0) END::INTEGER AS n_white_space FROM documents""")
def q82_result_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose gaps are a document's lines, with no list for some."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 6 <> 5 THEN slice(array('a', 'b', 'c', 'd', 'e'), 1, CAST(doc_id % 6 AS INT)) END AS competitors",
        "named_struct('avg_price', CAST(n_chars AS DOUBLE), 'sentiment_breakdown', named_struct('positive', CAST(doc_id % 101 AS INT)), 'white_space', CASE WHEN doc_id % 4 <> 0 THEN split(text, chr(10)) END) AS market_summary",
    )
    return market.result_headline(rows)
