"""Queries of the operators on product sheets, price lists, label words and reports, over a sheet made from ``part``.

Every part gives three rows of a product sheet, for three pack sizes; parts of one type, name and brand are one product.
The cells are stated once, in SQL that both engines read, and the oracles work out the operators' results from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import audit, checks, claims, market, products
from larder.plans.registry import query, table
from larder.sources import labels
from larder.sources.schema import NUTRIENT_COLUMNS, PCT_COLUMNS, ROWNUM, SHEET_COLUMNS

_ABSENT = "i = 2 AND p_partkey % 5 = 0"
_PRICE = "CAST(10 + p_partkey % 90 AS STRING)"


def _number(expression: str, unit: str = "") -> str:
    return f"CASE WHEN {_ABSENT} THEN '' ELSE CAST({expression} AS STRING) || '{unit}' END"


#: The cells of the sheet that aren't blank, over p_partkey, p_name, ... and the row's number i within its part.
CELLS = {
    "sheet": "p_type",
    "name": "p_name || ' ' || p_brand",
    "brand_usp": "'Source of Protein | ' || p_name || ' |'",
    "ingredients": "CASE p_partkey % 3 WHEN 0 THEN 'Oats, Sunflower Oil' WHEN 1 THEN 'Rice bran oil, sunflower oil' ELSE 'Salt, sugar' END",
    "serving_size_g": "CAST(p_size AS STRING) || 'g'",
    "allergens": "'Milk'",
    "small_pack_g": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size * 2 AS STRING) END",
    "large_pack_g": "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE CAST(p_size * 5 AS STRING) END",
    "mrp": f"CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(p_size * 2 AS STRING) || 'gm for ' || {_PRICE} || '/- (each)' ELSE 'Rs. ' || {_PRICE} || ' - ' || CAST(p_size AS STRING) || ' grams' END",
    "status": "CASE p_partkey % 4 WHEN 0 THEN 'launched' WHEN 1 THEN 'under_review' WHEN 2 THEN 'bogus' ELSE '' END",
    "grammage": "CAST(CASE i WHEN 0 THEN 100 WHEN 1 THEN p_size ELSE 30 END AS STRING)",
    "energy_kcal": _number("p_partkey % 400", " kcal"),
    "protein_g": _number("p_partkey % 30"),
    "carbohydrate_g": _number("p_partkey % 70"),
    "total_fat_g": _number("p_partkey % 20"),
    "saturated_fat_g": "CAST(p_partkey % 7 AS STRING)",
    "sodium_mg": "CAST(p_partkey * 7 % 1200 AS STRING)",
    "protein_pct": "CASE i WHEN 1 THEN CAST(p_partkey % 50 AS STRING) ELSE '' END",
}


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.selectExpr(f"p_partkey * 3 + i AS {ROWNUM}", *(f"{CELLS.get(c, repr(''))} AS {c}" for c in SHEET_COLUMNS))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.group_fold(sheet(spark, sf_dir))


_CELLS_SQL = ", ".join(f"{e} AS {c}" for c, e in CELLS.items())
_NUMBER_SQL = "TRY_CAST(regexp_extract({c}, '^[0-9]+') AS DOUBLE)"
_BLOCK_SQL = ", ".join(f"'{c}': {_NUMBER_SQL.format(c=c)}" for c in ("grammage", "energy_kcal", "protein_g", "carbohydrate_g", "total_fat_g", "saturated_fat_g", "sodium_mg"))
_SHEET_SQL = f"sheet AS (SELECT p_partkey * 3 + i AS rn, {_CELLS_SQL} FROM part, (SELECT unnest([0, 1, 2]) AS i))"
_PRODUCTS_SQL = f"""WITH {_SHEET_SQL},
g AS (SELECT sheet AS s, name AS n, min(rn) AS f, list({{{_BLOCK_SQL}}} ORDER BY {_NUMBER_SQL.format(c="grammage")}, rn) FILTER (protein_g <> '') AS nutrition,
  list({{'grammage': {_NUMBER_SQL.format(c="grammage")}, 'pct': {_NUMBER_SQL.format(c="protein_pct")}}} ORDER BY {_NUMBER_SQL.format(c="grammage")}, rn) FILTER (protein_pct <> '') AS rda FROM sheet GROUP BY 1, 2),
p AS (SELECT sheet, name, row_number() OVER (ORDER BY f) - 1 AS ord, nutrition, rda, list_filter(nutrition, lambda b: b.grammage = 100)[1] AS n100, ingredients, mrp, status,
  string_split(brand_usp, ' | ')[1] AS claim_0, rtrim(string_split(brand_usp, ' | ')[2], ' |') AS claim_1,
  {_NUMBER_SQL.format(c="serving_size_g")} AS serving, {_NUMBER_SQL.format(c="small_pack_g")} AS small, {_NUMBER_SQL.format(c="large_pack_g")} AS large FROM g JOIN sheet ON rn = f)"""


@query(f"""{_PRODUCTS_SQL} SELECT sheet || '-' || ord::VARCHAR || '-' || lower(regexp_replace(name[1:20], '\\s+', '-', 'g')) AS id, sheet, name, claim_0 || '/' || claim_1 AS claims, serving AS serving_size_g, small AS small_pack_g, large AS large_pack_g,
  CASE WHEN status IN ('launched', 'under_review') THEN status ELSE 'not_launched' END AS status, len(nutrition)::INTEGER AS n_blocks, nutrition[1].grammage AS least_g, nutrition[-1].protein_g AS last_protein_g, len(rda)::INTEGER AS n_rda, rda[1].pct AS first_pct FROM p""")
def q43_product_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).select(
        "id", "sheet", "name", F.array_join("brand_usp", "/").alias("claims"), "serving_size_g", "small_pack_g", "large_pack_g", "status", F.size("nutrition").alias("n_blocks"), F.get("nutrition", 0)["grammage"].alias("least_g"),
        F.element_at("nutrition", -1)["protein_g"].alias("last_protein_g"), F.size("rda").alias("n_rda"), F.get("rda", 0)["protein_pct"].alias("first_pct"),
    )


@query(f"{_PRODUCTS_SQL} SELECT sheet, name FROM p WHERE sheet IN ('ECONOMY', 'STANDARD') AND (contains(lower(name), 'old') OR contains(lower(claim_0), 'old') OR contains(lower(claim_1), 'old'))")
def q44_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.search(folded(spark, sf_dir), "OLD", ["ECONOMY", "STANDARD"]).select("sheet", "name")


_OPTIONS_SQL = f"""{_PRODUCTS_SQL},
m AS (SELECT *, TRY_CAST(regexp_extract(mrp, '([0-9]+) ?g', 1) AS DOUBLE) AS mg, TRY_CAST(regexp_extract(mrp, '(?:for |Rs. )([0-9]+)', 1) AS DOUBLE) AS mp FROM p),
own AS (SELECT sheet, name, mg AS grams, 0 AS prio, mp AS price FROM m WHERE mg > 0 UNION ALL SELECT sheet, name, small, 1, NULL FROM m WHERE small > 0 UNION ALL SELECT sheet, name, large, 1, NULL FROM m WHERE large > 0),
listed AS (SELECT * FROM own UNION ALL SELECT sheet, name, unnest(nutrition).grammage, 2, NULL FROM m ANTI JOIN own USING (sheet, name)),
o AS (SELECT sheet, name, grams, arg_min({{'p': price}}, prio).p AS price, ['mrp', 'pack', 'nutrition'][min(prio) + 1] AS source FROM listed GROUP BY ALL)"""


@query(f"{_OPTIONS_SQL} SELECT * FROM o")
def q45_pack_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.pack_options(folded(spark, sf_dir))


@query(f"{_OPTIONS_SQL} SELECT sheet, name, d.g AS grams, d.p AS price, d.s AS source FROM (SELECT sheet, name, arg_min({{'g': grams, 'p': price, 's': source}}, (CASE WHEN price IS NULL THEN 1000000 ELSE 0 END) + grams) AS d FROM o GROUP BY ALL)")
def q46_default_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.default_pack(products.pack_options(folded(spark, sf_dir))).select("sheet", "name", "pack.*")


_PASS_SQL = "CASE WHEN coalesce({b}.protein_g, 0) >= 5.4 THEN 'pass' ELSE 'fail' END"


@query(f"""{_PRODUCTS_SQL} SELECT sheet, name, 0 AS pos, claim_0 AS claim, 'nutrient' AS type, '>= 5.4g' AS threshold, n100.protein_g::BIGINT::VARCHAR || 'g' AS actual, {_PASS_SQL.format(b="n100")} AS status FROM p
UNION ALL SELECT sheet, name, 1, claim_1, 'custom', NULL, NULL, 'custom' FROM p""")
def q47_claim_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folded(spark, sf_dir).withColumn("n100", claims.block_at_100g(F.col("nutrition")))
    return claims.validate_claims(rows, ["sheet", "name"])


@query(f"""{_PRODUCTS_SQL},
c AS (SELECT sheet, name, n100, CASE WHEN n100.energy_kcal = 0 THEN 0 ELSE abs(n100.energy_kcal - (n100.carbohydrate_g * 4 + n100.protein_g * 4 + n100.total_fat_g * 9)) / n100.energy_kcal * 100 END AS dev,
  CASE WHEN n100.total_fat_g <> 0 THEN round((n100.saturated_fat_g / n100.total_fat_g * 100)::DECIMAL(20,10), 1)::DOUBLE END AS sat,
  CASE ingredients[1] WHEN 'O' THEN 'Sunflower Oil' WHEN 'R' THEN 'Rice Bran Oil' END AS oil, CASE ingredients[1] WHEN 'O' THEN 15 WHEN 'R' THEN 25 END AS most FROM p)
SELECT sheet, name, round(dev, 4) AS deviation_pct, oil, sat AS sat_pct, CASE WHEN n100.protein_g < 5.4 OR coalesce(sat > most, false) THEN 'NON_COMPLIANT' WHEN dev > 5 OR n100.sodium_mg > 800 THEN 'REVIEW_REQUIRED' ELSE 'COMPLIANT' END AS verdict FROM c""")
def q48_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.compliance(folded(spark, sf_dir))
    return rows.select("sheet", "name", F.round("deviation_pct", 4).alias("deviation_pct"), F.col("oil.name").alias("oil"), "sat_pct", "verdict")


_LAST_SQL = "(SELECT max(rn) FROM sheet)"


@query(f"""{_PRODUCTS_SQL}, w AS MATERIALIZED (SELECT sheet, name, status FROM p WHERE sheet = 'ECONOMY')
SELECT rn AS _rownum, sheet, name, grammage, protein_g, status FROM sheet ANTI JOIN w USING (sheet, name)
UNION ALL SELECT {_LAST_SQL} + row_number() OVER (ORDER BY sheet, name), sheet, name, '50', '7.5', CASE WHEN status IN ('launched', 'under_review') THEN status ELSE 'not_launched' END FROM w""")
def q49_replace_nutrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write request that gives every product of one category one block."""
    values = {"grammage": 50.0, "protein_g": 7.5}
    of = lambda names: F.array(F.struct(*(F.lit(values.get(c)).cast("double").alias(c) for c in ("grammage", *names))))
    request = folded(spark, sf_dir).filter("sheet = 'ECONOMY'").select("sheet", "name", of(NUTRIENT_COLUMNS).alias("nutrition"), of(PCT_COLUMNS).alias("rda"))
    return products.replace_nutrition(sheet(spark, sf_dir), request).select(ROWNUM, "sheet", "name", "grammage", "protein_g", "status")


@query(f"""{_PRODUCTS_SQL}, v AS MATERIALIZED (SELECT * FROM p), w AS (SELECT *, coalesce(sum(len(nutrition)) OVER (ORDER BY sheet, 'New ' || name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM v),
b AS (SELECT *, unnest(nutrition) AS x, unnest(range(len(nutrition))) AS nth FROM w)
SELECT rn AS _rownum, sheet, name, brand_usp, grammage, protein_g, protein_pct, status FROM sheet
UNION ALL SELECT ({_LAST_SQL} + 1 + ahead + nth)::BIGINT, sheet, 'New ' || name, claim_0 || ' | ' || claim_1, x.grammage::BIGINT::VARCHAR, x.protein_g::BIGINT::VARCHAR, coalesce(list_filter(rda, lambda r: r.grammage = x.grammage)[-1].pct::BIGINT::VARCHAR, ''), 'not_launched' FROM b""")
def q50_append_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write request that adds all products of the catalogue again, under new names."""
    new = folded(spark, sf_dir).withColumn("name", F.concat(F.lit("New "), F.col("name")))
    return products.append_products(sheet(spark, sf_dir), new).select(ROWNUM, "sheet", "name", "brand_usp", "grammage", "protein_g", "protein_pct", "status")


@query(f"WITH {_SHEET_SQL} SELECT rn AS _rownum, CASE WHEN sheet = 'ECONOMY' AND name = 'cold widget Brand#13' THEN 'needs_verification' ELSE status END AS status FROM sheet")
def q51_set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.set_status(sheet(spark, sf_dir), "ECONOMY", "cold widget Brand#13", "needs_verification").select(ROWNUM, "status")


_GENERIC_SQL = ", ".join(f"'{w}'" for w in products.GENERIC_WORDS)


@query(f"""{_PRODUCTS_SQL},
w AS (SELECT ord, list_filter(string_split(regexp_replace(lower(concat_ws(' ', name, ingredients, 'Milk', claim_0, claim_1)), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM p),
t AS (SELECT unnest(ws) AS term, (ord + 1) * 1000000 + unnest(range(len(ws))) AS ord FROM w UNION ALL SELECT unnest(gs), unnest(range(len(gs))) FROM (SELECT [{_GENERIC_SQL}] AS gs))
SELECT term, min(ord)::BIGINT AS ord FROM t WHERE regexp_full_match(term, '[a-z]{{3,}}') GROUP BY 1""")
def q52_product_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.vocabulary(folded(spark, sf_dir))


_STATUS = "CASE event_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'fail' WHEN 3 THEN 'skip' ELSE 'odd' END"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    product = "CASE WHEN event_id % 2 = 0 THEN event_type ELSE ' ' END"
    steps = f"""'[{{"step": 2, "checks": [{{"label": "' || event_type || '", "status": "' || {_STATUS} || '", "expected": " ", "found": "' || user_id || '", "sop_rule": true}}]}}, {{"checks": [{{"status": "pass"}}]}}, {{"step": 4, "checks": []}}]'"""
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", f"""'{{"product": "' || {product} || '", "steps": ' || {steps} || '}}' AS reply""")


@query(f"""SELECT event_id AS label_id, 2 AS step, 0 AS seq, event_type AS label, replace({_STATUS}, 'odd', 'warn') AS status, NULL::VARCHAR AS expected, user_id::VARCHAR AS found, NULL::VARCHAR AS note, true AS sop_rule FROM events
UNION ALL SELECT event_id, 0, 0, 'Check', 'pass', NULL, NULL, NULL, false FROM events""")
def q53_coerce_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.coerce_report(_replies(spark, sf_dir), "event_id", "reply")


@query(f"""SELECT event_id AS label_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'Product ' || user_id::VARCHAR END AS product, CASE user_id % 3 WHEN 0 THEN 'pack size not set' WHEN 1 THEN '50.5g' ELSE '101g' END AS pack_size,
  CASE event_id % 5 WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' WHEN 4 THEN 'warn' ELSE 'pass' END AS overall FROM events""")
def q54_report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = _replies(spark, sf_dir)
    reference = replies.selectExpr("event_id AS label_id", "'Product ' || user_id AS product_name", "CAST(user_id % 3 AS DOUBLE) * 50.5D AS pack_size_g")
    return checks.report_header(replies, reference, "event_id", "reply")


@query("""WITH f AS (SELECT conv_id, turn, 1 + length(text) % 3 AS pages, length(text) AS chars, (length(text) % 20)::DOUBLE AS px, role FROM conversations),
h AS (SELECT conv_id, sum(pages)::BIGINT AS page_count, sum(chars)::BIGINT AS char_count, CASE WHEN bool_or(role = 'assistant') THEN 'ocr' ELSE 'pdf' END AS source, min(px) AS photo_text_px FROM f GROUP BY 1)
SELECT conv_id::VARCHAR AS label_id, turn * 1000000 + 7 AS ord, (1 + coalesce(sum(pages) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS page, page_count, char_count, source, photo_text_px FROM f JOIN h USING (conv_id)""")
def q55_merge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    files = talks.selectExpr("CAST(conv_id AS STRING) AS label_id", "turn AS file_no", "1 + n % 3 AS page_count", "n AS char_count", "CAST(n % 20 AS DOUBLE) AS photo_text_px", "CASE role WHEN 'assistant' THEN 'ocr' ELSE 'pdf' END AS source")
    blank = "0D AS x, 0D AS y, 0D AS w, 0D AS h".split(", ")
    items = talks.selectExpr("CAST(conv_id AS STRING) AS label_id", "turn AS file_no", "7L AS ord", "role AS s", *blank, "1 AS page", "false AS rotated")
    moved, heads = labels.merge_files(items, files)
    return moved.select("label_id", "ord", "page").join(heads, "label_id")


def _ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = "named_struct('x0', l_linenumber * 10D, 'y0', 0D, 'x1', l_linenumber * 10D + l_quantity, 'y1', 10D) AS bbox"
    return table(spark, sf_dir, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS label_id", "l_linenumber AS ord", "'w' || l_partkey AS text", "l_quantity * 2 AS confidence", box)


@query("""WITH b AS (SELECT l_orderkey::VARCHAR AS label_id, l_linenumber AS ord, 'w' || l_partkey::VARCHAR AS text, l_quantity * 2 AS confidence, l_linenumber * 10 AS x0, l_linenumber * 10 + l_quantity AS x1 FROM lineitem)
SELECT label_id, ord, text, confidence FROM b WHERE ord <= 2 OR (confidence >= 70 AND NOT EXISTS (SELECT 1 FROM b o WHERE o.ord <= 2 AND o.label_id = b.label_id AND greatest(least(o.x1, b.x1) - greatest(o.x0, b.x0), 0) * 10 > 0.2::DOUBLE * greatest((b.x1 - b.x0) * 10, 1)))""")
def q56_merged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _ocr_words(spark, sf_dir)
    return labels.merged_words(words.filter("ord <= 2"), words.filter("ord > 2")).select("label_id", "ord", "text", "confidence")


@query("""WITH b AS (SELECT l_orderkey::VARCHAR AS label_id, l_linenumber AS ord, 'w' || l_partkey::VARCHAR AS text, l_quantity * 2 AS confidence, l_linenumber * 10 AS x0, l_linenumber * 10 + l_quantity AS x1, l_partkey % 2 AS turned FROM lineitem),
s AS (SELECT label_id, coalesce(sum(length(text)) FILTER (confidence >= 60 AND turned = 0), 0) AS a, coalesce(sum(length(text)) FILTER (confidence >= 60 AND turned = 1), 0) AS b FROM b GROUP BY 1),
r AS (SELECT b.*, turned = (s.b > s.a)::INTEGER AS best, least(s.a, s.b) >= 0.4::DOUBLE * greatest(s.a, s.b) AS two FROM b JOIN s USING (label_id))
SELECT label_id, ord, text, confidence FROM r WHERE best OR (two AND confidence >= 70 AND NOT EXISTS (SELECT 1 FROM r o WHERE o.best AND o.label_id = r.label_id AND greatest(least(o.x1, r.x1) - greatest(o.x0, r.x0), 0) * 10 > 0.2::DOUBLE * greatest((r.x1 - r.x0) * 10, 1)))""")
def q73_best_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as words of two reads, by the parity of the part."""
    words, odd = _ocr_words(spark, sf_dir), F.expr("CAST(substring(text, 2) AS bigint) % 2 = 1")
    return labels.best_read(words.filter(~odd), words.filter(odd)).select("label_id", "ord", "text", "confidence")


@query("SELECT l_orderkey::VARCHAR AS label_id, coalesce(sum(length('w' || l_partkey::VARCHAR)) FILTER (l_quantity * 2 >= 60), 0)::BIGINT AS score FROM lineitem GROUP BY 1")
def q57_read_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.read_score(_ocr_words(spark, sf_dir))


@query("""SELECT p_partkey, p_partkey % 7 <> 5 AS is_cell, CASE p_partkey % 7 WHEN 0 THEN p_size WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 4 THEN p_size WHEN 6 THEN p_size + 0.5 END::DOUBLE AS value FROM part""")
def q58_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = "CASE p_partkey % 7 WHEN 0 THEN p_size || ' g' WHEN 1 THEN 'ND<0.0' || p_size || 'g' WHEN 2 THEN 'nil' WHEN 3 THEN '-' WHEN 4 THEN '<' || p_size || 'mg' WHEN 5 THEN p_name ELSE p_size || '.5kcal' END AS cell"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", cell)
    return rows.select("p_partkey", text.is_cell(F.col("cell")).alias("is_cell"), text.cell_value(F.col("cell")).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN lower(p_name) END AS absent, CASE WHEN p_partkey % 4 = 2 THEN lower(p_name) END AS made_with FROM part")
def q59_claim_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'No ' || p_name WHEN 1 THEN p_name || '-free' WHEN 2 THEN 'Made with ' || p_name ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", text.absence_target(claim).alias("absent"), text.made_with_target(claim).alias("made_with"))


def _first_check(rows: DataFrame, step: str) -> DataFrame:
    return rows.select("p_partkey", F.get(step, 0)["label"].alias("label"), F.get(step, 0)["status"].alias("status"))


@query("""SELECT p_partkey, 'Product name' AS label, CASE p_partkey % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'fail' END AS status FROM part""")
def q60_name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that print the name, its words the other way round, or only the first of them."""
    printed = "CASE p_partkey % 3 WHEN 0 THEN 'the ' || p_name || ' pack' WHEN 1 THEN split(p_name, ' ')[1] || ' and ' || split(p_name, ' ')[0] ELSE split(p_name, ' ')[0] END AS printed"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS product_name", "false AS ocr", printed)
    rows = rows.withColumns({"views": F.array(text.normalize(F.col("printed"))), "label_words": text.words(F.col("printed"))})
    return _first_check(audit.name_step(rows), "step2")


@query("""SELECT p_partkey, 'Serving size vs pack size' AS label, CASE WHEN p_partkey % 4 = 0 THEN 'skip' WHEN p_size > p_partkey % 60 THEN 'warn' ELSE 'pass' END AS status FROM part""")
def q61_serving_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "'Serving size: ' || p_size || ' g net' AS flat", "CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 60 AS DOUBLE) END AS pack_size_g")
    return _first_check(audit.serving_step(rows), "step8")


@query("""SELECT p_partkey, 'MRP value' AS label, CASE p_partkey % 4 WHEN 0 THEN 'warn' WHEN 1 THEN 'fail' ELSE 'pass' END AS status, CASE p_partkey % 4 WHEN 2 THEN 'pass' WHEN 3 THEN 'fail' ELSE 'warn' END AS per_gram FROM part""")
def q62_price_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without a price, with a wrong one, and with unit prices that fit the price of 100 g or don't."""
    flat = "CASE p_partkey % 4 WHEN 0 THEN 'net weight' WHEN 1 THEN 'MRP Rs. 41/-' WHEN 2 THEN 'MRP Rs. 40/- (0.40 per g)' ELSE 'MRP: 40 (0.90 per g)' END AS flat"
    rows = audit.price_step(table(spark, sf_dir, "part").selectExpr("p_partkey", flat, "false AS ocr", "40D AS expected_mrp", "100D AS pack_size_g"))
    return _first_check(rows, "step9").join(rows.select("p_partkey", F.get("step9", 1)["status"].alias("per_gram")), "p_partkey")


@query(f"""{_PRODUCTS_SQL} SELECT sheet, name, 0 AS pos, claim_0 AS claim, {_PASS_SQL.format(b="n100")} AS master_status, n100.protein_g::BIGINT::VARCHAR || 'g' AS master_actual, {_PASS_SQL.format(b="nutrition[1]")} AS serving_status, nutrition[1].protein_g::BIGINT::VARCHAR || 'g' AS serving_actual FROM p
UNION ALL SELECT sheet, name, 1, claim_1, 'custom', NULL, 'custom', NULL FROM p""")
def q63_claim_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folded(spark, sf_dir).withColumns({"n100": claims.block_at_100g(F.col("nutrition")), "least": F.get("nutrition", 0)})
    return claims.claim_matrix(rows, ["sheet", "name"], {"master": "n100", "serving": "least"})


@query(f"""{_PRODUCTS_SQL}, r AS (SELECT sheet, name, unnest(rda) AS b, unnest(range(len(rda))) AS i FROM p),
n AS (SELECT sheet, name, arg_min(b, abs(b.grammage - 40) * 1000000 + i) AS near, arg_min(b, i) FILTER (abs(b.grammage - 40) < 0.5) AS own FROM r GROUP BY ALL)
SELECT sheet, name, coalesce(own.pct, floor(near.pct * 40 / near.grammage * 10 + 0.5) / 10) AS pct, own IS NULL AS calculated FROM n""")
def q64_daily_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).select("sheet", "name", claims.rda_for(F.lit(40.0), F.col("rda"), "protein_pct").alias("r")).select("sheet", "name", "r.*")


@query(f"""{_PRODUCTS_SQL} SELECT sheet, name, concat_ws(', ', small::BIGINT::VARCHAR || 'g', large::BIGINT::VARCHAR || 'g') AS packs, claim_0 AS shown, '1 more' AS more FROM p""")
def q65_product_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = products.top_claims_text(F.col("brand_usp"), 1)
    return folded(spark, sf_dir).select("sheet", "name", products.pack_text(F.array("small_pack_g", "large_pack_g")).alias("packs"), F.array_join(top["shown"], ", ").alias("shown"), top["more"].alias("more"))


@query("""SELECT p_partkey, p_name AS keyword, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Healthy Snacks' END AS category, 'Pan India' AS region FROM part WHERE p_partkey % 3 <> 0""")
def q66_search_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END AS keyword", "CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS category", "CAST(NULL AS STRING) AS region")
    return market.search_request(rows)


@query("""SELECT p_partkey, CASE WHEN p_size <= 0 OR p_size IS NULL THEN NULL ELSE floor(p_retailprice / p_size * 100 + 0.5) END AS price_per_100g, CASE WHEN p_size % 6 >= 4 THEN 'strong' WHEN p_size % 6 >= 3 THEN 'moderate' ELSE 'weak' END AS band FROM part WHERE p_type = 'ECONOMY'""")
def q67_listing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.of_platform(table(spark, sf_dir, "part").withColumnRenamed("p_type", "platform"), "ECONOMY")
    return rows.select("p_partkey", market.per_100g(F.col("p_retailprice"), F.concat("p_size", F.lit(" g"))).alias("price_per_100g"), market.band(F.col("p_size") % 6).alias("band"))


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 2 = 0 THEN 'sheet is required' END, CASE WHEN p_partkey % 3 = 0 THEN 'name is required' END, CASE WHEN p_partkey % 5 = 0 THEN 'status is unknown' END, CASE WHEN p_partkey % 7 = 0 THEN 'at least one nutrition block is required' END) AS errors FROM part""")
def q68_request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank: Column = F.array().cast("array<double>")
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 2 <> 0 THEN p_type END AS sheet", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name", "CASE WHEN p_partkey % 5 = 0 THEN 'sold' ELSE 'launched' END AS status")
    rows = rows.withColumn("nutrition", F.when(F.col("p_partkey") % 7 == 0, blank).when(F.col("p_partkey") % 7 == 1, F.array(F.lit(1.0))))
    return products.request_errors(rows).select("p_partkey", F.array_join("errors", "; ").alias("errors"))
