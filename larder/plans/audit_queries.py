"""Queries of the audit's steps and of the whole audit, over labels made from ``part``.

Every part gives a label and what the sheet says of its product. What is printed, left out or wrong depends on the part's
key, so the oracles state the checks that must come from it, not the way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import normalize
from larder.operators import audit
from larder.plans.registry import query, table
from larder.sources.schema import NUTRIENT_COLUMNS
from larder.sources.tables import listed, spread


def _block(grams: str, **values: str) -> str:
    cells = ", ".join(f"'{c}', CAST({values.get(c, 'NULL')} AS DOUBLE)" for c in NUTRIENT_COLUMNS)
    return f"named_struct('grammage', CAST({grams} AS DOUBLE), {cells})"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part dealt over tasks: its file is small, but a row is a label."""
    return spread(table(spark, sf_dir, "part"), "p_partkey")


def _checks(rows: DataFrame, step: str, *more: str) -> DataFrame:
    return listed(rows.select("p_partkey", step), step, "c").select("p_partkey", "c.label", "c.status", *(f"c.{m}" for m in more))


def _printed(rows: DataFrame, text: Column) -> DataFrame:
    return rows.withColumn("views", F.array(normalize(text)))


@query("""WITH p AS (SELECT p_partkey AS k, p_size, k % 4 = 3 AS ocr, k % 2 = 0 AS a, k % 3 = 0 AS b, k % 5 < 3 AS c, k % 7 < 4 AS d, k % 11 < 6 AS e, k % 13 < 5 AS wheat, k % 13 >= 5 AS sugar, CASE WHEN k % 17 < 6 THEN (k % 17) % 2 END AS sugar_g FROM part),
s AS (SELECT *, CASE WHEN a THEN 'pass' ELSE 'open' END AS s1, CASE WHEN b THEN 'pass' WHEN coalesce(sugar_g > 0, sugar) THEN 'fail' ELSE 'open' END AS s2,
  CASE WHEN NOT (wheat OR k % 13 >= 9) THEN 'fail' WHEN k % 4 = 2 THEN 'fail' WHEN c THEN 'pass' ELSE 'open' END AS s3, CASE WHEN d THEN 'pass' ELSE 'open' END AS s4 FROM p),
t AS (SELECT *, (s1 = 'pass')::INT + (s2 = 'pass')::INT + (s3 = 'pass')::INT + (s4 = 'pass')::INT >= CASE WHEN ocr THEN 3 ELSE 2 END AS panel FROM s),
u AS (SELECT k, panel, unnest([{'l': 'Claim: Source of protein', 's': s1}, {'l': 'Claim: No Sugar', 's': s2}, {'l': 'Claim: Made with wheat', 's': s3}, {'l': 'Claim: Baked', 's': s4}]) AS x FROM t)
SELECT k AS p_partkey, x.l AS label, replace(x.s, 'open', 'warn') AS status FROM u WHERE panel OR x.s <> 'open'
UNION ALL SELECT DISTINCT k, 'USP claims', 'skip' FROM u WHERE NOT panel AND x.s = 'open'
UNION ALL SELECT k, 'Claim figures: Source of protein', CASE WHEN k % 2 = 1 AND 1 > greatest(0.05::DOUBLE, p_size * 0.02::DOUBLE) THEN 'warn' ELSE 'pass' END FROM t
UNION ALL SELECT k, 'Cooking method pairs with Not Fried', CASE WHEN e THEN 'pass' WHEN NOT panel THEN 'skip' ELSE 'fail' END FROM t""")
def q74_claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 3: claims printed or not, contradicted, with figures, and an ingredient that a photo reads as "wheot"."""
    usps = "array('1. Source of protein (' || CAST(p_size + p_partkey % 2 AS STRING) || 'g/100g)/No Sugar', 'Made with wheat', 'Baked') AS usps"
    listed = "CASE p_partkey % 4 WHEN 1 THEN 'Wheat, salt' WHEN 2 THEN 'Rice, salt' WHEN 3 THEN 'Wheot, salt' END AS label_list"
    ingredients = "CASE WHEN p_partkey % 13 < 5 THEN 'Wheat, salt' WHEN p_partkey % 13 < 9 THEN 'Rice, sugar' ELSE 'Wheat, sugar' END AS ingredients"
    block = _block("100", protein_g="p_size", total_sugar_g="CASE WHEN p_partkey % 17 < 6 THEN (p_partkey % 17) % 2 END")
    printed = (("p_partkey % 2 = 0", "Source of Protein"), ("p_partkey % 3 = 0", "No sugar"), ("p_partkey % 5 < 3", "made with WHEAT"), ("p_partkey % 7 < 4", "Baked"), ("p_partkey % 11 < 6", "Not Fried"))
    rows = _parts(spark, sf_dir).selectExpr("p_partkey", usps, listed, ingredients, f"array({block}) AS nutrition", "p_partkey % 4 = 3 AS ocr", "concat_ws(' x ', 'pack', " + ", ".join(f"CASE WHEN {when} THEN '{t}' END" for when, t in printed) + ") AS printed")
    return _checks(audit.claims_step(_printed(rows, F.col("printed"))), "step3")


@query("""SELECT p_partkey, 'Net weight' AS label, CASE p_partkey % 5 WHEN 2 THEN 'fail' WHEN 3 THEN 'warn' ELSE 'pass' END AS status,
  CASE p_partkey % 5 WHEN 0 THEN p_size || 'g' WHEN 1 THEN p_size || 'gm, ' || p_size || 'g' WHEN 2 THEN '1.5kg' WHEN 3 THEN 'No ''Net Wt'' found on label' ELSE (p_size + 10) || 'g' END AS found FROM part
UNION ALL SELECT p_partkey, 'Net weight unit written consistently', CASE p_partkey % 5 WHEN 1 THEN 'warn' ELSE 'pass' END, CASE p_partkey % 5 WHEN 0 THEN p_size || 'g' WHEN 1 THEN p_size || 'gm, ' || p_size || 'g' WHEN 2 THEN '1.5kg' ELSE (p_size + 10) || 'g' END FROM part WHERE p_partkey % 5 <> 3""")
def q75_weight_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 4: one size, two spellings, kilograms, none, and a photo's g read as 9."""
    flat = "CASE p_partkey % 5 WHEN 0 THEN 'Net Wt: ' || p_size || 'g' WHEN 1 THEN 'Net Weight ' || p_size || ' gm and net qty: ' || p_size || 'g' WHEN 2 THEN 'NET QUANTITY - 1.5 kg' WHEN 3 THEN 'no weight' ELSE 'Net Wt ' || (p_size + 10) || '9' END AS flat"
    rows = _parts(spark, sf_dir).selectExpr("p_partkey", flat, "p_partkey % 5 = 4 AS ocr", "CAST(CASE WHEN p_partkey % 5 = 4 THEN p_size + 10 ELSE p_size END AS DOUBLE) AS pack_size_g")
    return _checks(audit.weight_step(rows), "step4", "found")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k FROM part)
SELECT p_partkey, 'Ingredients list' AS label, 'warn' AS status FROM p WHERE k = 1
UNION ALL SELECT p_partkey, 'Ingredients match the sheet', CASE k WHEN 3 THEN 'fail' ELSE 'pass' END FROM p WHERE k <> 1
UNION ALL SELECT p_partkey, 'No extra ingredients on the label', 'warn' FROM p WHERE k = 4
UNION ALL SELECT p_partkey, 'Ingredient order matches the sheet', CASE k WHEN 2 THEN 'warn' ELSE 'pass' END FROM p WHERE k NOT IN (1, 3)
UNION ALL SELECT p_partkey, 'Casing: first letter capital, rest lowercase', CASE k WHEN 5 THEN 'fail' ELSE 'pass' END FROM p WHERE k <> 1
UNION ALL SELECT p_partkey, 'Ends with full stop', CASE k WHEN 3 THEN 'fail' ELSE 'pass' END FROM p WHERE k <> 1
UNION ALL SELECT p_partkey, 'Allergen declaration', CASE k WHEN 1 THEN 'warn' WHEN 2 THEN 'fail' WHEN 3 THEN 'warn' ELSE 'pass' END FROM p""")
def q76_ingredient_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 6: the sheet's list, none, another order, one item less, one more, and capitals."""
    own = "upper(substring(p_name, 1, 1)) || substring(p_name, 2) || ' {flour}, rice flour, salt'"
    listed = f"""CASE p_partkey % 6 WHEN 0 THEN {own.format(flour="flour")} || '.' WHEN 2 THEN 'Rice flour, ' || p_name || ' flour, salt.' WHEN 3 THEN upper(substring(p_name, 1, 1)) || substring(p_name, 2) || ' flour, salt'
      WHEN 4 THEN {own.format(flour="flour")} || ', peppermint.' WHEN 5 THEN {own.format(flour="FLOUR")} || '.' END AS label_list"""
    allergens = "CASE p_partkey % 6 WHEN 1 THEN NULL WHEN 2 THEN 'Contains soya' WHEN 3 THEN 'Contains milk and soya' ELSE 'Contains milk.' END AS label_allergens"
    rows = _parts(spark, sf_dir).selectExpr("p_partkey", f"{own.format(flour='flour')} || '.' AS ingredients", listed, allergens, "CAST(NULL AS STRING) AS allergens_near", "'Contains milk.' AS allergens", "false AS ocr")
    return _checks(audit.ingredients_step(rows), "step6")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_size AS s, p_partkey % 5 = 0 AS typo, CASE WHEN p_partkey % 4 = 1 THEN 30 ELSE 100 END AS f FROM part)
SELECT p_partkey, 'Nutrition table' AS label, 'warn' AS status, NULL::VARCHAR AS expected, 'Could not find a nutrition table in the label text' AS found, NULL::VARCHAR AS note FROM p WHERE k = 3
UNION ALL SELECT p_partkey, 'Energy', 'pass', (s + 4 * f) || 'kcal', (s + 4 * f) || 'kcal', NULL FROM p WHERE k <> 3
UNION ALL SELECT p_partkey, 'Protein', 'pass', (f / 5)::BIGINT || 'g', (f / 5)::BIGINT || 'g', NULL FROM p WHERE k <> 3
UNION ALL SELECT p_partkey, 'Total Fat', CASE k WHEN 2 THEN 'fail' ELSE 'pass' END, (f / 10)::BIGINT || 'g', CASE k WHEN 2 THEN '15g' ELSE (f / 10)::BIGINT || 'g' END, CASE k WHEN 2 THEN '+50.0% against the sheet' END FROM p WHERE k <> 3
UNION ALL SELECT p_partkey, 'Sodium', 'warn', (f * 2) || 'mg', 'Not found in the nutrition table', NULL FROM p WHERE k <> 3
UNION ALL SELECT p_partkey, 'Calcium', 'pass', '0mg', '-', NULL FROM p WHERE k <> 3
UNION ALL SELECT p_partkey, 'Nutrient names spelled correctly', CASE WHEN typo THEN 'fail' ELSE 'pass' END, CASE WHEN typo THEN 'Protein' END, CASE WHEN typo THEN 'Protien' END, NULL FROM p WHERE k <> 3""")
def q77_nutrition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 7: labels that print the block of 100 g or of 30 g, a wrong value, a dash, a misspelt name, or too few lines."""
    block = lambda f: _block(str(f), energy_kcal=f"p_size + {4 * f}", protein_g=str(f // 5), total_fat_g=str(f // 10), sodium_mg=str(2 * f), calcium_mg="0")
    size = "CASE WHEN p_partkey % 4 = 1 THEN 30 ELSE 100 END"

    def line(row: int, key: str, title: str, value: str, label: str, typo: str = "false") -> str:
        values = f"array(CAST({value} AS DOUBLE))" if value else "CAST(array(NULL) AS array<double>)"
        return f"named_struct('row_no', {row}, 'key', '{key}', 'title', '{title}', 'typo', {typo}, 'row_label', {label}, 'values', {values}, 'x', 0D, 'y', 0D)"

    lines = [line(0, "energy_kcal", "Energy", f"p_size + 4 * {size}", "'Energy (kcal)'"), line(1, "protein_g", "Protein", f"{size} / 5", "CASE WHEN p_partkey % 5 = 0 THEN 'Protien (g)' ELSE 'Protein (g)' END", "p_partkey % 5 = 0")]
    more = [line(2, "total_fat_g", "Total Fat", f"CASE WHEN p_partkey % 4 = 2 THEN 15 ELSE {size} / 10 END", "'Total Fat (g)'"), line(3, "calcium_mg", "Calcium", "", "'Calcium (mg)'")]
    cells = f"CASE WHEN p_partkey % 4 = 3 THEN array({', '.join(lines)}) ELSE array({', '.join(lines + more)}) END AS cells"
    rows = _parts(spark, sf_dir).selectExpr("p_partkey", cells, f"array({block(30)}, {block(100)}) AS nutrition", "CAST(80 AS DOUBLE) AS pack_size_g", "false AS ocr")
    return _checks(audit.nutrition_step(rows), "step7", "expected", "found", "note")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 4 AS k FROM part)
SELECT p_partkey, 'Addresses' AS label, 'skip' AS status FROM p WHERE k = 2
UNION ALL SELECT p_partkey, 'Manufacturer name', 'pass' FROM p WHERE k <> 2
UNION ALL SELECT p_partkey, 'Pincode matches the sheet', CASE k WHEN 1 THEN 'fail' ELSE 'pass' END FROM p WHERE k <> 2
UNION ALL SELECT p_partkey, 'Full stop after pincode', CASE k WHEN 1 THEN 'warn' ELSE 'pass' END FROM p WHERE k <> 2
UNION ALL SELECT p_partkey, 'FSSAI licence number matches the sheet', CASE k WHEN 3 THEN 'fail' ELSE 'pass' END FROM p WHERE k <> 2
UNION ALL SELECT p_partkey, 'FSSAI licence number is 14 digits', CASE k WHEN 3 THEN 'fail' ELSE 'pass' END FROM p WHERE k <> 2""")
def q78_address_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 10: the sheet's address, another pincode, no address, and a licence number cut short."""
    digits = "CAST(10000000000000 + p_partkey AS STRING)"
    sheet = f"'Acme ' || p_name || ' Ltd,\\nPune 411001. Lic. No. ' || {digits} AS manufacturer"
    flat = f"CASE WHEN p_partkey % 4 = 2 THEN 'nothing of it' ELSE 'Packed for Acme ' || p_name || ' Ltd, Pune ' || CASE p_partkey % 4 WHEN 1 THEN '411002' ELSE '411001' END || '. Lic. No. ' || CASE p_partkey % 4 WHEN 3 THEN substring({digits}, 1, 10) ELSE {digits} END END AS flat"
    rows = _parts(spark, sf_dir).selectExpr("p_partkey", sheet, flat, "false AS ocr")
    return _checks(audit.address_step(_printed(rows, F.col("flat"))), "step10")


def _label_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items of a label a part: lines top down, table cells beside each other."""
    lines = [
        "initcap(p_name)", "'Source of Protein'", "'Net Wt: ' || CASE p_partkey % 3 WHEN 0 THEN '90' ELSE '80' END || 'g MRP Rs. 70/-'", "'Ingredients: ' || upper(substring(p_name, 1, 1)) || substring(p_name, 2) || ' flour, rice flour, salt.'",
        "'Allergen: Contains milk.'",
    ]
    items = [f"named_struct('s', {s}, 'x', 20D, 'y', {700 - 30 * i}D, 'w', 200D)" for i, s in enumerate(lines)]
    cells = (("Energy (kcal)", "400 + p_size"), ("Protein (g)", "CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 9 END"), ("Sodium (mg)", "100"))
    for k, (title, value) in enumerate(cells):
        items += [f"named_struct('s', '{title}', 'x', 20D, 'y', {550 - 30 * k}D, 'w', 55D)", f"named_struct('s', CAST({value} AS STRING), 'x', 80D, 'y', {550 - 30 * k}D, 'w', 20D)"]
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS label_id", f"posexplode(array({', '.join(items)})) AS (ord, it)").selectExpr("label_id", "CAST(ord AS BIGINT) AS ord", "it.s", "it.x", "it.y", "it.w", "8D AS h", "1 AS page", "false AS rotated")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 3 = 0 AS heavy, p_partkey % 2 = 1 AS wrong FROM part)
SELECT p_partkey, 2 AS step, 'Product name' AS label, 'pass' AS status FROM p
UNION ALL SELECT p_partkey, 3, unnest(['Claim: Source of Protein', 'Cooking method pairs with Not Fried']), unnest(['pass', 'skip']) FROM p
UNION ALL SELECT p_partkey, 4, 'Net weight', CASE WHEN heavy THEN 'fail' ELSE 'pass' END FROM p UNION ALL SELECT p_partkey, 4, 'Net weight unit written consistently', 'pass' FROM p
UNION ALL SELECT p_partkey, 5, 'Description vs USPs', 'skip' FROM p
UNION ALL SELECT p_partkey, 6, unnest(['Ingredients match the sheet', 'Ingredient order matches the sheet', 'Casing: first letter capital, rest lowercase', 'Ends with full stop', 'Allergen declaration']), 'pass' FROM p
UNION ALL SELECT p_partkey, 7, unnest(['Energy', 'Sodium', 'Nutrient names spelled correctly']), 'pass' FROM p UNION ALL SELECT p_partkey, 7, 'Protein', CASE WHEN wrong THEN 'fail' ELSE 'pass' END FROM p
UNION ALL SELECT p_partkey, 8, 'Serving size vs pack size', 'skip' FROM p
UNION ALL SELECT p_partkey, 9, unnest(['MRP value', 'Price per gram']), unnest(['pass', 'warn']) FROM p
UNION ALL SELECT p_partkey, 10, 'Addresses', 'skip' FROM p""")
def q79_label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of the audit, from positioned text items to checks."""
    items = _label_items(spark, sf_dir)
    parts = table(spark, sf_dir, "part")
    block = _block("100", energy_kcal="400 + p_size", protein_g="6", sodium_mg="100")
    reference = parts.selectExpr(
        "p_partkey AS label_id", "p_name AS product_name", "array('Source of Protein') AS usps", "p_name || ' flour, rice flour, salt.' AS ingredients", "'Contains milk.' AS allergens", "'Acme Foods Ltd,\\nPune 411001' AS manufacturer", f"array({block}) AS nutrition",
        "80D AS pack_size_g", "70D AS expected_mrp",
    )
    found = audit.audit(items, parts.selectExpr("p_partkey AS label_id", "'pdf' AS source"), reference)
    return found.select(F.col("label_id").alias("p_partkey"), "step", "label", "status")
