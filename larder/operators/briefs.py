"""The text that asks an external reader for a label's report: what the sheet says, shortened, the rules, and the report's shape.

The replies come back through ``checks.coerce_report``; asking is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.display import RUPEE, decimal_text
from larder.functions.numbers import number_text
from larder.functions.text import cut
from larder.operators.checks import STATUSES, STEP_NAMES

# The longest text of each reference field.
LONGEST = {"version": 120, "usps": 300, "ingredients": 500, "nutrition_text": 700, "allergens": 200, "manufacturer": 300}
# The checks asked for, by step: label, expected text ({size} is the pack size), whether a house rule.
ASKED = (
    (2, "Product name spelling", "", False),
    (3, "USPs present", "", False),
    (3, "Not Fried pairing", "", True),
    (4, "Net weight", "{size}g", False),
    (5, "Description vs USPs", "", False),
    (6, "Ingredients match", "", False),
    (6, "Casing rule", "First capital, rest lowercase", True),
    (6, "Ends with full stop", ".", True),
    (6, "Allergen declaration", "", False),
    (7, "Energy", "", False),
    (7, "Protein", "", False),
    (7, "Total Fat", "", False),
    (7, "Sodium", "", False),
    (8, "Serving vs grammage", "Serving <= {size}g", True),
    (9, "MRP value", "", False),
    (9, "Price per gram", "", False),
    (10, "Manufacturer address", "", False),
    (10, "Full stop after pincode", "PINCODE.", True),
)
#: The head of each line of reference values.
HEADS = {"version": "Label version", "usps": "Claims", "ingredients": "Ingredients", "nutrition_text": "Nutrition", "allergens": "Allergens", "manufacturer": "Manufacturer"}
OPENING = "Audit the printed label in the attached pages against the values below. Answer with one JSON object and nothing else."
RULES = (
    "A value given as Not provided decides nothing: skip its check and put what the label says in found.",
    "Label text beyond the values below (a second component, say) is no fault: mention it in note.",
    "A word spelled wrongly belongs in the check that it concerns.",
    "House rules have sop_rule true. Roasted, baked or popped among the claims asks for Not Fried on the label.",
    "An ingredient list has its first word in capitals, the rest in lower case, and a full stop at its end; so has an address behind its pincode.",
    "Of several nutrition columns compare the one that fits a value below, and name it in note.",
)


def _or(c: Column, otherwise: str) -> Column:
    """A number as text; null and 0 give ``otherwise``."""
    return F.when(F.coalesce(c, F.lit(0.0)) != 0, number_text(c)).otherwise(otherwise)


def report_shape(size: Column) -> Column:
    """The empty report as JSON, with the expected texts that are known."""
    step = {}
    for number, label, expected, sop in ASKED:
        wanted = F.replace(F.lit(expected), F.lit("{size}"), size)
        one = F.struct(F.lit(label).alias("label"), F.lit("|".join(reversed(STATUSES))).alias("status"), wanted.alias("expected"), F.lit("").alias("found"), F.lit("").alias("note"), F.lit(sop).alias("sop_rule"))
        step.setdefault(number, []).append(one)
    steps = F.array(*[F.struct(F.lit(n).alias("step"), F.lit(STEP_NAMES[n]).alias("name"), F.array(*own).alias("checks")) for n, own in step.items()])
    return F.to_json(F.struct(F.lit("").alias("product"), F.lit("").alias("pack_size"), F.lit("").alias("overall"), steps.alias("steps")))


def reference_lines(rows: DataFrame) -> Column:
    """The product, pack and price, then a line for each reference field; blank fields are "Not provided"."""
    price = F.coalesce("expected_mrp", F.lit(0.0))
    first = F.concat(F.lit("Product: "), F.coalesce("product_name", F.lit("")), F.lit(" | Pack: "), _or(F.col("pack_size_g"), "unknown"), F.lit("g | Price: "), F.when(price != 0, F.concat(F.lit(RUPEE), number_text(price))).otherwise("not provided"))
    own = {c: F.col(c) for c in HEADS} | {"usps": F.array_join("usps", " | ")}
    return F.concat_ws("\n", first, *[F.concat(F.lit(f"{head}: "), cut(own[c], LONGEST[c])) for c, head in HEADS.items()])


def with_brief(rows: DataFrame) -> DataFrame:
    """rows (product_name, pack_size_g, expected_mrp, version, usps, ingredients, nutrition_text, allergens, manufacturer) with ``brief``."""
    size, known = _or(F.col("pack_size_g"), "unknown"), (F.coalesce("expected_mrp", F.lit(0.0)) != 0) & (F.coalesce("pack_size_g", F.lit(0.0)) != 0)
    serving = F.concat(F.lit("A serving above "), size, F.lit("g warns."))
    price = F.when(known, F.concat(F.lit("A gram costs about "), F.lit(RUPEE), decimal_text(F.col("expected_mrp") / F.col("pack_size_g"), 3), F.lit("; two decimals, rounded either way, will do."))).otherwise("Put the printed price in note.")
    return rows.withColumn("brief", F.concat_ws("\n", F.lit(OPENING), reference_lines(rows), *map(F.lit, RULES), serving, price, report_shape(size)))
