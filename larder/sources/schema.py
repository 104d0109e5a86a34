"""Fixed schemas of the product sheet and of label text."""

from __future__ import annotations

from pyspark.sql import types as T

# The sheet's columns in order.
TEXT_COLUMNS = ("sheet", "name", "brand_usp", "ingredients", "serving_size_g", "allergens", "shelf_life", "small_pack_g", "large_pack_g", "manufacturer", "mrp", "status")
NUTRIENT_COLUMNS = (
    "energy_kcal", "protein_g", "carbohydrate_g", "total_sugar_g", "added_sugar_g", "dietary_fibre_g", "total_fat_g", "saturated_fat_g", "unsaturated_fat_g", "trans_fat_g", "cholesterol_mg", "sodium_mg", "calcium_mg",
)
PCT_COLUMNS = ("energy_pct", "protein_pct", "added_sugar_pct", "dietary_fibre_pct", "total_fat_pct", "saturated_fat_pct", "trans_fat_pct", "sodium_pct", "calcium_pct")
SHEET_COLUMNS = (*TEXT_COLUMNS, "grammage", *NUTRIENT_COLUMNS, *PCT_COLUMNS)
REQUIRED_NUTRIENTS = frozenset({"energy_kcal", "protein_g", "carbohydrate_g", "total_sugar_g", "total_fat_g"})
#: A nutrition or RDA block exists if one of these cells isn't blank ("0" isn't).
NUTRITION_PRESENT = ("energy_kcal", "protein_g", "total_fat_g", "carbohydrate_g")
RDA_PRESENT = ("energy_pct", "protein_pct", "total_fat_pct", "sodium_pct")
PRODUCT_STATUSES = ("not_launched", "under_review", "needs_verification", "launched")

ROWNUM = "_rownum"
SHEET_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in SHEET_COLUMNS])
LABEL_ITEM_SCHEMA = "label_id string, ord long, s string, x double, y double, w double, h double, page int, rotated boolean"
OCR_WORD_SCHEMA = "label_id string, ord long, text string, confidence double, bbox struct<x0:double,y0:double,x1:double,y1:double>"
LISTING_SCHEMA = "ord long, id string, brand string, product_name string, price double, pack_size string, rating double, platform string, claims array<string>, sample_reviews array<struct<text:string,sentiment:string>>"
# Nutrients with their names on labels, units and rounding floors, in order.
NUTRIENTS = (
    ("energy_kcal", "Energy", ("energy",), "kcal", 1.0),
    ("protein_g", "Protein", ("protein", "proteins"), "g", 0.05),
    ("carbohydrate_g", "Carbohydrate", ("carbohydrate", "carbohydrates", "total carbohydrate", "total carbohydrates", "carbs"), "g", 0.05),
    ("total_sugar_g", "Total Sugar", ("total sugar", "total sugars", "sugar", "sugars"), "g", 0.05),
    ("added_sugar_g", "Added Sugar", ("added sugar", "added sugars"), "g", 0.05),
    ("dietary_fibre_g", "Dietary Fibre", ("dietary fibre", "dietary fiber", "fibre", "fiber"), "g", 0.05),
    ("total_fat_g", "Total Fat", ("total fat", "fat"), "g", 0.05),
    ("saturated_fat_g", "Saturated Fat", ("saturated fat", "saturated fats", "sat fat"), "g", 0.05),
    ("trans_fat_g", "Trans Fat", ("trans fat", "trans fats"), "g", 0.05),
    ("cholesterol_mg", "Cholesterol", ("cholesterol",), "mg", 1.0),
    ("sodium_mg", "Sodium", ("sodium",), "mg", 1.0),
    ("calcium_mg", "Calcium", ("calcium",), "mg", 1.0),
)
UNIT_WORDS = ("kcal", "kj", "g", "gm", "gms", "mg", "mcg", "per", "serve", "serving", "approx", "100g", "100")
