"""Claim compliance: nutrient rules, energy, sodium and oil checks, scaling by serving, and the verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import number_text, round_half_up
from larder.operators.matching import nearest_block

# Claim rules per 100 g in their order, factual claims, oils and limits.
CLAIM_RULES = (
    ("Rich in Protein", "protein_g", ">=", 10.8),
    ("High in Protein", "protein_g", ">=", 10.8),
    ("High Protein", "protein_g", ">=", 10.8),
    ("Source of Protein", "protein_g", ">=", 5.4),
    ("Rich in Dietary Fibre", "dietary_fibre_g", ">=", 6.0),
    ("Rich in Fibre", "dietary_fibre_g", ">=", 6.0),
    ("Source of Dietary Fibre", "dietary_fibre_g", ">=", 3.0),
    ("Source of Fibre", "dietary_fibre_g", ">=", 3.0),
    ("Source of Calcium", "calcium_mg", ">=", 150.0),
    ("Rich in Calcium", "calcium_mg", ">=", 300.0),
    ("Low Calorie", "energy_kcal", "<=", 40.0),
)
FACTUAL_CLAIMS = (
    "No Palm Oil", "No Added Sugar", "Baked Not Fried", "Baked", "Roasted", "Made with Whole Grains", "No Preservatives",
    "No Maida", "No Refined Sugar", "Made with Jaggery", "Gluten Free", "Vegan", "Trans fat free",
)
OIL_RULES = (("Rice Bran Oil", r"(?i)rice\s*bran\s*oil", 25), ("Sunflower Oil", r"(?i)sunflower\s*oil", 15))
SODIUM_LIMIT_MG, ENERGY_TOLERANCE_PCT = 800, 5


def _alike(claim: Column, name: str) -> Column:
    """Either text holds the other, in any case."""
    low, own = F.lower(claim), F.lit(name.lower())
    return F.contains(low, own) | F.contains(own, low)


def claim_result(claim: Column, n100: Column) -> Column:
    """Struct (claim, type, threshold, actual, status) of one claim against the 100 g block; the first rule alike decides."""

    def of_rule(rule: tuple) -> Column:
        _, nutrient, op, limit = rule
        value = F.coalesce(n100[nutrient], F.lit(0.0))
        unit = " mg" if nutrient.endswith("_mg") else " kcal" if nutrient == "energy_kcal" else "g"
        good = value >= limit if op == ">=" else value <= limit
        return F.struct(claim.alias("claim"), F.lit("nutrient").alias("type"), F.lit(f"{op} {limit:g}{unit}").alias("threshold"), F.concat(number_text(value), F.lit(unit)).alias("actual"), F.when(good, "pass").otherwise("fail").alias("status"))

    def plain(kind: str) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(claim.alias("claim"), F.lit(kind).alias("type"), none.alias("threshold"), none.alias("actual"), F.lit(kind).alias("status"))

    factual = reduce(lambda a, b: a | b, [_alike(claim, f) for f in FACTUAL_CLAIMS])
    ladder = F.when(factual, plain("factual")).otherwise(plain("custom"))
    return reduce(lambda acc, r: F.when(_alike(claim, r[0]), of_rule(r)).otherwise(acc), reversed(CLAIM_RULES), ladder)


def validate_claims(products: DataFrame, key: list[str], claims: str = "brand_usp", n100: str = "n100") -> DataFrame:
    """Long table of (key, pos, claim, type, threshold, actual, status)."""
    rows = products.select(*key, n100, F.posexplode(F.filter(claims, lambda c: c != "")).alias("pos", "_claim"))
    return rows.select(*key, "pos", claim_result(F.col("_claim"), F.col(n100)).alias("r")).select(*key, "pos", "r.*")


def energy_kcal(carb: Column, protein: Column, fat: Column) -> Column:
    return carb * 4 + protein * 4 + fat * 9


def energy_deviation_pct(reported: Column, calculated: Column) -> Column:
    """Percent of the reported value; 0 if that is 0."""
    return F.when(reported == 0, F.lit(0.0)).otherwise(F.abs(reported - calculated) / reported * 100)


def sat_fat_pct(saturated: Column, total: Column) -> Column:
    """Percent of total fat to one place; null without a value or a total."""
    return F.when(total != 0, F.round((saturated / total * 100).cast("decimal(20,10)"), 1).cast("double"))


def primary_oil(ingredients: Column) -> Column:
    """Struct (name, max_pct, others) of the oil named first; null if none is."""
    hits = [F.when(F.regexp_instr(ingredients, F.lit(p)) > 0, F.struct(F.regexp_instr(ingredients, F.lit(p)).alias("at"), F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(m).alias("max_pct"))) for i, (n, p, m) in enumerate(OIL_RULES)]
    found = F.array_sort(F.array_compact(F.array(*hits)))
    first = F.get(found, 0)
    others = F.transform(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), lambda h: h["name"])
    return F.when(F.size(found) > 0, F.struct(first["name"].alias("name"), first["max_pct"].alias("max_pct"), others.alias("others")))


def block_at_100g(nutrition: Column) -> Column:
    return F.get(F.filter(nutrition, lambda b: F.abs(b["grammage"] - 100) < 1), 0)


def to_per_100g(values: Column, serving: Column, required: tuple[str, ...] = ("energy_kcal", "protein_g", "carbohydrate_g", "total_sugar_g", "total_fat_g")) -> Column:
    """A map of label values scaled from a serving to 100 g (2 places); required ones default to 0."""
    scale = F.when((serving > 0) & (F.abs(serving - 100) > 1), 100 / serving).otherwise(1.0)
    base = F.map_from_arrays(F.array(*map(F.lit, required)), F.array(*[F.lit(0.0)] * len(required)))
    scaled = F.map_filter(F.transform_values(values, lambda _, v: round_half_up(v * scale, 2)), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(scaled, k)), scaled)


def rda_for(grammage: Column, rda: Column, field: str) -> Column:
    """Struct (pct, calculated) for a nutrition block: its own band's value, else the nearest block with a value scaled to it."""
    own = F.get(F.filter(rda, lambda r: F.abs(r["grammage"] - grammage) < 0.5), 0)[field]
    near = nearest_block(grammage, F.filter(rda, lambda r: r[field].isNotNull()), "grammage")
    scaled = F.when(near["grammage"] > 0, round_half_up(near[field] * grammage / near["grammage"], 1))
    return F.struct(F.coalesce(own, scaled).alias("pct"), (own.isNull() & scaled.isNotNull()).alias("calculated"))


def verdict(any_fail: Column, oil_fail: Column, energy_fail: Column, sodium_fail: Column) -> Column:
    no = F.lit(False)
    return F.when(F.coalesce(any_fail, no) | F.coalesce(oil_fail, no), "NON_COMPLIANT").when(F.coalesce(energy_fail, no) | F.coalesce(sodium_fail, no), "REVIEW_REQUIRED").otherwise("COMPLIANT")


def compliance(products: DataFrame) -> DataFrame:
    """One row a product with a 100 g block: claim counts, energy, sodium and oil checks, and the verdict."""
    rows = products.withColumn("n100", block_at_100g(F.col("nutrition"))).filter("n100 IS NOT NULL")
    results = F.transform(F.filter("brand_usp", lambda c: c != ""), lambda c: claim_result(c, F.col("n100")))
    n = F.col("n100")
    rows = rows.withColumn("claims", results).withColumn("oil", primary_oil(F.col("ingredients")))
    rows = rows.withColumn("deviation_pct", energy_deviation_pct(n["energy_kcal"], energy_kcal(n["carbohydrate_g"], n["protein_g"], n["total_fat_g"]))).withColumn("sat_pct", sat_fat_pct(n["saturated_fat_g"], n["total_fat_g"]))
    any_fail = F.exists("claims", lambda c: c["status"] == "fail")
    return rows.select("sheet", "name", "claims", "deviation_pct", "oil", "sat_pct", verdict(any_fail, F.col("sat_pct") > F.col("oil.max_pct"), F.col("deviation_pct") > ENERGY_TOLERANCE_PCT, n["sodium_mg"] > SODIUM_LIMIT_MG).alias("verdict"))


def serving_factor(serving: Column) -> Column:
    """What a value per 100 g is multiplied with to be one per serving."""
    return serving / F.lit(100.0)


def signed_deviation_pct(got: Column, expected: Column) -> Column:
    """Percent that a value lies above (or, below 0, under) what is expected, to one place; null if that is 0."""
    return F.when(expected != 0, round_half_up((got - expected) / F.abs(expected) * 100, 1))


def rda_at_serving(serving: Column, rda: Column, field: str) -> Column:
    """The value of the block nearest to a serving, scaled to it; unscaled where the block has no grammage."""
    near = nearest_block(serving, F.filter(rda, lambda r: r[field].isNotNull()), "grammage")
    return near[field] * F.when(near["grammage"] > 0, serving / near["grammage"]).otherwise(1.0)


def nutrition_text(blocks: Column) -> Column:
    """Blocks (grammage, values of (label, value, unit)) in words, without the values that are null."""
    said = lambda v: F.when(v["value"].isNotNull(), F.concat(v["label"], F.lit(" "), number_text(v["value"]), F.lit(" "), v["unit"]))
    block = lambda b: F.concat(F.lit("per "), number_text(b["grammage"]), F.lit("g: "), F.array_join(F.transform(b["values"], said), ", "))
    return F.array_join(F.transform(blocks, block), " | ")


def claim_matrix(products: DataFrame, key: list[str], bases: dict[str, str], claims: str = "brand_usp") -> DataFrame:
    """(key, pos, claim) with the status and the actual value of each claim by every basis: name -> column of nutrition values."""
    rows = products.select(*key, *bases.values(), F.posexplode(F.filter(claims, lambda c: c != "")).alias("pos", "claim"))
    for name, values in bases.items():
        rows = rows.withColumn(f"_{name}", claim_result(F.col("claim"), F.col(values)))
    return rows.select(*key, "pos", "claim", *(F.col(f"_{n}.{f}").alias(f"{n}_{f}") for n in bases for f in ("status", "actual")))
