"""The product library: rows folded to products, searches, counts, pack options, vocabulary and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import number_text, num, num_or_null, positive
from larder.functions.text import mrp_entries, split_list, words
from larder.sources import ordinals
from larder.sources.products import product_rows
from larder.sources.schema import NUTRIENT_COLUMNS, NUTRITION_PRESENT, PCT_COLUMNS, PRODUCT_STATUSES, RDA_PRESENT, REQUIRED_NUTRIENTS, ROWNUM, SHEET_COLUMNS

# Words that any label may print.
GENERIC_WORDS = (
    "ingredients nutritional information energy protein carbohydrate carbohydrates total sugar added dietary fibre fiber saturated trans "
    "cholesterol sodium calcium serving approx contains flavours flavour flavouring nature identical substances permitted emulsifiers "
    "stabilizers preservatives antioxidants antioxidant sequestrant regulator acidity anticaking enhancer colours colour natural artificial "
    "manufactured marketed packed facility processes handles allergen allergens"
).split()


def _present(cols: tuple[str, ...]) -> Column:
    return F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in cols]) != ""


def _blocks(cols: tuple[str, ...], present: tuple[str, ...], required: frozenset[str]) -> Column:
    fields = [num(F.col(c)).alias(c) if c in required else num_or_null(F.col(c)).alias(c) for c in cols]
    block = F.struct(num(F.col("grammage")).alias("grammage"), F.col(ROWNUM).alias(ROWNUM), *fields)
    return F.array_sort(F.collect_list(F.when(_present(present), block)))


def _without_rownum(name: str, cols: tuple[str, ...]) -> Column:
    return F.transform(name, lambda b: F.struct(b["grammage"].alias("grammage"), *[b[c].alias(c) for c in cols])).alias(name)


def group_fold(rows: DataFrame) -> DataFrame:
    """Sheet rows to one product for each (sheet, name): the first row's fields, blocks sorted by grammage, ``id`` by first appearance."""
    first = F.min_by(F.struct(*[c for c in SHEET_COLUMNS if c not in ("sheet", "name")]), ROWNUM).alias("f")
    kept = rows.filter("sheet <> '' AND name <> ''")
    groups = kept.groupBy("sheet", "name").agg(first, _blocks(NUTRIENT_COLUMNS, NUTRITION_PRESENT, REQUIRED_NUTRIENTS).alias("nutrition"), _blocks(PCT_COLUMNS, RDA_PRESENT, frozenset()).alias("rda"), F.min(ROWNUM).alias("_first"))
    groups = ordinals.ordinal(groups, ["_first"], "_ord").withColumn("_ord", F.col("_ord").cast("int"))
    slug = F.lower(F.regexp_replace(F.substring("name", 1, 20), r"\s+", "-"))
    f = lambda c: F.col(f"f.{c}")
    return groups.select(
        F.concat_ws("-", "sheet", F.col("_ord").cast("string"), slug).alias("id"), "name", "sheet",
        split_list(f("brand_usp")).alias("brand_usp"), f("ingredients").alias("ingredients"),
        _without_rownum("nutrition", NUTRIENT_COLUMNS), _without_rownum("rda", PCT_COLUMNS),
        num(f("serving_size_g")).alias("serving_size_g"), f("allergens").alias("allergens"), f("shelf_life").alias("shelf_life"),
        num_or_null(f("small_pack_g")).alias("small_pack_g"), num_or_null(f("large_pack_g")).alias("large_pack_g"),
        f("manufacturer").alias("manufacturer"), f("mrp").alias("mrp"),
        F.when(f("status").isin(*PRODUCT_STATUSES), f("status")).otherwise("not_launched").alias("status"),
        F.lit(False).alias("hasCustomNutrition"), "_ord",
    )


def search(products: DataFrame, term: str = "", categories: list[str] | None = None) -> DataFrame:
    """Products whose name or any claim holds the term in any case, of the given categories (none: all)."""
    t = F.lit(term.lower())
    found = products.filter(F.contains(F.lower("name"), t) | F.exists("brand_usp", lambda u: F.contains(F.lower(u), t))) if term else products
    return found.filter(F.col("sheet").isin(categories)) if categories else found


def pick(products: DataFrame, term: str, n: int = 20) -> DataFrame:
    """The first n products whose name holds the term."""
    return products.filter(F.contains(F.lower("name"), F.lit(term.lower()))).orderBy("_ord").limit(n)


def category_counts(rows: DataFrame, col: str, order: str) -> DataFrame:
    """Rows by category with the first place of each."""
    return rows.groupBy(col).agg(F.count("*").alias("n"), F.min(order).alias("first_at"))


def pack_options(products: DataFrame) -> DataFrame:
    """(sheet, name, grams, price, source): price list packs, then pack fields, nutrition blocks only if there are none of those."""
    key = ["sheet", "name"]
    mrp = F.transform(mrp_entries(F.col("mrp")), lambda e, i: F.struct(e["grams"].alias("grams"), F.lit(0).alias("prio"), i.alias("i"), e["price"].alias("price")))
    packs = F.transform(F.filter(F.array("small_pack_g", "large_pack_g"), lambda g: g != 0), lambda g, i: F.struct(g.alias("grams"), F.lit(1).alias("prio"), i.alias("i"), F.lit(None).cast("double").alias("price")))
    blocks = F.transform(F.filter("nutrition", lambda b: b["grammage"] > 0), lambda b, i: F.struct(b["grammage"].alias("grams"), F.lit(2).alias("prio"), i.alias("i"), F.lit(None).cast("double").alias("price")))
    own = F.concat(mrp, packs)
    rows = products.select(*key, F.explode(F.when(F.size(own) > 0, own).otherwise(blocks)).alias("o")).select(*key, "o.*")
    best = rows.groupBy(*key, "grams").agg(F.min_by(F.struct("price", "prio"), F.struct("prio", "i")).alias("b"))
    return best.select(*key, "grams", F.col("b.price").alias("price"), F.element_at(F.array(F.lit("mrp"), F.lit("pack"), F.lit("nutrition")), F.col("b.prio") + 1).alias("source"))


def default_pack(options: DataFrame) -> DataFrame:
    """The least pack with a price, else the least pack."""
    return options.groupBy("sheet", "name").agg(F.min_by(F.struct("grams", "price", "source"), F.struct(F.col("price").isNull(), "grams")).alias("pack"))


def vocabulary(products: DataFrame) -> DataFrame:
    """(term, ord): generic words and the words of 3 or more letters of all products, in order of first use."""
    spark = products.sparkSession
    text = F.concat_ws(" ", "name", "ingredients", "allergens", F.concat_ws(" ", "brand_usp"))
    own = products.select("_ord", F.posexplode(words(text)).alias("pos", "term")).filter(F.col("term").rlike("^[a-z]{3,}$")).groupBy("term").agg(F.min(F.struct(F.col("_ord") + 1, "pos")).alias("at"))
    generic = spark.createDataFrame([(w, i) for i, w in enumerate(GENERIC_WORDS)], "term string, pos int").select("term", F.struct(F.lit(0).alias("col1"), "pos").alias("at"))
    merged = own.select("term", F.struct(F.col("at.col1").cast("long").alias("a"), F.col("at.pos").alias("pos")).alias("at")).unionByName(generic.select("term", F.struct(F.col("at.col1").cast("long").alias("a"), F.col("at.pos").alias("pos")).alias("at")))
    return merged.groupBy("term").agg(F.min("at").alias("at")).select("term", (F.col("at.a") * 1_000_000 + F.col("at.pos")).alias("ord"))


def set_status(rows: DataFrame, sheet: str, name: str, status: str) -> DataFrame:
    """All rows of a product with a new status."""
    if status not in PRODUCT_STATUSES:
        raise ValueError(f"unknown status: {status}")
    mine = (F.col("sheet") == sheet) & (F.col("name") == name)
    return rows.withColumn("status", F.when(mine, status).otherwise(F.col("status")))


def append_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Sheet rows with new products behind them, as not launched."""
    return rows.unionByName(_behind(rows, products.withColumn("status", F.lit("not_launched")), ["sheet", "name"]))


def _behind(rows: DataFrame, products: DataFrame, key: list[str]) -> DataFrame:
    """Sheet rows of products, numbered behind those of ``rows`` in order of the key: a row for each nutrition block."""
    last = rows.agg(F.coalesce(F.max(ROWNUM), F.lit(-1))).first()[0]
    ahead = ordinals.running_sum(products, key, F.size("nutrition"), "_ahead")
    return product_rows(ahead, F.lit(last + 1).cast("bigint") + F.col("_ahead"))


def replace_nutrition(rows: DataFrame, override: DataFrame) -> DataFrame:
    """Products of ``override`` (sheet, name, nutrition, rda; blocks required) lose their rows and get new ones behind all others."""
    key = ["sheet", "name"]
    some = override.filter(F.size("nutrition") > 0)
    first = rows.join(some.select(*key), key, "left_semi").groupBy(*key).agg(F.min_by(F.struct(*[c for c in SHEET_COLUMNS if c not in key]), ROWNUM).alias("f"))
    base = first.select(*key, split_list(F.col("f.brand_usp")).alias("brand_usp"), *[F.col(f"f.{c}").alias(c) for c in ("ingredients", "serving_size_g", "allergens", "shelf_life", "small_pack_g", "large_pack_g", "manufacturer", "mrp", "status")])
    base = base.withColumns({"serving_size_g": num(F.col("serving_size_g")), "small_pack_g": num_or_null(F.col("small_pack_g")), "large_pack_g": num_or_null(F.col("large_pack_g"))})
    base = base.withColumn("status", F.when(F.col("status").isin(*PRODUCT_STATUSES), F.col("status")).otherwise("not_launched"))
    return rows.join(some.select(*key), key, "left_anti").select(*rows.columns).unionByName(_behind(rows, base.join(some, key), key))


def request_errors(requests: DataFrame) -> DataFrame:
    """Requests (sheet, name, status, nutrition) with the list of what is wrong with each."""
    checks = (
        (F.coalesce(F.col("sheet"), F.lit("")) == "", "sheet is required"),
        (F.coalesce(F.col("name"), F.lit("")) == "", "name is required"),
        (F.col("status").isNotNull() & ~F.col("status").isin(*PRODUCT_STATUSES), "status is unknown"),
        (F.col("nutrition").isNotNull() & (F.size("nutrition") == 0), "at least one nutrition block is required"),
    )
    return requests.withColumn("errors", F.array_compact(F.array(*[F.when(c, m) for c, m in checks])))


def with_defaults(requests: DataFrame) -> DataFrame:
    """The serving size defaults to the first block's grammage, texts to blanks, lists to empty ones."""
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("ingredients", "allergens", "shelf_life", "manufacturer", "mrp")}
    first = F.get("nutrition", 0)["grammage"]
    return requests.withColumns({**texts, "serving_size_g": F.coalesce(F.col("serving_size_g"), first), "brand_usp": F.coalesce("brand_usp", F.array().cast("array<string>"))})


def set_cell(nutrition: Column, grammage: float, field: str, value: Column, fields: tuple[str, ...] = NUTRIENT_COLUMNS) -> Column:
    """The blocks with one cell of a pack size set; blank or unreadable text gives null."""
    new = lambda b, f: F.when(b["grammage"] == grammage, num_or_null(value)).otherwise(b[f]) if f == field else b[f]
    return F.transform(nutrition, lambda b: F.struct(b["grammage"].alias("grammage"), *[new(b, f).alias(f) for f in fields]))


def drop_block(nutrition: Column, grammage: float) -> Column:
    """The blocks without a pack size; the 100 g block always stays."""
    return F.filter(nutrition, lambda b: (b["grammage"] == 100) | (b["grammage"] != grammage))


def add_block(nutrition: Column, grammage: Column, fields: tuple[str, ...] = NUTRIENT_COLUMNS) -> Column:
    """The blocks with an empty one for a positive, new pack size, sorted by grammage."""
    g = positive(grammage)
    empty = F.struct(g.alias("grammage"), *[(F.lit(0.0) if f in REQUIRED_NUTRIENTS else F.lit(None).cast("double")).alias(f) for f in fields])
    known = F.exists(nutrition, lambda b: b["grammage"] == g)
    return F.when(g.isNull() | known, nutrition).otherwise(F.array_sort(F.concat(nutrition, F.array(empty))))


def align_rda(nutrition: Column, rda: Column) -> Column:
    """For each nutrition block the first RDA block of equal grammage, else an empty one."""

    def of(b: Column) -> Column:
        own = F.get(F.filter(rda, lambda r: r["grammage"] == b["grammage"]), 0)
        return F.struct(b["grammage"].alias("grammage"), *[own[c].alias(c) for c in PCT_COLUMNS])

    return F.transform(nutrition, of)


def pack_text(packs: Column, unit: str = "g") -> Column:
    """Pack sizes in words; those that are null or 0 aren't named."""
    return F.array_join(F.transform(F.filter(packs, lambda p: p > 0), lambda p: F.concat(number_text(p), F.lit(unit))), ", ")


def top_claims_text(claims: Column, most: int = 3) -> Column:
    """Struct (shown, more): the first few claims, and "N more" for the rest (null without a rest)."""
    rest = F.size(claims) - most
    return F.struct(F.slice(claims, 1, most).alias("shown"), F.when(rest > 0, F.concat(rest.cast("string"), F.lit(" more"))).alias("more"))
