import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from larder.operators import claims, products
from larder.sources.products import numbered, product_rows
from larder.sources.schema import ROWNUM, SHEET_COLUMNS


def sheet(spark, rows):
    full = [tuple({**dict.fromkeys(SHEET_COLUMNS, ""), **r}[c] for c in SHEET_COLUMNS) + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in SHEET_COLUMNS) + f", {ROWNUM} long")


@pytest.fixture(scope="module")
def rows(spark):
    return sheet(
        spark,
        [
            {"sheet": "Snacks", "name": "Ragi  Chips", "brand_usp": "Source of Protein | No Maida |", "grammage": "100", "energy_kcal": "440", "protein_g": "6.0", "carbohydrate_g": "60", "total_fat_g": "20", "saturated_fat_g": "4", "sodium_mg": "500", "energy_pct": "22", "status": "launched", "mrp": "80gm for 70/-", "small_pack_g": "34", "ingredients": "Ragi, sunflower oil, rice bran oil", "serving_size_g": "30g"},
            {"sheet": "Snacks", "name": "Ragi  Chips", "brand_usp": "ignored", "grammage": "30", "energy_kcal": "132", "status": "under_review"},
            {"sheet": "Bars", "name": "Oat Bar", "status": "odd", "grammage": "100", "protein_g": "0"},
            {"sheet": "", "name": "keyless"},
            {"sheet": "Snacks", "name": "Ragi  Chips", "grammage": "30", "energy_kcal": "133", "energy_pct": "7"},
        ],
    )


def test_group_fold(rows):
    got = {r["name"]: r for r in products.group_fold(rows).collect()}
    chips = got["Ragi  Chips"]
    assert chips["id"] == "Snacks-0-ragi-chips" and got["Oat Bar"]["id"] == "Bars-1-oat-bar"
    assert [b["grammage"] for b in chips["nutrition"]] == [30.0, 30.0, 100.0] and [b["energy_kcal"] for b in chips["nutrition"]] == [132.0, 133.0, 440.0]
    assert chips["brand_usp"] == ["Source of Protein", "No Maida"] and chips["status"] == "launched" and chips["serving_size_g"] == 30.0
    assert got["Oat Bar"]["status"] == "not_launched" and len(got["Oat Bar"]["nutrition"]) == 1 and got["Oat Bar"]["rda"] == []
    assert chips["nutrition"][0]["protein_g"] == 0.0 and chips["nutrition"][0]["sodium_mg"] is None


def test_fold_does_not_depend_on_partitions(rows):
    assert {str(r) for r in products.group_fold(rows.repartition(7)).collect()} == {str(r) for r in products.group_fold(rows.coalesce(1)).collect()}


def test_search_and_counts(rows):
    p = products.group_fold(rows)
    assert [r["name"] for r in products.search(p, "MAIDA").collect()] == ["Ragi  Chips"]
    assert products.search(p).count() == 2 and products.search(p, "", ["Bars"]).count() == 1
    assert {r["sheet"]: r["n"] for r in products.category_counts(p, "sheet", "_ord").collect()} == {"Snacks": 1, "Bars": 1}


def test_pack_options(rows):
    p = products.group_fold(rows)
    options = products.pack_options(p)
    assert sorted((r["name"], r["grams"], r["price"], r["source"]) for r in options.collect()) == [("Oat Bar", 100.0, None, "nutrition"), ("Ragi  Chips", 34.0, None, "pack"), ("Ragi  Chips", 80.0, 70.0, "mrp")]
    assert {r["name"]: r["pack"]["grams"] for r in products.default_pack(options).collect()} == {"Oat Bar": 100.0, "Ragi  Chips": 80.0}


def test_writes(rows):
    p = products.group_fold(rows)
    again = products.group_fold(products.append_products(rows, p.filter("name = 'Oat Bar'").withColumn("name", F.lit("New Bar"))))
    assert {r["name"]: r["status"] for r in again.collect()}["New Bar"] == "not_launched"
    assert set(products.set_status(rows, "Bars", "Oat Bar", "launched").filter("name = 'Oat Bar'").select("status").collect()) == {Row(status="launched")}
    with pytest.raises(ValueError):
        products.set_status(rows, "Bars", "Oat Bar", "gone")
    override = p.filter("name = 'Ragi  Chips'").select("sheet", "name", F.slice("nutrition", 1, 1).alias("nutrition"), "rda")
    new = products.replace_nutrition(rows, override)
    mine = new.filter("name = 'Ragi  Chips'").collect()
    assert len(mine) == 1 and mine[0]["energy_kcal"] == "132" and mine[0][ROWNUM] == 5 and mine[0]["brand_usp"] == "Source of Protein | No Maida" and mine[0]["energy_pct"] == "7"
    assert products.replace_nutrition(rows, override.withColumn("nutrition", F.slice("nutrition", 1, 0))).count() == rows.count()


def test_round_trip(rows):
    p = products.group_fold(rows)
    back = numbered(product_rows(p))
    assert back.filter("sheet = 'Snacks'").count() == 3 and back.filter("grammage = '100' AND name = 'Ragi  Chips'").first()["protein_g"] == "6"


def test_vocabulary(rows):
    terms = {r["term"]: r["ord"] for r in products.vocabulary(products.group_fold(rows)).collect()}
    assert terms["ingredients"] == 0 and "ragi" in terms and "a" not in terms


def test_block_edits(rows):
    p = products.group_fold(rows).filter("name = 'Ragi  Chips'")
    grams = lambda c: [b["grammage"] for b in p.select(c.alias("c")).first()["c"]]
    assert grams(products.drop_block(F.col("nutrition"), 30.0)) == [100.0] and grams(products.drop_block(F.col("nutrition"), 100.0)) == [30.0, 30.0, 100.0]
    assert grams(products.add_block(F.col("nutrition"), F.lit("50"))) == [30.0, 30.0, 50.0, 100.0] and len(grams(products.add_block(F.col("nutrition"), F.lit("-1")))) == 3
    assert p.select(products.set_cell(F.col("nutrition"), 100.0, "sodium_mg", F.lit("x")).alias("c")).first()["c"][2]["sodium_mg"] is None


def test_claims(spark, rows):
    got = claims.compliance(products.group_fold(rows)).filter("name = 'Ragi  Chips'").first()
    assert [(c["claim"], c["type"], c["status"], c["threshold"]) for c in got["claims"]] == [("Source of Protein", "nutrient", "pass", ">= 5.4g"), ("No Maida", "factual", "factual", None)]
    assert got["oil"]["name"] == "Sunflower Oil" and got["oil"]["others"] == ["Rice Bran Oil"] and got["sat_pct"] == 20.0
    assert got["verdict"] == "NON_COMPLIANT"


def test_claim_matrix(rows):
    found = products.group_fold(rows).filter("name = 'Ragi  Chips'").withColumn("n100", claims.block_at_100g(F.col("nutrition"))).withColumn("label", F.col("n100").withField("protein_g", F.lit(1.0)))
    got = claims.claim_matrix(found, ["name"], {"master": "n100", "label": "label"}).orderBy("pos").collect()
    assert [(r["pos"], r["claim"], r["master_status"], r["label_status"]) for r in got] == [(0, "Source of Protein", "pass", "fail"), (1, "No Maida", "factual", "factual")]


@pytest.mark.parametrize(("claim", "status", "threshold"), [("Source of Fibre", "pass", ">= 3g"), ("Protein", "fail", ">= 10.8g"), ("Low Calorie", "pass", "<= 40 kcal"), ("Tasty", "custom", None)])
def test_claim_rules(spark, claim, status, threshold):
    block = F.struct(F.lit(3.0).alias("dietary_fibre_g"), F.lit(None).cast("double").alias("protein_g"), F.lit(0.0).alias("calcium_mg"), F.lit(39.0).alias("energy_kcal"))
    got = spark.range(1).select(claims.claim_result(F.lit(claim), block).alias("r")).first()["r"]
    assert (got["status"], got["threshold"]) == (status, threshold)


def test_rda_scaling(spark):
    rda = F.array(F.struct(F.lit(100.0).alias("grammage"), F.lit(10.0).alias("energy_pct")), F.struct(F.lit(30.0).alias("grammage"), F.lit(None).cast("double").alias("energy_pct")))
    row = spark.range(1).select(claims.rda_for(F.lit(30.0), rda, "energy_pct").alias("a"), claims.rda_for(F.lit(100.2), rda, "energy_pct").alias("b")).first()
    assert (row["a"]["pct"], row["a"]["calculated"], row["b"]["pct"], row["b"]["calculated"]) == (3.0, True, 10.0, False)


def test_per_100g(spark):
    got = spark.range(1).select(claims.to_per_100g(F.create_map(F.lit("energy_kcal"), F.lit(120.0), F.lit("sodium_mg"), F.lit(None).cast("double")), F.lit(30.0)).alias("m")).first()["m"]
    assert got["energy_kcal"] == 400.0 and got["protein_g"] == 0.0 and "sodium_mg" not in got


def test_requests(spark):
    rows = spark.createDataFrame([("a", "b", None, None), ("", "b", "odd", [])], "sheet string, name string, status string, nutrition array<int>")
    assert [len(r["errors"]) for r in products.request_errors(rows).collect()] == [0, 3]
