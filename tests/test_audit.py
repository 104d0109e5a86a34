import pytest
from pyspark.sql import functions as F

from larder.operators import audit, checks, labels, market, matching
from larder.sources import labels as label_source
from larder.sources.schema import NUTRIENT_COLUMNS

LINES = [
    "Ragi Chips",
    "Source of Protein   Not Fried   Roasted",
    "Net Wt: 80g   MRP Rs. 70/- (Rs 0.88 per g)   Serving size: 30g",
    "Ingredients: Ragi flour, rice flour, sunflower oil, salt.",
    "Allergen: Contains gluten.",
    "Energy (kcal)|440",
    "Protein (g)|6.1",
    "Total Fat (g)|20",
    "Manufactured by Acme Foods Pvt Ltd, Pune 411001. Lic. No. 12345678901234",
]


def items_of(lines, label="L1", start=700.0):
    out = []
    for i, line in enumerate(lines):
        for k, part in enumerate(line.split("|")):
            out.append((label, len(out), part, 20.0 + 60 * k, start - 30 * i, 5.0 * len(part) if k == 0 and "|" not in line else 55.0, 8.0, 1, False))
    return out


def reference(spark, **over):
    base = {"label_id": "L1", "product_name": "Ragi Chips", "usps": ["Source of Protein", "No Maida", "Roasted"], "ingredients": "Ragi flour, rice flour, sunflower oil, salt.", "allergens": "Contains gluten.", "manufacturer": "Acme Foods Pvt Ltd,\nPune 411001", "nutrition": [{**dict.fromkeys(NUTRIENT_COLUMNS), "grammage": 100.0, "energy_kcal": 440.0, "protein_g": 6.1, "total_fat_g": 25.0, "sodium_mg": 100.0}], "pack_size_g": 80.0, "expected_mrp": 70.0} | over
    block = "struct<grammage:double," + ",".join(f"{c}:double" for c in NUTRIENT_COLUMNS) + ">"
    rows = [(base["label_id"], base["product_name"], base["usps"], base["ingredients"], base["allergens"], base["manufacturer"], [tuple([b["grammage"], *(b[c] for c in NUTRIENT_COLUMNS)]) for b in base["nutrition"]], base["pack_size_g"], base["expected_mrp"])]
    return spark.createDataFrame(rows, f"label_id string, product_name string, usps array<string>, ingredients string, allergens string, manufacturer string, nutrition array<{block}>, pack_size_g double, expected_mrp double")


@pytest.fixture(scope="module")
def report(spark):
    items = spark.createDataFrame(items_of(LINES), "label_id string, ord long, s string, x double, y double, w double, h double, page int, rotated boolean")
    heads = spark.createDataFrame([("L1", "pdf")], "label_id string, source string")
    return {(r["step"], r["label"]): r for r in audit.audit(items, heads, reference(spark)).collect()}


def test_text_steps(report):
    status = {k: r["status"] for k, r in report.items()}
    assert status[2, "Product name"] == "pass"
    assert status[3, "Claim: Source of Protein"] == "pass" and status[3, "Claim: No Maida"] == "warn"
    assert status[3, "Cooking method pairs with Not Fried"] == "pass"
    assert status[4, "Net weight"] == "pass" and status[4, "Net weight unit written consistently"] == "pass"
    assert status[5, "Description vs USPs"] == "skip"
    assert status[8, "Serving size vs pack size"] == "pass"
    assert status[9, "MRP value"] == "pass" and status[9, "Price per gram"] == "pass"


def test_ingredients(report):
    status = {k: r["status"] for k, r in report.items()}
    assert status[6, "Ingredients match the sheet"] == "pass" and status[6, "Ingredient order matches the sheet"] == "pass"
    assert status[6, "Ends with full stop"] == "pass" and status[6, "Casing: first letter capital, rest lowercase"] == "pass"
    assert status[6, "Allergen declaration"] == "pass"


def test_nutrition(report):
    status = {k: r["status"] for k, r in report.items()}
    assert status[7, "Energy"] == "pass" and status[7, "Protein"] == "pass" and status[7, "Total Fat"] == "fail" and status[7, "Sodium"] == "warn"
    assert report[7, "Total Fat"]["expected"] == "25g" and report[7, "Total Fat"]["found"] == "20g"
    assert status[7, "Nutrient names spelled correctly"] == "pass"


def test_addresses(report):
    status = {k: r["status"] for k, r in report.items()}
    assert status[10, "Manufacturer name"] == "pass" and status[10, "Pincode matches the sheet"] == "pass"
    assert status[10, "Full stop after pincode"] == "pass" and status[10, "FSSAI licence number is 14 digits"] == "pass"


def test_bad_label(spark):
    lines = ["Ragi Chip", "Net Wt: 90g  MRP Rs. 75/-", "Ingredients: Ragi FLOUR, salt", "net qty 90gm"]
    items = spark.createDataFrame(items_of(lines), "label_id string, ord long, s string, x double, y double, w double, h double, page int, rotated boolean")
    for source, casing in (("pdf", "fail"), ("ocr", "warn")):
        heads = spark.createDataFrame([("L1", source)], "label_id string, source string")
        status = {(r["step"], r["label"]): r["status"] for r in audit.audit(items, heads, reference(spark)).collect()}
        assert status[4, "Net weight"] == "fail" and status[4, "Net weight unit written consistently"] == "warn" and status[9, "MRP value"] == "fail"
        assert status[6, "Casing: first letter capital, rest lowercase"] == casing and status[7, "Nutrition table"] == "warn" and status[10, "Addresses"] == "skip"
        assert status[3, "USP claims"] == "skip"


def test_empty_label(spark):
    items = spark.createDataFrame([], "label_id string, ord long, s string, x double, y double, w double, h double, page int, rotated boolean")
    heads = spark.createDataFrame([("L1", "pdf")], "label_id string, source string")
    status = {(r["step"], r["label"]): r["status"] for r in audit.audit(items, heads, reference(spark)).collect()}
    assert status[2, "Product name"] == "fail" and status[6, "Ingredients list"] == "warn" and status[9, "MRP value"] == "warn"


def test_figures_spelling_and_table_beside(spark):
    block = {**dict.fromkeys(NUTRIENT_COLUMNS), "grammage": 100.0, "protein_g": 5.5}
    ref = reference(spark, usps=["1. Source of protein (5.50g/100g)/Vegan", "High protein (9g/100g)"], nutrition=[block])
    rows = items_of(["Ingredients: Ragi flour, sunflwer oil,", "salt."]) + [("L1", 90 + k, t, x, 700.0 - 30 * i, 60.0, 8.0, 1, False) for i in range(3) for k, (t, x) in enumerate([(["Energy", "Protein", "Sodium"][i], 300.0), ("5", 365.0)])]
    items = spark.createDataFrame(rows, "label_id string, ord long, s string, x double, y double, w double, h double, page int, rotated boolean")
    heads = spark.createDataFrame([("L1", "pdf")], "label_id string, source string")
    vocabulary = spark.createDataFrame([("sunflower", 0), ("flour", 1)], "term string, ord int")
    got = {(r["step"], r["label"]): r for r in audit.audit(items, heads, ref, vocabulary).collect()}
    assert got[3, "Claim figures: Source of protein"]["status"] == "pass" and got[3, "Claim figures: High protein"]["status"] == "warn"
    assert (got[6, "Ingredient spelling"]["status"], got[6, "Ingredient spelling"]["found"]) == ("fail", "sunflwer")
    assert "energy" not in (got[6, "No extra ingredients on the label"]["found"] if (6, "No extra ingredients on the label") in got else "")


def test_status_lattice(spark):
    rows = spark.createDataFrame([("a", 2, "skip"), ("a", 2, "pass"), ("a", 3, "warn"), ("b", 2, "warn"), ("b", 2, "fail")], "label_id string, step int, status string")
    assert {tuple(r) for r in checks.roll_up(rows, "label_id", "step").collect()} == {("a", 2, "pass"), ("a", 3, "warn"), ("b", 2, "fail")}
    assert {tuple(r) for r in checks.roll_up(checks.roll_up(rows, "label_id", "step"), "label_id").collect()} == {tuple(r) for r in checks.roll_up(rows, "label_id").collect()}
    assert checks.status_counts(rows, "label_id").filter("label_id = 'b'").first()["n_pass"] == 0
    assert spark.range(1).select(checks.status_of(F.lit(None).cast("int")).alias("s")).first()["s"] == "skip"


def test_external_report(spark):
    reply = 'Sure:\n{"steps": [{"step": 2, "checks": [{"label": " Name ", "status": "odd", "note": " "}, {"label": "B", "status": "pass", "sop_rule": true}]}, {"step": 3, "checks": []}]} done'
    from larder.functions.text import json_between_braces

    rows = spark.createDataFrame([("L", reply)], "id string, r string").withColumn("r", json_between_braces(F.col("r")))
    got = checks.coerce_report(rows, "id", "r").orderBy("seq").collect()
    assert [(r["step"], r["label"], r["status"], r["note"], r["sop_rule"]) for r in got] == [(2, "Name", "warn", None, False), (2, "B", "pass", None, True)]


def test_matching(spark):
    words = spark.createDataFrame([("giuten",), ("gluten",), ("sodium",), ("sodlum",)], "word string")
    vocab = spark.createDataFrame([("gluten", 0), ("sodium", 1)], "term string, ord int")
    assert {tuple(r) for r in matching.best_suggestion(words, vocab).collect()} == {("giuten", "gluten"), ("sodlum", "sodium")}
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert {tuple(r) for r in matching.priority_union(a, b, key=["k"]).collect()} == {(1, 0, "x"), (2, 1, "z")}


def test_market(spark):
    rows = spark.createDataFrame([("p", 100.0, ["a", "b"], 0), ("q", 0.0, ["b"], 1), ("p", 51.0, [], 2)], "platform string, price double, claims array<string>, ord long")
    assert tuple(market.price_summary(rows, F.col("price")).first()) == (76.0, 51.0, 100.0)
    assert [(r["claim"], r["n"]) for r in market.top_claims(rows, F.col("claims"), F.col("ord")).collect()] == [("b", 2), ("a", 1)]
    assert {tuple(r) for r in market.counts_with_total(rows, "platform").collect()} == {("p", 2), ("q", 1), ("All", 3)}


def test_label_sources(spark):
    raw = spark.createDataFrame([("L", 0, 1, "Hi", 5.0, None, [8.0, 0.0, 0.0, 8.0, 10.0, 20.0]), ("L", 1, 1, " ", 5.0, 8.0, [8.0, 0.0, 0.0, 8.0, 1.0, 2.0]), ("L", 2, 1, "up", 5.0, 8.0, [0.0, 8.0, -8.0, 0.0, 1.0, 2.0])], "label_id string, ord long, page int, str string, width double, height double, transform array<double>")
    got = label_source.text_items(raw).orderBy("ord").collect()
    assert [(r["s"], r["x"], r["h"], r["rotated"]) for r in got] == [("Hi", 10.0, 8.0, False), ("up", 1.0, 8.0, True)]
    frames = spark.createDataFrame([("w", t, s) for t, s in enumerate([[0.1, 0.9, 0.0], [0.1, 0.9, 0.0], [0.9, 0.1, 0.0], [0.1, 0.9, 0.0], [0.0, 0.2, 0.8]])], "k string, t int, scores array<double>")
    assert label_source.ctc_text(frames, ["k"], ["a", "b"]).first()["text"] == "aab"


def test_join_items(spark):
    items = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0).cast("long").alias("ord"), F.lit(s).alias("s"), F.lit(0.0).alias("y"), F.lit(w).alias("w"), F.lit(8.0).alias("h")) for x, s, w in ((0.0, "Ra", 10.0), (10.5, "gi", 10.0), (30.0, "chips", 20.0))])
    assert spark.range(1).select(labels.join_items(items).alias("t")).first()["t"] == "Ragi chips"


def test_segments(spark):
    text = "Pizza Sticks: Wheat flour, salt. Seasoning : Sugar (refined), mint) Dip: Oil."
    both = spark.range(1).select(audit.segments(F.lit(text), F.lit(False)).alias("a"), audit.segments(F.lit(text), F.lit(True)).alias("b"), audit.segments(F.lit("Salt, oil."), F.lit(False)).alias("c"), audit.segments(F.lit(" "), F.lit(True)).alias("d")).first()
    assert [tuple(x) for x in both["a"]] == [("Pizza Sticks", "Wheat flour, salt."), ("Seasoning", "Sugar (refined), mint) Dip: Oil.")]
    assert [tuple(x) for x in both["b"]] == [("Pizza Sticks", "Wheat flour, salt."), ("Seasoning", "Sugar (refined), mint)"), ("Dip", "Oil.")]
    assert [tuple(x) for x in both["c"]] == [(None, "Salt, oil.")] and both["d"] == []


def test_misread_allergens_by_brute_force(spark):
    from larder.functions.distance import osa

    texts = ["Contains giuten and mi1k", "milkcudmil", "contains wheta, soybaen", "alomnds", "eggs", "mil", "ilk", "nothing here", "xxmusttardxx", "walnu", "ssame cashew", "dairies, barely", "", "milksoybea"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", audit.allergen_groups(F.col("t"), F.lit(True)).alias("ocr"), audit.allergen_groups(F.col("t")).alias("plain")).collect():
        tokens = [w for w in "".join(c if c.isalnum() else " " for c in r["t"].lower()).split() if len(w) >= 4]
        run = "".join(c for c in r["t"].lower() if c.isalpha())
        want = {g for g, keys in audit.ALLERGEN_WORDS.items() for k in keys if any(osa(w, k, 1) <= 1 for w in tokens) or any(osa(run[i : i + len(k)], k, 1) <= 1 for i in range(max(len(run) - len(k) + 2, 0)))}
        assert set(r["ocr"]) == want | set(r["plain"]), r["t"]


def ingredient_checks(spark, ocr, label_list, label_allergens="Contains gluten.", allergens_near=None, sheet="Ragi flour, rice flour, sunflower oil, salt."):
    row = spark.createDataFrame([(ocr, sheet, label_list, "Contains gluten.", label_allergens, allergens_near)], "ocr boolean, ingredients string, label_list string, allergens string, label_allergens string, allergens_near string")
    return {c["label"]: c for c in audit.ingredients_step(row).first()["step6"]}


def test_ocr_ingredients(spark):
    text = "Ragi fl, rce flour, sunflower oil, slt."
    plain = ingredient_checks(spark, False, text, "Contains", "Contains giuten.")
    assert plain["Ingredients match the sheet"]["status"] == "fail" and plain["Allergen declaration"]["status"] == "fail"
    read = ingredient_checks(spark, True, text, "Contains", "Contains giuten.")
    assert (read["Ingredients match the sheet"]["status"], read["Ingredients match the sheet"]["found"]) == ("warn", "Read badly: rice, salt")
    assert "No extra ingredients on the label" not in read and read["Allergen declaration"]["status"] == "pass"


def test_component_full_stops(spark):
    got = ingredient_checks(spark, False, "Chips: Ragi flour, salt. Dip: Oil, Salt CONTAINS milk")
    assert got["Ends with full stop"]["found"] == "Missing after: Dip, the CONTAINS statement"
    assert got["Casing: first letter capital, rest lowercase"]["status"] == "warn" and "No extra ingredients on the label" not in got


def test_text_near(spark):
    places = [("Allergen: Contains", 20.0, 700.0), ("beside", 300.0, 700.0), ("wheat", 45.0, 686.0), ("and milk", 21.0, 672.0), ("Store in a dry place", 20.0, 658.0), ("soya", 20.0, 644.0)]
    items = spark.createDataFrame([("L1", i, t, x, y, 50.0, 8.0, 1, False) for i, (t, x, y) in enumerate(places)], "label_id string, ord long, s string, x double, y double, w double, h double, page int, rotated boolean")
    ctx = labels.context(items, spark.createDataFrame([("L1", "ocr")], "label_id string, source string"))
    at = labels.heading_at(F.col("rows"), "^allergen")
    got = ctx.select(labels.text_near(F.col("rows"), at, F.lit(250.0)).alias("near"), labels.block_under(F.col("rows"), at, 60.0, 7.0, F.lit(250.0)).alias("aligned")).first()
    assert got["near"] == "Allergen: Contains wheat and milk" and got["aligned"] == "Contains and milk"


def test_report_defaults(spark):
    replies = spark.createDataFrame([("a", '{"product": " ", "steps": [{"checks": [{"status": "fail"}]}, {"step": 4, "checks": []}]}'), ("b", '{"pack_size": "80 g"}'), ("c", "no json")], "id string, r string")
    ref = spark.createDataFrame([("a", "Chips", 70.5), ("b", "Dip", 0.0)], "label_id string, product_name string, pack_size_g double")
    assert [(r["step"], r["label"], r["status"]) for r in checks.coerce_report(replies, "id", "r").collect()] == [(0, "Check", "fail")]
    assert {tuple(r) for r in checks.report_header(replies, ref, "id", "r").collect()} == {("a", "Chips", "70.5g", "fail"), ("b", "Dip", "80 g", "skip"), ("c", None, "pack size not set", "skip")}


def plan_of(query):
    from larder.plans.queries import QUERIES

    def run(spark):
        return QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

    return run


@pytest.mark.parametrize("query", ["q75_weight_checks", "q78_address_checks"])
def test_checks_run_outside_of_lambdas(spark, query):
    assert "filter(array(" not in plan_of(query)(spark)


def test_only_nutrients_of_the_sheet_are_looked_up(spark):
    plan = plan_of("q77_nutrition_checks")(spark)
    assert "exists(cells" not in plan and plan.count("filter(cells") <= len(audit.NUTRIENTS) + 1


def test_names_of_an_address_are_normalised_once(spark):
    plan = plan_of("q78_address_checks")(spark)
    assert plan.count("AS _plain#") == plan.count("AS _unprinted#") == plan.count("AS _here#") == 1
