from pyspark.sql import functions as F

from larder.operators import claims, market, matching, products


def test_listings(spark):
    rows = spark.createDataFrame([(None, 0, "a", 50.0, "200 g"), ("x", 1, "b", 30.0, None)], "id string, ord int, platform string, price double, pack_size string")
    assert [(r["id"], r["price_per_100g"]) for r in market.enrich(rows).orderBy("ord").collect()] == [("real_0", 25.0), ("x", None)]
    assert market.headline(rows).first().asDict() == {"competitors": 2, "avg_price": 40.0, "min_price": 30.0, "max_price": 50.0, "positive": 60, "neutral": 20, "negative": 20, "white_space": 0}
    assert market.of_platform(rows, "b").count() == 1 and market.of_platform(rows).count() == 2
    scores = spark.createDataFrame([(4.0,), (3.5,), (1.0,)], "s double").select(market.band(F.col("s")).alias("b")).collect()
    assert [r["b"] for r in scores] == ["strong", "moderate", "weak"]


def test_history_and_requests(spark):
    past = spark.createDataFrame([(i, f"k{i}") for i in range(12)], "ts long, keyword string")
    assert [r["ts"] for r in market.history(past, past.limit(0)).collect()] == list(range(11, 1, -1))
    asked = spark.createDataFrame([("oats", None, ""), (" ", "c", "r"), (None, "c", "r"), ("bar", "c", "r")], "keyword string, category string, region string")
    assert sorted(tuple(r) for r in market.search_request(asked).collect()) == [("bar", "c", "r"), ("oats", "Healthy Snacks", "Pan India")]


def test_texts(spark):
    one = spark.range(1)
    got = one.select(products.pack_text(F.array(F.lit(50.0), F.lit(0.0), F.lit(None), F.lit(12.5))).alias("p"), products.top_claims_text(F.array(*map(F.lit, "abcde"))).alias("c"), products.top_claims_text(F.array(F.lit("a"))).alias("d")).first()
    assert got["p"] == "50g, 12.5g" and got["c"]["shown"] == ["a", "b", "c"] and got["c"]["more"] == "2 more" and got["d"]["more"] is None


def test_serving_and_deviation(spark):
    rda = F.array(F.struct(F.lit(30.0).alias("grammage"), F.lit(6.0).alias("pct")), F.struct(F.lit(0.0).alias("grammage"), F.lit(9.0).alias("pct")))
    got = spark.range(1).select(claims.rda_at_serving(F.lit(40.0), rda, "pct").alias("a"), claims.rda_at_serving(F.lit(5.0), rda, "pct").alias("b"), claims.signed_deviation_pct(F.lit(9.0), F.lit(-10.0)).alias("c"), claims.signed_deviation_pct(F.lit(9.0), F.lit(0.0)).alias("d")).first()
    assert (got["a"], got["b"], got["c"], got["d"]) == (8.0, 9.0, 190.0, None)


def test_rules_in_a_list(spark):
    rows = spark.createDataFrame([("a green b",), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(matching.first_rule_in_list(F.col("t"), [("green", "cool"), ("b", "late")], "rest")).collect()] == ["cool", "rest", "rest"]
