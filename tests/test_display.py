import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.functions import display
from larder.functions.distance import WordTrie, osa
from larder.operators import audit, briefs, checks, market
from larder.sources import products as sheets
from larder.sources.schema import SHEET_COLUMNS


def test_numbers(spark):
    rows = spark.createDataFrame([(0.125,), (12.0,), (1234567.5,), (-0.25,), (None,)], "x double")
    got = rows.select(display.decimal_text(F.col("x"), 2), display.rupees(F.col("x")), display.percent(F.col("x")), display.amount(F.col("x"), "g")).collect()
    assert [tuple(r) for r in got] == [
        ("0.13", "₹0.13", "0.1%", "0.13g"), ("12.00", "₹12.00", "12.0%", "12g"), ("1234567.50", "₹1234567.50", "1234567.5%", "1234567.5g"), ("-0.25", "₹-0.25", "-0.3%", "-0.25g"), (None, None, None, "—"),
    ]


def test_sizes_and_ages(spark):
    sizes = spark.createDataFrame([(0,), (1499,), (999_999,), (1_000_000,), (2_550_000,)], "n long").select(display.file_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["0 KB", "1 KB", "1000 KB", "1.0 MB", "2.6 MB"]
    now = dt.datetime(2024, 3, 1, 12)
    ages = [dt.timedelta(seconds=s) for s in (-5, 59, 60, 3599, 3600, 86399, 86400, 40 * 86400)]
    got = spark.createDataFrame([(now - a, now) for a in ages], "then timestamp, now timestamp").select(display.age(F.col("then"), F.col("now"))).collect()
    assert [r[0] for r in got] == ["just now", "just now", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "40d ago"]


def test_brief_comes_back_as_a_report(spark):
    row = ("Oat bar", 40.0, None, " new\n\n design ", ["Baked", "No sugar"], "x" * 501, "", "Milk", "y" * 300)
    rows = spark.createDataFrame([row, (None,) * 9], "product_name string, pack_size_g double, expected_mrp double, version string, usps array<string>, ingredients string, nutrition_text string, allergens string, manufacturer string")
    full, empty = [r["brief"] for r in briefs.with_brief(rows).orderBy(F.desc("product_name")).collect()]
    lines = full.split("\n")
    assert lines[1] == "Product: Oat bar | Pack: 40g | Price: not provided"
    assert lines[2:8] == ["Label version: new design", "Claims: Baked | No sugar", f"Ingredients: {'x' * 500}...", "Nutrition: Not provided", "Allergens: Milk", f"Manufacturer: {'y' * 300}"]
    assert "Product:  | Pack: unknowng" in empty and "Claims: Not provided" in empty
    asked = checks.coerce_report(spark.createDataFrame([("a", lines[-1])], "id string, reply string"), "id", "reply").collect()
    assert [(r["step"], r["label"], r["sop_rule"]) for r in asked] == [(n, label, sop) for n, label, _, sop in briefs.ASKED]
    assert {r["status"] for r in asked} == {"warn"} and [r["expected"] for r in asked if r["step"] == 8] == ["Serving <= 40g"]


def test_result_headline(spark):
    shape = "id int, competitors array<string>, market_summary struct<avg_price:double,sentiment_breakdown:struct<positive:int>,white_space:array<string>>"
    rows = spark.createDataFrame([(1, ["a", "b"], (9.0, (60,), ["x"])), (2, None, None), (3, [], (0.0, None, None))], shape)
    assert [tuple(r) for r in market.result_headline(rows).orderBy("id").collect()] == [(1, 2, 9.0, 60, 1), (2, 0, None, None, 0), (3, 0, 0.0, None, 0)]


def test_tabs(spark, tmp_path):
    rows = sheets.numbered(spark.createDataFrame([tuple(f"{c}{i}" for c in SHEET_COLUMNS) for i in range(3)], list(SHEET_COLUMNS)))
    sheets.write_tab(rows, str(tmp_path), 0, "Master")
    sheets.write_tab(rows.limit(1), str(tmp_path), 77, "Old 'tab'")
    assert sheets.tab_title(spark, str(tmp_path), 77) == "Old 'tab'"
    own = sheets.read_tab(spark, str(tmp_path), 0)
    assert own.count() == 3 and {r["tab"] for r in own.collect()} == {"Master"} and set(own.columns) == {*rows.columns, "tab"}
    with pytest.raises(ValueError, match="gid=5"):
        sheets.read_tab(spark, str(tmp_path), 5)


def test_unlike_words_equal_the_plain_way(spark):
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choices("abc", k=rng.randint(a, b)))
    rows = [([word(5, 9) for _ in range(6)], [word(2, 12) for _ in range(rng.randint(0, 4))]) for _ in range(120)] + [(None, ["ab"]), (["abcde"], None), (["powedr"], ["powder"])]

    def plain(ws, pool):
        alike = lambda w, t: t.startswith(w) or w.startswith(t) or osa(w, t, len(w) + len(t)) <= -(-len(w) * 9 // 20)
        return [w for w in ws or [] if not any(alike(w, t) for t in pool or [])]

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ws array<string>, pool array<string>")
    got = [list(r[0]) for r in df.orderBy("i").select(audit.unlike_words(F.col("ws"), F.col("pool"))).collect()]
    assert got == [plain(*r) for r in rows]
    assert WordTrie(["powder"]).has_start("pow") and not WordTrie(["powder"]).has_start("powders")
