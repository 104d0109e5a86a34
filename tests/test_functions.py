import random

import pytest
from pyspark.sql import functions as F

from larder.functions import distance, geometry, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("cell", "value"), [("12abc", 12.0), ("12d", 12.0), (" 3.5 g", 3.5), ("NaN", None), ("", None), ("-", None), (".5", 0.5), ("1e2x", 100.0), ("-4", -4.0)])
def test_number_prefix(spark, cell, value):
    assert one(spark, numbers.parse_float(F.lit(cell))) == value
    assert one(spark, numbers.num(F.lit(cell))) == (value or 0.0)


@pytest.mark.parametrize(("value", "shown"), [(10.0, "10"), (0.5, "0.5"), (1e7, "10000000"), (2.3456, "2.346"), (100.0, "100"), (-2.5, "-2.5")])
def test_number_text(spark, value, shown):
    assert one(spark, numbers.number_text(F.lit(value))) == shown


def test_rounding_goes_up(spark):
    assert one(spark, numbers.round_half_up(F.lit(-2.5))) == -2.0
    assert one(spark, numbers.round_half_up(F.lit(2.5))) == 3.0


def test_normalize(spark):
    assert one(spark, text.normalize(F.lit("  Jalapeño & Crème-brûlée  (50%) "))) == "jalapeno creme brulee 50"
    assert one(spark, text.words(F.lit("  "))) == []
    assert one(spark, text.has_phrase(F.lit("no palm oil"), F.lit("palm"))) is True
    assert one(spark, text.has_phrase(F.lit("no palmoil"), F.lit("palm"))) is False


@pytest.mark.parametrize(("cell", "value", "known"), [("ND<0.03g", 0.0, True), ("BLQ", 0.0, True), ("nil", 0.0, True), ("-", None, True), ("10.2 g", 10.2, True), ("10.2g", 10.2, True), ("abc", None, False), ("<0.5", 0.5, True)])
def test_cells(spark, cell, value, known):
    assert one(spark, text.is_cell(F.lit(cell))) is known
    assert one(spark, text.cell_value(F.lit(cell))) == value


@pytest.mark.parametrize(("token", "fixed"), [("10:2", "10.2"), ("Og", "0g"), ("Omg", "0mg"), ("12g", "12g")])
def test_ocr_fix(spark, token, fixed):
    assert one(spark, text.ocr_fix(F.lit(token))) == fixed


def test_ocr_alternatives(spark):
    assert one(spark, text.ocr_alternatives(F.lit("106"))) == ["1.06", "10.6"]
    assert one(spark, text.ocr_alternatives(F.lit("69"))) == ["6", "6.9"]
    assert one(spark, text.ocr_alternatives(F.lit("x"))) == []


@pytest.mark.parametrize(("cell", "packs"), [("80gm for 70/- (per gm 0.87/-)", [(80.0, 70.0)]), ("50 for 60g", [(60.0, 50.0)]), ("145 /-for 180g", [(180.0, 145.0)]), ("34gm-35/-", [(34.0, 35.0)]), ("60/- for 44 grams\n20g Rs. 10", [(44.0, 60.0), (20.0, 10.0)]), ("free", [])])
def test_price_lists(spark, cell, packs):
    assert [tuple(e) for e in one(spark, text.mrp_entries(F.lit(cell)))] == packs


def test_claims_split_outside_brackets(spark):
    assert one(spark, text.split_outside_brackets(F.lit("Vegan/Source of protein (3.85g/70g and 5.50g/100g)"), "/")) == ["Vegan", "Source of protein (3.85g/70g and 5.50g/100g)"]
    assert one(spark, text.absence_target(F.lit("No Maida"))) == "maida"
    assert one(spark, text.absence_target(F.lit("Trans fat free"))) == "trans fat"
    assert one(spark, text.made_with_target(F.lit("Made with Jaggery"))) == "jaggery"


def plain_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 3))
    def agrees(a, b, most):
        assert distance.osa(a, b, most) == min(plain_osa(a, b), most + 1)

    agrees()
    assert distance.osa("abcd", "acbd", 2) == 1
    assert distance.osa("ca", "abc", 3) == 3


def test_osa_column(spark):
    rows = spark.createDataFrame([("abcd", "acbd"), ("milk", "mi1k"), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(distance.osa_distance(F.col("a"), F.col("b"), 2)).collect()] == [1, 1, None]


def test_anchored_clusters(spark):
    items = F.array(*[F.struct(F.lit(float(y)).alias("y")) for y in (10, 8, 7.4, 5, 3)])
    assert [c["cluster"] for c in one(spark, geometry.anchored_clusters(items, "y", 2.5))] == [1, 1, 2, 2, 3]
    assert one(spark, geometry.upper_median(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2)))) == 3
    assert one(spark, geometry.upper_median(F.array().cast("array<int>"))) is None


def test_osa_pairs_equal_all_pairs(spark):
    import random

    from larder.functions.distance import osa
    from larder.operators.matching import deletions, osa_pairs

    rng = random.Random(9)
    words = sorted({"a" + "".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(60)} | {"", "b", "ca", "abc", "ba"})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(r) for r in osa_pairs(frame, frame.withColumnRenamed("word", "near"), "word", "near").collect()}
    assert got == {(a, b, osa(a, b, 2)) for a in words for b in words if a[:1] == b[:1] and osa(a, b, 2) <= 2}
    keys = spark.createDataFrame([("abc",), ("",)], "w string").select(deletions(F.col("w"), 2)).collect()
    assert sorted(keys[0][0]) == ["a", "ab", "abc", "ac", "b", "bc", "c"] and keys[1][0] == [""]


def test_splits_outside_brackets_equal_a_plain_fold(spark):
    def plain(s):
        depth, parts = 0, [""]
        for ch in s:
            depth = depth + 1 if ch in "([" else max(depth - 1, 0) if ch in ")]" else depth
            if ch == "," and not depth:
                parts.append("")
            else:
                parts[-1] += ch
        return parts

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab,,()[] ") for _ in range(rng.randrange(14))) for _ in range(600)] + ["", "a,", "(a,b),c", "((a),b),c", "a),b(,c", "(a,[b),c],d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.split_outside_brackets(F.col("t"), ",").alias("parts"))
    assert [r.parts for r in df.collect()] == [plain(t) for t in texts]
    assert "CASE WHEN NOT RLIKE(regexp_replace" in df._jdf.queryExecution().optimizedPlan().toString()  # texts without nested brackets skip the fold
