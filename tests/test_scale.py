"""Operators that must not hold a group, a page or a catalogue in one task, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import geometry
from larder.operators import clusters
from larder.operators.clusters import _anchors, anchored_groups, covered
from larder.plans.queries import QUERIES
from larder.sources import labels, ordinals
from larder.sources.schema import OCR_WORD_SCHEMA


def plain_clusters(values, tolerance):
    out, anchor, k = [], None, 0
    for v in values:
        if anchor is None or abs(anchor - v) > tolerance:
            anchor, k = v, k + 1
        out.append((anchor, k))
    return out


@pytest.mark.parametrize("down", [False, True])
def test_streamed_clusters_equal_the_fold(spark, down):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, round(rng.random() * 60, 1)) for i in range(900)] + [("c", -1, 5.0), ("n", 1, None), ("n", 2, 1.0), ("n", 3, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)
    order = [F.desc("v") if down else F.asc("v"), F.asc("i")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # clusters and groups run over batches
        got = {(r.g, r.i): (r.anchor, r.cluster) for r in anchored_groups(df, ["g"], order, "v", 2.5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for g in ("a", "b", None, "c"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2] if down else r[2], r[1]))
        want = plain_clusters([r[2] for r in own], 2.5)
        assert [got[g, r[1]] for r in own] == want
    assert got["n", 1] == got["n", 3] == (None, None) and got["n", 2] == (1.0, 1)
    assert anchored_groups(df.limit(0), ["g"], order, "v", 2.5).collect() == []


def test_anchors_at_the_edge_of_the_tolerance():
    rng = np.random.default_rng(1)
    for _ in range(50):
        at = np.sort(np.round(rng.random(30) * 3, 1))
        own, new, last = _anchors(at, 0.3, None)
        want = plain_clusters(at.tolist(), 0.3)
        assert own.tolist() == [a for a, _ in want] and np.cumsum(new).tolist() == [k for _, k in want] and last == want[-1][0]


def words(n, seed, side=100.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.random() * side, rng.random() * side
        out.append((f"L{i % 3}", i, rng.choice(["word", "--", "x9"]), rng.random() * 100, (x, y, x + rng.random() * 12, y + rng.random() * 9)))
    return out


def plain_merge(primary, secondary):
    def over(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return max(w, 0) * max(h, 0) > 0.2 * max((a[2] - a[0]) * (a[3] - a[1]), 1)

    new = [s for s in secondary if s[3] >= 70 and any(c.isalnum() for c in s[2]) and not any(p[0] == s[0] and over(s[4], p[4]) for p in primary)]
    return [*primary, *new]


def rows_of(df):
    return sorted((r.label_id, r.ord, r.text, r.confidence, tuple(r.bbox)) for r in df.collect())


def test_merged_words_equal_all_pairs(spark):
    a, b = words(240, 1), words(300, 2)
    b += b[:3] + [("L0", 900, "wide", 99.0, (-50.0, -50.0, 300.0, 300.0)), ("none", 901, "alone", 99.0, (0.0, 0.0, 1.0, 1.0))]
    first, second = spark.createDataFrame(a, OCR_WORD_SCHEMA), spark.createDataFrame(b, OCR_WORD_SCHEMA)
    assert rows_of(labels.merged_words(first, second)) == sorted(plain_merge(a, b))
    assert rows_of(labels.merged_words(first.limit(0), second)) == sorted(plain_merge([], b))


def test_a_page_of_many_words_gives_pairs_in_proportion(spark):
    made = {}
    for n in (2_000, 8_000):
        side = 10.0 * n**0.5
        page = spark.createDataFrame([("L", *w[1:]) for w in words(n, n, side)], OCR_WORD_SCHEMA)
        grid = [F.floor(F.col(f"bbox.{c}0") / 6) for c in "xy"]
        tiles = page.groupBy(*grid).count()
        some = page.filter("(bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0) > 0.2").count()  # a smaller box counts as one pixel
        assert covered(page, page, ["label_id"], ["ord"], 0.2).count() == some > 0.9 * n
        made[n] = tiles.selectExpr("sum(count * count)").first()[0]
    assert made[8_000] < 6 * made[2_000]


def test_the_better_read_is_kept_and_the_other_merged_if_it_read_enough(spark):
    box = lambda k: (20.0 * k, 0.0, 20.0 * k + 10, 10.0)
    normal = [("a", 0, "abcdefgh", 90.0, box(0)), ("b", 0, "abc", 90.0, box(0)), ("b", 1, "xyz", 90.0, box(5)), ("c", 0, "ab", 90.0, box(0)), ("c", 1, "q", 90.0, box(7)), ("e", 0, "same", 90.0, box(0))]
    turned = [("a", 0, "abc", 90.0, box(1)), ("b", 0, "abcdefghij", 90.0, box(0)), ("c", 0, "abcdefghij", 90.0, box(0)), ("d", 0, "only", 90.0, box(0)), ("e", 0, "sane", 90.0, box(1))]
    got = {}
    for r in labels.best_read(spark.createDataFrame(normal, OCR_WORD_SCHEMA), spark.createDataFrame(turned, OCR_WORD_SCHEMA)).collect():
        got.setdefault(r.label_id, set()).add(r.text)
    # a: 3 < 0.4 * 8, so the turned read is noise; b: 6 >= 0.4 * 10; c: 3 < 0.4 * 10; e: a tie keeps the normal read
    assert got == {"a": {"abcdefgh"}, "b": {"abcdefghij", "xyz"}, "c": {"abcdefghij"}, "d": {"only"}, "e": {"same", "sane"}}


def test_running_sums_equal_one_window(spark):
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v double, n int").repartition(6)
    got = {r.i: (r.before, r.place) for r in ordinals.ordinal(ordinals.running_sum(df, ["v"], F.col("n"), "before"), ["v"], "place").collect()}
    ahead = 0
    for k, (i, _, n) in enumerate(sorted(rows, key=lambda r: r[1])):
        assert got[i] == (ahead, k)
        ahead += n
    assert ordinals.ordinal(df.limit(0), ["v"], "place").collect() == []


def test_the_catalogue_needs_no_window_over_all_rows(spark):
    from larder.plans import sheet_queries

    for query in (sheet_queries.q43_product_fold, sheet_queries.q49_replace_nutrition, sheet_queries.q50_append_products):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window" in line]
        assert not any(line.rstrip().endswith("]") and line.count("[") < 3 for line in windows), windows


def test_module_has_no_group_collects():
    import inspect

    assert "collect_list" not in inspect.getsource(clusters)


@pytest.mark.parametrize("name", ["q74_claim_checks", "q75_weight_checks", "q76_ingredient_checks", "q77_nutrition_checks", "q78_address_checks"])
def test_checks_are_worked_out_once_and_over_all_tasks(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert max((len(line) for line in plan if "Filter" in line.split("(")[0]), default=0) < 200  # no step is pushed into a filter
    assert any("RepartitionByExpression" in line for line in plan)


def test_boxes_are_dealt_by_key_before_they_are_multiplied(spark):
    boxes = spark.range(600).selectExpr("id % 7 AS k", "CAST(id % 11 AS double) AS x", "CAST(id % 5 AS double) AS y", "id % 3 + 1 AS width")
    found = geometry.row_sharpness(boxes, ["k"], (-0.5, 0.0, 0.5), 2.0)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of boxes; sums of rows aren't sent
    want = Counter()
    for i in range(600):
        for s in (-0.5, 0.0, 0.5):
            want[i % 7, s, math.floor((i % 5 - s * (i % 11)) / 2 + 0.5)] += i % 3 + 1
    sharp = Counter()
    for (k, s, _), w in want.items():
        sharp[k, s] += w * w
    assert {(r["k"], r["slope"]): r["sharpness"] for r in found.collect()} == sharp


@pytest.mark.parametrize("most", [0, 40, 256])
def test_pages_of_few_and_many_words_are_merged_alike(spark, monkeypatch, most):
    a, b = words(240, 1), words(300, 2)
    a.append((None, 5, "noword", 99.0, (0.0, 0.0, 9.0, 9.0)))
    b += [("few", 1, "same", 99.0, (0.0, 0.0, 9.0, 9.0)), ("few", 2, "far", 99.0, (50.0, 0.0, 59.0, 9.0)), (None, 6, "kept", 99.0, (0.0, 0.0, 9.0, 9.0))]
    a.append(("few", 0, "word", 99.0, (0.0, 0.0, 9.0, 9.0)))
    monkeypatch.setattr(labels, "PAGE_WORDS", most)
    key = lambda r: (str(r[0]), *r[1:])
    got = labels.merged_words(spark.createDataFrame(a, OCR_WORD_SCHEMA), spark.createDataFrame(b, OCR_WORD_SCHEMA)).collect()
    want = plain_merge([w for w in a if w[0]], [w for w in b if w[0]]) + [a[240], b[302]]
    assert sorted(((r.label_id, r.ord, r.text, r.confidence, tuple(r.bbox)) for r in got), key=key) == sorted(want, key=key)


def test_reads_are_compared_in_one_shuffle(spark):
    first = spark.createDataFrame(words(60, 1), OCR_WORD_SCHEMA)
    plan = labels.best_read(first.filter("ord % 2 = 0"), first.filter("ord % 2 = 1"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
