import math
import random
from collections import defaultdict

import numpy as np
import pytest

from larder.operators import labels, photo
from larder.operators.photo import best_pairs, levelled, line_slope, names_of, photo_values, sharpness, value_column
from larder.sources.schema import LABEL_ITEM_SCHEMA, NUTRIENTS


def plain_sharpness(points, slope, size):
    rows = defaultdict(float)
    for x, y, w in points:
        rows[math.floor((y - slope * x) / size + 0.5)] += w
    return sum(v * v for v in rows.values())


def page(slope, lines=14, seed=0, bend=0.0):
    """Words of one page: left edges, y, widths, heights, and the number of each word's line; y = line + slope * middle."""
    rng = random.Random(seed)
    out = []
    for k in range(lines):
        x = rng.random() * 5
        while x < 200:
            w = rng.uniform(8, 25)
            mid = x + w / 2 - 100
            out.append((x, 400 - 12 * k + slope * mid + bend * mid * mid, w, 7.0, k))
            x += w + 4
    return [np.array(c, float) for c in zip(*out, strict=True)]


def test_sharpness_equals_the_plain_sum():
    rng = np.random.default_rng(2)
    for scale in (10.0, 10_000.0):  # dense and sparse bins
        x, y, w = rng.random(60) * 300, rng.random(60) * scale, rng.random(60) * 20
        slopes = np.array([-0.3, -0.01, 0.0, 0.2])
        want = [plain_sharpness(zip(x, y, w, strict=True), s, 3.5) for s in slopes]
        assert np.allclose(sharpness(x, y, w, slopes, 3.5), want)


def test_line_slope_equals_the_best_of_all_slopes():
    x, y, w, _, _ = page(0.13, seed=3)
    steps = [k * 0.01 for k in range(-30, 31)]
    scores = [plain_sharpness(zip(x, y, w, strict=True), s, 3.5) for s in steps]
    slope, peak = line_slope(x, y, w, 3.5, 0.01)
    assert slope == pytest.approx(steps[scores.index(max(scores))]) and peak == pytest.approx(max(scores) / (sum(scores) / len(scores)))
    assert line_slope(x[:9], y[:9], w[:9], 3.5, 0.01) == (0.0, 0.0)


@pytest.mark.parametrize("slope,bend", [(0.12, 0.0), (-0.2, 0.0), (0.05, 0.0), (0.0, 0.0006), (0.06, -0.0004)])
def test_tilted_and_bent_words_come_back_to_rows(slope, bend):
    x, y, w, h, line = page(slope, bend=bend, seed=7)
    new = levelled(x, y, w, h)
    assert np.ptp(y[line == 3]) > 5
    for k in range(1, 13):
        assert np.ptp(new[line == k]) < 4.8  # the row tolerance of OCR
    assert plain_sharpness(zip(x + w / 2, new, w, strict=True), 0, 3.5) >= 1.08 * plain_sharpness(zip(x + w / 2, y, w, strict=True), 0, 3.5)


def plain_levelled(x, y, w, h):
    """Word by word, as the description of levelling says."""
    n, mid = len(x), [a + b / 2 for a, b in zip(x, w, strict=True)]
    height = sorted(h)[n // 2]
    size = max(1.0, height / 2)

    def best(points, step):
        if len(points) < 10:
            return 0.0, 0.0
        steps = [k * step for k in range(-round(0.3 / step), round(0.3 / step) + 1)]
        scores = [plain_sharpness(points, s, size) for s in steps]
        return steps[scores.index(max(scores))], max(scores) / (sum(scores) / len(scores))

    slope, peak = best(list(zip(mid, y, w, strict=True)), 0.005)
    slope = slope if peak >= 1.3 else 0.0
    x0, y0, cw, ch = min(mid), min(y), (max(mid) - min(mid)) / 4, (max(y) - min(y)) / 8
    raw = {}
    for i in range(4):
        for j in range(8):
            cx, cy = x0 + (i + 0.5) * cw, y0 + (j + 0.5) * ch
            s, p = best([(a - cx, b - cy, c) for a, b, c in zip(mid, y, w, strict=True) if abs(a - cx) <= cw * 0.9 and abs(b - cy) <= ch], 0.01)
            raw[i, j] = s if p >= 1.3 else slope
    field = {}
    for i, j in raw:
        near = [raw[c] for c in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if c in raw]
        field[i, j] = (2 * raw[i, j] + sum(near)) / (2 + len(near))

    def at(a, b):
        u, v = min(3, max(0, (a - x0) / cw - 0.5)), min(7, max(0, (b - y0) / ch - 0.5))
        i, j = int(u), int(v)
        f = lambda p, q: field[min(3, p), min(7, q)]
        return (f(i, j) * (1 - u + i) + f(i + 1, j) * (u - i)) * (1 - v + j) + (f(i, j + 1) * (1 - u + i) + f(i + 1, j + 1) * (u - i)) * (v - j)

    centre, bent = (min(mid) + max(mid)) / 2, []
    for a, b in zip(mid, y, strict=True):
        steps = max(1, math.ceil(abs(a - centre) / (4 * height)))
        dx = (a - centre) / steps
        bent.append(b - sum(at(centre + (k + 0.5) * dx, b) * dx for k in range(steps)))
    turned = [b - slope * (a - centre) for a, b in zip(mid, y, strict=True)]
    sharp = lambda ys: plain_sharpness(zip(mid, ys, w, strict=True), 0, size)
    out = turned if slope and sharp(turned) > sharp(bent) else bent
    return out if sharp(out) >= 1.08 * sharp(y) else list(y)


@pytest.mark.parametrize("slope,bend,seed", [(0.1, 0.0, 1), (0.02, 0.0005, 2), (0.0, 0.0, 3), (-0.15, -0.0003, 4)])
def test_levelled_equals_the_plain_way(slope, bend, seed):
    x, y, w, h, _ = page(slope, 10, seed, bend)
    assert levelled(x, y, w, h).tolist() == pytest.approx(plain_levelled(x.tolist(), y.tolist(), w.tolist(), h.tolist()), abs=1e-6)


def test_level_small_and_narrow_pages_stay_equal():
    x, y, w, h, _ = page(0.0)
    assert levelled(x, y, w, h) is y
    x, y, w, h, _ = page(0.2)
    assert levelled(x[:39], y[:39], w[:39], h[:39]).tolist() == y[:39].tolist()
    assert levelled(x * 0.01, y, w * 0.01, h) is y


def test_levelled_items(spark):
    rows = []
    for label, slope in (("flat", 0.0), ("tilted", 0.15), ("pdf", 0.15), ("few", 0.15)):
        x, y, w, h, _ = page(slope, 3 if label == "few" else 14, seed=1)
        rows += [(label, i, f"w{i}", *map(float, (x[i], y[i], w[i], h[i])), 1, i % 50 == 49) for i in range(len(x))]
    items = spark.createDataFrame(rows, LABEL_ITEM_SCHEMA)
    heads = spark.createDataFrame([("flat", "ocr"), ("tilted", "ocr"), ("pdf", "pdf"), ("few", "ocr"), ("none", "ocr")], "label_id string, source string")
    got = {(r.label_id, r.ord): r for r in photo.levelled_items(items, heads).collect()}
    assert len(got) == len(rows) and photo.levelled_items(items, heads).columns == items.columns
    moved = {label for label, i, *_, y, _, _, _, _ in [(r[0], r[1], r[2], r[3], r[4], *r[5:]) for r in rows] if got[label, i].y != y}
    assert moved == {"tilted"}
    assert all(got[r[0], r[1]].y == r[4] for r in rows if r[-1])
    assert photo.levelled_items(items.limit(0), heads).collect() == []


def plain_pairs(names_y, reach, column_y, agrees, inside, pitch):
    """The best score over all slopes, pair by pair."""
    middle, best = (max(names_y) + min(names_y)) / 2, None
    for a in photo.SLOPES_A:
        for b in photo.SLOPES_B:
            own = {}
            for k, y in enumerate(names_y):
                at = y + (a + b * (y - middle)) * reach[k]
                gaps = [abs(c - at) for c in column_y]
                c = gaps.index(min(gaps))
                if gaps[c] <= pitch * 0.5 and (c not in own or gaps[c] < own[c][1]):
                    own[c] = (k, gaps[c])
            open_ = sum(1 for c in range(len(column_y)) if c not in own and inside[c])
            score = len(own) - 0.8 * open_ - 0.05 * sum(g / pitch for _, g in own.values()) - 0.02 * (abs(a) + abs(b) * 100) + 2 * sum(bool(agrees[k][c]) for c, (k, _) in own.items())
            if best is None or score > best[0] + 1e-9:
                best = (score, sorted((k, c) for c, (k, _) in own.items()))
    return best


def test_pairs_equal_the_search_over_all_slopes():
    rng = np.random.default_rng(8)
    for _ in range(3):
        n, m = 6, 7
        names_y = np.sort(rng.random(n) * 90)[::-1]
        reach, column_y = 60 + rng.random(n) * 20, np.sort(rng.random(m) * 100)[::-1]
        agrees, inside = rng.random((n, m)) < 0.2, rng.random(m) < 0.8
        score, want = plain_pairs(names_y, reach, column_y, agrees, inside, 14.0)
        got, _, _ = best_pairs(names_y, reach, column_y, agrees, inside, 14.0)
        assert sorted(got) == want, score


def test_value_column():
    mid = np.array([1.0, 50, 51, 52, 53, 90, 91, 92, 93])
    assert value_column(mid, 5.0, 3).tolist() == [False, True, True, True, True, False, False, False, False]
    assert value_column(np.array([1.0, 50, 99]), 5.0, 3) is None


VALUES = {"Energy": "412", "Protein": "11.5", "Carbohydrate": "61", "Total Sugar": "14.2", "Total Fat": "19", "Saturated Fat": "7.25", "Sodium": "356"}
BY_TITLE = {title: i for i, (_, title, *_) in enumerate(NUTRIENTS)}


def table_words(slope, rows, second=None):
    """Items of a tilted table: names at x = 20, values centred at x = 150, a second column at x = 190, filler text below."""
    out = []
    for k, (title, value) in enumerate(rows):
        y0, x = 300 - 13 * k, 20.0
        for part in title.split():
            out.append((part, x, y0, 5.0 * len(part)))
            x += 5.0 * len(part) + 3
        if value:
            out.append((value, 150 - 2.5 * len(value), y0, 5.0 * len(value)))
        if second:
            out.append((second[k], 190 - 2.5 * len(second[k]), y0, 5.0 * len(second[k])))
    out += [(t, 20 + 40.0 * i, 100.0, 30.0) for i, t in enumerate("store in a cool and dry place".split())]
    return [(s, x, y + slope * (x + w / 2), w, 7.0) for s, x, y, w in out]


def as_rows(spark, tables):
    items = spark.createDataFrame([(label, i, s, x, y, w, h, 1, False) for label, own in tables.items() for i, (s, x, y, w, h) in enumerate(own)], LABEL_ITEM_SCHEMA)
    heads = spark.createDataFrame([(label, "ocr") for label in tables], "label_id string, source string")
    return labels.rows(items, heads)


def sheet(spark, names, values=VALUES):
    rows = [(label, NUTRIENTS[BY_TITLE[t]][0], [float(v)]) for label in names for t, v in values.items()]
    return spark.createDataFrame(rows, "label_id string, key string, values array<double>")


def test_values_of_tilted_tables(spark):
    rows = list(VALUES.items())
    slopes = {"level": 0.0, "up": 0.1, "down": -0.12}
    tables = {label: table_words(s, rows) for label, s in slopes.items()}
    got = {(r.label_id, r.title): r for r in photo.photo_cells(as_rows(spark, tables), sheet(spark, slopes)).collect()}
    for label in slopes:
        assert {t for lab, t in got if lab == label} == set(VALUES), label
        for title, value in VALUES.items():
            assert got[label, title]["values"][0] == float(value) and not got[label, title].typo


def test_further_columns_typos_and_tables_without_a_sheet(spark):
    rows = [("Proteln" if t == "Protein" else "Carbohydrste" if t == "Carbohydrate" else t, v) for t, v in VALUES.items()]
    tables = {"two": table_words(0.08, rows, [str(10 + k) for k in range(len(rows))])}
    got = {r.title: r for r in photo.photo_cells(as_rows(spark, tables), sheet(spark, [])).collect()}
    assert set(got) == set(VALUES)
    assert {t for t, r in got.items() if r.typo} == {"Protein", "Carbohydrate"}
    assert all(float(10 + k) in got[t]["values"] for k, t in enumerate(VALUES))


def test_a_number_without_a_name_goes_to_the_only_nutrient_between(spark):
    rows = [(("Xqzw" if t == "Total Fat" else t), v) for t, v in VALUES.items()]
    got = {r.title: r for r in photo.photo_cells(as_rows(spark, {"a": table_words(0.06, rows)}), sheet(spark, ["a"])).collect()}
    assert got["Total Fat"]["values"] == [19.0, 1.9] or 19.0 in got["Total Fat"]["values"]
    without = {r.title for r in photo.photo_cells(as_rows(spark, {"a": table_words(0.06, rows)}), sheet(spark, [])).collect()}
    assert without == set(VALUES) - {"Total Fat"}


def test_position_equals_enumeration():
    rng = random.Random(3)
    for _ in range(200):
        n = len(NUTRIENTS)
        pairs = [(k, k) for k in range(rng.randrange(1, 4))]
        nutrients = rng.sample(range(n), len(pairs))
        names = [photo.Name(i, 0, 0, "", False, False) for i in nutrients]
        ys = [rng.randrange(100) * 1.0 for _ in range(len(pairs) + 2)]
        values = [[None] for _ in pairs] + [[float(rng.randrange(4))] for _ in range(2)]
        words = photo.Words(np.zeros(len(ys)), np.array(ys), np.zeros(len(ys)), np.zeros(len(ys)), np.zeros(len(ys)), [], [], np.ones(len(ys), bool), values)
        expected = {i: [float(rng.randrange(4)) + 10 * (rng.random() < 0.5)] for i in range(n) if rng.random() < 0.6}
        known = set(nutrients) | set(rng.sample(range(n), 2))
        want, seen = [], set(known)
        for c in range(len(pairs), len(ys)):
            fits = []
            for i in range(n):
                ok = i not in seen and i in expected and any(abs(v - e) <= max(NUTRIENTS[i][4], abs(e) * 0.02) for v in values[c] for e in expected[i])
                over = [nutrients[k] for k, _ in sorted(pairs, key=lambda p: -ys[p[1]]) if ys[k] > ys[c]]
                under = [nutrients[k] for k, _ in sorted(pairs, key=lambda p: -ys[p[1]]) if ys[k] < ys[c]]
                if ok and (not over or i > over[-1]) and (not under or i < under[0]):
                    fits.append(i)
            if len(fits) == 1:
                seen.add(fits[0])
                want.append((fits[0], values[c]))
        got = photo._by_position(words, names, np.arange(len(ys)), pairs, expected, known)
        assert [(f.nutrient, f.values) for f in got] == want


def test_names_and_small_labels():
    own = [("Of", 0), ("which", 15), ("Fat", 60), ("Trans", 0), ("Fat", 28), ("Sugar", 0)]
    ys = [100.0, 100, 100, 80, 80, 60]
    words = photo.Words(np.array([float(x) for _, x in own]), np.array(ys), np.array([5.0 * len(s) for s, _ in own]), np.full(6, 7.0), np.ones(6), [s for s, _ in own], [s.lower() for s, _ in own], np.zeros(6, bool), [[]] * 6)
    found = names_of(words, 7.0)
    assert [(NUTRIENTS[f.nutrient][1], f.text, f.bare) for f in found] == [("Total Fat", "Fat", True), ("Trans Fat", "Trans Fat", False), ("Total Sugar", "Sugar", True)]
    assert photo_values(words, {}) == ([], [])


def test_the_audit_reads_a_tilted_table(spark):
    from larder.operators import audit
    from tests.test_audit import reference

    block = {**dict.fromkeys(c for c, *_ in NUTRIENTS), "grammage": 100.0, **{NUTRIENTS[BY_TITLE[t]][0]: float(v) for t, v in VALUES.items()}, "unsaturated_fat_g": None}
    ref = reference(spark, nutrition=[block])
    words = table_words(0.11, list(VALUES.items()))
    items = spark.createDataFrame([("L1", i, *r, 1, False) for i, r in enumerate(words)], LABEL_ITEM_SCHEMA)
    found = {}
    for source in ("ocr", "pdf"):
        rows = audit.audit(items, spark.createDataFrame([("L1", source)], "label_id string, source string"), ref).filter("step = 7").collect()
        found[source] = {r["label"]: r["status"] for r in rows}
    assert all(found["ocr"][t] == "pass" for t in VALUES), found["ocr"]
    assert found["pdf"] != found["ocr"]


def test_boxes_of_the_vector_maps_equal_pixel_by_pixel(spark):
    from larder.plans import photo_queries
    from tests.test_detection import plain_boxes

    maps = {r["vec_id"]: np.array(r["scores"]).reshape(-1, r["map_width"]) for r in photo_queries.score_maps(spark, "/root/testdata/sf0.001").filter("vec_id < 12").collect()}
    rows = photo_queries.q72_detected_boxes(spark, "/root/testdata/sf0.001").filter("vec_id < 12").orderBy("vec_id", "box").collect()
    for k, scores in maps.items():
        want = plain_boxes(scores, scores.shape[1] * 4.0, scores.shape[1] * 4.0)
        got = [tuple(r)[2:] for r in rows if r["vec_id"] == k]
        assert len(got) == len(want) and all(g == pytest.approx(w, abs=1e-5) for g, w in zip(got, want, strict=True))
    assert rows


def plain_pairs(names_y, reach, column_y, agrees, inside, pitch):
    """best_pairs slope by slope and name by name."""
    middle, best = (max(names_y) + min(names_y)) / 2, None
    for a in photo.SLOPES_A:
        for b in photo.SLOPES_B:
            owner = {}
            for i, y in enumerate(names_y):
                gaps = [abs(v - (y + (a + b * (y - middle)) * reach[i])) for v in column_y]
                c = gaps.index(min(gaps))
                if gaps[c] <= pitch * 0.5 and (c not in owner or gaps[c] < owner[c][1]):
                    owner[c] = i, gaps[c]
            score = len(owner) - photo.UNPAIRED * sum(bool(inside[c]) for c in range(len(column_y)) if c not in owner) - photo.DISTANCE * (sum(g for _, g in owner.values()) / pitch)
            score += -photo.STEEPNESS * (abs(a) + abs(b) * 100) + photo.AGREEMENT * sum(bool(agrees[i][c]) for c, (i, _) in owner.items())
            if best is None or score > best[0] + 1e-9:
                best = score, sorted((i, c) for c, (i, _) in owner.items())
    return best


@pytest.mark.parametrize("at_once", [1, 5_000, 250_000])
def test_slopes_tried_together_pair_as_one_by_one(monkeypatch, at_once):
    monkeypatch.setattr(photo, "_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    for n, c in ((1, 1), (4, 7), (9, 5)):
        given = np.sort(rng.random(n) * 200)[::-1], rng.random(n) * 100 + 20, rng.random(c) * 200, rng.random((n, c)) < 0.2, rng.random(c) < 0.7, 12.0
        assert sorted(best_pairs(*given)[0]) == plain_pairs(*given)[1]


def test_a_name_is_looked_up_once_by_a_task():
    photo.nutrient_of.cache_clear()
    assert photo.nutrient_of("saturatd fat") == photo.nutrient_of("saturatd fat")
    assert photo.nutrient_of.cache_info().hits == 1


def test_labels_cross_to_python_in_batches(spark):
    tables = {str(k): table_words(0.01 * k, list(VALUES.items())) for k in range(6)}
    cells = photo.photo_cells(as_rows(spark, tables), sheet(spark, ["1", "2"]))
    plan = cells._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan  # before, each label was a group that crossed by itself
    assert {r.label_id for r in cells.collect()} == set(tables)


def test_words_of_parts_are_dealt_before_they_become_rows(spark, tmp_path):
    from larder.plans import photo_queries

    spark.range(1, 50).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = photo_queries.q71_tilted_tables(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert plan.count("RepartitionByExpression [label_id") >= 2  # before, one task made the rows of 120,000 labels
