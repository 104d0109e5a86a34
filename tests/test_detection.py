import math
import random

import numpy as np
import pytest

from larder.sources import detection
from larder.sources.detection import components, text_boxes


def flood(mask):
    """Pixels of each 8-connected component, by first pixel in scan order."""
    h, w = mask.shape
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if mask[y, x] and (x, y) not in seen:
                todo, own = [(x, y)], []
                seen.add((x, y))
                while todo:
                    a, b = todo.pop()
                    own.append((a, b))
                    for c in range(max(0, a - 1), min(w, a + 2)):
                        for d in range(max(0, b - 1), min(h, b + 2)):
                            if mask[d, c] and (c, d) not in seen:
                                seen.add((c, d))
                                todo.append((c, d))
                out.append(sorted(own))
    return out


def plain_boxes(scores, width, height):
    """Pixel by pixel."""
    out = []
    for own in flood(scores > 0.3):
        n = len(own)
        mean = sum(float(scores[y, x]) for x, y in own) / n
        mx, my = sum(x for x, _ in own) / n, sum(y for _, y in own) / n
        sxx, syy, sxy = (sum(f(x - mx, y - my) for x, y in own) for f in (lambda a, b: a * a, lambda a, b: b * b, lambda a, b: a * b))
        angle = 0.5 * math.atan2(2 * sxy, sxx - syy) if abs(sxy) > 1e-9 or abs(sxx - syy) > 1e-9 else 0.0
        ux, uy = math.cos(angle), math.sin(angle)
        span = lambda ux, uy: [f((x - mx) * p + (y - my) * q for x, y in own) for p, q in ((ux, uy), (-uy, ux)) for f in (min, max)]
        u0, u1, v0, v1 = span(ux, uy)
        if u1 - u0 < 1.5 * (v1 - v0):
            ux, uy = 1.0, 0.0
            u0, u1, v0, v1 = span(ux, uy)
        long, high = u1 - u0 + 1, v1 - v0 + 1
        if n < 12 or mean < 0.5 or min(long, high) < 3:
            continue
        grow = long * high * 1.5 / (2 * (long + high))
        cx, cy = mx + (u0 + u1) / 2 * ux - (v0 + v1) / 2 * uy, my + (u0 + u1) / 2 * uy + (v0 + v1) / 2 * ux
        fx, fy = width / scores.shape[1], height / scores.shape[0]
        at = lambda su, sv: ((cx + su * (long / 2 + grow) * ux - sv * (high / 2 + grow) * uy) * fx, (cy + su * (long / 2 + grow) * uy + sv * (high / 2 + grow) * ux) * fy)
        out.append((n, mean, *at(-1, -1), *at(1, -1), *at(-1, 1)))
    return out


@pytest.mark.parametrize("share", [0.05, 0.3, 0.5, 0.7, 1.0])
def test_components_equal_flood_fill(share):
    rng = np.random.default_rng(int(share * 10))
    for shape in ((1, 1), (1, 9), (9, 1), (23, 31)):
        mask = rng.random(shape) < share
        (row, first, last), of = components(mask)
        own = [sorted((x, int(row[i])) for i in np.flatnonzero(of == k) for x in range(first[i], last[i] + 1)) for k in range(of.max() + 1 if len(of) else 0)]
        assert own == flood(mask)


def test_a_spiral_is_one_component():
    mask = np.zeros((41, 41), bool)
    x0, y0, x1, y1 = 0, 0, 40, 40
    while x0 < x1:
        mask[y0, x0 : x1 + 1] = mask[y0 : y1 + 1, x1] = mask[y1, x0 : x1 + 1] = True
        mask[y0 + 2 : y1 + 1, x0] = True
        if y0 + 2 <= y1:
            mask[y0 + 2, x0 : x0 + 3] = True
        x0, y0, x1, y1 = x0 + 2, y0 + 2, x1 - 2, y1 - 2
    assert len(flood(mask)) == components(mask)[1].max() + 1


def test_boxes_equal_pixel_by_pixel():
    rng = np.random.default_rng(4)
    some = 0
    for _ in range(30):
        scores = rng.random((30, 44)) * 0.2
        for _ in range(rng.integers(1, 6)):
            y, x, t = rng.integers(0, 24), rng.integers(0, 30), rng.random() * 0.6 - 0.3
            for k in range(rng.integers(3, 14)):
                yy = int(y + k * t)
                scores[max(0, yy) : yy + rng.integers(2, 6), x + k] = 0.35 + rng.random() * 0.6
        got = [tuple(b.values()) for b in text_boxes(scores, 88.0, 90.0)]
        want = plain_boxes(scores, 88.0, 90.0)
        some += len(want)
        assert np.allclose(np.array(got), np.array(want)) and len(got) == len(want)
    assert some > 20


def test_boxes_of_stored_maps(spark):
    level = np.zeros((8, 20))
    level[2:6, 3:17] = 0.9
    rows = [("a", 20, level.ravel().tolist(), 40.0, 16.0), ("none", 20, [0.0] * 40, 40.0, 4.0), ("null", 20, None, 40.0, 4.0), ("empty", 20, [], 40.0, 4.0)]
    got = detection.boxes(spark.createDataFrame(rows, "page string, map_width int, scores array<double>, width double, height double"), "page").collect()
    assert [(r["page"], r["box"], r["pixels"]) for r in got] == [("a", 0, 56)]
    want = plain_boxes(level, 40.0, 16.0)[0]
    assert [got[0][c] for c in ("tl_x", "tl_y", "tr_x", "tr_y", "bl_x", "bl_y")] == pytest.approx(want[2:])


def plain_words(frames, box, alphabet):
    """Frame by frame."""
    letters, prev = [], -1
    for t, scores in enumerate(frames):
        best = max(range(len(scores)), key=lambda c: (scores[c], -c))
        if best and best != prev:
            letters.append([alphabet[best - 1], t, t, scores[best]])
        elif best:
            letters[-1][2] = t
        prev = best
    out, word = [], []
    for x in [*letters, [" ", 0, 0, 0]]:
        if x[0] != " ":
            word.append(x)
        elif word:
            a0, a1 = word[0][1] / len(frames), (word[-1][2] + 1) / len(frames)
            (ax, ay), (bx, by), (cx, cy) = box
            mx, my = ax + (bx - ax) * (a0 + a1) / 2 + (cx - ax) / 2, ay + (by - ay) * (a0 + a1) / 2 + (cy - ay) / 2
            w, h = math.hypot(bx - ax, by - ay) * (a1 - a0), math.hypot(cx - ax, cy - ay) * 0.7
            out.append(("".join(c[0] for c in word), 100 * sum(c[3] for c in word) / len(word), mx - w / 2, my - h / 2, mx + w / 2, my + h / 2))
            word = []
    return out


def test_words_in_boxes(spark):
    rng = random.Random(6)
    alphabet, lines = [*"abc", " "], {}
    for k in range(12):
        frames = []
        for _ in range(rng.randrange(1, 40)):
            scores = [rng.random() for _ in range(5)]
            frames += [scores] * rng.randrange(1, 3)
        lines[k] = (frames, [(rng.random() * 50, rng.random() * 50), (60 + rng.random() * 50, rng.random() * 50), (rng.random() * 9, 70 + rng.random() * 9)])
    frames = spark.createDataFrame([(k, t, s) for k, (fs, _) in lines.items() for t, s in enumerate(fs)], "line int, t int, scores array<double>")
    boxes = spark.createDataFrame([(k, *map(float, (a, b, c, d, e, f))) for k, (_, ((a, b), (c, d), (e, f))) in lines.items()], "line int, tl_x double, tl_y double, tr_x double, tr_y double, bl_x double, bl_y double")
    rows = detection.box_words(frames, boxes, ["line"], alphabet).orderBy("line", "ord").collect()
    for k, (fs, box) in lines.items():
        got = [(r["text"], r["confidence"], *r["bbox"]) for r in rows if r["line"] == k]
        want = plain_words(fs, box, alphabet)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(g[1:] == pytest.approx(w[1:]) for g, w in zip(got, want, strict=True))
