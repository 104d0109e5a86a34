"""Stored outputs of text detectors and readers as boxes and words: score maps to boxes, frames of class scores to words in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Least score of a text pixel and mean of a box, least pixels and extent of a box, how far a box grows, the ratio of sides from which a box has a direction, the share of a box's height that is text.
PIXEL_SCORE, BOX_SCORE, BOX_PIXELS, BOX_EXTENT, GROWTH, DIRECTED = 0.3, 0.5, 12, 3.0, 1.5, 1.5
TEXT_SHARE = 0.7


# ---- components ----


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each horizontal run of set pixels, in scan order."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, first, last - 1


def components(mask: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The runs of a mask and the 8-connected component of each, numbered by first pixel in scan order.

    Runs of neighbouring rows that touch, corners included, are joined; labels sink to the least of their component.
    """
    row, first, last = runs = _runs(mask)
    n, wide = len(row), mask.shape[1] + 2
    # the runs of the row above that touch run i: those that end at first - 1 or later and start at last + 1 or earlier
    lo = np.searchsorted(row * wide + last + 1, (row - 1) * wide + first)
    hi = np.searchsorted(row * wide + first + 1, (row - 1) * wide + last + 2, "right")
    touching = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), touching)
    b = np.arange(len(a)) - np.repeat(np.cumsum(touching) - touching, touching) + np.repeat(lo, touching)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # both the runs and the heads of their labels take the lesser label, then labels are followed to the end
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        while (shorter := new[new]).tolist() != new.tolist():
            new = shorter
        if (new == label).all():
            break
        label = new
    return runs, np.unique(label, return_inverse=True)[1] if n else label


def text_boxes(scores: np.ndarray, width: float, height: float) -> list[dict]:
    """The text boxes of a score map (rows by columns) of a picture of a width and height: three corners, pixels and mean score, by first pixel."""
    scores = scores.astype(np.float64)
    (row, first, last), of = components(scores > PIXEL_SCORE)
    if not len(row):
        return []
    k, size = int(of.max()) + 1, last - first + 1
    total = lambda v: np.bincount(of, v, k)
    ahead = np.concatenate([np.zeros((scores.shape[0], 1)), np.cumsum(scores, 1)], 1)
    n = total(size)
    mean = total(ahead[row, last + 1] - ahead[row, first]) / n
    # whole sums of x, y, xx, xy, yy over the pixels of runs, so that moments don't depend on the order of adding
    squares = lambda m: m * (m + 1) * (2 * m + 1) // 6
    sx = (first + last) * size // 2
    whole = lambda v: np.rint(total(v)).astype(np.int64)
    count, x, y = n.astype(np.int64), whole(sx), whole(row * size)
    xx = whole(squares(last) - squares(first - 1)) * count - x * x
    yy = whole(row * row * size) * count - y * y
    xy = whole(row * sx) * count - x * y
    angle = 0.5 * np.arctan2(2.0 * xy, (xx - yy).astype(np.float64))
    mx, my = x / n, y / n

    def extent(ux: np.ndarray, uy: np.ndarray) -> tuple[np.ndarray, ...]:
        """Least and greatest u and v of each component: at the ends of its runs."""
        out = []
        for p, q in ((ux, uy), (-uy, ux)):
            ends = np.stack([(c - mx[of]) * p[of] + (row - my[of]) * q[of] for c in (first, last)])
            low, high = np.full(k, np.inf), np.full(k, -np.inf)
            np.minimum.at(low, of, ends.min(0))
            np.maximum.at(high, of, ends.max(0))
            out += [low, high]
        return tuple(out)

    ux, uy = np.cos(angle), np.sin(angle)
    u0, u1, v0, v1 = extent(ux, uy)
    round_ = u1 - u0 < DIRECTED * (v1 - v0)  # a short word: taken as level
    ux, uy = np.where(round_, 1.0, ux), np.where(round_, 0.0, uy)
    u0, u1, v0, v1 = extent(ux, uy)
    long, high = u1 - u0 + 1, v1 - v0 + 1
    grow = long * high * GROWTH / (2 * (long + high))
    cu, cv = (u0 + u1) / 2, (v0 + v1) / 2
    cx, cy = mx + cu * ux - cv * uy, my + cu * uy + cv * ux
    fx, fy = width / scores.shape[1], height / scores.shape[0]
    corners = {name: ((cx + su * (long / 2 + grow) * ux - sv * (high / 2 + grow) * uy) * fx, (cy + su * (long / 2 + grow) * uy + sv * (high / 2 + grow) * ux) * fy) for name, su, sv in (("tl", -1, -1), ("tr", 1, -1), ("bl", -1, 1))}
    kept = np.flatnonzero((n >= BOX_PIXELS) & (mean >= BOX_SCORE) & (np.minimum(long, high) >= BOX_EXTENT))
    return [{"pixels": int(count[i]), "score": float(mean[i]), **{f"{name}_{c}": float(v[i]) for name, both in corners.items() for c, v in zip("xy", both, strict=True)}} for i in kept]


_BOX = "pixels bigint, score double, tl_x double, tl_y double, tr_x double, tr_y double, bl_x double, bl_y double"


def boxes(maps: DataFrame, key: str) -> DataFrame:
    """(key, box, pixels, score, corners) of stored score maps (key, map_width, scores array by rows, and the picture's width and height).

    A map is one row: a detector's picture has a greatest side. Null or empty maps have no boxes.
    """
    kind = dict(maps.dtypes)[key]
    rows = maps.select(key, F.col("map_width").cast("int").alias("map_width"), F.col("scores").cast("array<double>").alias("scores"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    names = ["box", *(c.split()[0] for c in _BOX.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                scores = b.column("scores")[i]
                if not scores.is_valid or not len(scores):
                    continue
                grid = np.nan_to_num(scores.values.to_numpy(zero_copy_only=False)).reshape(-1, b.column("map_width")[i].as_py())
                found = [{"box": k, **x} for k, x in enumerate(text_boxes(grid, b.column("width")[i].as_py(), b.column("height")[i].as_py()))]
                if found:
                    columns = [pa.array([x[c] for x in found], pa.int64() if c in ("box", "pixels") else pa.float64()) for c in names]
                    yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array([i] * len(found))), *columns], [key, *names])

    return rows.mapInArrow(run, f"{key} {kind}, box bigint, {_BOX}")


# ---- words ----


def box_words(frames: DataFrame, boxes: DataFrame, key: list[str], alphabet: list[str]) -> DataFrame:
    """(key, ord, text, confidence, bbox) of frames of class scores (key, t, scores) read within boxes (key and corners).

    The best class of each frame; repeats are one character, class 0 is none; a space ends a word; a word's confidence is
    the mean of its characters' first scores; its box is its part of the line, TEXT_SHARE of the padded height.
    """
    own = Window.partitionBy(*key)
    best = frames.select(*key, "t", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("best"), F.array_max("scores").cast("double").alias("p"), F.count("*").over(own).alias("n"))
    new = (F.col("best") != F.coalesce(F.lag("best").over(own.orderBy("t")), F.lit(-1))).cast("int")
    runs = best.withColumn("new", new).withColumn("run", F.sum("new").over(own.orderBy("t")))
    letter = F.coalesce(F.try_element_at(F.array(*map(F.lit, alphabet)), F.col("best")), F.lit(""))
    letters = runs.filter("best > 0").groupBy(*key, "run", "best", "n").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("p", "t").alias("p")).withColumn("letter", letter)
    number = F.sum((F.col("letter") == " ").cast("int")).over(own.orderBy("t0"))
    words = letters.withColumn("ord", number).filter("letter <> ' '").groupBy(*key, "ord", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t0", "letter"))), lambda x: x["letter"]), "").alias("text"), (F.avg("p") * 100).alias("confidence"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
    )
    at = words.join(boxes.select(*key, "tl_x", "tl_y", "tr_x", "tr_y", "bl_x", "bl_y"), key)
    a0, a1 = F.col("t0") / F.col("n"), (F.col("t1") + 1) / F.col("n")
    side = lambda p: [F.col(f"{p}_{c}") - F.col(f"tl_{c}") for c in "xy"]
    (ux, uy), (vx, vy) = side("tr"), side("bl")
    cx, cy = (F.col(f"tl_{c}") + u * (a0 + a1) / 2 + v * 0.5 for c, u, v in (("x", ux, vx), ("y", uy, vy)))
    half_w, half_h = F.hypot(ux, uy) * (a1 - a0) / 2, F.hypot(vx, vy) * TEXT_SHARE / 2
    return at.select(*key, "ord", "text", "confidence", F.struct((cx - half_w).alias("x0"), (cy - half_h).alias("y0"), (cx + half_w).alias("x1"), (cy + half_h).alias("y1")).alias("bbox"))
