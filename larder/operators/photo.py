"""Photographed labels: words on sloping lines brought level, and nutrient names paired with the numbers beside them.

Both work on one page or label at a time, as Arrow functions over arrays of its words: a search over slopes needs all
words of a page together, and a page holds what fits on a pack.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.distance import osa
from larder.functions.text import cell_value, is_cell, loosened, ocr_alternatives, ocr_fix
from larder.sources.schema import NUTRIENTS, UNIT_WORDS
from larder.sources.tables import spread

# Fixed values of levelling: cells of a page across and down, least words of a page and of a cell, least peak of a slope over the mean of all, greatest slope and its steps (page, cell), least gain that is kept, least extent of a page in text heights.
CELLS_ACROSS, CELLS_DOWN = 4, 8
PAGE_WORDS, CELL_WORDS = 40, 10
LEAST_PEAK, GREATEST_SLOPE, PAGE_STEP, CELL_STEP = 1.3, 0.3, 0.005, 0.01
LEAST_GAIN = 1.08
LEAST_WIDTH, LEAST_HEIGHT = 10, 6

# Fixed values of pairing: least words and names, the slopes a and b tried, and the weights of the score.
TABLE_WORDS, TABLE_NAMES = 20, 3
SLOPES_A, SLOPES_B = np.arange(-30, 31) * 0.01, np.arange(-10, 11) * 0.0003
UNPAIRED, DISTANCE, STEEPNESS, AGREEMENT = 0.8, 0.05, 0.02, 2.0
AGREES_WITHIN = 0.02
#: Slopes times names or numbers that are tried together.
_AT_ONCE = 250_000
#: More than what bounds and scores differ by rounding.
_ROUNDING = 1e-6
#: Names whose nutrients a task remembers.
_NAMES_KEPT = 100_000


# ---- levelling ----


def sharpness(x: np.ndarray, y: np.ndarray, w: np.ndarray, slopes: np.ndarray, bin_height: float) -> np.ndarray:
    """For each slope the sum of squared widths of the rows that words fall into once sheared by it."""
    rows = np.floor((y - slopes[:, None] * x) / bin_height + 0.5).astype(np.int64)
    rows -= rows.min(1, keepdims=True)
    span = int(rows.max()) + 1
    flat = (rows + np.arange(len(slopes))[:, None] * span).ravel()
    if span * len(slopes) <= 8 * flat.size + 1000:
        return (np.bincount(flat, np.broadcast_to(w, rows.shape).ravel(), span * len(slopes)).reshape(len(slopes), span) ** 2).sum(1)
    bins, at = np.unique(flat, return_inverse=True)
    return np.bincount(bins // span, np.bincount(at, np.broadcast_to(w, rows.shape).ravel()) ** 2, len(slopes))


def line_slope(x: np.ndarray, y: np.ndarray, w: np.ndarray, bin_height: float, step: float) -> tuple[float, float]:
    """The slope that makes the sharpest rows, and its peak over the mean of all slopes; (0, 0) for too few words."""
    if len(x) < CELL_WORDS:
        return 0.0, 0.0
    n = round(GREATEST_SLOPE / step)
    slopes = np.arange(-n, n + 1) * step
    found = sharpness(x, y, w, slopes, bin_height)
    best = int(found.argmax())
    return float(slopes[best]), float(found[best] / found.mean())


def _median(values: np.ndarray) -> float:
    return float(np.sort(values)[len(values) // 2])


class Field(NamedTuple):
    """Slopes at the centres of a grid of cells, read by bilinear interpolation."""

    slopes: np.ndarray
    left: float
    low: float
    wide: float
    high: float

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        down, across = self.slopes.shape
        u = np.clip((x - self.left) / self.wide - 0.5, 0, across - 1)
        v = np.clip((y - self.low) / self.high - 0.5, 0, down - 1)
        i, j = u.astype(int), v.astype(int)
        i2, j2, u, v = np.minimum(i + 1, across - 1), np.minimum(j + 1, down - 1), u - i, v - j
        near = self.slopes[j, i] * (1 - u) + self.slopes[j, i2] * u
        far = self.slopes[j2, i] * (1 - u) + self.slopes[j2, i2] * u
        return near * (1 - v) + far * v


def slope_field(x: np.ndarray, y: np.ndarray, w: np.ndarray, bin_height: float, fallback: float) -> Field:
    """The slope of each cell of the page from the words around it, where they show one, averaged with the cells beside it."""
    left, low = x.min(), y.min()
    wide, high = (x.max() - left) / CELLS_ACROSS, (y.max() - low) / CELLS_DOWN
    raw = np.full((CELLS_DOWN + 2, CELLS_ACROSS + 2), np.nan)
    for j in range(CELLS_DOWN):
        for i in range(CELLS_ACROSS):
            cx, cy = left + (i + 0.5) * wide, low + (j + 0.5) * high
            near = (np.abs(x - cx) <= wide * 0.9) & (np.abs(y - cy) <= high)
            slope, peak = line_slope(x[near] - cx, y[near] - cy, w[near], bin_height, CELL_STEP)
            raw[j + 1, i + 1] = slope if peak >= LEAST_PEAK else fallback
    own = raw[1:-1, 1:-1]
    beside = np.stack([own, own, raw[1:-1, 2:], raw[1:-1, :-2], raw[2:, 1:-1], raw[:-2, 1:-1]])
    return Field(np.nanmean(beside, 0), left, low, wide, high)


def levelled(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The y of the upright words of one page (left edges x, widths w, heights h) with lines made level; y itself where that doesn't make rows clearly sharper."""
    if len(x) < PAGE_WORDS:
        return y
    height = _median(h) or 7.0
    bin_height, mid = max(1.0, height * 0.5), x + w / 2
    if np.ptp(mid) < height * LEAST_WIDTH or np.ptp(y) < height * LEAST_HEIGHT:
        return y
    slope, peak = line_slope(mid, y, w, bin_height, PAGE_STEP)
    slope = slope if peak >= LEAST_PEAK else 0.0
    field, centre = slope_field(mid, y, w, bin_height, slope), (mid.min() + mid.max()) / 2
    steps = np.maximum(1, np.ceil(np.abs(mid - centre) / (height * 4))).astype(int)
    dx, shift = (mid - centre) / steps, np.zeros(len(x))
    for k in range(steps.max()):  # the slope integrated along the word's height, from the middle of the page
        on = steps > k
        shift[on] += field.at(centre + (k + 0.5) * dx[on], y[on]) * dx[on]
    sharp = lambda at: float(sharpness(mid, at, w, np.zeros(1), bin_height)[0])
    bent, turned = y - shift, y - slope * (mid - centre)
    best, gain = bent, sharp(bent)
    if slope and (whole := sharp(turned)) > gain:
        best, gain = turned, whole
    return best if gain >= sharp(y) * LEAST_GAIN else y


def page_slopes(items: DataFrame) -> DataFrame:
    """(label_id, page, slope, peak, n_words) of the upright words of each page: the slope of its lines, and how far it stands out; (0, 0) for fewer than CELL_WORDS words."""
    kind = dict(items.dtypes)["label_id"]

    def run(t: pa.Table) -> pa.Table:
        get = lambda c: t.column(c).to_numpy().astype(np.float64)
        x, y, w, h = map(get, "xywh")
        slope, peak = line_slope(x + w / 2, y, w, max(1.0, (_median(h) or 7.0) * 0.5), PAGE_STEP)
        return pa.Table.from_arrays([t.column("label_id").slice(0, 1), t.column("page").slice(0, 1), pa.array([slope]), pa.array([peak]), pa.array([len(x)])], ["label_id", "page", "slope", "peak", "n_words"])

    upright = items.filter(~F.col("rotated")).select("label_id", "page", "x", "y", "w", "h")
    return upright.groupBy("label_id", "page").applyInArrow(run, f"label_id {kind}, page int, slope double, peak double, n_words bigint")


def levelled_items(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Label items with the words of photos (source ``ocr``) brought level, page by page; a photo of fewer than PAGE_WORDS upright words, rotated words and text layers stay as they are."""
    upright = items.filter(~F.col("rotated")).groupBy("label_id").agg(F.count("*").alias("_upright"))
    photos = labels.select("label_id", (F.col("source") == "ocr").alias("_ocr")).join(upright, "label_id")
    marked = items.join(photos.select("label_id", (F.col("_ocr") & (F.col("_upright") >= PAGE_WORDS)).alias("_photo")), "label_id", "left")

    def run(t: pa.Table) -> pa.Table:
        get = lambda c: t.column(c).to_numpy().astype(np.float64)
        x, y, w, h, up = *map(get, "xywh"), ~t.column("rotated").to_numpy().astype(bool)
        new = y.copy()
        # in one order whatever the order of rows, so that sums are too
        order = np.lexsort([t.column("ord").to_numpy(), x, y])
        order = order[up[order]]
        new[order] = levelled(x[order], y[order], w[order], h[order])
        return t.set_column(t.schema.get_field_index("y"), "y", pa.array(new))

    schema = items.schema
    still = marked.filter(~F.coalesce("_photo", F.lit(False))).select(*items.columns)
    return still.unionByName(marked.filter("_photo").select(*items.columns).groupBy("label_id", "page").applyInArrow(run, schema))


# ---- pairing ----


class Name(NamedTuple):
    """A nutrient's name found among the words: its number in NUTRIENTS, its first and last word, its text, and whether it is misspelt or only a bare "fat" or "sugar"."""

    nutrient: int
    first: int
    last: int
    text: str
    typo: bool
    bare: bool


_GENERIC = {"fat", "fats", "sugar", "sugars"}
_EXACT = {name: i for i, (_, _, names, _, _) in reversed(list(enumerate(NUTRIENTS))) for name in names}


def _ao(text: str) -> str:
    """Names that OCR can't tell apart get one key (as ``ao_key``)."""
    return re.sub("(?<=[a-z])(fi|ii|ri)(?=o)", "n", text).replace("o", "a")


_FOLDED = {_ao(name): i for name, i in sorted(_EXACT.items(), key=lambda p: -p[1])}


@lru_cache(_NAMES_KEPT)
def nutrient_of(text: str) -> tuple[int, bool] | None:
    """The nutrient that a normalised name means, and whether the name is misspelt: exact names first, then a/o-folded ones, then ones an edit or two away, each by least number."""
    if text in _EXACT:
        return _EXACT[text], False
    if _ao(text) in _FOLDED:
        return _FOLDED[_ao(text)], False
    for i, (_, _, names, _, _) in enumerate(NUTRIENTS):
        for name in names:
            most = 2 if len(name) >= 9 else 1
            if len(name) >= 6 and osa(text, name, most) <= most:
                return i, True
    return None


class Words(NamedTuple):
    """The words of one label in reading order."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray
    page: np.ndarray
    s: list[str]
    loose: list[str]
    numeric: np.ndarray
    readings: list[list[float | None]]

    def joined(self, own: list[int], parts: list[str]) -> str:
        """Texts left to right, with a space only where a gap shows."""
        out, end = "", None
        for i in own:
            if end is not None and (self.x[i] - end > 0.15 * max(self.h[i], 1.0) or not out or out[-1].isspace()):
                out += " "
            out, end = out + parts[i], self.x[i] + self.w[i]
        return " ".join(out.split())


def _neighbours(words: Words, height: float) -> tuple[list[list[int]], np.ndarray]:
    """For each word the words that start within 1.5 text heights of its end on its line, nearest first; and whether a word ends so before it.

    Words are sought in a band of the page's words by height, so a page isn't compared with itself.
    """
    n = len(words.x)
    order = np.lexsort([words.y, words.page])
    page, y = words.page[order], words.y[order]
    heads = np.flatnonzero(np.r_[True, page[1:] != page[:-1]]) if n else order
    i, j = [], []
    for a, b in zip(heads, [*heads[1:], n], strict=False):
        own = order[a:b]
        lo, hi = np.searchsorted(y[a:b], words.y[own] - height * 0.6, "left"), np.searchsorted(y[a:b], words.y[own] + height * 0.6, "right")
        ends = np.cumsum(hi - lo)
        i.append(np.repeat(own, hi - lo))
        j.append(own[np.arange(ends[-1]) + np.repeat(hi - ends, hi - lo)])
    i, j = (np.concatenate(x) if x else order for x in (i, j))
    gap = words.x[j] - (words.x + words.w)[i]
    near = (gap >= -1) & (gap <= height * 1.5) & (i != j)
    i, j = i[near], j[near]
    by = np.lexsort([j, words.x[j], i])
    before, after = np.zeros(n, bool), [[] for _ in range(n)]
    before[j] = True
    for k, m in zip(i[by].tolist(), j[by].tolist(), strict=True):
        after[k].append(m)
    return after, before


def names_of(words: Words, height: float) -> list[Name]:
    """Nutrient names of one to three neighbouring words, in reading order; no word is in two names."""
    after, before = _neighbours(words, height)
    used, found = np.zeros(len(words.x), bool), []
    for start in range(len(words.x)):
        if used[start]:
            continue
        chain = [start]
        while len(chain) < 3:
            free = [i for i in after[chain[-1]] if not used[i]]
            if not free or free[0] in chain:
                break
            chain.append(free[0])
        for n in range(len(chain), 0, -1):
            own = chain[:n]
            text = " ".join(t for t in words.joined(own, words.loose).split() if t not in UNIT_WORDS)
            bare = n == 1 and text in _GENERIC
            if not text or (bare and before[start]):  # after another word it ends a longer name
                continue
            if (hit := nutrient_of(text)) is not None:
                found.append(Name(hit[0], start, own[-1], words.joined(own, words.s), hit[1], bare))
                used[own] = True
                break
    proper = {(f.nutrient, words.page[f.last]) for f in found if not f.bare}
    return [f for f in found if not f.bare or (f.nutrient, words.page[f.last]) not in proper]


def _numbers(readings: list[float | None]) -> list[float]:
    return [v for v in readings if v is not None]


def _agrees(readings: list[float | None], expected: list[float] | None, floor: float) -> bool:
    return bool(expected) and any(abs(v - e) <= max(floor, abs(e) * AGREES_WITHIN) for v in _numbers(readings) for e in expected)


def best_pairs(names_y: np.ndarray, reach: np.ndarray, column_y: np.ndarray, agrees: np.ndarray, inside: np.ndarray, pitch: float) -> tuple[list[tuple[int, int]], float, float]:
    """The pairs (name, number) of the slopes a + b * (y - middle) with the best score, and these slopes.

    ``reach`` is how far to the right of each name the column of numbers stands. At each slope a name takes the nearest
    number within half a pitch, a number keeps the nearest of its names. The score counts pairs, numbers inside the table
    without a name, distances, steepness, and pairs that agree with the sheet. Equal scores: the least a, then the least b.

    A slope's score is at most what its names would give if each kept a number of its own; only slopes for which that reaches the
    best score are scored in full.
    """
    middle = (names_y.max() + names_y.min()) / 2
    many, best = max(1, _AT_ONCE // (len(SLOPES_B) * max(len(names_y), len(column_y)))), None

    def scored(gap: np.ndarray, near: np.ndarray, steep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores of some slopes, and the names that numbers keep."""
        owner, least = np.full((len(gap), len(column_y)), -1), np.full((len(gap), len(column_y)), np.inf)
        for i in range(len(names_y)):
            k = np.flatnonzero((gap[:, i] <= pitch * 0.5) & (gap[:, i] < least[np.arange(len(gap)), near[:, i]]))
            owner[k, near[k, i]], least[k, near[k, i]] = i, gap[k, i]
        taken = owner >= 0
        agree = (agrees[owner, np.arange(len(column_y))] & taken).sum(1)
        distance = np.where(taken, least, 0).sum(1) / pitch
        return taken.sum(1) - UNPAIRED * (~taken & inside).sum(1) - DISTANCE * distance - STEEPNESS * steep + AGREEMENT * agree, owner

    for start in range(0, len(SLOPES_A), many):
        slopes = SLOPES_A[start : start + many]
        at = names_y + (slopes[:, None, None] + SLOPES_B[:, None] * (names_y - middle)) * reach
        at = at.reshape(-1, len(names_y))  # a and b, name
        near, gap = np.zeros(at.shape, np.intp), np.full(at.shape, np.inf)
        for c, y in enumerate(column_y):
            far = np.abs(y - at)
            np.copyto(near, c, where=far < gap)
            np.minimum(gap, far, out=gap)
        steep = (np.abs(slopes)[:, None] + np.abs(SLOPES_B) * 100).ravel()
        reached = gap <= pitch * 0.5
        worth = np.where(reached, 1 + AGREEMENT * agrees[np.arange(len(names_y)), near] - DISTANCE / pitch * gap, 0)
        most = worth.sum(1) - UNPAIRED * np.maximum(0, inside.sum() - reached.sum(1)) - STEEPNESS * steep
        own = most.argmax()[None]
        score, owner = scored(gap[own], near[own], steep[own])
        also = np.flatnonzero(most >= max(float(score[0]), best[0] if best else -np.inf) - _ROUNDING)
        if len(also) > 1:
            own = also
            score, owner = scored(gap[own], near[own], steep[own])
        k = int(score.argmax())
        top = int(own[k])
        if best is None or score[k] > best[0]:
            best = float(score[k]), float(slopes[top // len(SLOPES_B)]), float(SLOPES_B[top % len(SLOPES_B)]), owner[k]
    _, a, b, owner = best
    return [(int(n), c) for c, n in enumerate(owner) if n >= 0], a, b


def value_column(mid: np.ndarray, height: float, need: int) -> np.ndarray | None:
    """The first dense stack of numbers: those within 1.2 text heights of the centre that grows from the leftmost number with enough neighbours. ``mid`` is sorted."""
    width = height * 1.2
    count = np.searchsorted(mid, mid + width, "right") - np.searchsorted(mid, mid - width, "left")
    dense = np.flatnonzero(count >= need)
    if not len(dense):
        return None
    centre = mid[dense[0]]
    for _ in range(3):
        centre = mid[np.abs(mid - centre) <= width].mean()
    return np.abs(mid - centre) <= width


class Found(NamedTuple):
    nutrient: int
    text: str
    typo: bool
    values: list[float | None]


def _page_values(words: Words, names: list[Name], numbers: np.ndarray, expected: dict[int, list[float]], height: float, known: set[int]) -> list[Found]:
    """The values of the nutrients named on one page."""
    first, last = np.array([n.first for n in names]), np.array([n.last for n in names])
    names_y, ends = words.y[last], words.x[last] + words.w[last]
    edge = _median(ends)
    # the tilt of columns: the median slope between the names' left edges, so that indented names don't matter
    i, j = np.triu_indices(len(names), 1)
    dy = words.y[first][j] - words.y[first][i]
    steep = np.abs(dy) > height * 2
    tilts = (words.x[first][j] - words.x[first][i])[steep] / dy[steep]
    tilt = float(np.clip(_median(tilts), -0.2, 0.2)) if len(tilts) else 0.0
    level = names_y.mean()
    mid = words.x + words.w / 2 - tilt * (words.y - level)
    right = numbers[(words.x[numbers] >= edge - 2) & (words.x[numbers] - edge <= height * 16)]
    right = right[np.argsort(mid[right], kind="stable")]
    stack = value_column(mid[right], height, max(3, -(-len(names) * 2 // 5))) if len(right) else None
    if stack is None:
        return []
    column = right[stack]
    column_x = (words.x[column] - tilt * (words.y[column] - level)).mean() + tilt * (names_y - level)
    down = np.sort(names_y)[::-1]
    gaps = -np.diff(down)
    gaps = gaps[gaps > height * 0.5]
    pitch = _median(gaps) if len(gaps) else height * 1.6
    column_y = words.y[column]
    inside = (column_y <= down[0] + pitch) & (column_y >= down[-1] - pitch)
    agrees = np.array([[_agrees(words.readings[c], expected.get(n.nutrient), NUTRIENTS[n.nutrient][4]) for c in column] for n in names])
    pairs, a, b = best_pairs(names_y, column_x - ends, column_y, agrees, inside, pitch)
    middle = (down[0] + down[-1]) / 2
    found = []
    for k, c in pairs:
        own, slope = int(column[c]), a + b * (names_y[k] - middle)
        values = list(words.readings[own])
        at = own
        for _ in range(2):  # the columns after the first, along the same line
            off = words.x[numbers] - words.x[own]
            further = numbers[(words.x[numbers] > words.x[at] + height * 3) & (off <= height * 14) & (np.abs(words.y[numbers] - words.y[own] - slope * off) <= height * 0.55)]
            if not len(further):
                break
            at = int(further[np.argmin(words.x[further])])
            values += words.readings[at]
        found.append(Found(names[k].nutrient, names[k].text, names[k].typo, values))
    return found + _by_position(words, names, column, pairs, expected, known | {f.nutrient for f in found})


def _by_position(words: Words, names: list[Name], column: np.ndarray, pairs: list[tuple[int, int]], expected: dict[int, list[float]], known: set[int]) -> list[Found]:
    """Numbers left over, given to the only nutrient that stands between the nutrients of the pairs above and below in the usual order, hasn't been read, and has such a value on the sheet."""
    paired, out = {c for _, c in pairs}, []
    places = sorted(((words.y[column[c]], names[k].nutrient) for k, c in pairs), key=lambda p: -p[0])
    for c, word in enumerate(column):
        if c in paired:
            continue
        above = [n for y, n in places if y > words.y[word]]
        below = [n for y, n in places if y < words.y[word]]
        between = range(above[-1] + 1 if above else 0, below[0] if below else len(NUTRIENTS))
        fits = [n for n in between if n not in known and _agrees(words.readings[word], expected.get(n), NUTRIENTS[n][4])]
        if len(fits) == 1:
            known = known | {fits[0]}
            out.append(Found(fits[0], NUTRIENTS[fits[0]][1], False, _numbers(words.readings[word])))
    return out


def photo_values(words: Words, expected: dict[int, list[float]]) -> tuple[list[Found], list[Name]]:
    """The nutrients of a photographed label with their values, empty unless three are found; and the misspelt names."""
    if len(words.x) < TABLE_WORDS:
        return [], []
    height = _median(words.h) or 7.0
    names = names_of(words, height)
    if len(names) < TABLE_NAMES:
        return [], []
    found: dict[int, Found] = {}
    for page in dict.fromkeys(words.page[n.last] for n in names):
        own = [n for n in names if words.page[n.last] == page]
        if len(own) >= TABLE_NAMES:
            for f in _page_values(words, own, np.flatnonzero(words.numeric & (words.page == page)), expected, height, set(found)):
                prev = found.get(f.nutrient)
                found[f.nutrient] = f._replace(text=prev.text, typo=prev.typo or f.typo, values=prev.values + f.values) if prev else f
    return (list(found.values()) if len(found) >= TABLE_NAMES else []), [n for n in names if n.typo]


_CELLS = "label_id {kind}, key string, title string, typo boolean, row_label string, values array<double>"


def photo_cells(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(label_id, key, title, typo, row_label, values) of photographed labels, by geometry rather than by rows.

    ``rows``: the lines of such labels (label_id, row_no, items) as ``labels.rows`` gives them; ``expected``: (label_id, key,
    values), what the sheet says. Values are null where only a misspelt name was found. Labels without three nutrients give
    no values.
    """
    words = rows.select("label_id", "row_no", F.col("page").alias("page"), F.posexplode("items").alias("at", "it"))
    tokens = F.split(F.col("it.s"), r"\s+")
    number = lambda t: F.when(is_cell(ocr_fix(t)), F.array(cell_value(ocr_fix(t)))).otherwise(F.array().cast("array<double>"))
    others = lambda t: F.filter(F.transform(ocr_alternatives(ocr_fix(t)), cell_value), lambda v: v.isNotNull())
    words = words.select(
        "label_id", "row_no", "at", "page", "it.s", "it.x", "it.y", "it.w", "it.h", loosened(F.col("it.s")).alias("loose"), F.forall(tokens, lambda t: is_cell(ocr_fix(t))).alias("numeric"),
        F.flatten(F.transform(tokens, lambda t: F.concat(number(t), others(t)))).alias("readings"),
    )
    kind = dict(rows.dtypes)["label_id"]
    order = {key: i for i, (key, *_) in enumerate(NUTRIENTS)}
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.float64())]

    def fields(lists: pa.ListArray) -> tuple[np.ndarray, Callable[[str], pa.Array]]:
        """Where each list of structs starts, and the fields of all."""
        each, offsets = lists.flatten(), lists.offsets.to_numpy()
        return offsets - offsets[0], lambda c: each.field(each.type.get_field_index(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, word = fields(batch.column("words"))
            x, y, w, h, page, numeric = (word(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "w", "h", "page", "numeric"))
            s, loose, readings = (word(c).to_pylist() for c in ("s", "loose", "readings"))
            stops, fact = fields(batch.column("said"))
            keys, values = fact("key").to_pylist(), fact("values").to_pylist()
            numeric, at, lines = numeric.astype(bool), [], []
            for k in range(batch.num_rows):
                a, b = ends[k], ends[k + 1]
                own = Words(x[a:b], y[a:b], w[a:b], h[a:b], page[a:b], s[a:b], loose[a:b], numeric[a:b], readings[a:b])
                sheet = {order[keys[i]]: [v for v in values[i] if v is not None] for i in range(stops[k], stops[k + 1]) if keys[i] in order}
                found, typos = photo_values(own, sheet)
                seen = {f.nutrient for f in found if f.typo}
                lines += [(f.nutrient, f.typo, f.text, f.values) for f in found] + [(n.nutrient, True, n.text, None) for n in {n.nutrient: n for n in reversed(typos)}.values() if n.nutrient not in seen]
                at += [k] * (len(lines) - len(at))
            columns = [[NUTRIENTS[n][0] for n, *_ in lines], [NUTRIENTS[n][1] for n, *_ in lines], [t for _, t, *_ in lines], [t for *_, t, _ in lines], [v for *_, v in lines]]
            yield pa.RecordBatch.from_arrays([batch.column("label_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["label_id", "key", "title", "typo", "row_label", "values"])

    # a row a label: a group a label would cross to Python by itself
    word, fact = F.struct("row_no", "at", "page", "s", "x", "y", "w", "h", "loose", "numeric", "readings").alias("word"), F.struct("key", "values").alias("fact")
    both = words.select("label_id", word).unionByName(expected.select("label_id", fact), allowMissingColumns=True)
    each = spread(both, "label_id").groupBy("label_id").agg(F.array_sort(F.collect_list("word")).alias("words"), F.collect_list("fact").alias("said"))
    return each.mapInArrow(run, _CELLS.format(kind=kind))


def expected_values(reference: DataFrame) -> DataFrame:
    """(label_id, key, values): what the blocks of each label's product say of each nutrient."""
    said = lambda key: F.array_compact(F.transform("nutrition", lambda b: b[key]))
    each = F.array(*[F.struct(F.lit(key).alias("key"), said(key).alias("values")) for key, *_ in NUTRIENTS])
    return reference.select("label_id", F.explode(each).alias("e")).select("label_id", "e.*").filter(F.size("values") > 0)


#: A photo's nutrients come after all rows of the label.
_AFTER = 1_000_000_000


def with_photo_cells(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Cells by rows (``labels.nutrition_cells``) with those found by geometry in their place; a misspelt name is listed once."""
    read = found.filter(F.col("values").isNotNull())
    own = cells.join(read.select("label_id", "key", F.lit(True).alias("_read")), ["label_id", "key"], "left")
    own = own.withColumn("values", F.when(F.col("_read"), F.array().cast("array<double>")).otherwise(F.col("values"))).select(*cells.columns)
    listed = cells.filter("typo").select("label_id", "title", F.lit(True).alias("_listed")).distinct()
    more = found.join(listed, ["label_id", "title"], "left").withColumn("typo", F.col("typo") & F.col("_listed").isNull()).filter("typo OR values IS NOT NULL")
    none = F.lit(None).cast("double")
    more = more.withColumns({"key": F.when(F.col("values").isNotNull(), F.col("key")), "values": F.coalesce("values", F.array().cast("array<double>")), "row_no": F.lit(_AFTER).cast("int"), "x": none, "y": none})
    return own.unionByName(more.select(*cells.columns))
