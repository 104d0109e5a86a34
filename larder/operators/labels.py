"""Label text in reading order: rows, columns and views of positioned items, paragraphs under headings, nutrition cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.distance import osa_distance
from larder.functions.geometry import anchored_clusters
from larder.functions.text import ao_key, cell_value, is_cell, normalize, ocr_alternatives, ocr_fix, words
from larder.sources.schema import NUTRIENTS, UNIT_WORDS
from larder.sources.tables import listed

# Row tolerance of text layers and of OCR, column tolerance, least gap before another panel's text, headings that end a paragraph.
ROW_TOLERANCE, OCR_ROW_TOLERANCE, COLUMN_TOLERANCE = 2.5, 4.8, 6.0
LABEL_GAP, OCR_LABEL_GAP = 30.0, 4.5
STOP = (
    r"^(oil separation|do not consume|store in|store at|storage|avoid storing|allergen|packed|manufactured|marketed|best before|use by|net wt|net weight|mrp|batch|date of|customer care|fssai|lic no|nutritional|nutrition|serving|directions|shelf life|ingredients)(?![a-z0-9])"
)


def join_items(items: Column) -> Column:
    """Item texts left to right, with a space only where a gap shows."""
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("double").alias("end"))

    def step(acc: Column, it: Column) -> Column:
        gap = it["x"] - acc["end"] > 0.15 * F.greatest(it["h"], F.lit(1.0))
        space = F.when(acc["end"].isNotNull() & (gap | ~acc["out"].rlike(r"\S$")), " ").otherwise("")
        return F.struct(F.concat(acc["out"], space, it["s"]).alias("out"), (it["x"] + it["w"]).alias("end"))

    return F.trim(F.regexp_replace(F.aggregate(items, start, step, lambda acc: acc["out"]), r"\s+", " "))


def rows(items: DataFrame, labels: DataFrame) -> DataFrame:
    """(label_id, row_no, page, y, items, text): upright items on one baseline, pages and rows downward, items rightward."""
    tol = F.when(F.col("source") == "ocr", OCR_ROW_TOLERANCE).otherwise(ROW_TOLERANCE)
    upright = items.filter(~F.col("rotated")).join(labels.select("label_id", tol.alias("tol")), "label_id")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "ord", "s", "x", "y", "w", "h")))
    pages = upright.groupBy("label_id", "page").agg(ordered.alias("items"), F.first("tol").alias("tol"))
    clusters = anchored_clusters(F.col("items"), "y", F.col("tol"))
    each = listed(pages.select("label_id", "page", F.arrays_zip("items", clusters.alias("c")).alias("zs")), "zs", "z")
    lines = each.groupBy("label_id", "page", F.col("z.c.cluster").alias("cluster")).agg(F.first("z.c.anchor").alias("y"), F.array_sort(F.collect_list(F.struct("z.items.x", "z.items.ord", "z.items.s", "z.items.y", "z.items.w", "z.items.h"))).alias("items"))
    number = F.row_number().over(Window.partitionBy("label_id").orderBy("page", "cluster")).alias("row_no")
    return lines.select("label_id", number, "page", "y", "items", join_items(F.col("items")).alias("text"))


def columns(items: DataFrame) -> DataFrame:
    """(label_id, text): x-aligned columns of two or more upright items, read downward."""
    ordered = F.array_sort(F.collect_list(F.struct("x", "ord", "y", "s")))
    pages = items.filter(~F.col("rotated")).groupBy("label_id", "page").agg(ordered.alias("items"))
    each = pages.select("label_id", "page", F.explode(F.arrays_zip("items", anchored_clusters(F.col("items"), "x", COLUMN_TOLERANCE).alias("c"))).alias("z"))
    lines = each.groupBy("label_id", "page", "z.c.cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("z.items.y")).alias("down"), "z.items.x", "z.items.ord", "z.items.s"))).alias("items"))
    return lines.filter(F.size("items") > 1).select("label_id", F.array_join(F.transform("items", lambda i: i["s"]), " ").alias("text"))


def context(items: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a label: ocr, flat text, normalised views (rows, columns, rotated text), its words, and its rows in order."""
    lines = rows(items, labels)
    line = F.struct("row_no", "page", "y", "items", "text")
    flat = lines.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("row_no", F.col("text").alias("t")))).alias("t"), F.array_sort(F.collect_list(line)).alias("rows"))
    flat = flat.select("label_id", F.array_join(F.transform("t", lambda x: x["t"]), " ").alias("flat"), "rows")
    cols = columns(items).groupBy("label_id").agg(F.array_sort(F.collect_list(normalize(F.col("text")))).alias("cols"))
    turned = items.filter("rotated").groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("ord", "s"))).alias("t"))
    turned = turned.select("label_id", F.array(normalize(F.array_join(F.transform("t", lambda x: x["s"]), " "))).alias("turned"))
    none = F.array().cast("array<string>")
    out = labels.select("label_id", (F.col("source") == "ocr").alias("ocr")).join(flat, "label_id", "left").join(cols, "label_id", "left").join(turned, "label_id", "left")
    out = out.withColumn("flat", F.coalesce("flat", F.lit("")))
    out = out.withColumn("views", F.concat(F.array(normalize(F.col("flat"))), F.coalesce("cols", none), F.coalesce("turned", none)))
    return out.withColumn("label_words", F.array_distinct(F.flatten(F.transform("views", lambda v: F.split(v, " "))))).drop("cols", "turned")


def heading_at(lines: Column, pattern: str) -> Column:
    """Struct (row, item) of the first item whose normalised text starts a heading, both from 0; null if none does."""
    hits = F.flatten(F.transform(lines, lambda r, i: F.transform(F.filter(F.transform(r["items"], lambda it, k: F.struct(k.alias("k"), normalize(it["s"]).rlike(pattern).alias("hit"))), lambda x: x["hit"]), lambda x: F.struct(i.alias("row"), x["k"].alias("item")))))
    return F.get(hits, 0)


def table_edge(at: Column, lines: Column, cells: Column) -> Column:
    """The x where a nutrition table beside a heading starts (cells: array of (x, y) of its row labels), less 2; null if there is none."""
    head = F.get(F.get(lines, at["row"])["items"], at["item"])
    y = F.get(lines, at["row"])["y"]
    beside = F.filter(cells, lambda c: (c["x"] > head["x"] + 30) & (c["y"] <= y + 3) & (c["y"] >= y - 130))
    return F.array_min(F.transform(beside, lambda c: c["x"])) - 2


def block_under(lines: Column, at: Column, column_gap: Column | float, align: Column | float, edge_x: Column | None = None, most_rows: int = 30) -> Column:
    """The paragraph that starts at a heading: what follows a colon, the rest of its line up to a gap, and the aligned lines below.

    A fold over the lines below with the paragraph's drifting left edge, its last line, and whether it has ended.
    """
    x_max = F.lit(float("inf")) if edge_x is None else F.coalesce(edge_x, F.lit(float("inf")))
    row0 = F.get(lines, at["row"])
    head = F.get(row0["items"], at["item"])
    lead = F.when(F.contains(head["s"], F.lit(":")), F.trim(F.regexp_extract(head["s"], r"(?s)^[^:]*:(.*)$", 1))).otherwise("")

    def run(items: Column, edge: Column, left: Column) -> Column:
        """Items up to the first gap."""
        start = F.struct(F.array().cast("array<struct<x:double,ord:bigint,s:string,y:double,w:double,h:double>>").alias("kept"), edge.alias("edge"), F.lit(True).alias("open"))

        def step(acc: Column, it: Column) -> Column:
            ok = acc["open"] & (it["x"] >= left) & (it["x"] < x_max) & (it["x"] - acc["edge"] <= column_gap)
            return F.struct(F.when(ok, F.concat(acc["kept"], F.array(it))).otherwise(acc["kept"]).alias("kept"), F.when(ok, it["x"] + it["w"]).otherwise(acc["edge"]).alias("edge"), ok.alias("open"))

        return F.aggregate(items, start, step, lambda acc: acc["kept"])

    after = F.slice(row0["items"], at["item"] + 2, F.size(row0["items"]))
    same = join_items(run(after, head["x"] + head["w"], head["x"]))
    gap = F.greatest(head["h"], F.lit(4.0)) * 3.6
    state = F.struct(F.array_compact(F.array(F.when(lead != "", lead), F.when(same != "", same))).alias("parts"), head["x"].alias("x"), row0["y"].alias("y"), F.lit(False).alias("contains"), F.lit(True).alias("open"))

    def below(acc: Column, line: Column) -> Column:
        far = (line["page"] != row0["page"]) | (acc["y"] - line["y"] > gap)
        cand = F.filter(line["items"], lambda i: (i["x"] >= acc["x"] - align - 1) & (i["x"] < x_max))
        first = F.get(cand, 0)
        beside = first.isNull() | (F.abs(first["x"] - acc["x"]) > align)
        text = join_items(run(cand, first["x"], first["x"]))
        stop = normalize(text).rlike(STOP)
        takes = acc["open"] & ~far & ~beside & ~stop
        contains = acc["contains"] | (takes & text.rlike(r"^CONTAINS(?![A-Za-z0-9_])"))
        ends = takes & contains & text.rlike(r"\.\s*$")
        still = acc["open"] & ~far & (beside | ~stop) & ~ends
        return F.struct(F.when(takes, F.concat(acc["parts"], F.array(text))).otherwise(acc["parts"]).alias("parts"), F.when(takes, first["x"]).otherwise(acc["x"]).alias("x"), F.when(takes, line["y"]).otherwise(acc["y"]).alias("y"), F.coalesce(contains, F.lit(False)).alias("contains"), F.coalesce(still, F.lit(False)).alias("open"))

    text = F.aggregate(F.slice(lines, at["row"] + 2, most_rows - 1), state, below, lambda acc: F.array_join(acc["parts"], " "))
    return F.when(at.isNotNull(), F.trim(F.regexp_replace(text, r"\s+", " ")))


def text_near(lines: Column, at: Column, edge_x: Column, most_rows: int = 30) -> Column:
    """All text from a heading down to the next blank stretch or heading, left of the edge, whatever column it stands in."""
    x_max = F.coalesce(edge_x, F.lit(float("inf")))
    row0 = F.get(lines, at["row"])
    head = F.get(row0["items"], at["item"])
    own = F.slice(row0["items"], at["item"] + 1, F.size(row0["items"]))
    state = F.struct(F.array(join_items(F.filter(own, lambda i: i["x"] < x_max))).alias("parts"), row0["y"].alias("y"), F.lit(True).alias("open"))

    def below(acc: Column, line: Column) -> Column:
        far = (line["page"] != row0["page"]) | (acc["y"] - line["y"] > F.greatest(head["h"], F.lit(4.0)) * 3.6)
        text = join_items(F.filter(line["items"], lambda i: i["x"] < x_max))
        still = acc["open"] & ~far & ((text == "") | ~normalize(text).rlike(STOP))
        takes = still & (text != "")
        return F.struct(F.when(takes, F.concat(acc["parts"], F.array(text))).otherwise(acc["parts"]).alias("parts"), F.when(takes, line["y"]).otherwise(acc["y"]).alias("y"), F.coalesce(still, F.lit(False)).alias("open"))

    text = F.aggregate(F.slice(lines, at["row"] + 2, most_rows - 1), state, below, lambda acc: F.array_join(acc["parts"], " "))
    return F.when(at.isNotNull(), F.trim(F.regexp_replace(text, r"\s+", " ")))


def nutrient_names(spark) -> DataFrame:
    """(ord, key, title, name): every name of every nutrient; a fixed list."""
    return spark.createDataFrame([(i, key, title, name) for i, (key, title, names, _, _) in enumerate(NUTRIENTS) for name in names], "ord int, key string, title string, name string")


def resolve_names(found: DataFrame) -> DataFrame:
    """(label_norm, ocr, key, title, typo): exact names first, then a/o-folded ones (OCR), then ones an edit or two away; least nutrient order."""
    names = F.broadcast(nutrient_names(found.sparkSession))
    spans = F.when(F.length("name") >= 9, 2).when(F.length("name") >= 6, 1).otherwise(0)
    pairs = found.select("label_norm", "ocr").distinct().join(names, F.abs(F.length("label_norm") - F.length("name")) <= 2)
    near = (spans > 0) & (osa_distance(F.col("label_norm"), F.col("name"), 2) <= spans)
    tier = F.when(F.col("label_norm") == F.col("name"), 0).when(F.col("ocr") & (ao_key(F.col("label_norm")) == ao_key(F.col("name"))), 1).when(near, 2)
    best = F.min(F.struct("tier", "ord", "key", "title")).alias("b")
    return pairs.withColumn("tier", tier).filter("tier IS NOT NULL").groupBy("label_norm", "ocr").agg(best).select("label_norm", "ocr", F.col("b.key").alias("key"), F.col("b.title").alias("title"), (F.col("b.tier") == 2).alias("typo"))


def nutrition_cells(ctx: DataFrame) -> DataFrame:
    """(label_id, row_no, key, title, typo, row_label, values): for each line the first number whose label names a nutrient, and the line's cells from there."""
    lines = ctx.select("label_id", "ocr", F.explode("rows").alias("r")).select("label_id", "ocr", F.col("r.row_no").alias("row_no"), F.col("r.y").alias("y"), F.col("r.items").alias("items")).filter(F.size("items") > 1)
    at = lines.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("items") - 1)))
    fixed = lambda t: F.when(F.col("ocr"), ocr_fix(t)).otherwise(t)
    tokens = lambda s: F.split(s, r"\s+")
    gap = F.when(F.col("ocr"), OCR_LABEL_GAP).otherwise(LABEL_GAP)
    breaks = F.filter(F.sequence(F.lit(0), F.col("i") - 1), lambda j: (j > 0) & (F.get("items", j)["x"] - (F.get("items", j - 1)["x"] + F.get("items", j - 1)["w"]) > gap))
    numbers = at.filter(F.forall(tokens(F.get("items", F.col("i"))["s"]), lambda t: is_cell(fixed(t)))).withColumn("start", F.coalesce(F.array_max(breaks), F.lit(0)))
    labelled = numbers.withColumn("row_label", join_items(F.slice("items", F.col("start") + 1, F.col("i") - F.col("start"))))
    norm = F.array_join(F.filter(words(F.col("row_label")), lambda w: ~w.isin(*UNIT_WORDS)), " ")
    labelled = labelled.withColumn("label_norm", norm).filter("label_norm <> ''")
    known = labelled.join(resolve_names(labelled), ["label_norm", "ocr"])
    all_tokens = F.flatten(F.transform(F.slice("items", F.col("i") + 1, F.size("items")), lambda it: tokens(it["s"])))

    def readings(t: Column) -> Column:
        own = F.when(is_cell(fixed(t)), F.array(cell_value(fixed(t)))).otherwise(F.array().cast("array<double>"))
        other = F.filter(F.transform(ocr_alternatives(ocr_fix(t)), cell_value), lambda v: v.isNotNull())
        return F.when(F.col("ocr"), F.concat(own, other)).otherwise(own)

    values = F.flatten(F.transform(all_tokens, readings))
    first = F.min_by(F.struct("key", "title", "typo", "row_label", values.alias("values"), F.get("items", F.col("start"))["x"].alias("x"), "y"), "i").alias("f")
    return known.groupBy("label_id", "row_no").agg(first).select("label_id", "row_no", "f.*")
