"""The label audit: one row a label in, a long table of checks out, step by step.

All checks are expressions over a label's row: its flat text, views, words and nutrition cells beside the product's
fields. Many labels audit in one job, and one pass over the rows gives the checks of all steps.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from larder.functions.distance import TriesByPool
from larder.functions.numbers import number_text
from larder.functions.text import absence_target, ao_key, find_all, has_phrase, made_with_target, normalize, split_outside_brackets, words
from larder.operators import photo
from larder.operators.checks import ocr_post_pass
from larder.operators.labels import block_under, context, heading_at, nutrition_cells, table_edge, text_near
from larder.operators.matching import best_suggestion
from larder.sources.schema import NUTRIENTS
from larder.sources.tables import cut_lineage, listed, spread

# Aliases of absent ingredients, allergen groups, words that may stand in capitals, tolerances.
ABSENCE_ALIASES = {"maida": ("maida", "refined wheat flour", "refined flour", "all purpose flour"), "refined sugar": ("refined sugar", "white sugar", "sugar syrup", "invert sugar")}
ALLERGENS = (
    ("gluten", "gluten|wheat|barley|rye"),
    ("milk", "milk|dairy|whey|casein|lactose"),
    ("soya", "soya|soy|soybeans?"),
    ("peanut", "peanuts?|groundnuts?"),
    ("tree nuts", "tree nuts?|almonds?|cashews?|walnuts?|pistachios?|hazelnuts?"),
    ("nuts", "nuts"),
    ("mustard", "mustard"),
    ("sesame", "sesame"),
    ("egg", "eggs?"),
    ("fish", "fish"),
    ("crustacean", "crustaceans?|shellfish|prawns?"),
)
# The words that a misread allergen word may stand for.
ALLERGEN_WORDS = {
    "gluten": ("gluten", "wheat", "barley"),
    "milk": ("milk", "dairy", "whey", "casein", "lactose"),
    "soya": ("soya", "soybean", "soybeans"),
    "peanut": ("peanut", "peanuts", "groundnut", "groundnuts"),
    "tree nuts": ("almond", "almonds", "cashew", "cashews", "walnut", "walnuts", "pistachio", "pistachios", "hazelnut", "hazelnuts"),
    "mustard": ("mustard",),
    "sesame": ("sesame",),
    "crustacean": ("crustacean", "crustaceans", "shellfish"),
}
ALLOWED_CAPS = ("INS", "GMO", "FSSAI")
FACILITY = r"(?i)made in a facility|manufactured in a facility|in a facility|may contain|processed in|processes"
WEIGHT_TOLERANCE, PRICE_TOLERANCE, UNIT_PRICE_PASS, UNIT_PRICE_WARN, FAIL_PCT = 0.01, 0.001, 0.011, 0.05, 2.0
CLAIMS_PRINTED, OCR_CLAIMS_PRINTED = 0.4, 0.75

REFERENCE = "label_id, product_name, usps, ingredients, allergens, manufacturer, nutrition, pack_size_g, expected_mrp"
_CHECKS = "array<struct<label:string,status:string,expected:string,found:string,note:string,sop_rule:boolean>>"
_END, _START = "(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])"


def check(label: Column | str, status: Column | str, expected: Column | None = None, found: Column | None = None, note: Column | str | None = None, sop: bool = False) -> Column:
    text = lambda c: (F.lit(c) if c is None or isinstance(c, str) else c).cast("string")
    return F.struct(text(label).alias("label"), text(status).alias("status"), text(expected).alias("expected"), text(found).alias("found"), text(note).alias("note"), F.lit(sop).alias("sop_rule"))


def _listed(*checks: Column) -> Column:
    """Checks without the null ones; by concat, as checks inside array_compact would run without generated code."""
    return F.concat(*[F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast(_CHECKS)) for c in checks])


def _if_any(ws: Column, pool: Column) -> Column:
    """The pool of rows with words to look for; others needn't send theirs to Python."""
    return F.when(F.size(ws) > 0, pool)


@F.pandas_udf(ArrayType(StringType()))
def _near(own: pd.Series, pool: pd.Series, long: pd.Series) -> pd.Series:
    tries = TriesByPool()

    def of(ws, ps, n):
        tested = [w for w in ws if len(w) >= 5] if ws is not None else []
        if not tested or ps is None or not len(ps):
            return []
        trie = tries.of(ps)
        return [w for w in tested if trie.near(w, 2 if len(w) >= n else 1) is not None]

    return pd.Series([of(*x) for x in zip(own, pool, long, strict=True)])


def near_words(own: Column, pool: Column, long: int = 8) -> Column:
    """Words of 5 letters or more that the pool nearly has (one edit; two for long ones)."""
    return _near(own, _if_any(own, pool), F.lit(long))


@F.pandas_udf(ArrayType(StringType()))
def _damaged(absent: pd.Series, pool: pd.Series) -> pd.Series:
    tries = TriesByPool()

    def fragment(w, ps, trie):
        most = 1 if len(w) <= 3 else 2 if len(w) <= 7 else -(-len(w) * 2 // 5)
        places = [p for p in (trie.start_of(w, 3), trie.near(w, most, 2)) if p is not None]
        return ps[min(places)] if places else None

    def of(ws, ps):
        if ws is None or ps is None or not len(ws):
            return []
        trie = tries.of(ps)
        return [fragment(w, ps, trie) for w in ws]

    return pd.Series([of(*x) for x in zip(absent, pool, strict=True)])


def damaged_words(absent: Column, pool: Column) -> Column:
    """Array of (word, fragment): absent words with the first word of the pool that may be a damaged piece of each: its start, or a few edits away (40 % of a long word)."""
    pairs = F.arrays_zip(absent.alias("word"), _damaged(absent, _if_any(absent, pool)).alias("fragment"))
    return F.filter(pairs, lambda d: d["fragment"].isNotNull())


@F.pandas_udf(ArrayType(StringType()))
def _unlike(ws: pd.Series, pool: pd.Series) -> pd.Series:
    tries = TriesByPool()

    def of(ws, ps):
        if ws is None or not len(ws) or ps is None or not len(ps):
            return [] if ws is None else list(ws)
        trie = tries.of(ps)
        return [w for w in ws if not trie.has_start(w) and trie.start_of(w, 1) is None and trie.near(w, math.ceil(len(w) * 0.45)) is None]

    return pd.Series([of(*x) for x in zip(ws, pool, strict=True)])


def unlike_words(ws: Column, pool: Column) -> Column:
    """Words that nothing in the pool resembles: none starts the other, and none is within 45 % of the word's letters in OSA edits."""
    return _unlike(ws, _if_any(ws, pool))


def _printed(phrase: Column) -> Column:
    return F.exists("views", lambda v: has_phrase(v, phrase))


def _pool() -> Column:
    """Label words that near matches may use: OCR only."""
    return F.when(F.col("ocr"), F.col("label_words")).otherwise(F.array().cast("array<string>"))


def name_step(rows: DataFrame) -> DataFrame:
    own = words(F.col("product_name"))
    rows = rows.withColumn("_absent", F.array_except(own, F.col("label_words"))).withColumn("_near", near_words(F.col("_absent"), _pool()))
    rows = rows.withColumn("_missing", F.filter("_absent", lambda w: ~F.array_contains("_near", w)))
    name, missing = F.col("product_name"), F.col("_missing")
    status = F.when(F.size(missing) * 2 >= F.size(own), "fail").otherwise("warn")
    best = F.when(_printed(normalize(name)), check("Product name", "pass", name, name)).when(F.size(missing) == 0, check("Product name", "warn", name, F.lit("Same words, but not as one phrase")))
    return rows.withColumn("step2", _listed(best.otherwise(check("Product name", status, name, F.concat(F.lit("Missing words: "), F.array_join(missing, ", ")))))).drop("_absent", "_near", "_missing")


def _block_value(target: Column) -> Column:
    """Value of the nutrient named, in the 100 g block or else the first."""
    block = F.coalesce(F.get(F.filter("nutrition", lambda b: b["grammage"] == 100), 0), F.get("nutrition", 0))
    return F.coalesce(*[F.when(target.isin(*names), block[key]) for key, _, names, _, _ in NUTRIENTS])


def _list_has(list_norm: Column, target: Column) -> Column:
    singular = F.when(target.endswith("s"), F.substring(target, F.lit(1), F.length(target) - 1)).otherwise(target)
    padded = F.concat(F.lit(" "), list_norm)
    return reduce(lambda a, b: a | b, [(f != "") & F.contains(padded, F.concat(F.lit(" "), f)) for f in (target, singular)])


def _nearly_listed(target: Column) -> Column:
    """Photos: whether each word of a target is in the label's ingredient list, or nearly (``_near_list``)."""
    return F.col("ocr") & F.forall(F.split(target, " "), lambda w: F.array_contains("_list_words", w) | F.array_contains("_near_list", w))


def _contradicted(target: Column) -> Column:
    value = _block_value(target)
    aliases = [F.when(target == k, F.exists(F.array(*map(F.lit, v)), lambda a: F.contains(F.concat(F.lit(" "), F.col("_list")), F.concat(F.lit(" "), a)))) for k, v in ABSENCE_ALIASES.items()]
    return F.when(value.isNotNull(), value > 0).otherwise(_list_has(F.col("_list"), target) | F.coalesce(*aliases, F.lit(False)))


def _core(claim: Column) -> Column:
    """A claim without its brackets and final dots."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(claim, r"[(\[][^)\]]*[)\]]", " "), r"\s+", " "), r"[\s.]+$", ""))


def claims_step(rows: DataFrame) -> DataFrame:
    """Claims of the sheet: printed, contradicted, unsupported or not printed; claims whose panel is absent become one skip."""
    parts = F.flatten(F.transform("usps", lambda u: split_outside_brackets(F.regexp_replace(u, r"^\s*\d+[).]\s*", ""), "/")))
    rows = with_figures(rows.withColumn("_parts", parts))
    rows = rows.withColumn("_claims", F.filter(F.transform("_parts", _core), lambda c: F.length(c) > 1)).withColumn("_list", normalize(F.col("ingredients")))
    rows = rows.withColumn("_label_list", normalize(F.coalesce("label_list", F.lit(""))))
    wanted = F.flatten(F.transform("_claims", lambda c: F.coalesce(F.split(made_with_target(c), " "), F.array().cast("array<string>"))))
    rows = rows.withColumn("_list_words", F.split("_label_list", " "))
    rows = rows.withColumn("_near_list", near_words(F.array_distinct(wanted), F.when(F.col("ocr"), F.col("_list_words")).otherwise(F.array().cast("array<string>")), 7))

    facts = F.transform("_claims", lambda c: F.struct(c.alias("claim"), normalize(c).alias("norm"), made_with_target(c).alias("made"), absence_target(c).alias("absent")))
    facts = F.transform(
        F.filter(facts, lambda f: f["norm"] != ""),
        lambda f: F.struct(
            f["claim"].alias("claim"), f["made"].alias("made"), f["absent"].alias("absent"), _printed(f["norm"]).alias("printed"), _list_has(F.col("_list"), f["made"]).alias("in_sheet"),
            (_list_has(F.col("_label_list"), f["made"]) | _nearly_listed(f["made"])).alias("in_label"), _contradicted(f["absent"]).alias("contradicted"),
        ),
    )

    def of(f: Column) -> Column:
        claim, made, absent, printed, in_sheet, in_label = (f[c] for c in ("claim", "made", "absent", "printed", "in_sheet", "in_label"))
        label = F.concat(F.lit("Claim: "), claim)
        with_ = (
            F.when((F.trim("ingredients") != "") & ~in_sheet, check(label, "fail", claim, F.lit("Contradicted by the sheet")))
            .when((F.col("_label_list") != "") & ~in_label, check(label, F.when(F.col("ocr"), "warn").otherwise("fail"), claim, F.concat(F.lit("No "), made, F.lit(" in the label's ingredients"))))
            .when(~printed, check(label, "warn", claim, F.lit("Not printed")))
            .otherwise(check(label, "pass", None, F.lit("Present")))
        )
        plain = (
            F.when(printed, check(label, "pass", None, F.lit("Present")))
            .when(absent.isNotNull() & f["contradicted"], check(label, "fail", claim, F.lit("Contradicted by the sheet")))
            .when(absent.isNotNull(), check(label, "warn", claim, F.lit("Not printed")))
            .otherwise(check(label, "warn", claim, F.lit("Missing")))
        )
        return F.when(made.isNotNull(), with_).otherwise(plain)

    rows = rows.withColumn("_checks", F.transform(facts, of))
    printed = F.size(F.filter("_checks", lambda c: c["status"] == "pass"))
    share = F.when(F.col("ocr"), OCR_CLAIMS_PRINTED).otherwise(CLAIMS_PRINTED)
    rows = rows.withColumn("_panel", (F.size("_claims") == 0) | (printed >= F.greatest(F.lit(1), F.ceil(F.size("_claims") * share))))
    open_ = lambda c: (c["status"] == "warn") & c["found"].isin("Not printed", "Missing")
    drop = ~F.col("_panel") & F.exists("_checks", open_)
    kept = F.when(drop, F.concat(F.array(check("USP claims", "skip")), F.filter("_checks", lambda c: ~open_(c)))).otherwise(F.col("_checks"))
    none_yet = F.array().cast(_CHECKS)
    none = F.when(F.size("_claims") == 0, F.array(check("USPs present", "skip"))).otherwise(none_yet)
    cooking = F.exists("usps", lambda u: u.rlike(rf"(?i){_START}(roasted|baked|popped){_END}"))
    title = "Cooking method pairs with Not Fried"
    fried = (
        F.when(~cooking, check(title, "skip", sop=True))
        .when(_printed(F.lit("not fried")), check(title, "pass", None, F.lit("'Not Fried' is on the label"), sop=True))
        .when(~F.col("_panel"), check(title, "skip", sop=True))
        .otherwise(check(title, "fail", F.lit("Not Fried next to the cooking method"), F.lit("'Not Fried' not found"), sop=True))
    )
    return rows.withColumn("step3", F.concat(none, kept, F.col("_figures"), F.array(fried))).drop("_parts", "_figures", "_claims", "_list", "_label_list", "_list_words", "_near_list", "_checks", "_panel")


def with_figures(rows: DataFrame) -> DataFrame:
    """rows with ``_figures``: checks of the amounts in claims' brackets ("3.85g/70g") against the sheet's block of that size; a claim that stands twice counts with its last brackets."""
    figure = r"(?i)(\d+(?:\.\d+)?)\s*(?:g|mg)\s*/\s*(\d+(?:\.\d+)?)\s*g"
    of_nutrient = lambda core: F.coalesce(*[F.when(F.concat(F.lit(" "), core, F.lit(" ")).rlike(f" (?:{'|'.join(names)}) "), i) for i, (_, _, names, _, _) in enumerate(NUTRIENTS)])
    rows = rows.withColumn("_said", F.filter(F.transform("_parts", lambda p: F.struct(_core(p).alias("core"), F.array_join(F.regexp_extract_all(p, F.lit(r"[(\[]([^)\]]*)[)\]]"), F.lit(1)), " ").alias("detail"))), lambda p: p["detail"] != ""))
    rows = rows.withColumn("_said", F.filter("_said", lambda p, i: ~F.exists(F.slice("_said", i + 2, F.size("_said")), lambda q: q["core"] == p["core"])))
    rows = rows.withColumn("_said", F.transform("_said", lambda p: F.struct(p["core"].alias("core"), p["detail"].alias("detail"), normalize(p["core"]).alias("norm"), F.arrays_zip(find_all(p["detail"], figure, 1).alias("amount"), find_all(p["detail"], figure, 2).alias("per")).alias("figures"))))
    rows = rows.withColumn("_said", F.transform("_said", lambda p: F.struct(p["core"].alias("core"), p["detail"].alias("detail"), of_nutrient(p["norm"]).alias("n"), p["figures"].alias("figures"))))
    floors = F.array(*[F.lit(f) for *_, f in NUTRIENTS])
    value = lambda p, f: F.get(F.get(F.transform(F.filter("nutrition", lambda b: F.abs(b["grammage"] - f["per"].cast("double")) < 0.5), _values), 0), p["n"])
    rows = rows.withColumn("_said", F.transform("_said", lambda p: F.struct(p["core"].alias("core"), p["detail"].alias("detail"), F.get(floors, p["n"]).alias("floor"), F.filter(F.transform(p["figures"], lambda f: F.struct(f["amount"].alias("amount"), f["per"].alias("per"), value(p, f).alias("value"))), lambda f: f["value"].isNotNull()).alias("figures"))))
    off = lambda p: F.filter(p["figures"], lambda f: F.abs(f["value"] - f["amount"].cast("double")) > F.greatest(p["floor"], F.abs(f["value"]) * 0.02))
    shown = lambda f: F.concat(f["amount"], F.lit("/"), f["per"], F.lit("g (sheet nutrition: "), number_text(f["value"]), F.lit(")"))
    rows = rows.withColumn("_said", F.transform(F.filter("_said", lambda p: F.size(p["figures"]) > 0), lambda p: F.struct(p["core"].alias("core"), p["detail"].alias("detail"), F.array_join(F.transform(off(p), shown), "; ").alias("off"))))

    def of(p: Column) -> Column:
        wrong = p["off"] != ""
        return check(F.concat(F.lit("Claim figures: "), p["core"]), F.when(wrong, "warn").otherwise("pass"), F.trim(p["detail"]), F.when(wrong, F.concat(F.lit("Different from the sheet's nutrition: "), p["off"])))

    return rows.withColumn("_figures", F.coalesce(F.transform("_said", of), F.array().cast(_CHECKS))).drop("_said")


def _values(block: Column) -> Column:
    """A nutrition block's values in the order of NUTRIENTS."""
    return F.array(*[block[key] for key, *_ in NUTRIENTS])


def misspelt(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(label_id, misspelt: array of (word, suggestion)): words of a label's ingredient list that the vocabulary (term, ord) lacks but nearly has; with OCR words that differ only in o and a are the same."""
    each = rows.filter("label_list IS NOT NULL").select("label_id", "ocr", F.explode(F.array_distinct(words(F.col("label_list")))).alias("word"))
    typos = each.join(best_suggestion(each, vocabulary), "word").filter(~F.col("ocr") | (ao_key(F.col("word")) != ao_key(F.col("suggestion"))))
    return typos.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("word", "suggestion"))).alias("misspelt"))


def spelling_check() -> Column:
    """The check of a label whose ``misspelt`` words are known; null without a list."""
    text = lambda f: F.array_join(F.transform("misspelt", lambda x: x[f]), ", ")
    wrong = F.size(F.coalesce("misspelt", F.array().cast("array<struct<word:string,suggestion:string>>"))) > 0
    status = F.when(~wrong, "pass").when(F.col("ocr"), "warn").otherwise("fail")
    return F.when(F.col("label_list").isNotNull(), check("Ingredient spelling", status, F.when(wrong, text("suggestion")), F.when(wrong, text("word"))))


def _grams(c: Column) -> Column:
    return F.concat(number_text(c), F.lit("g"))


def weight_step(rows: DataFrame) -> DataFrame:
    pattern = rf"(?i)net\s*(?:wt|weight|quantity|qty){_END}\.?\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(kg|gms?|grams?|g|ml|l){_END}"
    plain = F.arrays_zip(find_all(F.col("flat"), pattern, 1).alias("n"), find_all(F.col("flat"), pattern, 2).alias("u"))
    nine = F.transform(find_all(F.col("flat"), rf"(?i)net\s*(?:wt|weight|quantity|qty){_END}\.?\s*[:\-]?\s*(\d{{2,4}})9(?!\d)", 1), lambda n: F.struct(n.alias("n"), F.lit("g").alias("u")))
    rows = rows.withColumn("_hits", F.when((F.size(plain) == 0) & F.col("ocr"), nine).otherwise(plain))
    grams = lambda h: h["n"].cast("double") * F.when(F.lower(h["u"]) == "kg", 1000.0).otherwise(1.0)
    found = F.array_join(F.array_distinct(F.transform("_hits", lambda h: F.concat(h["n"], h["u"]))), ", ")
    wrong = F.exists("_hits", lambda h: F.abs(grams(h) - F.col("pack_size_g")) > WEIGHT_TOLERANCE)
    styles = F.size(F.array_distinct(F.transform("_hits", lambda h: F.lower(h["u"]))))
    expected = _grams(F.col("pack_size_g"))
    none = F.size("_hits") == 0
    first = F.when(none, check("Net weight", "warn", expected, F.lit("No 'Net Wt' found on label"))).when(F.col("pack_size_g").isNull(), check("Net weight", "skip", None, found)).otherwise(check("Net weight", F.when(wrong, "fail").otherwise("pass"), expected, found))
    second = F.when(~none, check("Net weight unit written consistently", F.when(styles > 1, "warn").otherwise("pass"), None, found))
    return rows.withColumn("step4", _listed(first, second)).drop("_hits")


def _one_edit(word: str, letter: str) -> str:
    """A pattern for all texts of 4 letters or more that are at most one edit from a word."""
    n = len(word)
    other = [word[:i] + letter + word[i + 1 :] for i in range(n)] + [word[:i] + letter + word[i:] for i in range(n + 1)]
    return "|".join([*other, *_swapped(word), *(word[:i] + word[i + 1 :] for i in range(n) if n > 4)])


def _swapped(word: str) -> list[str]:
    return [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]


def _run_together(word: str) -> str:
    """A pattern for a word inside a run of letters, one letter wrong, two swapped, or one lost at the run's end."""
    n = len(word)
    short = "|".join(word[:i] + word[i + 1 :] for i in range(n))
    return "|".join([*(word[:i] + "." + word[i + 1 :] for i in range(n)), *_swapped(word), f"(?:{short})$"])


def allergen_groups(text: Column, ocr: Column | None = None) -> Column:
    """The allergen groups that a text names; where ``ocr`` holds also those of words one edit off, apart or run into others."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = {g: low.rlike(f"{_START}({p}){_END}") for g, p in ALLERGENS}
    if ocr is not None:
        plain, compact = normalize(low), F.regexp_replace(low, "[^a-z]", "")
        for g, keys in ALLERGEN_WORDS.items():
            apart = plain.rlike(f"(?<![a-z0-9])(?:{'|'.join(_one_edit(k, '[a-z0-9]') for k in keys)})(?![a-z0-9])")
            hits[g] = hits[g] | (ocr & (apart | compact.rlike("|".join(_run_together(k) for k in keys))))
    return F.array_compact(F.array(*[F.when(hit, g) for g, hit in hits.items()]))


def _declared(group: Column, label: Column) -> Column:
    """Whether label groups cover a sheet group: nuts, peanut and tree nuts stand in for each other in part."""
    has = lambda g: F.array_contains(label, g)
    return has(group) | ((group == "nuts") & (has(F.lit("peanut")) | has(F.lit("tree nuts")))) | (group.isin("peanut", "tree nuts") & has(F.lit("nuts")))


def top_items(body: Column) -> Column:
    """Comma-separated items outside brackets, their brackets dropped, normalised."""
    plain = lambda i: normalize(F.regexp_replace(i, r"\([^)]*\)|\[[^\]]*\]", " "))
    return F.filter(F.transform(split_outside_brackets(body, ","), plain), lambda i: i != "")


_SEGMENT = "array<struct<heading:string,body:string>>"


def segments(text: Column, ocr: Column) -> Column:
    """Array of (heading, body): the components of a list. A heading ("Seasoning:") stands at the start or after a full stop, with OCR also after a bracket."""
    name = r"([A-Z\x{C0}-\x{DD}][A-Za-z\x{C0}-\x{FF}&'\x{2019} ]{1,40}?)"
    mark = lambda lead: F.regexp_replace(F.trim(text), rf"(^|[{lead}]\s+){name}\s*:\s", "$1\ue000$2\ue001")
    parts = F.split(F.when(ocr, mark(".)")).otherwise(mark(".")), "\ue000")

    def of(part: Column) -> Column:
        headed = F.contains(part, F.lit("\ue001"))
        head, body = F.substring_index(part, "\ue001", 1), F.substring_index(part, "\ue001", -1)
        return F.struct(F.when(headed, F.trim(head)).alias("heading"), F.trim(F.when(headed, body).otherwise(part)).alias("body"))

    return F.coalesce(F.filter(F.transform(parts, of), lambda x: x["body"] != ""), F.array().cast(_SEGMENT))


def _components(segs: Column) -> Column:
    return F.size(F.filter(segs, lambda x: x["heading"].isNotNull()))


def ingredients_step(rows: DataFrame) -> DataFrame:
    """Ingredient words, order, casing and full stops against the sheet by component, and the allergen statement."""
    has_list, ocr, none = F.col("label_list").isNotNull(), F.col("ocr"), F.array().cast("array<string>")
    before = lambda c: F.trim(F.regexp_replace(c, rf"(?s){_START}CONTAINS{_END}.*$", ""))
    rows = rows.withColumn("_sheet", F.regexp_replace(F.coalesce("ingredients", F.lit("")), r"\s+", " ")).withColumn("_list", F.coalesce("label_list", F.lit("")))
    rows = rows.withColumns({"_own": F.filter(F.array_distinct(words(F.col("_sheet"))), lambda w: F.length(w) > 1), "_tokens": F.array_distinct(words(F.col("_list"))), "_body": before(F.col("_list"))})
    rows = rows.withColumns({"_segs": segments(F.col("_body"), ocr), "_sheet_segs": segments(before(F.col("_sheet")), F.lit(False))})
    rows = rows.withColumn("_absent", F.array_except("_own", "_tokens")).withColumn("_near", near_words(F.col("_absent"), F.when(ocr, F.col("_tokens")), 7))
    rows = rows.withColumn("_absent", F.array_except("_absent", "_near")).withColumn("_damaged", damaged_words(F.col("_absent"), F.when(ocr, F.array_except("_tokens", "_own"))))
    rows = rows.withColumns({"_unclear": F.transform("_damaged", lambda d: d["word"]), "_pieces": F.transform("_damaged", lambda d: d["fragment"])})
    rows = rows.withColumns({"_missing": F.array_except("_absent", "_unclear"), "_new": F.array_except(F.array_except(words(F.col("_body")), "_own"), "_pieces")})
    missing, unclear = F.col("_missing"), F.col("_unclear")
    single = (_components(F.col("_segs")) <= 1) & (_components(F.col("_sheet_segs")) <= 1)
    rows = rows.withColumn("_long", F.filter("_new", lambda w: F.length(w) >= 5)).withColumn("_clean", unlike_words(F.col("_long"), F.col("_own")))
    clean = F.col("_clean")
    extra = F.when(ocr, clean).otherwise(F.filter("_new", lambda w: F.length(w) > 1))
    partly = ocr & ((F.size("_own") - F.size("_absent")) < 0.8 * F.size("_own"))
    bad = ((F.size(missing) > 0.1 * F.size("_own")) | (single & (F.size(clean) > 0))) & ~partly
    some = lambda c: F.concat(F.array_join(F.slice(c, 1, 10), ", "), F.when(F.size(c) > 10, "...").otherwise(""))
    match = (
        F.when(F.trim("ingredients") == "", check("Ingredients match the sheet", "skip"))
        .when(F.size("_absent") == 0, check("Ingredients match the sheet", "pass", None, F.lit("All sheet ingredients are on the label")))
        .when(F.size(missing) == 0, check("Ingredients match the sheet", "warn", F.trim("ingredients"), F.concat(F.lit("Read badly: "), some(unclear)), "Printed, but misread: to be checked by eye."))
        .otherwise(check("Ingredients match the sheet", F.when(bad, "fail").otherwise("warn"), F.trim("ingredients"), F.concat(F.lit("Missing on label: "), some(missing)), F.when(partly, "Only part of the list was read.").when(F.size(unclear) > 0, F.concat(F.lit("Also read badly: "), some(unclear)))))
    )
    more = F.when((F.trim("ingredients") != "") & single & (F.size(extra) > 0), check("No extra ingredients on the label", "warn", None, F.concat(F.lit("Not in sheet: "), some(extra))))
    all_items = lambda segs: F.array_distinct(F.flatten(F.transform(segs, lambda x: top_items(x["body"]))))
    rows = rows.withColumns({"_items": all_items("_sheet_segs"), "_label_items": all_items("_segs")})
    rows = rows.withColumn("_shared", F.array_intersect("_items", "_label_items"))
    places = F.transform("_shared", lambda i: F.array_position("_label_items", i))
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.size("_shared") - 1, F.lit(1))), lambda k: F.get(places, k) < F.get(places, k - 1))
    order = F.when(F.size("_shared") >= 3, check("Ingredient order matches the sheet", F.when(swap, "warn").otherwise("pass")))

    def rest(seg: Column) -> Column:
        """The words of a component behind its first."""
        tokens = F.regexp_extract_all(seg["body"], F.lit(r"([A-Za-z\x{C0}-\x{FF}][A-Za-z\x{C0}-\x{FF}'\x{2019}-]*)"), F.lit(1))
        return F.filter(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: (F.length(t) > 1) & ~t.isin(*ALLOWED_CAPS))

    rows = rows.withColumn("_rest", F.flatten(F.transform("_segs", rest)))
    caps, capital = F.exists("_rest", lambda t: t == F.upper(t)), F.exists("_rest", lambda t: t.rlike(r"^[A-Z\x{C0}-\x{DD}]"))
    starts = (F.size("_segs") > 0) & F.forall("_segs", lambda x: x["body"].rlike(r"^[^A-Za-z]*[A-Z\x{C0}-\x{DD}]"))
    casing = check("Casing: first letter capital, rest lowercase", F.when(~starts | caps, "fail").when(capital, "warn").otherwise("pass"), F.lit("First ingredient capitalised, the rest lowercase"), sop=True)
    statement = F.regexp_extract("_list", rf"(?s){_START}(CONTAINS{_END}.*)$", 1)
    ends = lambda c: c.rlike(r"\.\s*$")
    open_ends = F.concat(F.transform(F.filter("_segs", lambda x: ~ends(x["body"])), lambda x: F.coalesce(x["heading"], F.lit("Ingredient list"))), F.when((statement != "") & ~ends(statement), F.array(F.lit("the CONTAINS statement"))).otherwise(none))
    stop = check("Ends with full stop", F.when(F.size(open_ends) == 0, "pass").otherwise("fail"), F.lit("A full stop at the end of the list"), F.when(F.size(open_ends) > 0, F.concat(F.lit("Missing after: "), F.array_join(open_ends, ", "))), sop=True)
    listed = F.when(has_list, _listed(match, more, order, casing, stop)).otherwise(F.array(check("Ingredients list", "warn", None, F.lit("No 'Ingredients' heading found in the label text"))))

    primary = allergen_groups(F.get(F.split("allergens", FACILITY), 0))
    rows = rows.withColumns({"_needs": allergen_groups(F.col("allergens")), "_read": allergen_groups(F.col("label_allergens"), ocr), "_wide": allergen_groups(F.col("allergens_near"), ocr)})
    lacking = lambda groups: F.filter("_needs", lambda g: ~_declared(g, F.col(groups)))
    again = ocr & (F.size(lacking("_read")) > 0)  # a tilted line may have left the column: read the whole block
    lacks = F.when(again, F.filter(lacking("_read"), lambda g: ~_declared(g, F.col("_wide")))).otherwise(lacking("_read"))
    sheet, label = F.col("_needs"), F.when(again, F.col("_wide")).otherwise(F.col("_read"))
    extras = F.filter(label, lambda g: ~F.array_contains(sheet, g) & ~_declared(g, sheet))
    worst = (F.size(F.array_intersect(lacks, primary)) > 0) | ((F.size(lacks) > 0) & ~ocr)
    title = "Allergen declaration"
    declared = (
        F.when(F.size(sheet) == 0, check(title, "skip"))
        .when(F.coalesce("label_allergens", F.lit("")) == "", check(title, "warn", F.trim("allergens"), F.lit("No 'Allergen' statement found")))
        .when(F.size(lacks) > 0, check(title, F.when(worst, "fail").otherwise("warn"), F.trim("allergens"), F.concat(F.lit("Label does not declare: "), F.array_join(lacks, ", "))))
        .when(F.size(extras) > 0, check(title, "warn", F.trim("allergens"), F.concat(F.lit("Label also declares: "), F.array_join(extras, ", "))))
        .otherwise(check(title, "pass", F.trim("allergens"), F.col("label_allergens")))
    )
    used = "_sheet _list _own _tokens _body _segs _sheet_segs _absent _near _damaged _unclear _pieces _missing _new _long _clean _items _label_items _shared _rest _needs _read _wide"
    return rows.withColumn("step6", F.concat(listed, F.array(declared))).drop(*used.split())


def serving_step(rows: DataFrame) -> DataFrame:
    size = rf"(\d+(?:\.\d+)?)\s*(?:gms?|grams?|g){_END}"
    found = F.concat(find_all(F.col("flat"), rf"(?i)serving\s*size\s*[:\-]?\s*{size}"), find_all(F.col("flat"), rf"(?i)nutritional\s*(?:information|info)\s*(?:per|for)\s*{size}"))
    rows = rows.withColumn("_bases", F.filter(F.array_distinct(F.transform(found, lambda x: x.cast("double"))), lambda b: b != 100))
    text = F.array_join(F.transform("_bases", _grams), ", ")
    over = F.exists("_bases", lambda b: b > F.col("pack_size_g") + WEIGHT_TOLERANCE)
    title = "Serving size vs pack size"
    best = F.when(F.size("_bases") == 0, check(title, "skip", sop=True)).when(F.col("pack_size_g").isNull(), check(title, "skip", None, text, sop=True)).otherwise(check(title, F.when(over, "warn").otherwise("pass"), F.concat(F.lit("Serving ≤ "), _grams(F.col("pack_size_g"))), text, sop=True))
    return rows.withColumn("step8", F.array(best)).drop("_bases")


_PER_GRAM = r"(?!\s*/?\s*-?\s*\)?\s*per\s*(?:gm|g|gram))"


def price_step(rows: DataFrame) -> DataFrame:
    number = r"(\d+(?:\.\d+)?)(?![\d.])"
    shown = F.concat(
        find_all(F.col("flat"), rf"(?i)(?:mrp|m\.r\.p\.?)[\s.:\-]*(?:rs\.?|\x{{20B9}}|inr)?[\s.:\-]*{number}{_PER_GRAM}"),
        F.when(F.col("ocr"), find_all(F.col("flat"), rf"(?i)mrp\s*\d\s*[:\-]\s*{number}{_PER_GRAM}")).otherwise(F.array().cast("array<string>")),
        find_all(F.col("flat"), rf"(?i)(?:\x{{20B9}}|rs\.?)\s*{number}\s*/\s*-?{_PER_GRAM}"),
    )
    units = F.concat(
        find_all(F.col("flat"), rf"(?i)(\d+(?:\.\d+)?)\s*/?\s*-?\s*\)?\s*per\s*(?:gm|gms|g|gram|grams){_END}"),
        find_all(F.col("flat"), r"(?i)per\s*(?:gm|g|gram)s?\s*[:\-]?\s*(?:rs\.?|\x{20B9})?\s*(\d+(?:\.\d+)?)"),
        find_all(F.col("flat"), rf"(?i){_START}(?:usp|unit\s*sale\s*price){_END}[^\d]{{0,8}}?(\d+\.\d+)"),
    )
    values = lambda c: F.array_distinct(F.transform(c, lambda x: x.cast("double")))
    rows = rows.withColumns({"_prices": values(shown), "_units": values(units)})
    money = lambda c: F.concat(F.lit("₹"), number_text(c))
    text = F.array_join(F.transform("_prices", money), ", ")
    wrong = F.exists("_prices", lambda p: F.abs(p - F.col("expected_mrp")) > PRICE_TOLERANCE)
    mrp = F.when(F.size("_prices") == 0, check("MRP value", "warn", money(F.col("expected_mrp")), F.lit("No MRP found on label"))).when(F.col("expected_mrp").isNull(), check("MRP value", "skip", None, text)).otherwise(check("MRP value", F.when(wrong, "fail").otherwise("pass"), money(F.col("expected_mrp")), text))
    unit = F.col("expected_mrp") / F.col("pack_size_g")
    worst = F.array_max(F.transform("_units", lambda u: F.abs(u - unit)))
    status = F.when(worst <= UNIT_PRICE_PASS, "pass").when(worst <= UNIT_PRICE_WARN, "warn").otherwise("fail")
    shown_units = F.array_join(F.transform("_units", lambda u: F.concat(money(u), F.lit("/g"))), ", ")
    per_gram = F.when(F.size("_units") == 0, check("Price per gram", "warn", F.concat(money(unit), F.lit("/g")), F.lit("No per-gram price found on label"))).otherwise(check("Price per gram", status, F.concat(money(unit), F.lit("/g")), shown_units))
    known = F.col("expected_mrp").isNotNull() & (F.col("pack_size_g") > 0)
    return rows.withColumn("step9", _listed(mrp, F.when(known, per_gram))).drop("_prices", "_units")


def manufacturer_names(c: Column) -> Column:
    """Up to 3 company names: the first line of each paragraph that is no heading and no licence line."""
    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit(True).alias("expect"))

    def step(acc: Column, raw: Column) -> Column:
        line = F.trim(raw)
        skip = line.rlike(r":\s*$") | line.rlike(rf"(?i)^(for|fssai|lic){_END}")
        takes = acc["expect"] & (line != "") & ~skip
        names = F.when(takes, F.concat(acc["names"], F.array(F.regexp_replace(line, "[.,]+$", "")))).otherwise(acc["names"])
        return F.struct(names.alias("names"), F.when(line == "", True).when(takes, False).otherwise(acc["expect"]).alias("expect"))

    return F.aggregate(F.split(F.coalesce(c, F.lit("")), "\r?\n"), start, step, lambda acc: F.slice(acc["names"], 1, 3))


def address_step(rows: DataFrame) -> DataFrame:
    pin, licence = r"(?<!\d)(?<!\d\s)([1-9]\d{5})(?!\s?\d)", r"(?<![A-Za-z0-9_])(\d{14})(?![A-Za-z0-9_])"
    rows = rows.withColumns(
        {
            "_names": manufacturer_names(F.col("manufacturer")),
            "_sheet_pins": F.array_distinct(find_all(F.col("manufacturer"), rf"{_START}([1-9]\d{{5}}){_END}")),
            "_pins": F.array_distinct(find_all(F.col("flat"), pin)),
            "_spelled": F.transform(find_all(F.col("flat"), r"(?<!\d)(\d(?:[ -]?\d){5})(?!\d)"), lambda x: F.regexp_replace(x, r"\D", "")),
            "_sheet_lic": F.array_distinct(find_all(F.col("manufacturer"), licence)),
            "_lic": F.array_distinct(find_all(F.col("flat"), licence)),
            "_lic_hits": F.transform(find_all(F.col("flat"), r"(?i)lic\.?\s*no\.?\s*[:\-]?\s*(\d[\d\s]*\d)"), take_licence),
        }
    )
    near = F.col("ocr")
    rows = rows.withColumn("_plain", F.transform("_names", normalize)).withColumn("_unprinted", F.filter("_names", lambda n, i: ~_printed(F.get("_plain", i))))
    missing_names = F.col("_unprinted")
    names = F.when(F.size("_names") == 0, check("Manufacturer name", "skip")).otherwise(check("Manufacturer name", F.when(F.size(missing_names) == 0, "pass").when(near, "warn").otherwise("fail"), F.array_join("_names", "; "), F.when(F.size(missing_names) > 0, F.concat(F.lit("Not found on label: "), F.array_join(missing_names, "; ")))))
    exact = lambda p: F.array_contains("_spelled", p)
    off = lambda p, q: F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.lit(0), lambda a, i: a + (F.substring(p, i, F.lit(1)) != F.substring(q, i, F.lit(1))).cast("int"))
    misread = lambda p: near & F.exists("_spelled", lambda q: off(p, q) == 1)
    rows = rows.withColumn("_here", F.filter("_sheet_pins", lambda p: exact(p) | misread(p))).withColumn("_gone", F.filter("_sheet_pins", lambda p: ~exact(p) & ~misread(p)))
    gone = F.col("_gone")
    status = F.when(F.size(gone) > 0, F.when(near & (F.size("_pins") == 0), "warn").otherwise("fail")).when(F.exists("_sheet_pins", lambda p: ~exact(p)), "warn").otherwise("pass")
    some_pin = F.size("_sheet_pins") > 0
    found = F.when(F.size("_pins") > 0, F.array_join(F.slice("_pins", 1, 3), ", ")).otherwise("No pincode found on the label")
    pins = F.when(some_pin, check("Pincode matches the sheet", status, F.array_join("_sheet_pins", ", "), F.when(status != "pass", found)))
    checked = F.when(some_pin, F.col("_here")).otherwise(F.col("_pins"))
    dotted = lambda p: F.regexp_like(F.col("flat"), F.concat(F.array_join(F.split(p, ""), "[ -]?"), F.lit(r"\s*\.")))
    stop = F.when(F.size(checked) == 0, check("Full stop after pincode", "warn", F.lit("PINCODE."), F.lit("No pincode found on label"), sop=True)).otherwise(check("Full stop after pincode", F.when(F.exists(checked, lambda p: ~dotted(p)), "fail").otherwise("pass"), F.lit("PINCODE."), sop=True))
    rows = rows.withColumn("_joined", F.regexp_replace("flat", r"\s+", "")).withColumn("_no_lic", F.exists("_sheet_lic", lambda x: ~F.contains(F.col("_joined"), x)))
    no_lic = F.col("_no_lic")
    close = F.exists("_lic", lambda p: F.exists("_sheet_lic", lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda a, i: a + (F.substring(p, i, F.lit(1)) != F.substring(s, i, F.lit(1))).cast("int")) <= 2))
    lic = F.when(F.size("_sheet_lic") > 0, check("FSSAI licence number matches the sheet", F.when(~no_lic, "pass").when(near & ((F.size("_lic") == 0) | close), "warn").otherwise("fail"), F.array_join("_sheet_lic", ", "), F.when(no_lic, F.when(F.size("_lic") > 0, F.array_join(F.slice("_lic", 1, 3), ", ")).otherwise("No licence number found on the label"))))
    rows = rows.withColumn("_bad", F.filter("_lic_hits", lambda d: F.length(d) != 14))
    bad = F.col("_bad")
    form = F.when(F.size("_lic_hits") > 0, check("FSSAI licence number is 14 digits", F.when(F.size(bad) > 0, "fail").otherwise("pass"), None, F.when(F.size(bad) > 0, F.array_join(bad, ", "))))
    maker = F.col("flat").rlike(rf"(?i){_START}(manufactured|marketed|packed)\s+(?:&\s*marketed\s+)?by{_END}|{_START}fssai{_END}")
    present = (F.size("_names") > F.size("_unprinted")) | (F.size("_here") > 0) | (F.size("_lic_hits") > 0) | maker
    out = F.when(present, _listed(names, pins, stop, lic, form)).otherwise(F.array(check("Addresses", "skip")))
    return rows.withColumn("step10", out).drop("_names", "_sheet_pins", "_pins", "_spelled", "_sheet_lic", "_lic", "_lic_hits", "_plain", "_unprinted", "_here", "_gone", "_joined", "_no_lic", "_bad")


def take_licence(raw: Column) -> Column:
    """Digit groups joined until there are 14 digits or more."""
    return F.aggregate(F.split(F.trim(raw), r"\s+"), F.lit(""), lambda acc, g: F.when(F.length(acc) >= 14, acc).otherwise(F.concat(acc, g)))


def value_status(expected: Column, got: Column, floor: Column) -> Column:
    """Passes within the rounding floor or below FAIL_PCT percent."""
    diff = F.abs(expected - got)
    deviation = F.when(expected != 0, diff / F.abs(expected) * 100).otherwise(100.0)
    return F.when((diff <= floor) | (deviation < FAIL_PCT), "pass").otherwise("fail")


def likely_misread(got: Column, expected: Column) -> Column:
    """One digit differs, or one number's digits are a run of the other's."""
    a, b = (F.replace(number_text(x), F.lit("."), F.lit("")) for x in (got, expected))
    differs = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    return F.when(F.length(a) == F.length(b), differs == 1).otherwise((F.length(short) >= 2) & F.contains(long, short))


def label_cells(cells: DataFrame) -> DataFrame:
    """(label_id, cells): a label's nutrition cells in the order of rows, as one array."""
    return cells.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "key", "title", "typo", "row_label", "values", "x", "y"))).alias("cells"))


def nutrition_step(rows: DataFrame) -> DataFrame:
    """A label's cells against the product block that most nutrients agree with; then the size nearest to the pack's decides, then the earlier block."""
    number = F.array().cast("array<double>")
    own = lambda key: F.filter("cells", lambda c: c["key"] == key)
    rows = rows.withColumn("_own", F.array(*[own(key) for key, *_ in NUTRIENTS]))
    rows = rows.withColumn("_values", F.transform("_own", lambda cs: F.when(F.size(cs) > 0, F.flatten(F.transform(cs, lambda c: F.coalesce(c["values"], number))))))
    rows = rows.withColumn("_read", F.array(*[F.struct(F.lit(t).alias("title"), F.lit(u).alias("unit"), F.lit(f).alias("floor"), F.get("_values", i).alias("values")) for i, (_, t, _, u, f) in enumerate(NUTRIENTS)]))

    def line(pair: Column) -> Column:
        expected, r = pair["expected"], pair["read"]
        near = F.array_min(F.transform(F.filter(r["values"], lambda v: v.isNotNull()), lambda v, i: F.struct(F.abs(v - expected).alias("gap"), i.alias("i"), v.alias("v"))))["v"]
        return F.struct(r["title"].alias("title"), r["unit"].alias("unit"), r["floor"].alias("floor"), expected.alias("expected"), r["values"].isNotNull().alias("there"), near.alias("got"))

    def ranked(b: Column, i: Column) -> Column:
        score = F.size(F.filter(b["lines"], lambda x: x["got"].isNotNull() & (value_status(x["expected"], x["got"], x["floor"]) == "pass")))
        return F.struct((-score).alias("score"), F.coalesce(F.abs(b["grammage"] - F.col("pack_size_g")), F.lit(0.0)).alias("gap"), i.alias("i"), b["lines"].alias("lines"))

    lines = F.transform("nutrition", lambda b: F.struct(b["grammage"].alias("grammage"), F.transform(F.filter(F.zip_with(_values(b), F.col("_read"), lambda e, r: F.struct(e.alias("expected"), r.alias("read"))), lambda x: x["expected"].isNotNull()), line).alias("lines")))
    rows = rows.withColumn("_best", F.array_min(F.transform(lines, ranked))["lines"])
    shown = lambda x, c: F.concat(number_text(x[c]), x["unit"])

    def one(x: Column) -> Column:
        verdict = value_status(x["expected"], x["got"], x["floor"])
        unsure = (verdict == "fail") & F.col("ocr") & likely_misread(x["got"], x["expected"])
        deviation = (x["got"] - x["expected"]) / F.abs(x["expected"]) * 100
        by = F.when((verdict == "fail") & (x["expected"] != 0), F.concat(F.format_string("%+.1f", deviation), F.lit("% against the sheet")))
        return (
            F.when(~x["there"], check(x["title"], "warn", shown(x, "expected"), F.lit("Not found in the nutrition table")))
            .when(x["got"].isNull(), check(x["title"], F.when(x["expected"] == 0, "pass").otherwise("warn"), shown(x, "expected"), F.lit("-")))
            .otherwise(check(x["title"], F.when(unsure, "warn").otherwise(verdict), shown(x, "expected"), shown(x, "got"), F.when(unsure, "Off by one digit, or cut off: perhaps misread.").otherwise(by)))
        )

    typos = F.array_sort(F.transform(F.filter("cells", lambda c: c["typo"]), lambda c: F.struct(c["row_no"], F.trim(F.regexp_replace(c["row_label"], r"\s*\([^)]*\)\s*", "")).alias("found"), c["title"].alias("title"))))
    rows = rows.withColumn("_typos", typos)
    list_of = lambda f: F.array_join(F.transform("_typos", lambda t: t[f]), ", ")
    wrong = F.size("_typos") > 0
    names = check("Nutrient names spelled correctly", F.when(~wrong, "pass").when(F.col("ocr"), "warn").otherwise("fail"), F.when(wrong, list_of("title")), F.when(wrong, list_of("found")))
    kinds = F.size(F.array_compact(F.array_distinct(F.transform("cells", lambda c: c["key"]))))
    out = (
        F.when(kinds < 3, F.array(check("Nutrition table", "warn", None, F.lit("Could not find a nutrition table in the label text"))))
        .when(F.col("nutrition").isNull() | (F.size("nutrition") == 0), F.array(check("Nutrition table", "skip")))
        .otherwise(F.concat(F.transform("_best", one), F.array(names)))
    )
    return rows.withColumn("step7", out).drop("_own", "_values", "_read", "_best", "_typos")


def description_step(rows: DataFrame) -> DataFrame:
    """A description is compared by people."""
    return rows.withColumn("step5", F.array(check("Description vs USPs", "skip")))


#: All steps work on a label's row.
STEPS = ((2, name_step), (3, claims_step), (4, weight_step), (5, description_step), (6, ingredients_step), (7, nutrition_step), (8, serving_step), (9, price_step), (10, address_step))
_CELLS = "array<struct<row_no:int,key:string,title:string,typo:boolean,row_label:string,values:array<double>,x:double,y:double>>"


def label_rows(items: DataFrame, labels: DataFrame, reference: DataFrame) -> DataFrame:
    """One row a label: its text in reading order, its lists, allergens and nutrition cells, beside the product's fields."""
    ctx = cut_lineage(spread(context(photo.levelled_items(items, labels), labels), "label_id"))  # read by rows, by geometry and as a whole
    empty = F.array().cast("array<struct<row_no:int,page:int,y:double,items:array<struct<x:double,ord:bigint,s:string,y:double,w:double,h:double>>,text:string>>")
    ctx = ctx.withColumn("rows", F.coalesce("rows", empty)).withColumn("_ing", heading_at(F.col("rows"), "^ingredients?(?![a-z0-9])")).withColumn("_all", heading_at(F.col("rows"), "^allergen"))
    lines = ctx.filter("ocr").select("label_id", F.explode("rows").alias("r")).select("label_id", "r.*")
    found = photo.with_photo_cells(nutrition_cells(ctx), photo.photo_cells(lines, photo.expected_values(reference)))
    ctx = ctx.join(label_cells(found), "label_id", "left").withColumn("cells", F.coalesce("cells", F.array().cast(_CELLS)))
    ctx = ctx.withColumns({f"{at}_edge": table_edge(F.col(at), F.col("rows"), F.col("cells")) for at in ("_ing", "_all")})
    gap, align = F.when(F.col("ocr"), 60.0).otherwise(20.0), F.when(F.col("ocr"), 7.0).otherwise(4.0)
    near = text_near(F.col("rows"), F.col("_all"), F.col("_all_edge")).alias("allergens_near")
    under = [block_under(F.col("rows"), F.col(at), gap, align, F.col(f"{at}_edge")).alias(name) for name, at in (("label_list", "_ing"), ("label_allergens", "_all"))]
    ctx = ctx.select("label_id", "ocr", "flat", "views", "label_words", "cells", near, *under)
    return cut_lineage(spread(reference.select(*REFERENCE.split(", ")).join(ctx, "label_id"), "label_id"))


def all_steps(rows: DataFrame) -> DataFrame:
    """(label_id, ocr, step, seq, check columns) of rows as ``label_rows`` gives them: every step is a column of the row, and one explode lists them."""
    done = reduce(lambda df, step: step[1](df), STEPS, rows)
    if "misspelt" in rows.columns:
        done = done.withColumn("step6", F.array_compact(F.concat("step6", F.array(spelling_check()))))
    numbered = lambda n: F.transform(f"step{n}", lambda c, i: F.struct(F.lit(n).alias("step"), i.alias("seq"), c.alias("c")))
    steps = F.flatten(F.array(*[numbered(n) for n, _ in STEPS]))
    return listed(done.select("label_id", "ocr", steps.alias("steps")), "steps", "s").select("label_id", "ocr", "s.step", "s.seq", "s.c.*")


def audit(items: DataFrame, labels: DataFrame, reference: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """All checks of all labels in long form; ``reference`` has the REFERENCE columns, one row a label; without a vocabulary spelling isn't checked."""
    rows = label_rows(items, labels, reference)
    if vocabulary is not None:
        rows = rows.join(misspelt(rows, vocabulary), "label_id", "left")
    return ocr_post_pass(all_steps(rows), F.col("ocr")).drop("ocr")
