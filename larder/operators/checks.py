"""Long check tables: severity lattice, roll-ups, counts, the OCR post-pass and coercion of external reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import number_text

# Statuses from the least to the most severe, and step names.
STATUSES = ("skip", "pass", "warn", "fail")
STEP_NAMES = {2: "Product Name", 3: "USPs", 4: "Grammage", 5: "Long Description", 6: "Ingredients", 7: "Nutritional Values", 8: "Serving Size", 9: "MRP", 10: "Addresses"}

CHECK_SCHEMA = "label_id string, step int, seq int, label string, status string, expected string, found string, note string, sop_rule boolean"
REPORT_SCHEMA = "product string, pack_size string, steps array<struct<step:int,name:string,checks:array<struct<label:string,status:string,expected:string,found:string,note:string,sop_rule:boolean>>>>"


def rank(status: Column) -> Column:
    """0 to 3 by severity; an unknown status warns."""
    ladder = F.lit(2)
    for i, s in enumerate(STATUSES):
        ladder = F.when(status == s, i).otherwise(ladder)
    return ladder


def status_of(rank_: Column) -> Column:
    """The status of a rank; of no checks at all: skip."""
    return F.element_at(F.array(*map(F.lit, STATUSES)), F.coalesce(rank_, F.lit(0)).cast("int") + 1)


def roll_up(checks: DataFrame, *keys: str) -> DataFrame:
    """The most severe status of each group: associative, so steps roll up into reports."""
    return checks.groupBy(*keys).agg(F.max(rank(F.col("status"))).alias("rank")).select(*keys, status_of(F.col("rank")).alias("status"))


def status_counts(checks: DataFrame, *keys: str) -> DataFrame:
    """A column for each status with its number of checks, 0 kept."""
    return checks.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in reversed(STATUSES)])


def of_status(checks: DataFrame, status: str) -> DataFrame:
    """The checks of a status; steps without any vanish."""
    return checks.filter(F.col("status") == status)


def collapsed(checks: DataFrame) -> DataFrame:
    """Whether a step is shown collapsed: nothing in it warns or fails."""
    return roll_up(checks, "label_id", "step").withColumn("collapsed", F.col("status").isin("pass", "skip"))


def ocr_quality(checks: DataFrame, labels: DataFrame) -> DataFrame:
    """Flags of poor reads: photo text under 10 px, or 70 % of the decided checks warn."""
    counts = status_counts(checks, "label_id")
    decided = F.col("n_pass") + F.col("n_warn") + F.col("n_fail")
    share = F.when(decided > 0, F.col("n_warn") / decided)
    return labels.join(counts, "label_id", "left").select("label_id", F.coalesce(F.col("photo_text_px") < 10, F.lit(False)).alias("small_text"), F.coalesce(share >= 0.7, F.lit(False)).alias("mostly_unsure"))


def ocr_post_pass(checks: DataFrame, is_ocr: Column) -> DataFrame:
    """For OCR labels: fails of fragile checks become warnings, other fails get a note."""
    fragile = F.col("label").rlike(r"(?i)spelling|spelled|full stop|casing|capital|^product name")
    failed = is_ocr & (F.col("status") == "fail")
    note = F.when(failed & ~fragile, F.coalesce("note", F.lit("Read by OCR: if this looks wrong, check it on the label."))).otherwise(F.col("note"))
    return checks.withColumns({"note": note, "status": F.when(failed & fragile, "warn").otherwise(F.col("status"))})


def coerce_report(replies: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Checks of external JSON reports in long form: an unknown status warns, blank texts are null, sop_rule only if true;
    a step without a number is 0, a check without a label is "Check". Steps without checks vanish."""
    steps = F.explode(F.from_json(json_col, REPORT_SCHEMA)["steps"])
    rows = replies.select(F.col(id_col).alias("label_id"), steps.alias("s")).select("label_id", F.coalesce("s.step", F.lit(0)).alias("step"), F.posexplode("s.checks").alias("seq", "c"))
    text = lambda name: F.when(F.trim(F.col(f"c.{name}")) != "", F.trim(F.col(f"c.{name}")))
    status = F.when(F.col("c.status").isin(*STATUSES), F.col("c.status")).otherwise("warn").alias("status")
    return rows.select("label_id", "step", "seq", F.coalesce(text("label"), F.lit("Check")).alias("label"), status, *(text(c).alias(c) for c in ("expected", "found", "note")), F.coalesce("c.sop_rule", F.lit(False)).alias("sop_rule"))


def report_header(replies: DataFrame, reference: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(label_id, product, pack_size, overall) of external reports: what a report doesn't say comes from ``reference`` (label_id, product_name, pack_size_g)."""
    said = F.from_json(json_col, REPORT_SCHEMA)
    own = replies.select(F.col(id_col).alias("label_id"), said["product"].alias("product"), said["pack_size"].alias("pack_size"))
    overall = roll_up(coerce_report(replies, id_col, json_col), "label_id").select("label_id", F.col("status").alias("overall"))
    rows = own.join(reference.select("label_id", "product_name", "pack_size_g"), "label_id", "left").join(overall, "label_id", "left")
    filled = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    grams = F.when(F.coalesce("pack_size_g", F.lit(0.0)) != 0, F.concat(number_text(F.col("pack_size_g")), F.lit("g"))).otherwise("pack size not set")
    return rows.select("label_id", F.coalesce(filled("product"), "product_name").alias("product"), F.coalesce(filled("pack_size"), grams).alias("pack_size"), F.coalesce("overall", F.lit("skip")).alias("overall"))


def nested_report(checks: DataFrame) -> DataFrame:
    """One row a label: steps with their checks in order, and the overall status."""
    check = F.struct("seq", "label", "status", "expected", "found", "note", "sop_rule")
    steps = checks.groupBy("label_id", "step").agg(F.array_sort(F.collect_list(check)).alias("checks"), F.max(rank(F.col("status"))).alias("rank"))
    return steps.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("step", status_of(F.col("rank")).alias("status"), "checks"))).alias("steps"), status_of(F.max("rank")).alias("overall"))
