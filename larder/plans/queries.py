"""The registered queries over the star-schema tables and their DuckDB SQL.

The tables hold no product labels, so each query applies an operator to stand-ins. Sums of doubles go through
decimals, and computed columns are cast, so that both engines return equal values and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import geometry
from larder.functions.numbers import parse_float
from larder.functions.text import ACCENTED, PLAIN, find_all, has_phrase, normalize, split_outside_brackets, words
from larder.operators import checks, claims, clusters, market, matching, products
from larder.plans.registry import QUERIES, SQL, query, table
from larder.sources.tables import listed

__all__ = ["QUERIES", "SQL"]


def dec(c: str, scale: int = 2) -> Column:
    return F.col(c).cast(T.DecimalType(18, scale))


def as_double(c: Column, places: int = 4) -> Column:
    return F.round(c.cast(T.DecimalType(38, 10)), places).cast("double")


@query("""
SELECT l_orderkey, f.f AS first_flag, f.p AS first_part, n_blocks, total FROM (SELECT l_orderkey, min({'n': l_linenumber, 'p': l_partkey, 'f': l_returnflag}) AS f, count(*)::BIGINT AS n_blocks,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY 1)""")
def q01_group_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_returnflag")).alias("f")  # line numbers may repeat
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(first, F.count("*").alias("n_blocks"), F.sum(dec("l_extendedprice")).cast("double").alias("total"))
    return rows.select("l_orderkey", F.col("f.l_returnflag").alias("first_flag"), F.col("f.l_partkey").alias("first_part"), "n_blocks", "total")


# A stand-in for the claim rules: a keyword of the part's name, a nutrient and its least value.
KEYWORD_RULES = (("red", "protein", 25.0), ("blue", "fat", 4.5), ("green", "carb", 3.9), ("a", "protein", 26.5))


def _nutrients(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    per = lambda c, scale=1: as_double(F.sum(dec(c)) * scale / n)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(per("l_quantity").alias("protein"), per("l_tax", 100).alias("carb"), per("l_discount", 100).alias("fat"))


_RULE_SQL = " ".join(f"WHEN contains(lower(p_name), '{k}') THEN {n} >= {v}" for k, n, v in KEYWORD_RULES)


@query(f"""
WITH n AS (SELECT l_partkey AS p_partkey, round((sum(l_quantity::DECIMAL(18,2)) / count(*))::DECIMAL(28,10), 4)::DOUBLE AS protein,
    round((sum(l_tax::DECIMAL(18,2)) * 100 / count(*))::DECIMAL(28,10), 4)::DOUBLE AS carb, round((sum(l_discount::DECIMAL(18,2)) * 100 / count(*))::DECIMAL(28,10), 4)::DOUBLE AS fat
  FROM lineitem GROUP BY 1),
j AS (SELECT p_partkey, CASE {_RULE_SQL} END AS good, 4 * carb + 4 * protein + 9 * fat AS kcal, p_size * 10 AS reported FROM part JOIN n USING (p_partkey))
SELECT p_partkey, CASE WHEN NOT good THEN 'NON_COMPLIANT' WHEN abs(reported - kcal) * 100 > 5 * reported THEN 'REVIEW_REQUIRED' ELSE 'COMPLIANT' END AS verdict, round(kcal, 4) AS kcal FROM j""")
def q02_claim_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.operators.claims import energy_kcal, verdict

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").join(_nutrients(spark, sf_dir), "p_partkey")
    good = F.lit(None).cast("boolean")
    for keyword, nutrient, least in reversed(KEYWORD_RULES):
        good = F.when(F.contains(F.lower("p_name"), F.lit(keyword)), F.col(nutrient) >= least).otherwise(good)
    kcal, reported = energy_kcal(F.col("carb"), F.col("protein"), F.col("fat")), F.col("p_size") * 10
    off = F.abs(reported - kcal) * 100 > 5 * reported
    return rows.select("p_partkey", verdict(~good, F.lit(False), off, F.lit(False)).alias("verdict"), F.round(kcal, 4).alias("kcal"))


NAME_RULES = (("green", "cool"), ("blue", "cool"), ("red", "warm"), ("or", "other"))


@query("SELECT p_partkey, " + "CASE " + " ".join(f"WHEN contains(lower(p_name), '{k}') THEN {i}" for i, (k, _) in enumerate(NAME_RULES)) + " END AS ord, CASE " + " ".join(f"WHEN contains(lower(p_name), '{k}') THEN '{v}'" for k, v in NAME_RULES) + " END AS family FROM part")
def q03_first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("p_name")
    place = matching.first_rule_in_list(low, [(kw, i) for i, (kw, _) in enumerate(NAME_RULES)])
    return table(spark, sf_dir, "part").select("p_partkey", place.cast("int").alias("ord"), matching.first_rule_in_list(low, list(NAME_RULES)).alias("family"))


BLOCKS = ((10.0, 2.0), (20.0, 3.5), (30.0, 6.0), (45.0, 7.25))
_BLOCKS_SQL = "(VALUES " + ", ".join(f"({i}, {g}::DOUBLE, {v}::DOUBLE)" for i, (g, v) in enumerate(BLOCKS)) + ") b(i, g, v)"


def _blocks() -> Column:
    return F.array(*[F.struct(F.lit(g).alias("grammage"), F.lit(v).alias("pct")) for g, v in BLOCKS])


@query(f"""SELECT p_partkey, arg_min(g, abs(g - p_size) * 100 + i) AS nearest, floor(arg_min(v, abs(g - p_size) * 100 + i) * p_size / arg_min(g, abs(g - p_size) * 100 + i) * 10 + 0.5)::BIGINT::DOUBLE / 10.0 AS scaled
FROM part, {_BLOCKS_SQL} GROUP BY p_partkey, p_size""")
def q04_nearest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = matching.nearest_block(F.col("p_size"), _blocks(), "grammage")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", near.alias("b"))
    scaled = F.floor(F.col("b.pct") * F.col("p_size") / F.col("b.grammage") * 10 + 0.5).cast("double") / 10.0
    return rows.select("p_partkey", F.col("b.grammage").alias("nearest"), scaled.alias("scaled"))


@query(f"SELECT p_partkey, arg_min(v, i) AS pct FROM part LEFT JOIN {_BLOCKS_SQL} ON abs(g - p_size) < 0.5 GROUP BY 1")
def q05_band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", matching.band_block(F.col("p_size"), _blocks(), "grammage")["pct"].alias("pct"))


@query("""
WITH last AS (SELECT l_orderkey, max({'n': l_linenumber, 's': l_shipdate, 'q': l_quantity}) AS m FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT o_orderkey, strftime(m.s, '%Y-%m-%d') AS ship_date, m.q AS quantity FROM orders LEFT JOIN last ON l_orderkey = o_orderkey""")
def q06_last_wins_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    last = matching.last_wins(lines, ["l_orderkey"], ["l_linenumber", "l_shipdate", "l_quantity"])
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"), F.col("l_quantity").alias("quantity"))


_WORDS_SQL = "list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(f"""
WITH w AS (SELECT DISTINCT unnest({_WORDS_SQL.format(c="p_name || ' ' || p_type || ' ' || p_brand")}) AS word FROM part)
SELECT a.word AS word, b.word AS near, levenshtein(a.word, b.word)::INTEGER AS distance FROM w a JOIN w b ON a.word[1] = b.word[1] AND abs(length(a.word) - length(b.word)) <= 2 AND levenshtein(a.word, b.word) <= 2 AND a.word <> b.word""")
def q07_fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").select(F.explode(words(F.concat_ws(" ", "p_name", "p_type", "p_brand"))).alias("word")).distinct()
    return matching.fuzzy_pairs(terms, terms.withColumnRenamed("word", "near"), "word", "near").filter("word <> near")


_NORMAL_SQL = f"trim(regexp_replace(lower(regexp_replace(translate(text, '{ACCENTED}', '{PLAIN}'), '[\\x{{300}}-\\x{{36F}}]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_ALL_WORDS_SQL = f"SELECT word, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM (SELECT doc_id, unnest(string_split({_NORMAL_SQL}, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1"


@query(_ALL_WORDS_SQL)
def q08_normalize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listed(table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("words")), "words", "word")
    return rows.groupBy("doc_id", "word").agg(F.count("*").alias("k")).groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


PHRASES = ("of the", "the and", "and that the")


@query("SELECT doc_id, " + ", ".join(f"contains(' ' || t || ' ', ' {p} ') AS has_{i}" for i, p in enumerate(PHRASES)) + " FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents) WHERE " + " OR ".join(f"contains(' ' || t || ' ', ' {p} ')" for p in PHRASES))
def q09_phrase_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("t")
    has = [has_phrase(F.col("t"), F.lit(p)).alias(f"has_{i}") for i, p in enumerate(PHRASES)]
    return table(spark, sf_dir, "documents").select("doc_id", text).select("doc_id", *has).filter(" OR ".join(f"has_{i}" for i in range(len(PHRASES))))


@query(f"""
WITH w AS (SELECT DISTINCT unnest({_WORDS_SQL.format(c="text")}) AS word FROM benchmark), v AS (SELECT DISTINCT unnest({_WORDS_SQL.format(c="text")}) AS word FROM documents)
SELECT word FROM w ANTI JOIN v USING (word)""")
def q10_word_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    def own(name: str) -> DataFrame:
        text = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
        return table(spark, sf_dir, name).select(F.explode(F.array_remove(F.split(text, " "), "")).alias("word")).distinct()

    return own("benchmark").join(own("documents"), "word", "left_anti")


@query(f"""SELECT term, min(p_partkey)::BIGINT AS first_at FROM (SELECT p_partkey, unnest({_WORDS_SQL.format(c="p_name || ' ' || p_type")}) AS term FROM part) WHERE regexp_full_match(term, '[a-z]{{3,}}') GROUP BY 1""")
def q11_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(words(F.concat_ws(" ", "p_name", "p_type"))).alias("term"))
    return matching.first_seen(rows.filter(F.col("term").rlike("^[a-z]{3,}$")), "term", "p_partkey")


@query("""SELECT p_type AS claim, count(*)::BIGINT AS n, min(p_partkey)::BIGINT AS first_at FROM part GROUP BY 1 ORDER BY n DESC, first_at, claim LIMIT 5""")
def q12_top_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.top_claims(table(spark, sf_dir, "part"), F.array("p_type"), F.col("p_partkey"))


@query("""SELECT p_brand, coalesce(floor(avg(CASE WHEN p_retailprice > 0 THEN p_retailprice END) + 0.5), 0)::DOUBLE AS avg_price, coalesce(min(CASE WHEN p_retailprice > 0 THEN p_retailprice END), 0)::DOUBLE AS min_price,
  coalesce(max(CASE WHEN p_retailprice > 0 THEN p_retailprice END), 0)::DOUBLE AS max_price FROM part GROUP BY 1""")
def q13_price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.price_summary(table(spark, sf_dir, "part"), F.col("p_retailprice"), "p_brand")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1 UNION ALL SELECT 'All', count(*)::BIGINT FROM events")
def q14_platform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.counts_with_total(table(spark, sf_dir, "events"), "event_type")


@query("SELECT p_brand, count(*)::BIGINT AS n, min(p_partkey)::BIGINT AS first_at FROM part GROUP BY 1")
def q15_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.category_counts(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE (contains(lower(p_name), 're') OR contains(lower(p_type), 'pol')) AND p_size IN (5, 10, 15)")
def q16_search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.filter((F.contains(F.lower("p_name"), F.lit("re")) | F.contains(F.lower("p_type"), F.lit("pol"))) & F.col("p_size").isin(5, 10, 15)).select("p_partkey", "p_name", "p_brand")


def _line_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "warn").when(F.col("l_linestatus") == "F", "pass").otherwise("skip")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), status.alias("status"))


_LINE_STATUS_SQL = "CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_returnflag = 'A' THEN 2 WHEN l_linestatus = 'F' THEN 1 ELSE 0 END"


@query(f"""
WITH steps AS (SELECT l_orderkey AS o_orderkey, max({_LINE_STATUS_SQL}) AS r FROM lineitem GROUP BY 1)
SELECT o_custkey, ['skip', 'pass', 'warn', 'fail'][max(r) + 1] AS status, count(*)::BIGINT AS orders FROM orders JOIN steps USING (o_orderkey) GROUP BY 1""")
def q17_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = checks.roll_up(_line_checks(spark, sf_dir), "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(steps, "o_orderkey")
    return rows.groupBy("o_custkey").agg(checks.status_of(F.max(checks.rank(F.col("status")))).alias("status"), F.count("*").alias("orders"))


@query(f"""SELECT l_suppkey, {", ".join(f"count(*) FILTER (r = {3 - i})::BIGINT AS n_{s}" for i, s in enumerate(("fail", "warn", "pass", "skip")))} FROM (SELECT l_suppkey, {_LINE_STATUS_SQL} AS r FROM lineitem) GROUP BY 1""")
def q18_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "warn").when(F.col("l_linestatus") == "F", "pass").otherwise("skip")
    return checks.status_counts(table(spark, sf_dir, "lineitem").select("l_suppkey", status.alias("status")), "l_suppkey")


@query("""
WITH n AS (SELECT l_partkey, round((sum(l_quantity::DECIMAL(18,2)) / count(*))::DECIMAL(28,10), 4)::DOUBLE AS protein, round((sum(l_tax::DECIMAL(18,2)) * 100 / count(*))::DECIMAL(28,10), 4)::DOUBLE AS carb,
  round((sum(l_discount::DECIMAL(18,2)) * 100 / count(*))::DECIMAL(28,10), 4)::DOUBLE AS fat FROM lineitem GROUP BY 1)
SELECT l_partkey AS p_partkey, round(dev, 4) AS deviation_pct, CASE WHEN dev <= 5 THEN 'pass' ELSE 'fail' END AS status
FROM (SELECT l_partkey, CASE WHEN protein * 8 = 0 THEN 0 ELSE abs(protein * 8 - (carb * 4 + protein * 4 + fat * 9)) / (protein * 8) * 100 END AS dev FROM n)""")
def q19_energy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.operators.claims import ENERGY_TOLERANCE_PCT, energy_deviation_pct, energy_kcal

    dev = energy_deviation_pct(F.col("protein") * 8, energy_kcal(F.col("carb"), F.col("protein"), F.col("fat")))
    return _nutrients(spark, sf_dir).select("p_partkey", F.round(dev, 4).alias("deviation_pct"), F.when(dev <= ENERGY_TOLERANCE_PCT, "pass").otherwise("fail").alias("status"))


@query("""SELECT l_orderkey, CASE WHEN t = 0 THEN NULL ELSE round((s * 100 / t)::DECIMAL(28,10), 1)::DOUBLE END AS pct
FROM (SELECT l_orderkey, sum(l_discount::DECIMAL(18,2)) AS s, sum((l_discount + l_tax)::DECIMAL(18,2)) AS t FROM lineitem GROUP BY 1)""")
def q20_pct_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = (F.col("l_discount") + F.col("l_tax")).cast(T.DecimalType(18, 2))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(dec("l_discount")).alias("s"), F.sum(both).alias("t"))
    return rows.select("l_orderkey", F.when(F.col("t") != 0, as_double(F.col("s") * 100 / F.col("t"), 1)).alias("pct"))


@query("SELECT p_partkey, CASE WHEN p_size > 0 AND abs(p_size - 10) > 1 THEN floor(p_retailprice * (10.0::DOUBLE / p_size) * 100 + 0.5) / 100 ELSE p_retailprice END AS per_10 FROM part")
def q21_scale_per_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.floor(F.col("p_retailprice") * (F.lit(10.0) / F.col("p_size")) * 100 + 0.5) / 100
    return table(spark, sf_dir, "part").select("p_partkey", F.when((F.col("p_size") > 0) & (F.abs(F.col("p_size") - 10) > 1), scaled).otherwise(F.col("p_retailprice")).alias("per_10"))


@query("SELECT l_suppkey, list_sort(list(l_quantity))[(count(*) // 2) + 1] AS median FROM lineitem GROUP BY 1")
def q22_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").transform(geometry.upper_medians, ["l_suppkey"], "l_quantity")


@query("""
WITH RECURSIVE r AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier),
f AS (SELECT s_nationkey, s_suppkey, s_acctbal, k, s_acctbal AS anchor, 1 AS cluster FROM r WHERE k = 1
  UNION ALL SELECT r.s_nationkey, r.s_suppkey, r.s_acctbal, r.k, CASE WHEN abs(f.anchor - r.s_acctbal) <= 500 THEN f.anchor ELSE r.s_acctbal END, CASE WHEN abs(f.anchor - r.s_acctbal) <= 500 THEN f.cluster ELSE f.cluster + 1 END
  FROM f JOIN r ON r.s_nationkey = f.s_nationkey AND r.k = f.k + 1)
SELECT s_suppkey, anchor, cluster FROM f""")
def q23_anchored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return clusters.anchored_groups(rows, ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], "s_acctbal", 500.0).select("s_suppkey", "anchor", "cluster")


@query("""
WITH u AS (SELECT o_custkey AS k, 0 AS prio, min(o_orderkey) AS ref FROM orders WHERE o_totalprice > 200000 GROUP BY 1 UNION ALL SELECT c_custkey, 1, min(c_nationkey)::BIGINT FROM customer GROUP BY 1)
SELECT k AS custkey, min(prio) AS prio, arg_min(ref, prio) AS ref FROM u GROUP BY 1""")
def q24_priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("ref"))
    rest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").cast("long").alias("ref"))
    return matching.priority_union(big, rest, key=["custkey"])


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_shipdate < lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS bad FROM lineitem) WHERE bad""")
def q25_order_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", matching.inversions(F.col("l_shipdate"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]).alias("bad"))
    return rows.filter("bad").select("l_orderkey", "l_linenumber")


@query(r"SELECT doc_id, len(x)::INTEGER AS n, x[1] AS first, list_aggregate(list_transform(x, lambda v: length(v)), 'max')::INTEGER AS longest FROM (SELECT doc_id, regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)', 1) AS x FROM documents) WHERE len(x) > 0")
def q26_regex_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", find_all(F.col("text"), r"([0-9]+(?:\.[0-9]+)?)").alias("x")).filter(F.size("x") > 0)
    return rows.select("doc_id", F.size("x").alias("n"), F.get("x", 0).alias("first"), F.array_max(F.transform("x", F.length)).alias("longest"))


@query("""
WITH k AS (SELECT c_custkey, lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS pin FROM customer),
v AS (SELECT c_custkey, pin, unnest(range(1, 7)) AS i FROM k), m AS (SELECT c_custkey, pin, i, pin[1:i - 1] || '_' || pin[i + 1:6] AS mask FROM v)
SELECT a.c_custkey AS custkey, b.c_custkey AS other FROM m a JOIN m b ON a.mask = b.mask AND a.i = b.i AND a.c_custkey < b.c_custkey AND a.pin <> b.pin""")
def q27_pincode_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    pins = table(spark, sf_dir, "customer").select("c_custkey", F.lpad((F.col("c_custkey") % 1_000_000).cast("string"), 6, "0").alias("pin"))
    masked = pins.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("mask", F.overlay("pin", F.lit("_"), F.col("i"), F.lit(1)))
    other = masked.select("i", "mask", F.col("c_custkey").alias("other"), F.col("pin").alias("other_pin"))
    return masked.join(other, ["i", "mask"]).filter("c_custkey < other AND pin <> other_pin").select(F.col("c_custkey").alias("custkey"), "other")


@query(r"""SELECT event_id, TRY_CAST(regexp_extract(t, '^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE) AS n FROM (SELECT event_id, substring(props, 7) AS t FROM events)""")
def q28_parse_float_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", parse_float(F.expr("substring(props, 7)")).alias("n"))


@query("""SELECT event_id, coalesce(CASE WHEN json_valid(t) THEN TRY_CAST(json_extract_string(t, '$.k') AS BIGINT) END, -1) AS k FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{' || props ELSE props END AS t FROM events)""")
def q29_json_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(text, "k long")["k"], F.lit(-1)).cast("long").alias("k"))


@query("""SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_offset FROM conversations""")
def q30_running_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return rows.select("conv_id", "turn", matching.running_before(F.col("size"), ["conv_id"], ["turn"]).cast("long").alias("page_offset"))


_BOXES_SQL = "SELECT l_orderkey, l_linenumber, l_quantity AS lo, l_quantity + l_discount * 100 AS hi FROM lineitem WHERE l_linenumber {op} 2"


@query(f"""SELECT l_orderkey, l_linenumber, lo, hi FROM ({_BOXES_SQL.format(op=">")}) s WHERE NOT EXISTS (SELECT 1 FROM ({_BOXES_SQL.format(op="<=")}) p WHERE p.l_orderkey = s.l_orderkey AND least(p.hi, s.hi) - greatest(p.lo, s.lo) > 0.2::DOUBLE * (s.hi - s.lo))""")
def q31_box_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("hi"))
    return matching.interval_anti_join(boxes.filter("l_linenumber > 2"), boxes.filter("l_linenumber <= 2"), ["l_orderkey"], "lo", "hi", 0.2)


LINE_SLOPES = tuple(k / 10 for k in range(-3, 4))


@query(f"""
WITH pts AS (SELECT l_suppkey AS k, l_linenumber::DOUBLE AS x, l_quantity AS y, l_linenumber AS w FROM lineitem),
bins AS (SELECT k, s, floor((y - s * x) / 4.0 + 0.5)::BIGINT AS bin, sum(w) AS w FROM pts, (VALUES {", ".join(f"({s}::DOUBLE)" for s in LINE_SLOPES)}) t(s) GROUP BY ALL)
SELECT k AS suppkey, s AS slope, sum(w * w)::BIGINT AS sharpness FROM bins GROUP BY ALL""")
def q32_slope_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("suppkey"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y"), F.col("l_linenumber").alias("width"))
    found = geometry.row_sharpness(points, ["suppkey"], LINE_SLOPES, 4.0)
    return found.select("suppkey", "slope", F.col("sharpness").cast("bigint").alias("sharpness"))


@query("""
WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 50000)
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ANTI JOIN gone USING (o_orderkey) UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'N' FROM orders JOIN gone USING (o_orderkey)""")
def q33_rewrite_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    gone = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000)
    new = orders.filter(gone).select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))
    return orders.filter(~gone).drop("o_totalprice").unionByName(new)


@query("""SELECT o_orderkey::VARCHAR AS sheet, l_linenumber::VARCHAR AS grammage, coalesce(l_quantity::BIGINT::VARCHAR, '') AS protein_g, concat_ws(' | ', l_returnflag, l_linestatus) AS brand_usp, 'not_launched' AS status FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def q34_append_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.functions.numbers import number_text

    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem")
    b = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return b.select(F.col("o_orderkey").cast("string").alias("sheet"), F.col("l_linenumber").cast("string").alias("grammage"), F.coalesce(number_text(F.col("l_quantity")), F.lit("")).alias("protein_g"), F.concat_ws(" | ", "l_returnflag", "l_linestatus").alias("brand_usp"), F.lit("not_launched").alias("status"))


@query("""SELECT p_partkey, string_split(p_type, ' ') AS parts, len(string_split(p_type, ' '))::INTEGER AS n FROM part""")
def q35_claim_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = F.replace(F.concat(F.col("p_type"), F.lit(" (3.85g/70g)")), F.lit(" "), F.lit("/"))
    parts = F.slice(split_outside_brackets(claim, "/"), 1, F.size(split_outside_brackets(claim, "/")) - 1)
    return table(spark, sf_dir, "part").select("p_partkey", parts.alias("parts"), F.size(parts).alias("n"))


# An alignment with a swap is one edit and two Levenshtein distances around it; with two swaps it is both of them.
@query(f"""
WITH w AS (SELECT DISTINCT unnest({_WORDS_SQL.format(c="p_name || ' ' || p_type || ' ' || p_brand")}) AS word FROM part),
p AS (SELECT a.word AS word, b.word AS near, levenshtein(a.word, b.word) AS d FROM w a JOIN w b ON a.word[1] = b.word[1] AND abs(length(a.word) - length(b.word)) <= 2 AND a.word <> b.word),
s AS (SELECT word, near, d, i, j, 1 + levenshtein(word[1:i - 1], near[1:j - 1]) + levenshtein(word[i + 2:], near[j + 2:]) AS one,
    CASE WHEN word[1:i - 1] = near[1:j - 1] THEN len(list_filter(range(1, length(word) - i), lambda k: word[i + 2:][1:k - 1] || word[i + 2:][k + 1] || word[i + 2:][k] || word[i + 2:][k + 2:] = near[j + 2:])) END AS again
  FROM (SELECT *, unnest(range(1, length(near))) AS j FROM (SELECT *, unnest(range(1, length(word))) AS i FROM p)) WHERE abs(i - j) <= 2 AND word[i] = near[j + 1] AND word[i + 1] = near[j] AND word[i] <> word[i + 1])
SELECT word, near, least(any_value(p.d), coalesce(min(one), 9), CASE WHEN max(again) > 0 THEN 2 ELSE 9 END)::INTEGER AS distance FROM p LEFT JOIN s USING (word, near) GROUP BY ALL HAVING distance <= 2""")
def q36_osa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").select(F.explode(words(F.concat_ws(" ", "p_name", "p_type", "p_brand"))).alias("word")).distinct()
    return matching.osa_pairs(terms, terms.withColumnRenamed("word", "near"), "word", "near").filter("word <> near")


@query(f"SELECT doc_id, length(t)::INTEGER AS n_chars, md5(t) AS normal_md5 FROM (SELECT doc_id, {_NORMAL_SQL} AS t FROM documents)")
def q37_fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("n_chars"), F.md5(t).alias("normal_md5"))


@query(_ALL_WORDS_SQL)
def q38_normalize_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q08_normalize_words(spark, sf_dir)


@query(f"SELECT doc_id, length({_NORMAL_SQL})::INTEGER AS n_chars FROM documents")
def q39_fold_all_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(normalize(F.col("text"))).alias("n_chars"))


@query("SELECT p_partkey, CASE WHEN p_size <> 25 THEN CASE WHEN p_size = 0 THEN NULL ELSE floor((p_retailprice - p_size * 30.0::DOUBLE) / abs(p_size * 30.0::DOUBLE) * 100 * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE END END AS deviation_pct, p_size / 100.0::DOUBLE AS factor FROM part")
def q40_signed_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, want = F.when(F.col("p_size") != 25, F.col("p_retailprice")), F.col("p_size") * F.lit(30.0)
    return table(spark, sf_dir, "part").select("p_partkey", claims.signed_deviation_pct(got, want).alias("deviation_pct"), claims.serving_factor(F.col("p_size")).alias("factor"))


ROW_SLOPES = (-2.0, -0.5, 0.0, 0.5, 2.0)


@query(f"""WITH bins AS (SELECT l_suppkey, slope, floor((l_linenumber - slope * l_quantity) / 3.0 + 0.5) AS bin, sum(l_quantity::DECIMAL(18,2)) AS width
  FROM lineitem, (SELECT unnest([{", ".join(map(str, ROW_SLOPES))}]::DOUBLE[]) AS slope) GROUP BY ALL) SELECT l_suppkey, slope, sum(width::DOUBLE * width::DOUBLE) AS sharpness FROM bins GROUP BY ALL""")
def q41_row_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("y"), dec("l_quantity").alias("width"))
    return geometry.row_sharpness(boxes, ["l_suppkey"], ROW_SLOPES, 3.0)


@query("""SELECT l_orderkey, 'per ' || (count(*) * 10)::VARCHAR || 'g: ' || coalesce(string_agg(l_returnflag || ' ' || l_quantity::BIGINT::VARCHAR || ' g', ', ' ORDER BY l_linenumber, l_returnflag, l_quantity) FILTER (WHERE l_quantity <> 7), '') AS said FROM lineitem GROUP BY 1""")
def q42_nutrition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", F.col("l_quantity").alias("q"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))
    values = F.transform("items", lambda b: F.struct(b["l_returnflag"].alias("label"), F.when(b["q"] != 7, b["q"]).alias("value"), F.lit("g").alias("unit")))
    return rows.select("l_orderkey", claims.nutrition_text(F.array(F.struct((F.size("items") * 10).cast("double").alias("grammage"), values.alias("values")))).alias("said"))
