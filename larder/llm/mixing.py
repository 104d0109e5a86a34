"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone.

Documents fall into cells (source, language, topic). The cells' token counts are raked in turn to the target
marginals of each dimension; a document's inclusion probability is its cell's fitted weight over its tokens,
scaled so that the expected tokens are ``budget`` of all, with probabilities over 1 set to 1 and the rest scaled
anew. A document is sampled when a uniform number made from its id lies below its probability, so a rerun and
a lost executor give the same sample.

Without a budget (``budget=None``, what the query and the pipeline use) a cell's weight is at most MOST_WEIGHT times its
tokens (STATED_WEIGHT for stated shares) in every step of the raking, so that other cells of its marginals take over what a scarce one can't give, and the
rate is the largest at which cells that give all they have hold CUT_SHARE of the weight at most. So the sample keeps about
1 / MOST_WEIGHT of the tokens or more, however scarce a cell is, and misses a target only where these bounds hold (``achieved`` returns target and sampled shares). With a
budget, cells that would pass 1 are cut off and the marginals miss their targets by that.

Targets: shares by dimension (value -> share) or, by default, tempered shares: share ** TEMPER, normalised. The
cell table is made by one aggregation that combines before the shuffle, and raked by windows over one dimension's value at
a time, with the lineage cut after each CUT_ROUNDS rounds; totals are single numbers. Whether the fitted cells are broadcast
to the documents is left to Spark's own check of their size.

Defined cases: null source or language counts as the empty string; null and empty texts have no tokens, are
sampled always (they weigh nothing); a target value without documents is ignored and the rest renormalised; an
empty table gives an empty result; rows that repeat, and ties of an id, are drawn alike; very long texts are counted whole; the columns added are topic, n_tokens, probability, sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import cut_lineage

DIMENSIONS = ("source", "lang", "topic")
BUDGET, TEMPER, ROUNDS = 0.9, 0.7, 12
CUT_ROUNDS = 4
#: A cell's tokens are weighed at most so many times; 1 / MOST_WEIGHT of all tokens is what the sample keeps at least, roughly.
MOST_WEIGHT = 2.0
#: The same where shares are stated: they may ask for more, at the price of a smaller sample.
STATED_WEIGHT = 10.0
#: Of all weight, what cells that give all they have may hold, and the parts of 1 by which ratios are compared.
CUT_SHARE, STEPS = 0.005, 1000
#: Topic rules in order; the first that holds counts, the last is the rest.
LEGAL = "[Ll]icen[cs]e|[Cc]opyright"
CONTACT = "[a-z0-9]@[a-z0-9]"
TABLE_SHARE, SHORT_TOKENS = 20, 200


def n_tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: str = "text", tokens: str = "n_tokens") -> Column:
    t = F.coalesce(F.col(text), F.lit(""))
    pipes = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    return F.when(pipes * TABLE_SHARE > F.col(tokens), "table").when(t.rlike(LEGAL), "legal").when(t.rlike(CONTACT), "contact").when(F.col(tokens) < SHORT_TOKENS, "short").otherwise("prose")


def with_cells(docs: DataFrame) -> DataFrame:
    """docs with n_tokens, topic and the null-free dimensions _source and _lang."""
    out = docs.withColumn("n_tokens", n_tokens()).withColumn("topic", topic())
    return out.withColumns({f"_{d}": F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS})


def _targets(cells: DataFrame, shares: dict[str, dict[str, float]] | None) -> DataFrame:
    """cells with target_<dim>: tokens that the cell's value of the dimension should have in all."""
    keys = [f"_{d}" for d in DIMENSIONS]
    for d in DIMENSIONS:
        values = cells.groupBy(f"_{d}").agg(F.sum("tokens").cast("double").alias("_own"))
        if shares and d in shares:
            given = F.coalesce(*(F.when(F.col(f"_{d}") == v, F.lit(float(s))) for v, s in shares[d].items()), F.lit(0.0))
        else:
            given = F.pow("_own", F.lit(TEMPER))
        values = values.withColumn("_given", given)
        tokens, total = values.agg(F.sum("_own"), F.sum("_given")).first()
        factor = (tokens or 0.0) / total if total else 0.0
        cells = cells.join(values.select(f"_{d}", (F.col("_given") * F.lit(factor)).alias(f"target_{d}")), f"_{d}")
    return cells.select(*keys, *(c for c in cells.columns if c not in keys))


def rake(cells: DataFrame, shares: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, most: float | None = None) -> DataFrame:
    """cells (_source, _lang, _topic, tokens) with weight: fitted tokens, in each step at most ``most`` times the tokens."""
    cells = cut_lineage(_targets(cells, shares).withColumn("weight", F.col("tokens").cast("double")))
    for k in range(1, rounds + 1):
        for d in DIMENSIONS:
            own = F.sum("weight").over(Window.partitionBy(f"_{d}"))
            fitted = F.when(own > 0, F.col("weight") * F.col(f"target_{d}") / own).otherwise(0.0)
            cells = cells.withColumn("weight", fitted if most is None else F.least(fitted, F.lit(most) * F.col("tokens")))
        if k % CUT_ROUNDS == 0 or k == rounds:
            cells = cut_lineage(cells)
    return cells


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """raked cells with probability: min(1, rate * weight / tokens), the rate such that expected tokens meet the budget."""
    want = budget * (cells.agg(F.sum("tokens")).first()[0] or 0)
    rate, full = 0.0, F.lit(False)
    while True:  # each round cuts off at least one more cell, and few rounds cut off all that must be
        whole, rest = cells.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (want - (whole or 0)) / rest if rest else rate
        if new <= rate:
            break
        rate, full = new, F.lit(new) * F.col("weight") >= F.col("tokens")
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(rate) * F.col("weight") / F.col("tokens"))).otherwise(1.0)
    return cells.withColumn("probability", F.round(p, 6))


def uncut(cells: DataFrame) -> DataFrame:
    """raked cells with probability: rate * weight / tokens, at most 1, the rate the largest at which cells that pass 1 hold CUT_SHARE of the weight at most, so that the marginals hold but for that.

    Ratios are compared by STEPS-ths; as they are bounded, so are the sums by step that come to the driver.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    steps = cells.filter(ratio.isNotNull()).groupBy(F.ceil(ratio * STEPS).alias("step")).agg(F.sum("weight").alias("weight")).collect()
    left, cap = CUT_SHARE * sum(r["weight"] for r in steps), 0.0
    for r in sorted(steps, key=lambda r: -r["step"]):
        cap = r["step"] / STEPS
        left -= r["weight"]
        if left < 0:
            break
    p = F.when(ratio.isNull() | F.lit(not cap), F.lit(1.0)).otherwise(F.least(F.lit(1.0), ratio / F.lit(cap or 1.0)))
    return cells.withColumn("probability", F.round(p, 6))


def uniform(id_col: str = "doc_id") -> Column:
    """A number in [0, 1) made from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0


def lean(docs: DataFrame) -> DataFrame:
    """docs with their cells and without their texts, written once: what ``mix`` needs when the texts aren't wanted."""
    return cut_lineage(with_cells(docs).drop("text", *(f"_{d}" for d in DIMENSIONS)))


def mix(docs: DataFrame, shares: dict[str, dict[str, float]] | None = None, budget: float | None = None) -> DataFrame:
    """docs (as they are, or from ``lean``) with topic, n_tokens, probability and sampled; without a budget as many tokens as the targets allow."""
    rows = with_cells(docs) if "text" in docs.columns else docs.withColumns({f"_{d}": F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS})
    keys = [f"_{d}" for d in DIMENSIONS]
    cells = cut_lineage(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    raked = rake(cells, shares, most=None if budget is not None else STATED_WEIGHT if shares else MOST_WEIGHT)
    fitted = cut_lineage((uncut(raked) if budget is None else calibrate(raked, budget)).select(*keys, "probability"))
    return rows.join(fitted, keys).drop(*keys).withColumn("sampled", uniform() < F.col("probability"))


def achieved(mixed: DataFrame, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(dimension, value, target, share): the target and the sampled share of tokens of each value, from the rows of ``mix``."""
    rows = mixed.withColumns({f"_{d}": F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS})
    keys = [f"_{d}" for d in DIMENSIONS]
    kept = F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).alias("kept")
    cells = _targets(cut_lineage(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), kept)), shares)
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"_{d}").alias("value"), F.col(f"target_{d}").alias("goal")) for d in DIMENSIONS))).alias("of")
    out = cells.select("tokens", "kept", each).groupBy("of.dimension", "of.value").agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept"), F.max("of.goal").alias("goal"))
    whole = Window.partitionBy("dimension")
    part = lambda c: F.when(F.sum(c).over(whole) > 0, F.col(c) / F.sum(c).over(whole))
    return out.select("dimension", "value", part("goal").alias("target"), part("kept").alias("share"))


def sample(docs: DataFrame, shares: dict[str, dict[str, float]] | None = None, budget: float | None = None) -> DataFrame:
    """The sampled documents with their own columns."""
    return mix(docs, shares, budget).filter("sampled").select(*docs.columns)


def _sql() -> str:
    keys = ", ".join(f"_{d}" for d in DIMENSIONS)
    steps = [
        rf"""rows_ AS (SELECT doc_id, coalesce(source, '') AS _source, coalesce(lang, '') AS _lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, coalesce(text, '') AS t FROM documents)""",
        f"""docs AS (SELECT doc_id, _source, _lang, n_tokens, CASE WHEN (length(t) - length(replace(t, '|', ''))) * {TABLE_SHARE} > n_tokens THEN 'table' WHEN regexp_matches(t, '{LEGAL}') THEN 'legal' WHEN regexp_matches(t, '{CONTACT}') THEN 'contact' WHEN n_tokens < {SHORT_TOKENS} THEN 'short' ELSE 'prose' END AS _topic FROM rows_)""",
        f"cells AS (SELECT {keys}, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        steps.append(f"t_{d} AS (SELECT _{d}, pow(sum(tokens), {TEMPER}) AS g FROM cells GROUP BY 1)")
        steps.append(f"target_{d} AS (SELECT _{d}, g / (SELECT sum(g) FROM t_{d}) * (SELECT sum(tokens) FROM cells) AS target FROM t_{d})")
    last = "cells_0"
    steps.append(f"{last} AS (SELECT {keys}, tokens, tokens AS weight FROM cells)")
    for i in range(ROUNDS * len(DIMENSIONS)):
        d = DIMENSIONS[i % len(DIMENSIONS)]
        steps.append(f"cells_{i + 1} AS MATERIALIZED (SELECT {', '.join('c.' + f'_{x}' for x in DIMENSIONS)}, tokens, least(CASE WHEN sum(weight) OVER (PARTITION BY c._{d}) > 0 THEN weight * target / sum(weight) OVER (PARTITION BY c._{d}) ELSE 0 END, {MOST_WEIGHT} * tokens) AS weight FROM {last} c JOIN target_{d} t ON t._{d} = c._{d})")
        last = f"cells_{i + 1}"
    steps += [
        f"ratios AS (SELECT {keys}, tokens, weight, CASE WHEN tokens > 0 THEN weight / tokens END AS ratio FROM {last})",
        f"steps AS (SELECT ceil(ratio * {STEPS})::BIGINT AS step, sum(weight) AS w FROM ratios WHERE ratio IS NOT NULL GROUP BY 1)",
        f"cap AS (SELECT min(step) / {STEPS}.0 AS cap FROM (SELECT step, coalesce(sum(w) OVER (ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS more, sum(w) OVER () AS every FROM steps) WHERE more <= {CUT_SHARE} * every)",
        f"fitted AS (SELECT {keys}, round(CASE WHEN ratio IS NULL OR coalesce(cap, 0) = 0 THEN 1.0 ELSE least(1.0, ratio / cap::DOUBLE) END, 6) AS probability FROM ratios, cap)",
    ]
    u = "(('0x' || md5(doc_id::VARCHAR)[1:8])::UBIGINT)::DOUBLE / 4294967296.0"
    return f"WITH {', '.join(steps)} SELECT doc_id, _source AS source, _lang AS lang, _topic AS topic, n_tokens, probability, {u} < probability AS sampled FROM docs JOIN fitted USING ({keys})"


SQL = _sql()
