"""Competitor listings: price summary, claim frequency, platform counts and score bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import parse_float, round_half_up


def _prices(price: Column) -> list[Column]:
    p = F.when(price > 0, price)
    aggs = (round_half_up(F.avg(p)), F.min(p), F.max(p))
    return [F.coalesce(a, F.lit(0)).cast("double").alias(n) for a, n in zip(aggs, ("avg_price", "min_price", "max_price"), strict=True)]


def price_summary(rows: DataFrame, price: Column, *keys: str) -> DataFrame:
    """Rounded average, least and greatest of the prices above 0; 0 where there is none."""
    return rows.groupBy(*keys).agg(*_prices(price))


def top_claims(rows: DataFrame, claims: Column, order: Column, n: int = 5) -> DataFrame:
    """The n most frequent claims; ties go to the one seen first."""
    seen = rows.select(F.explode(claims).alias("claim"), order.alias("_at"))
    return seen.groupBy("claim").agg(F.count("*").alias("n"), F.min("_at").alias("first_at")).orderBy(F.desc("n"), "first_at", "claim").limit(n)


def counts_with_total(rows: DataFrame, col: str, total: str = "All") -> DataFrame:
    """Rows by value and over all; values without rows don't appear."""
    return rows.rollup(col).agg(F.count("*").alias("n"), F.grouping(col).alias("_all")).select(F.when(F.col("_all") == 1, total).otherwise(F.col(col)).alias(col), "n")


def per_100g(price: Column, pack_size: Column) -> Column:
    """The price of 100 g from a pack size that starts with its number."""
    return round_half_up(price / parse_float(pack_size) * 100)


def band(score: Column) -> Column:
    return F.when(score >= 4, "strong").when(score >= 3, "moderate").otherwise("weak")


def enrich(listings: DataFrame) -> DataFrame:
    """Listings with a default id by position, and unit prices."""
    return listings.withColumn("id", F.coalesce("id", F.concat(F.lit("real_"), F.col("ord").cast("string")))).withColumn("price_per_100g", per_100g(F.col("price"), F.col("pack_size")))


def headline(listings: DataFrame) -> DataFrame:
    """Competitor count, price summary, the constant sentiment split of scraped data and its white space, of which it names none."""
    constant = (("positive", 60), ("neutral", 20), ("negative", 20), ("white_space", 0))
    return listings.agg(F.count("*").alias("competitors"), *_prices(F.col("price"))).select("*", *[F.lit(v).alias(k) for k, v in constant])


def result_headline(results: DataFrame) -> DataFrame:
    """The numbers on top of stored search results (competitors, market_summary): lists that are null count as empty."""
    held = lambda c: F.coalesce(F.size(c), F.lit(0))
    own = F.col("market_summary")
    return results.withColumns({"n_competitors": held(F.col("competitors")), "avg_price": own["avg_price"], "positive": own["sentiment_breakdown"]["positive"], "n_white_space": held(own["white_space"])}).drop("competitors", "market_summary")


def history(past: DataFrame, new: DataFrame, keep: int = 10) -> DataFrame:
    """The newest entries by time."""
    return past.unionByName(new).orderBy(F.desc("ts")).limit(keep)


def of_platform(listings: DataFrame, platform: str = "All") -> DataFrame:
    """The listings of one platform, or all."""
    return listings if platform == "All" else listings.filter(F.col("platform") == platform)


def search_request(requests: DataFrame) -> DataFrame:
    """Requests that have a keyword, with the default category and region."""
    blank = lambda c, d: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.lit(d))
    return requests.filter(F.trim("keyword") != "").withColumns({"category": blank("category", "Healthy Snacks"), "region": blank("region", "Pan India")})
