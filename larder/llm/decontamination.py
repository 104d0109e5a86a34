"""Benchmark decontamination with DataFrame functions alone.

Benchmark items are normalised to words and cut into windows of WINDOW consecutive words (a shorter item is one
window). The hash set of windows, keyed by the hash of a window's first KEY_WORDS words, is broadcast to the scan
once its size is known to be under BROADCAST_WINDOWS; a larger set is joined by shuffling the keys. A document's
keys are made in one pass over its words and probed where they are made; only a position whose key hits compares
its whole window with the item's words, so a hash collision is no hit. Then documents are dropped, or the hit words are cut out of their text.

Words: A-Z lower-cased, then runs of code points outside ASCII except 0-9 and a-z. Defined cases: a null or
empty text has no words and no hits; an empty benchmark hits nothing; rows that share a doc_id count as one
document (their hits are joined, the larger word count stands); a null doc_id is a document of its own; repeated
items count as often as they have different item_ids; extra columns are kept by ``decontaminate``, ignored by ``scan``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window, and of its start that serve as its hash key.
WINDOW, KEY_WORDS = 10, 3
#: A window takes about 200 bytes in the broadcast set.
BROADCAST_WINDOWS = 500_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"


def words_of(text: str) -> Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATOR), "")


def _keyed(rows: DataFrame, length: int) -> DataFrame:
    """rows (.., words) with the hashes of all runs of so many words."""
    count = F.greatest(F.size("words") - (length - 1), F.lit(0))
    return rows.withColumn("keys", F.transform(F.slice("words", F.lit(1), count), lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, length)))))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, len, key_len and the words of every window of every item."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(text_col).alias("words")).filter(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1))))
    rows = items.select("item_id", "words", starts.alias("start"))
    window = F.slice("words", F.col("start"), F.lit(WINDOW))
    out = rows.select("item_id", F.least(F.size("words"), F.lit(WINDOW)).alias("len"), window.alias("window")).distinct()
    return out.withColumn("key_len", F.least(F.col("len"), F.lit(KEY_WORDS)))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document a row with at = -1 and n_words, and a row (at, len, item_id) for each verified hit."""
    windows = item_windows(benchmark)
    sizes = {r["key_len"]: r["count"] for r in windows.groupBy("key_len").count().collect()}  # at most KEY_WORDS rows
    small = sum(sizes.values()) <= BROADCAST_WINDOWS
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(text_col).alias("words"))
    parts = []
    for length in sorted({KEY_WORDS, *sizes}, reverse=True):
        main = length == KEY_WORDS  # there the first entry stands for the document itself
        keys = F.concat(F.array(F.lit(0).cast("long")), "keys") if main else F.col("keys")
        scan = _keyed(rows, length).select("doc_id", "words", F.posexplode(keys).alias("at", "key")).withColumn("at", F.col("at") - int(main))
        set_ = windows.filter(F.col("key_len") == length).select("item_id", "len", F.xxhash64(*(F.get("window", F.lit(k)) for k in range(length))).alias("item_key"), "window")
        same = (F.col("key") == F.col("item_key")) & (F.col("at") >= 0) & (F.slice("words", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("len")) == F.col("window"))
        if not small:  # only keys cross the network; what a key finds is verified against the document, joined back
            keyed = scan.filter("at >= 0").select("doc_id", "at", "key").join(set_, F.col("key") == F.col("item_key")).drop("key", "item_key")
            found = keyed.join(rows.select(F.col("doc_id").alias("_id"), "words"), F.col("doc_id").eqNullSafe(F.col("_id"))).filter(F.slice("words", F.col("at") + 1, F.col("len")) == F.col("window"))
            found = found.select("doc_id", "at", "len", "item_id", F.lit(None).cast("long").alias("n_words"))
            if main:
                found = found.unionByName(rows.select("doc_id", F.lit(-1).alias("at"), F.lit(None).cast("int").alias("len"), F.lit(None).cast(dict(set_.dtypes)["item_id"]).alias("item_id"), F.size("words").cast("long").alias("n_words")))
            parts.append(found)
            continue
        joined = scan.join(F.broadcast(set_), same, "left" if main else "inner")
        parts.append(joined.filter((F.col("at") < 0) | F.col("item_id").isNotNull()).select("doc_id", "at", "len", "item_id", F.when(F.col("at") < 0, F.size("words")).cast("long").alias("n_words")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _covered(spans: Column) -> Column:
    """Words inside the union of sorted (at, len) spans."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    end = lambda s: (s["at"] + s["len"]).cast("long")
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), end(s) - F.greatest(a["end"], s["at"].cast("long")))).alias("n"), F.greatest(a["end"], end(s)).alias("end"))
    return F.aggregate(spans, none, step, lambda a: a["n"])


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's word count, hit words and hit items; spans lists the (at, len) of its hits."""
    spot = F.when(F.col("at") >= 0, F.struct("at", "len"))
    found = hits(docs, benchmark, id_col, text_col).groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(spot)).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    n_hit = _covered(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, or (remove = "spans") with the hit words and what follows them up to the next word cut out."""
    bad = scan(docs, benchmark, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("spans").alias("_spans"))
    bad = (bad if remove == "spans" else bad.select("_bad_id")).hint("merge")
    same = F.col(id_col).eqNullSafe(F.col("_bad_id"))
    if remove == "documents":
        return docs.join(bad, same, "left_anti")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"[{_WORD}]+[^{_WORD}]*"), 0)
    kept = F.filter(pieces, lambda _, i: ~F.exists("_spans", lambda s: (i >= s["at"]) & (i < s["at"] + s["len"])))
    lead = F.regexp_extract(text_col, f"^[^{_WORD}]*", 0)
    cut = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.concat(lead, F.array_join(kept, "")))
    return docs.join(bad, same, "left").withColumn(text_col, cut).drop("_bad_id", "_spans")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(up=string.ascii_uppercase, low=string.ascii_lowercase)

SQL = rf"""
WITH item_words AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM item_words WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
docs AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM items) WHERE len(w) >= n),
hits AS (SELECT s.doc_id, s.i, s.n, wins.item_id FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM spots) s JOIN wins ON wins.n = s.n AND wins.win = s.win),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
