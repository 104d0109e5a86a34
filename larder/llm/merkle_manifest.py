"""A Merkle manifest of a dataset: digest-to-children records, and proofs found by descending them.

A leaf is the hash of a row. The leaves of a language, by ascending doc_id, are a tree whose nodes have FAN children;
the languages' roots are the leaves of the tree on top. A tree is built and read in segments of LEVELS levels, so that a
task holds FAN ** LEVELS leaves at most, whatever the size of a language:

1. Rows get their place in their language by a range partition and prefix counts, without a window over all rows.
2. Each segment is hashed by one task; its record keeps, by digest, the children of all its nodes. The tops of segments
   are the leaves of the next round, until every tree has one top.
3. Requests descend from the root: a segment's record is looked up by its digest, the digits of the place choose a child
   at every level, the children not chosen are collected, and the path is reversed when the leaf is reached. A segment's
   path is found once and shared by its leaves, so the top records aren't asked once per row.

Defined cases: null values of a leaf are ``-``; null languages are a tree of their own and come first, an empty one is
another language; null doc_ids come first in their language and are never tampered with; rows that share a doc_id go by
their leaves, so equal rows are interchangeable; null and empty texts give different leaves; very long texts are hashed
in place and never shuffled; extra columns are ignored; an empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import shared_dir

FAN, LEVELS = 8, 4
SEGMENT = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NODES = "array<struct<digest:string,children:array<string>>>"
_STEPS = "array<struct<at:int,others:array<string>>>"
_SIBLINGS = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))
_RECORD = pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("inputs", pa.int64()), ("nodes", pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])))])


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/larder-tables/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- places ----


def placed(rows: DataFrame, by: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with _task and _line, sorted by ``by`` and ``order`` (nulls first) over all tasks; and for each ``by`` and _task, what makes _line the place within ``by`` (_shift), and the rows of ``by`` (n)."""
    # a salt parts equal rows, so that one value isn't one task; equal rows are interchangeable
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(by, *order, "_salt").sortWithinPartitions(by, *order, "_salt").drop("_salt")
    number = F.monotonically_increasing_id()
    lines = _written(dealt.withColumns({"_task": F.shiftright(number, 33), "_line": number.bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = lines.groupBy(by, "_task").agg(F.count("*").alias("k"), F.min("_line").alias("first"))
    own = Window.partitionBy(by)
    before = F.sum("k").over(own.orderBy("_task")) - F.col("k")
    return lines, parts.select(by, "_task", (before - F.col("first")).alias("_shift"), F.sum("k").over(own).alias("n"))


# ---- building ----


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def hashed(digests: list[str], levels: int) -> tuple[str, list[dict]]:
    """The top over ``levels`` levels, and the records of its nodes."""
    nodes: dict[str, list[str]] = {}
    for _ in range(levels):
        runs = [digests[a : a + FAN] for a in range(0, len(digests), FAN)]
        digests = [digest(r) for r in runs]
        nodes.update(zip(digests, runs, strict=True))
    return digests[0], [{"digest": d, "children": c} for d, c in nodes.items()]


def _segments(rows: DataFrame) -> DataFrame:
    """rows: tree, place, n (rows of the tree), digest. A record for each segment, itself a row of the next round."""

    def run(t: pa.Table) -> pa.Table:
        own = sorted(zip(t.column("place").to_pylist(), t.column("digest").to_pylist(), strict=True))
        n = t.column("n")[0].as_py()
        top, nodes = hashed([d for _, d in own], min(LEVELS, height(n)))
        return pa.Table.from_pylist([{"tree": t.column("tree")[0].as_py(), "place": own[0][0] // SEGMENT, "n": -(-n // SEGMENT), "digest": top, "inputs": len(own), "nodes": nodes}], _RECORD)

    segment = F.floor(F.col("place") / SEGMENT).alias("segment")
    return _written(rows.select("tree", "place", "n", "digest", segment).groupBy("tree", "segment").applyInArrow(run, f"tree bigint, place bigint, n bigint, digest string, inputs bigint, nodes {_NODES}"))


def build(rows: DataFrame) -> list[DataFrame]:
    """The records of all rounds, from the leaves up; the last round has one row a tree, whose digest is the tree's root."""
    rounds = [_segments(rows)]
    while rounds[-1].agg(F.max("n")).first()[0] > 1:
        rounds.append(_segments(rounds[-1]))
    return rounds


# ---- descending ----


def paths(top: str, nodes: dict[str, list[str]], inputs: int) -> Iterator[tuple[str, list[dict]]]:
    """For each place below ``top``, in order: the digest there, and the steps from it up to top (digit and children not chosen)."""
    levels, below = 0, top
    while below in nodes:  # the last segment of a tree is as high as the others
        below, levels = nodes[below][0], levels + 1
    for place in range(inputs):
        at, steps = top, []
        for k in reversed(range(levels)):
            children, digit = nodes[at], place // FAN**k % FAN
            steps.append({"at": digit, "others": children[:digit] + children[digit + 1 :]})
            at = children[digit]
        yield at, steps[::-1]


def _with_records(at: DataFrame, records: DataFrame) -> DataFrame:
    """at (tree, place, digest, steps) with the record of its digest."""
    return at.join(records.select("digest", "inputs", "nodes").dropDuplicates(["digest"]), "digest")


def _children(at: DataFrame, records: DataFrame) -> DataFrame:
    """The leaves of the segments that ``at`` names, with their steps up to the root."""
    schema = pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("digest", pa.string()), ("steps", _SIBLINGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                found = paths(x["digest"], {r["digest"]: r["children"] for r in x["nodes"]}, x["inputs"])
                yield pa.RecordBatch.from_pylist([{"tree": x["tree"], "place": x["place"] * SEGMENT + k, "digest": d, "steps": s + x["steps"]} for k, (d, s) in enumerate(found)], schema)

    return _with_records(at, records).select("tree", "place", "digest", "steps", "inputs", "nodes").mapInArrow(run, f"tree bigint, place bigint, digest string, steps {_STEPS}")


def fold(own: str, steps: list[dict]) -> str:
    """The root that a leaf and the siblings on its path give."""
    for s in steps:
        own = digest([*s["others"][: s["at"]], own, *s["others"][s["at"] :]])
    return own


_PROOF = "doc_id bigint, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string"
_PROVED = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root")), ("proof", pa.list_(pa.string())), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def _proved(leaves: DataFrame, at: DataFrame, keep: bool) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PROVED.empty_table()
        x = right.to_pylist()[0]
        found = list(paths(x["digest"], {r["digest"]: r["children"] for r in x["nodes"]}, x["inputs"]))
        above = [d for s in x["steps"] for d in s["others"]]
        roots: dict[str, str] = {}
        rows = []
        for r in left.select(["doc_id", "place", "digest", "changed"]).to_pylist():
            own, steps = found[r["place"] % SEGMENT]
            if own != r["digest"]:
                raise ValueError(f"the records lead to another leaf at place {r['place']}")
            top = fold(r["changed"] or own, steps)
            if top not in roots:
                roots[top] = fold(top, x["steps"])
            proof = [d for s in steps for d in s["others"]] + above
            rows.append({"doc_id": r["doc_id"], "leaf": own, "subroot": x["subroot"], "root": x["root"], "proof": proof if keep else None, "proof_sha256": digest(proof), "folded_root": roots[top]})
            if r["changed"]:
                del roots[top]
        return pa.Table.from_pylist(rows, _PROVED)

    own = leaves.withColumn("segment", F.floor(F.col("place") / SEGMENT)).groupBy("tree", "segment")
    return own.cogroup(at.withColumnRenamed("place", "segment").groupBy("tree", "segment")).applyInArrow(run, _PROOF)


def manifest(docs: DataFrame, keep_proofs: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """Per row of docs its leaf, subroot, root, proof and the root folded from its tampered leaf, if crc32 of its doc_id is divisible by 3, or its own; and the records, from the leaves up.

    Tampering lower-cases A-Z of the text. Without keep_proofs the proofs, FAN - 1 digests a level, are hashed only.
    """
    spark = docs.sparkSession
    doc_id, other = F.col("doc_id").cast("bigint"), F.translate("text", UPPER, LOWER)
    fields = [doc_id, *map(F.col, ("source", "lang", "n_chars"))]
    hit = F.crc32(doc_id.cast("string")) % 3 == 0
    rows = docs.select(doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(*fields, F.col("text")).alias("digest"), F.when(hit, leaf(*fields, other)).alias("changed"))
    lines, parts = placed(rows, "lang", ["doc_id", "digest"])
    parts = _written(parts)
    # the tree of a language is numbered by its place among the languages
    named, shifts = placed(parts.groupBy("lang").agg(F.max("n").alias("rows")).withColumn("top", F.lit(0)), "top", ["lang"])
    langs = named.join(shifts.drop("top"), "_task").select("lang", (F.col("_line") + F.col("_shift")).alias("tree"), F.col("n").alias("n_trees"))
    parts = parts.join(langs, parts["lang"].eqNullSafe(langs["lang"])).select(parts["lang"].alias("_lang"), F.col("_task").alias("_of"), "_shift", "n", "tree")
    leaves = _written(lines.join(parts, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("_task") == F.col("_of"))).select("doc_id", "digest", "changed", "tree", "n", (F.col("_line") + F.col("_shift")).alias("place")))
    if leaves.isEmpty():
        return spark.createDataFrame([], _PROOF), []
    low = build(leaves)
    subroots = low[-1].select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.lit(low[-1].count()).cast("bigint").alias("n"), "digest")
    high = build(subroots)
    root = high[-1].first()["digest"]
    at = high[-1].select("tree", "place", "digest", F.expr(f"CAST(array() AS {_STEPS}) AS steps"))
    for records in reversed(high):
        at = _children(at, records)
    at = _written(at.select(F.col("place").alias("tree"), F.lit(0).cast("bigint").alias("place"), "digest", "steps"))
    tops = at.select("tree", F.col("digest").alias("subroot"))
    for records in reversed(low[1:]):
        at = _children(at, records)
    at = _with_records(at, low[0]).join(tops, "tree").withColumn("root", F.lit(root))
    return _proved(leaves, at, keep_proofs), [*low, *high]


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and whether that is the root."""
    return manifest(docs, False)[0].drop("proof").withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD_SQL = "coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
_LEAF_SQL = "sha256(" + " || ".join(_FIELD_SQL.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: crc32 of decimal digits, bit by bit; recursion builds both trees and folds the paths.
_CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
SQL = f"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF_SQL.format(text="text")} AS leaf, CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_LEAF_SQL.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM l),
low AS (SELECT tree, 0 AS h, i, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM p
  UNION ALL SELECT tree, h, i, d, count(*) OVER (PARTITION BY tree) FROM (SELECT tree, h + 1 AS h, i // 8 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM low WHERE n > 1 GROUP BY ALL)),
sub AS (SELECT tree, d FROM low WHERE n = 1),
high AS (SELECT 0 AS tree, 100 AS h, tree - 1 AS i, d, count(*) OVER () AS n FROM sub
  UNION ALL SELECT tree, h, i, d, count(*) OVER () FROM (SELECT tree, h + 1 AS h, i // 8 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM high WHERE n > 1 GROUP BY ALL)),
root AS (SELECT d AS root FROM high WHERE n = 1),
top AS (SELECT tree, max(h) AS h FROM low GROUP BY 1),
runs AS (SELECT tree, h, i // 8 AS up, list(d ORDER BY i) AS ds FROM low WHERE n > 1 GROUP BY ALL UNION ALL SELECT 0, h, i // 8, list(d ORDER BY i) FROM high WHERE n > 1 GROUP BY ALL),
walk AS (SELECT r, tree, 0 AS h, i, coalesce(changed, leaf) AS d, '' AS proof, false AS over FROM p
  UNION ALL SELECT r, CASE WHEN jump THEN 0 ELSE w.tree END, CASE WHEN jump THEN 100 WHEN ds IS NULL THEN w.h ELSE w.h + 1 END, CASE WHEN jump THEN w.tree - 1 WHEN ds IS NULL THEN w.i ELSE w.i // 8 END,
    CASE WHEN ds IS NULL THEN d ELSE sha256(array_to_string(ds[:w.i % 8] || [d] || ds[w.i % 8 + 2:], '')) END, CASE WHEN ds IS NULL THEN proof ELSE proof || array_to_string(ds[:w.i % 8] || ds[w.i % 8 + 2:], '') END, ds IS NULL AND NOT jump
  FROM (SELECT walk.*, ds, ds IS NULL AND walk.tree > 0 AS jump FROM walk LEFT JOIN runs ON runs.tree = walk.tree AND runs.h = walk.h AND runs.up = walk.i // 8 WHERE NOT over) w)
SELECT doc_id, leaf, sub.d AS subroot, root, sha256(proof) AS proof_sha256, walk.d AS folded_root, walk.d = root AS verified
FROM p JOIN sub USING (tree) JOIN (SELECT * FROM walk WHERE over) walk ON walk.r = p.r, root"""
