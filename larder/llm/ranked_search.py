"""Ranked lexical search with geometric blocks of posting lists.

The stated items are taken in blocks of ITEM_BYTES of text, so that what is broadcast (their terms and weights) has a
bound. For each block of items:

1. All documents are read once; of each, its length and the counts of the items' terms are written (``forward``).
2. Those counts give document frequencies, lengths and thereby integer impacts. Documents are clustered by the cosine
   of their weighted impacts, CLUSTER at a time; within a cluster a term's postings are one block of its list, with the
   coordinatewise maximum of its documents' impacts, over the terms that items ask together with it (``index``).
3. Each task goes through its clusters with the ten best so far of every item. The maxima bound the score of every
   document of a block from above; a block is skipped only if that bound is under the tenth score, else its documents
   are scored in full. The tenths of all tasks are ranked.

Exact: the bounds are sums of the same integers as the scores. Items of more than WIDE terms are bounded by the maxima
of whole clusters, since coordinates of all pairs of their terms would take the square.

Defined cases: a null text has no terms; an item without terms, or whose terms no document has, has no rows; equal scores
go by ascending doc_id, null ids last; repeated documents and repeated items count as often as they occur; very long
texts are read whole by one task; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import shared_dir, text_slices

#: Text bytes of the items that are searched at once.
ITEM_BYTES = 64_000
#: Text bytes whose documents are clustered together, and documents of a cluster.
SLICE, CLUSTER = 4_000_000, 128
#: Distinct terms from which an item is bounded by clusters rather than blocks.
WIDE = 256
#: Saturation and share of the length in the impact of a term, in the integer form of the contract.
LENGTH_SHARE = 75
LAST = np.iinfo(np.int64).max

_FORWARD = "ids array<bigint>, lengths array<bigint>, sizes binary, terms binary, counts binary, n_docs bigint, n_terms bigint"
_INDEX = "ids array<bigint>, sizes binary, terms binary, impacts binary, block_terms binary, block_sizes binary, block_docs binary, maxima binary"


def _alphabet() -> bytes:
    """Byte by byte: digits, letters (lower-cased) and all beyond ASCII stay, the others part terms."""
    keep = {b for b in range(256) if b >= 0x80 or chr(b).isalnum()}
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in keep else 0x20 for b in range(256))


_LETTERS = _alphabet()


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_LETTERS).split() if text else []


def _z(name: str, values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, name).tobytes(), 1)


def _unz(name: str, blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), name)


class Items(NamedTuple):
    """Items of one block: per item its distinct term numbers and how often it has each; per term the terms asked with it."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    beside: list[np.ndarray]


def asked(texts: list[str | None]) -> Items:
    counts = [Counter(terms_of(t)) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    terms = [np.array(sorted(vocabulary[t] for t in c), np.int64) for c in counts]
    names = list(vocabulary)
    times = [np.array([c[names[t]] for t in own], np.int64) for c, own in zip(counts, terms, strict=True)]
    beside: list[set[int]] = [set() for _ in vocabulary]
    for own in terms:
        if len(own) <= WIDE:
            for t in own.tolist():
                beside[t].update(own.tolist())
    return Items(vocabulary, terms, times, [np.array(sorted(x), np.int64) for x in beside])


# ---- the index ----


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Slices of documents (id, text) that have a term: their lengths and the counts of the vocabulary's terms; n_docs and n_terms count them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for lo, hi in text_slices(b.column("text"), SLICE):
                ids, lengths, sizes, terms, counts = [], [], [], [], []
                for key, text in zip(b.column("id")[lo:hi].to_pylist(), b.column("text")[lo:hi].to_pylist(), strict=True):
                    if not (own := terms_of(text)):
                        continue
                    found = Counter(own)
                    both = [(known[t], k) for t, k in found.items() if t in known]
                    ids.append(key)
                    lengths.append(len(own))
                    sizes.append(len(both))
                    terms += [t for t, _ in both]
                    counts += [k for _, k in both]
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([_z("<u4", sizes)]), pa.array([_z("<u4", terms)]), pa.array([_z("<u4", counts)]), pa.array([len(ids)]), pa.array([sum(lengths)], pa.int64())], ["ids", "lengths", "sizes", "terms", "counts", "n_docs", "n_terms"])

    return _written(docs.mapInArrow(run, _FORWARD), _FORWARD)


def _written(df: DataFrame, schema: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/larder-tables/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def document_frequencies(slices: DataFrame, n: int) -> np.ndarray:
    """Documents that have each of the n terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for blob in b.column("terms").to_pylist():
                total += np.bincount(_unz("<u4", blob), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(n, np.int64)
    for term, df in slices.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():  # at most a row a term of the items
        out[term] = df
    return out


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(k) + 1))) for k in df], np.int64)


def impacts_of(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * n_docs // n_terms
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def _clusters(of: np.ndarray, terms: np.ndarray, values: np.ndarray, n_docs: int, n_terms: int) -> list[np.ndarray]:
    """Documents in groups of at most CLUSTER that are alike: each goes to the nearest of evenly spaced documents, by cosine."""
    centres = np.linspace(0, n_docs - 1, -(-n_docs // CLUSTER)).astype(np.int64)
    norm = np.sqrt(np.bincount(of, values.astype(np.float64) ** 2, n_docs))
    values = (values / np.maximum(norm, 1e-9)[of]).astype(np.float32)
    start = np.searchsorted(of, np.arange(n_docs + 1))

    def dense(docs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(docs), n_terms), np.float32)
        for i, d in enumerate(docs):
            out[i, terms[start[d] : start[d + 1]]] = values[start[d] : start[d + 1]]
        return out

    middle = dense(centres).T
    near = np.concatenate([dense(np.arange(a, min(a + 256, n_docs))) @ middle for a in range(0, n_docs, 256)])
    to = near.argmax(1)
    order = np.lexsort([-near[np.arange(n_docs), to], to])
    groups = np.split(order, np.flatnonzero(np.diff(to[order])) + 1)
    return [g[a : a + CLUSTER] for g in groups for a in range(0, len(g), CLUSTER)]


def index(slices: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each cluster of documents: their impacts, and for each term a block of its posting list with coordinatewise maxima over ``items.beside`` of the term."""
    shared = slices.sparkSession.sparkContext.broadcast((items.beside, weights))
    width = len(items.vocabulary)

    def rows(ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        beside, weight = shared.value
        has = sizes > 0
        ids, lengths, sizes = ids[has], lengths[has], sizes[has].astype(np.int64)
        if not len(ids):
            return
        of = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort([terms, of])
        terms, counts = terms[order].astype(np.int64), counts[order].astype(np.int64)
        impacts = impacts_of(counts, lengths[of], n_docs, n_terms)
        begin = np.cumsum(sizes) - sizes
        for group in _clusters(of, terms, impacts * weight[terms], len(ids), width):
            n = sizes[group]
            at = np.arange(n.sum()) + np.repeat(begin[group] - np.cumsum(n) + n, n)
            own, value, doc = terms[at], impacts[at], np.repeat(np.arange(len(group)), n)
            grid = np.zeros((len(group), width), np.int32)
            grid[doc, own] = value
            by_term = np.argsort(own, kind="stable")
            block, first = np.unique(own[by_term], return_index=True)
            lists = np.split(doc[by_term], first[1:])
            maxima = [grid[np.ix_(docs, beside[t])].max(0) for t, docs in zip(block, lists, strict=True)]
            yield {
                "ids": ids[group].tolist(), "sizes": _z("<u4", n), "terms": _z("<u4", own), "impacts": _z("<u4", value), "block_terms": _z("<u4", block),
                "block_sizes": _z("<u4", np.array([len(x) for x in lists])), "block_docs": _z("<u2", doc[by_term]), "maxima": _z("<u4", np.concatenate(maxima)),
            }

    schema = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("sizes", "terms", "impacts", "block_terms", "block_sizes", "block_docs", "maxima"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = {c: b.column(c)[i] for c in ("ids", "lengths", "sizes", "terms", "counts")}
                ids = x["ids"].values.fill_null(LAST).to_numpy(zero_copy_only=False)
                for row in rows(ids, x["lengths"].values.to_numpy(zero_copy_only=False), *(_unz("<u4", x[c].as_py()) for c in ("sizes", "terms", "counts"))):
                    yield pa.RecordBatch.from_pylist([row], schema)

    return _written(slices.select("ids", "lengths", "sizes", "terms", "counts").mapInArrow(run, _INDEX), _INDEX)


# ---- search ----


class Best:
    """The k best (score, id) of an item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document needs this score to enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort([ids, -scores])[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _search_cluster(row: dict, items: Items, weighted: list[np.ndarray], places: list[list[np.ndarray]], best: list[Best], seen: Counter) -> None:
    """Enter the documents of one cluster into the best of every item."""
    ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)
    n, terms, impacts = (_unz("<u4", row[c]).astype(np.int64) for c in ("sizes", "terms", "impacts"))
    grid = np.zeros((len(ids), len(items.vocabulary)), np.int64)
    grid[np.repeat(np.arange(len(ids)), n), terms] = impacts
    block, size = _unz("<u4", row["block_terms"]).astype(np.int64), _unz("<u4", row["block_sizes"]).astype(np.int64)
    docs, maxima = np.split(_unz("<u2", row["block_docs"]), np.cumsum(size)[:-1]), _unz("<u4", row["maxima"]).astype(np.int64)
    wide = np.array([len(items.beside[t]) for t in block])
    start = np.full(len(items.vocabulary), -1)
    start[block] = np.cumsum(wide) - wide
    number = np.full(len(items.vocabulary), -1)
    number[block] = np.arange(len(block))
    top = grid.max(0)
    for q, own in enumerate(items.terms):
        here = np.flatnonzero(start[own] >= 0)
        if not len(here):
            continue
        if len(own) > WIDE:
            bounds = np.full(len(here), int(top[own] @ weighted[q]))
        else:
            bounds = maxima[start[own[here]][:, None] + places[q][here]] @ weighted[q]
        open_ = here[bounds >= best[q].least]
        seen["blocks"] += len(here)
        seen["skipped"] += len(here) - len(open_)
        if len(open_):
            found = np.unique(np.concatenate([docs[k] for k in number[own[open_]]]))
            scores = grid[np.ix_(found, own)] @ weighted[q]
            good = scores >= best[q].least
            seen["scored"] += len(found)
            best[q].add(scores[good], ids[found[good]])


def _scan(clusters: DataFrame, items: Items, weights: np.ndarray, k: int) -> DataFrame:
    """item (its number), doc_id, score: the k best documents of each item in each task."""
    shared = clusters.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        weighted = [weight[t] * m for t, m in zip(own.terms, own.times, strict=True)]
        places = [np.array([np.searchsorted(own.beside[t], ts) for t in ts]).reshape(len(ts), len(ts)) if len(ts) <= WIDE else None for ts in own.terms]
        best, seen = [Best(k) for _ in own.terms], Counter()
        for b in batches:
            for row in b.to_pylist():
                _search_cluster(row, own, weighted, places, best, seen)
        number = np.repeat(np.arange(len(best)), [len(x.ids) for x in best])
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *(getattr(x, c) for x in best)]) for c in ("ids", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids, mask=ids == LAST), pa.array(scores)], ["item", "doc_id", "score"])

    return clusters.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def _search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """The results of one block of items, which is bounded by ITEM_BYTES or is one item."""
    rows = block.select("item_id", "text").collect()
    items = asked([r.text for r in rows])
    slices = forward(docs, items.vocabulary)
    n_docs, n_terms = slices.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weights = weights_of(document_frequencies(slices, len(items.vocabulary)), n_docs)
    found = _scan(index(slices, items, weights, n_docs, max(1, n_terms)), items, weights, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item bigint, item_id {dict(block.dtypes)['item_id']}")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """For each row of items (item_id, text): the k documents (doc_id, text) of the highest scores above 0, with rank and score."""
    docs = docs.selectExpr("CAST(doc_id AS bigint) AS id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    dealt = items.select("item_id", "text", size.alias("_size"))
    total = dealt.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    # rows in order of a hash, cut where their sizes add up to a block: the running sum is taken over hash ranges first, so no window holds all items
    ranges = max(1, total // ITEM_BYTES)
    dealt = dealt.withColumn("_range", F.pmod(F.xxhash64("item_id", "text"), F.lit(ranges)))
    before = Window.partitionBy("_range").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_part", F.floor(F.coalesce(F.sum("_size").over(before), F.lit(0)) / ITEM_BYTES)).drop("_size")
    blocks = dealt.groupBy("_range", "_part").count().drop("count").collect() if total else []  # a row a block
    found = [_search_block(docs, dealt.filter((F.col("_range") == r) & (F.col("_part") == p)), k) for r, p in sorted(blocks)]
    if not found:
        kind = dict(items.dtypes)["item_id"]
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: All scores, without an index.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*)::BIGINT AS n_all, sum(len(t))::BIGINT AS l_all FROM d WHERE len(t) > 0),
i AS (SELECT k, item_id, term, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS k, item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY 1),
s AS (SELECT k, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all))))::BIGINT AS score FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
