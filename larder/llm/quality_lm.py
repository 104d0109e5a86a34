"""Quality by an interpolated modified Kneser-Ney model over words, trained on trusted text.

Words are what stands between spaces, whole and unfolded, told apart by 64-bit hashes. Texts lie in blocks. Trusted
blocks send the shards of the n-grams' hashes what they count, and are told which n-grams are theirs to count; so
trigrams, then bigrams, then words get their counts and contexts, in a table in buckets that grows with the corpus; none
goes to the driver. Then every block asks the shards for each of its n-grams once, and sums the logarithms by document. All
messages are sorted hashes and numbers, packed. Texts are scored in rounds, each a part of them; its blocks and messages
go before the next round begins, so that the disk holds the counts and the messages of one round. Below the unigrams, a word unknown to the counts has
the probability of its spelling: an interpolated modified Kneser-Ney model of byte classes (SYMBOLS ** ORDER
numbers at most, 21 MB), which is the base of the word model, as word counts have none for new words.

No text is scored by counts of its own: trusted texts fall into two folds by a hash of the text, and each text is
scored by the word counts of the other fold. Perplexity is by byte. A document is kept when its perplexity lies
between two quantiles of its language's trusted documents.

Defined cases: null and empty texts have no perplexity and aren't kept; a null language is the empty string; a
language with fewer than MIN_TRUSTED trusted documents takes the quantiles of all; without trusted text the
model is uniform and all texts are kept; repeated rows are scored alike; extra columns are ignored. Results are
exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Scratch, cut_lineage, text_slices, utf8
from larder.llm.suffix_dedup import _packed, _packed_steps, _ramp, _unpacked, _unpacked_steps

ORDER, SYMBOLS = 4, 48
#: Words in the n-grams that are counted and joined.
WORD_ORDER = 3
LOW, HIGH = 0.001, 0.995
#: A document is only rejected beyond the quantiles by this factor; texts of few symbols vary more.
SLACK = 1.02
MIN_TRUSTED = 30


class Sizes(NamedTuple):
    """Text bytes of a block, whose n-grams are asked for together, and of a shard of the count tables; text bytes from which there is another round of scoring, and the most rounds."""

    block: int = 4_000_000
    shard: int = 16_000_000
    round: int = 12_000_000
    rounds: int = 12


#: Rounds in which shards are sent the n-grams of trusted texts, by their number of words.
PARTS = {3: 2, 2: 2, 1: 1}
MOST_BUCKETS = 10_000


def _classes() -> np.ndarray:
    """The symbol class of each byte; class 0 is the line end, which also precedes every text."""
    out = np.full(256, 39, np.uint8)  # further ASCII
    out[[10, 13]] = 0
    out[[9, 11, 12, 32]] = 1
    out[65:91] = 2
    out[48:58] = 3
    for k, marks in enumerate((b".", b",", b"!", b"?", b":;", b"\"'-()", b"|", b"#$%&*@")):
        out[list(marks)] = 4 + k
    out[97:123] = np.arange(12, 38)
    out[0xC0:256] = 38
    out[0xC3] = 47  # the lead byte of Western European letters
    out[0x80:0xC0] = 40 + np.arange(64) % 7
    return out


CLASS = _classes()


def symbol_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER-gram code that ends at each byte of texts that lie end to end."""
    pad = ORDER - 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + pad * doc
    padded = np.zeros(len(data) + pad * len(offsets), np.uint8)
    padded[at + pad] = CLASS[data]
    code = np.zeros(len(padded) - pad, np.int32)  # also of the places between texts
    for k in range(ORDER):
        code = code * np.int32(SYMBOLS) + padded[k : len(code) + k]
    return code[at]


def gram_counts(texts: DataFrame) -> DataFrame:
    """(code, c): how often each ORDER-gram occurs in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for b in batches:
            for i, j in text_slices(b.column(0)):
                codes, counts = np.unique(symbol_codes(*utf8(b.column(0).slice(i, j - i))), return_counts=True)
                total[codes] += counts
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 50_000):
            part = seen[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["code", "c"])

    return texts.select("text").mapInArrow(run, "code bigint, c bigint").groupBy("code").agg(F.sum("c").alias("c"))


def discounts(grams: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ of a level from its counts of counts."""
    row = grams.agg(*(F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, 5))).first()
    return _discounts(*(row[f"n{k}"] for k in range(1, 5)))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    bound = lambda d, k: min(max(d, 0.05), k - 0.05)
    return bound(1 - 2 * y * n2 / n1, 1), bound(2 - 3 * y * n3 / n2, 2), bound(3 - 4 * y * n4 / n3, 3)


def _discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def levels(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: (code, p) of the n-grams met and (ctx, gamma) of their contexts."""
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        tables.append(cut_lineage(tables[-1].groupBy((F.col("code") % SYMBOLS**order).alias("code")).agg(F.count("*").alias("c"))))
    out: list[tuple[DataFrame, DataFrame]] = []
    for order, grams in enumerate(reversed(tables), 1):
        d = discounts(grams)
        rows = grams.select("code", "c", F.floor(F.col("code") / SYMBOLS).alias("ctx"), (F.col("code") % SYMBOLS ** (order - 1)).alias("suffix"), _discount(F.col("c"), d).alias("d"))
        contexts = cut_lineage(rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("held")).select("ctx", "total", (F.col("held") / F.col("total")).alias("gamma")))
        rows = rows.join(contexts, "ctx")
        if order == 1:
            rows = rows.withColumn("lower", F.lit(1.0 / SYMBOLS))
        else:
            rows = rows.join(out[-1][0].select(F.col("code").alias("suffix"), F.col("p").alias("lower")), "suffix")
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("lower")
        out.append((cut_lineage(rows.select("code", p.alias("p"))), contexts.select("ctx", "gamma")))
    return out


def train(trusted: DataFrame) -> np.ndarray:
    """The spelling model: log probabilities of all SYMBOLS ** ORDER n-grams, of a size that doesn't depend on the corpus."""
    table = np.full(1, 1.0 / SYMBOLS)
    for order, (grams, contexts) in enumerate(levels(cut_lineage(gram_counts(trusted))), 1):
        gamma = np.ones(SYMBOLS ** (order - 1))
        seen = contexts.toPandas()  # at most SYMBOLS ** (order - 1) rows
        gamma[seen["ctx"].to_numpy(np.int64)] = seen["gamma"].to_numpy(float)
        lower = table if order > 1 else np.full(SYMBOLS, 1.0 / SYMBOLS)
        suffixes = np.tile(lower.reshape(-1), SYMBOLS) if order > 1 else lower
        table = suffixes * np.repeat(gamma, SYMBOLS)
        met = grams.toPandas()  # at most SYMBOLS ** order rows
        table[met["code"].to_numpy(np.int64)] = met["p"].to_numpy(float)
    return np.log(table).astype(np.float32)


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A random number for each byte, and the base of the words' hashes with its inverse modulo 2 ** 64.
_BYTES = np.random.default_rng(10).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next slice."""
    if not _POWERS or len(_POWERS[-1][0]) < n:
        both = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = [(both[0], both[1])]
    return _POWERS[-1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and hash of each word of texts that lie end to end."""
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:n]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64)))
    hashes = _mix((sums[ends] - sums[starts]) * down[starts])
    return np.searchsorted(offsets, starts, side="right") - 1, starts, hashes


def word_grams(data: np.ndarray, offsets: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Text number, start and the last WORD_ORDER words at each word; a hash's lowest bit is the fold, 0 and 1 stand before a text."""
    doc, starts, w = words_of(data, offsets)
    fold = folds[doc].astype(np.uint64)
    w = (w & ~np.uint64(1)) | fold
    out = [w]
    for k in range(1, WORD_ORDER):
        back = np.concatenate((np.zeros(min(k, len(w)), np.uint64), w[:-k]))
        same = np.concatenate((np.full(min(k, len(w)), -1), doc[:-k])) == doc
        out.insert(0, np.where(same, back, fold))
    return doc, starts, out


def _text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    whole = data.tobytes()
    return np.array([xxhash.xxh64_intdigest(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)


def word_counts(texts: DataFrame) -> DataFrame:
    """The trusted texts in blocks, from which ``perplexities`` makes the counts of their word trigrams, by fold and shard by shard."""
    return cut_lineage(_blocks(texts.select(F.lit(0).alias("doc_id"), F.lit("").alias("lang"), "text"), Sizes().block))


_BLOCK = "block bigint, ids array<{}>, langs array<string>, sizes array<bigint>, data binary, n bigint"
_SENT = "shard bigint, block bigint, keys binary, columns binary"
_SUMMED = "shard bigint, block bigint, n int, keys binary, columns binary, met array<bigint>"
_ASKED = "shard bigint, block bigint, " + ", ".join(f"k{n} binary" for n in range(1, WORD_ORDER + 1))
_REPLY = "shard bigint, block bigint, " + ", ".join(f"r{n} binary" for n in range(1, WORD_ORDER + 1))
#: What is summed of an n-gram: how often it is counted; as a context (not of trigrams) the counts of what follows: their total and how many are 1, 2 and more.
_COLUMNS = {3: 1, 2: 5, 1: 5}


def _blocks(docs: DataFrame, size: int, turn: int = 0) -> DataFrame:
    """Rows of whole texts, about ``size`` bytes together, end to end; to be written once, so that a block keeps its number, of which ``turn`` is part."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = (turn << 52) + (TaskContext.get().partitionId() << 32)
        for b in batches:
            for lo, hi in text_slices(b.column("text"), size):
                data, offsets = utf8(b.column("text").slice(lo, hi - lo))
                lists = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), b.column(c).slice(lo, hi - lo)) for c in ("doc_id", "lang")]
                yield pa.RecordBatch.from_arrays([pa.array([k]), *lists, pa.array([np.diff(offsets)], pa.list_(pa.int64())), pa.array([_packed(data)], pa.binary()), pa.array([len(data)])], ["block", "ids", "langs", "sizes", "data", "n"])
                k += 1

    lean = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    return lean.mapInArrow(run, _BLOCK.format(kind))


def _turns(docs: DataFrame, turns: int) -> list[DataFrame]:
    """docs in so many parts, by a hash."""
    return [docs] if turns == 1 else [docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(turns)) == k) for k in range(turns)]


def _rounds(n: int, sizes: Sizes) -> int:
    return max(1, min(sizes.rounds, -(-n // sizes.round)))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """As np.unique, which for 64-bit numbers in no order takes many times as long."""
    return (keys := np.sort(keys))[_heads(keys)]


def _heads(keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    out[1:] = keys[1:] != keys[:-1]
    return out


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and which of them is at each place."""
    order = np.argsort(keys)
    head = _heads(keys[order])
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(head) - 1
    return keys[order[head]], order[head], of


def _grams_of(t: pa.Table, other: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Data and offsets of the one block in t; text number, start and words of its trigrams, as the other fold or their own has them."""
    data = _unpacked(t.column("data")[0].as_py())
    offsets = np.concatenate(([0], np.cumsum(t.column("sizes")[0].values.to_numpy(zero_copy_only=False)))).astype(np.int64)
    return data, offsets, *word_grams(data, offsets, np.uint64(other) ^ (_text_keys(data, offsets) >> np.uint64(63)))


def _texts(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, sizes in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, offsets = _unpacked(blob), np.concatenate(([0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False)))).astype(np.int64)
                rows = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([rows.cast(pa.string())], ["text"])

    return blocks.select("data", "sizes").mapInArrow(run, "text string")


def _keys(words: list[np.ndarray]) -> np.ndarray:
    """A hash of n-grams; its lowest bit is the fold."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = _mix(h + w)
    return (h & ~np.uint64(1)) | (words[-1] & np.uint64(1))


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of sorted keys begins and ends; a shard has a range of the keys."""
    edges = np.array([min(-(-(k << 64) // shards), (1 << 64) - 1) for k in range(shards)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _packed_columns(values: np.ndarray) -> bytes:
    """64-bit values, their first bytes first, then their second ones, and so on."""
    return _packed(np.ascontiguousarray(values).reshape(-1).view("u1").reshape(-1, 8).T)


def _unpacked_columns(blob: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(_unpacked(blob).reshape(8, -1).T).view(kind).ravel()


def _asked(blocks: DataFrame, shards: int) -> DataFrame:
    """The n-grams of each block, once each, for the shards that have their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(i, 1)])
                grams = _grams_of(t)[4]
                # a context that no trigram ends with stands at the beginning of a text
                keys = [_distinct(np.concatenate([_keys(x) for x in own])) for own in ((grams[2:], grams[1:2]), (grams[1:], grams[:2]), (grams,))]
                cuts = [_cuts(k, shards) for k in keys]
                parts = [[_packed_steps(k[x:y].view(np.int64)) for x, y in zip(c, c[1:], strict=False)] for k, c in zip(keys, cuts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int64()), pa.array([t.column("block")[0].as_py()] * shards, pa.int64()), *(pa.array(x, pa.binary()) for x in parts)], ["shard", "block", "k1", "k2", "k3"])

    return blocks.select("block", "sizes", "data").mapInArrow(run, _ASKED)


def _sent(block: int, keys: np.ndarray, columns: np.ndarray, shards: int, part: int, parts: int) -> pa.Table:
    """Sorted keys and their columns, packed by shard; of the shards only one part of all parts."""
    cuts = _cuts(keys, shards)
    at = [(k, slice(cuts[k], cuts[k + 1])) for k in np.flatnonzero(np.diff(cuts)) if k % parts == part]
    return pa.table({"shard": pa.array([k for k, _ in at], pa.int64()), "block": pa.array([block] * len(at), pa.int64()), "keys": pa.array([_packed_steps(keys[own].view(np.int64)) for _, own in at], pa.binary()), "columns": pa.array([_packed_columns(columns[:, own]) for _, own in at], pa.binary())})


def _summed(sent: DataFrame, n: int) -> DataFrame:
    """What the blocks sent of n-grams, summed by shard (rows without block; ``met`` has, by fold, how many n-grams are counted 1, 2, 3, 4 times and at all, and the sum of counts); for each block, twice the sum of its n-grams' counts, plus one in one block of those that have them."""

    def run(t: pa.Table) -> pa.Table:
        own = [(x["block"], _unpacked_steps(x["keys"]).view(np.uint64), _unpacked_columns(x["columns"], "<i8")) for x in t.sort_by("block").to_pylist()]
        shard, every = t.column("shard")[0].as_py(), np.concatenate([k for _, k, _ in own])
        order = np.argsort(every)
        first = _heads(every[order])
        columns = np.add.reduceat(np.concatenate([c.reshape(_COLUMNS[n], -1) for _, _, c in own], 1)[:, order], np.flatnonzero(first), axis=1)
        keys, c = every[order[first]], columns[0]
        met = [int(x) for f in (0, 1) for own_c in [c[(keys & np.uint64(1)) == f]] for x in (*((own_c == k).sum() for k in range(1, 5)), (own_c > 0).sum(), own_c.sum())]
        told = np.empty(len(every), np.int64)
        told[order] = 2 * c[np.cumsum(first) - 1] + first
        rows = [{"shard": shard, "block": None, "n": n, "keys": _packed_steps(keys.view(np.int64)), "columns": _packed_columns(columns), "met": met}]
        if n > 1:
            rows += [{"shard": shard, "block": b, "n": n, "columns": _packed_columns(x)} for (b, _, _), x in zip(own, np.split(told, np.cumsum([len(k) for _, k, _ in own])[:-1]), strict=True)]
        return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("columns", pa.binary()), ("met", pa.list_(pa.int64()))]))

    return sent.groupBy("shard").applyInArrow(run, _SUMMED)


def _added(counted: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of n-grams of which ``counted`` occur once each, and of ``contexts`` that are followed by something counted so often; also where each is in both together."""
    every, first, of = _grouped(np.concatenate([counted, contexts]))
    ctx, sums = of[len(counted) :], lambda at, *weights: np.bincount(at, *weights, minlength=len(every))
    followed = [ctx[np.minimum(counts, 3) == k] for k in (1, 2, 3)]
    out = np.stack([sums(of[: len(counted)]), sums(ctx, counts), *map(sums, followed)])
    return every, out.astype(np.int64), first


def _lower(trusted: DataFrame, replies: DataFrame, n: int, shards: int, part: int) -> DataFrame:
    """The n-grams that end or begin those of n + 1 words, of which each is counted by one block that has it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _sent(0, np.zeros(0, np.uint64), np.zeros((5, 0), np.int64), shards, 0, 1)
        words = _grams_of(left, other=False)[4]
        own = _grouped(_keys(words))[1]
        words = [w[own] for w in words]
        right = right.sort_by("shard")
        for order in (3, 2):
            own = right.filter(pc.equal(right.column("n"), order)).column("columns").to_pylist()
            told = np.concatenate([np.zeros(0, "<i8"), *(_unpacked_columns(x, "<i8") for x in own)])
            new = (told % 2 == 1) & (told > 1)
            words, counts = [w[new] for w in words], told[new] // 2
            every, out, first = _added(_keys(words[1:]), _keys(words[:-1]), counts)
            if order == n + 1:
                return _sent(left.column("block")[0].as_py(), every, out, shards, part, PARTS[n])
            words = [np.concatenate([a, b])[first] for a, b in zip(words[1:], words[:-1], strict=True)]
        raise AssertionError

    return trusted.select("block", "sizes", "data").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, _SENT)


def _counts(tables: Scratch, trusted: DataFrame, shards: int) -> tuple[DataFrame, dict[int, tuple[float, float, float]], dict[int, tuple[int, float]]]:
    """The summed columns of all n-grams, the discounts by order, and by fold the total and the held-back part of the words."""

    def counted(part: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    t = pa.Table.from_batches([b.slice(i, 1)])
                    keys, counts = np.unique(_keys(_grams_of(t, other=False)[4]), return_counts=True)
                    yield from _sent(t.column("block")[0].as_py(), keys, counts[None, :].astype(np.int64), shards, part, PARTS[3]).to_batches()

        return trusted.select("block", "sizes", "data").mapInArrow(run, _SENT)

    for n in (3, 2, 1):
        told = table.filter("block IS NOT NULL").select("shard", "block", "n", "columns") if n < 3 else None
        for part in range(PARTS[n]):
            table = tables.add("counts", _summed(counted(part) if told is None else _lower(trusted, told, n, shards, part), n), "shard", min(shards, MOST_BUCKETS))
    every = table.filter("block IS NULL")
    sums = {r["n"]: r for r in every.groupBy("n").agg(*(F.coalesce(F.sum(F.col("met")[k]), F.lit(0)).alias(f"m{k}") for k in range(12))).collect()}  # three rows
    met = {n: [sums[n][f"m{k}"] if n in sums else 0 for k in range(12)] for n in _COLUMNS}
    d = {n: _discounts(*(m[k] + m[k + 6] for k in range(4))) for n, m in met.items()}
    folds = {}
    for f in (0, 1):
        n1, n2, _, _, n, total = met[1][6 * f : 6 * f + 6]
        folds[f] = total, d[1][0] * n1 + d[1][1] * n2 + d[1][2] * (n - n1 - n2)
    return every.select("shard", "n", "keys", "columns"), d, folds


def _replies(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """For each of the n-grams that a block asks a shard for, in that order, the columns of it, one column after the other."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = {x["n"]: (_unpacked_steps(x["keys"]).view(np.uint64), _unpacked_columns(x["columns"], "<i8").reshape(_COLUMNS[x["n"]], -1)) for x in right.to_pylist()}
        rows = []
        for a in left.to_pylist():
            row = {"shard": a["shard"], "block": a["block"]}
            for n, m in _COLUMNS.items():
                own = _unpacked_steps(a[f"k{n}"]).view(np.uint64)
                out = np.zeros((m, len(own)), np.int64)
                if n in tables:
                    keys, columns = tables[n]
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    met = keys[at] == own
                    out[:, met] = columns[:, at[met]]
                row[f"r{n}"] = _packed_columns(out)
            rows.append(row)
        return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int64()), ("block", pa.int64()), *((f"r{n}", pa.binary()) for n in range(1, WORD_ORDER + 1))]))

    return asked.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(run, _REPLY)


def _scored(blocks: DataFrame, replies: DataFrame, log_p: Broadcast, d: dict[int, tuple[float, float, float]], folds: dict[int, tuple[int, float]]) -> DataFrame:
    """doc_id, lang, n_symbols and logs, the log probability of the text, from what the shards told the blocks."""
    kind = dict(blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def met(c: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
        cut = np.array([0.0, *d[n]])[np.minimum(c, 3)]
        return np.where(c > 0, (c - cut) / np.maximum(total, 1), 0.0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": left.schema.field("ids").type.value_type and pa.array([], left.schema.field("ids").type.value_type), "lang": pa.array([], pa.string()), "n_symbols": pa.array([], pa.int64()), "logs": pa.array([], pa.float64())})
        data, offsets, doc, starts, grams = _grams_of(left)
        logs = np.zeros(len(offsets) - 1)
        first = offsets[1:].copy()
        np.minimum.at(first, doc, starts)
        letters = log_p.value[symbol_codes(data, offsets)].astype(np.float64)
        for k in np.flatnonzero(first > offsets[:-1]):  # spaces before the first word
            logs[k] = letters[offsets[k] : first[k]].sum()
        if len(doc):
            told = right.sort_by("shard")
            got = {n: np.concatenate([_unpacked_columns(x, "<i8").reshape(m, -1) for x in told.column(f"r{n}").to_pylist()], 1) for n, m in _COLUMNS.items()}
            k3, k2, c2, k1, c1 = _keys(grams), _keys(grams[1:]), _keys(grams[:2]), _keys(grams[2:]), _keys(grams[1:2])
            at3, at2, at1 = (_grouped(x)[2] for x in (k3, np.concatenate([k2, c2]), np.concatenate([k1, c1])))
            fold = (grams[2] & np.uint64(1)).astype(np.int64)
            total, held = (np.array([folds.get(f, (0, 0.0))[i] for f in (0, 1)], float)[fold] for i in (0, 1))
            own = met(got[1][0, at1[: len(k1)]], 1, total)
            base = np.where(total > 0, held / np.maximum(total, 1), 1.0)
            for n, at, ctx in ((2, at2[: len(k2)], at1[len(k1) :]), (3, at3, at2[len(k2) :])):
                total, held = got[n - 1][1, ctx], np.array(d[n]) @ got[n - 1][2:, ctx]
                gamma = np.where(total > 0, held / np.maximum(total, 1), 1.0)
                own, base = met(got[n][0, at], n, total) + gamma * own, gamma * base
            until = np.minimum(np.append(starts[1:], len(data)), offsets[doc + 1])
            lead = np.ones(len(data), bool)  # spaces before a first word belong to no word
            lead[_ramp(starts, until - starts)] = False
            sums = np.where(lead, 0.0, letters)
            spelt = np.add.reduceat(sums, starts)
            with np.errstate(divide="ignore"):
                word = np.where(own > 0, np.log(own + base * np.exp(spelt)), np.log(base) + spelt)
            heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            logs[doc[heads]] += np.add.reduceat(word, heads)
        return pa.table({"doc_id": left.column("ids")[0].values, "lang": left.column("langs")[0].values, "n_symbols": pa.array(np.diff(offsets)), "logs": pa.array(logs)})

    return blocks.select("block", "ids", "langs", "sizes", "data").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, f"doc_id {kind}, lang string, n_symbols bigint, logs double")


def perplexities(docs: DataFrame, log_p: np.ndarray, counts: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, lang, n_symbols and perplexity by byte of every document, by ``word_counts``."""
    with Scratch(docs.sparkSession) as tables:
        return _perplexities(tables, docs, _bytes(docs), log_p, counts, sizes)


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def _perplexities(tables: Scratch, docs: DataFrame, n: int, log_p: np.ndarray, trusted: DataFrame, sizes: Sizes, used: tuple[str, ...] = ()) -> DataFrame:
    """As ``perplexities``, of texts of n bytes in all; tables ``used`` go once the counts are made."""
    shards = max(1, -(-n // sizes.shard))
    counts, d, folds = _counts(tables, trusted, shards)
    for name in used:
        tables.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(log_p)  # SYMBOLS ** ORDER numbers, in a file as well: once for all rounds
    tables.kept.add("scored")
    for turn, part in enumerate(_turns(docs, _rounds(n, sizes))):
        blocks = tables.add("blocks", _blocks(part, sizes.block, turn))
        scored = tables.add("scored", _scored(blocks, _replies(_asked(blocks, shards), counts), shared, d, folds))
        tables.drop("blocks")
    shared.unpersist()
    perplexity = F.when(F.col("n_symbols") > 0, F.round(F.exp(-F.col("logs") / F.col("n_symbols")), 6))
    return scored.select("doc_id", "lang", "n_symbols", perplexity.alias("perplexity"))


def _quantiles() -> tuple[Column, Column]:
    return F.percentile_approx("perplexity", LOW, 100_000).alias("low"), F.percentile_approx("perplexity", HIGH, 100_000).alias("high")


def judged(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """Every document with its perplexity, its language's quantiles, and whether it is kept."""
    ids = trusted_ids.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    n, sizes = _bytes(docs), Sizes()
    with Scratch(docs.sparkSession) as tables:
        for turn, part in enumerate(_turns(docs, -(-_rounds(n, sizes) // 6))):
            own = _blocks(part.join(ids.hint("merge"), "doc_id", "left_semi"), sizes.block, turn)
            trusted = tables.add("trusted", own, "block", min(max(1, -(-n // sizes.block)), MOST_BUCKETS))
        scored = _perplexities(tables, docs, n, train(_texts(trusted)), trusted, sizes, ("trusted",))
    model = scored.join(ids, "doc_id", "left_semi").filter("perplexity IS NOT NULL")
    by_lang = cut_lineage(model.groupBy("lang").agg(*_quantiles(), F.count("*").alias("n")).filter(F.col("n") >= MIN_TRUSTED).drop("n"))
    overall = model.agg(*_quantiles()).first()
    rows = scored.join(by_lang, "lang", "left")
    low = F.coalesce("low", F.lit(overall["low"] if overall["low"] is not None else 0.0))
    high = F.coalesce("high", F.lit(overall["high"] if overall["high"] is not None else math.inf))
    slack = F.lit(SLACK) + 2.0 / F.sqrt(F.greatest(F.col("n_symbols"), F.lit(1)).cast("double"))
    kept = F.coalesce(F.col("perplexity").between(low / slack, high * slack), F.lit(False))
    return rows.select("doc_id", "lang", "n_symbols", "perplexity", low.alias("low"), high.alias("high"), kept.alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that labels call good and none call bad."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
