"""Repeated passages by longest-previous-factor arrays: every later copy of a long byte string goes, the first stays.

The factors are those of the suffixes of all texts, put in suffix order shard by shard. Where two texts share a string
of ``least`` bytes, both have the same least hash among its GRAM-byte strings; so a run of starts with one such hash (its
key) and the bytes that their strings cover make a piece, and all pieces of a key meet in one shard:

1. Texts are packed into blocks. Each block sends a 32-bit mark of each of its keys to the key's shard, and gets
   back which keys other texts have too.
2. The suffixes of the pieces with such keys are put in order, within the block, and a piece goes on only if one of its
   strings is new to the block: hot passages leave a block once, however many of its texts hold them. Keys that many
   blocks have go on string by string, dealt by the string, so that no shard gets all contexts of a frequent key.
   A set of blocks, one after the other, sends a shard one message: blocks and shards grow with the input, so a message
   of a single block would shrink until it is all overhead.
3. Within a shard the same is done for the pieces of FAN blocks at a time, in as many rounds as it takes. A round
   sends on most of its pieces, so FAN is what memory asks for, and one round does for some 100 GB.
4. The starts whose longest previous factor reaches ``least`` come back to their blocks, which cut the texts.

Blocks are written in buckets by set, so that neither reading of them shuffles texts; marks go once they are answered.

Exact: a hash only brings strings together, the order compares their bytes. (The 64-bit hash that leaves strings without
a partner out before sorting is equal wherever the strings are.)

Defined cases: a null text is an empty one; texts under ``least`` bytes lose nothing; rows with a null doc_id come after
all others; rows that share an id are not earlier than each other, so both keep what they share; strings that repeat only
within a row stay; repeated rows give repeated results; very long texts are one block, hashed by slices; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Scratch, text_slices, utf8
from larder.llm.shingles import mixed

#: Bytes of a string that counts as repeated.
LEAST = 50
#: Bytes of the strings whose least hash keys a piece.
GRAM = 16


class Sizes(NamedTuple):
    """Text bytes of a block and of a shard, shards of pieces to one of marks, blocks of a shard that meet at once, the blocks from which a key is dealt by string, and the blocks of a set."""

    block: int = 2_000_000
    shard: int = 32_000_000
    split: int = 16
    fan: int = 65_536
    hot: int = 16_384
    set: int = 16


LAST = np.iinfo(np.int64).max
_LETTER = np.random.default_rng(20240311).integers(0, 1 << 64, 256, np.uint64)
_ODD = 0x9E3779B97F4A7C15
_SLICE = 1 << 17
#: Of zstandard; level 1 takes 14 % more for texts; level 9 takes 8 % less, but much more CPU time.
_LEVEL = 3
_BLOCK = "set bigint, block bigint, ids array<bigint>, sizes array<bigint>, data binary, n bigint"
_ROW = "kind int, shard bigint, set bigint, of binary, at binary, size binary, id binary, data binary"


def _packed(data: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(data).tobytes(), _LEVEL)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), "u1")


def _packed_steps(values: np.ndarray) -> bytes:
    """64-bit numbers as the steps between them, their first bytes first, then their second ones, and so on; steps wrap."""
    steps = np.diff(values.astype("<i8"), prepend=np.int64(0))
    return _packed(steps.view("u1").reshape(-1, 8).T)


def _unpacked_steps(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unpacked(blob).reshape(8, -1).T).view("<i8").ravel())


def _ramp(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of starts[i], starts[i] + 1, ... sizes[i] of them, for each i in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


# ---- factors ----


def _earlier(docs: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each place of the suffix order, the common prefix with the nearest place before it that has a smaller doc; 0 once it is under least.

    lcp[i] is that of places i - 1 and i. Pointers jump over places that are no smaller, so a few rounds do.
    """
    at, common = np.arange(len(docs)) - 1, lcp.copy()
    todo = np.flatnonzero((common >= least) & (at >= 0))
    while len(todo := todo[docs[at[todo]] >= docs[todo]]):
        to = at[todo]
        common[todo], at[todo] = np.minimum(common[todo], common[to]), at[to]
        todo = todo[(common[todo] >= least) & (at[todo] >= 0)]
    return np.where((common >= least) & (at >= 0), common, 0)


def _suffix_order(words: np.ndarray, starts: np.ndarray, steps: list[int]) -> np.ndarray:
    """The places of the starts by their first bytes: sorted by the first word, then what is still equal by the next one."""
    order = np.argsort(words[starts])
    todo = np.arange(len(starts))
    w = words[starts[order]]
    for k in steps[1:]:
        equal = np.r_[False, w[1:] == w[:-1]]
        if k > steps[1]:
            equal &= np.r_[False, group[1:] == group[:-1]]
        tied = equal | np.r_[equal[1:], False]
        group = (np.cumsum(~equal) - 1)[tied]
        todo = todo[tied]
        if not len(todo):
            break
        own = order[todo]
        w = words[starts[own] + k]
        by = np.argsort(w)
        by = by[np.argsort(group[by], kind="stable")]
        order[todo], w = own[by], w[by]
    return order


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, docs: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For each start, the length of the longest string there, up to ``least``, that a smaller doc has at one of the starts; shorter ones count 0.

    From every start at least ``least`` bytes of data follow. The starts are put in suffix order by their first ``least``
    bytes; the previous and the next smaller doc in that order give the longest earlier match. Starts with equal strings,
    brought together by a hash and compared byte by byte, are put in order as one.
    """
    out = np.zeros(len(starts), np.int64)
    if not len(starts):
        return out
    words = np.ndarray(len(data) - 7, ">u8", data, strides=(1,)).astype(np.uint64)
    steps = [*range(0, least - 7, 8), *([least - 8] if least % 8 else [])]
    h = np.zeros(len(starts), np.uint64)
    for k in steps:
        h ^= h >> np.uint64(29)
        h *= np.uint64(_ODD + 2 * k)
        h += words[starts + k]
    order = np.argsort(h)
    h = h[order]
    first = np.r_[True, h[1:] != h[:-1]]
    heads = np.flatnonzero(first)
    # documents by their rank: a start mostly has that of the start before it
    runs = np.r_[True, docs[1:] != docs[:-1]]
    doc = np.unique(docs[runs], return_inverse=True)[1][np.cumsum(runs) - 1]
    sorted_doc = doc[order]
    low, high = np.minimum.reduceat(sorted_doc, heads), np.maximum.reduceat(sorted_doc, heads)
    some = np.repeat(low < high, np.diff(np.r_[heads, len(order)]))  # the others have no partner in another doc
    own, first, doc = order[some], first[some], sorted_doc[some]
    if not len(own):
        return out
    del h, order, some, sorted_doc
    at, differ = starts[own], np.zeros(len(own) - 1, bool)
    for k in steps:
        w = words[at + k]
        differ |= w[1:] != w[:-1]
    if (differ & ~first[1:]).any():  # unlike strings with one hash: each start is put in order by itself
        first = np.ones(len(own), bool)
    reps = at[first]
    by = _suffix_order(words, reps, steps)
    rank = np.empty(len(reps), np.int64)
    rank[by] = np.arange(len(reps))
    rank = rank[np.cumsum(first) - 1]
    place = np.argsort(rank * len(docs) + doc)
    sa, rank, reps = own[place], rank[place], reps[by]
    equal = np.ones(len(reps) - 1, bool)
    for k in steps:
        w = words[reps + k]
        equal &= w[1:] == w[:-1]
    lcp = np.where(np.r_[True, rank[1:] == rank[:-1]] | np.r_[False, equal][rank], least, 0)
    lcp[0] = 0
    doc = doc[place]
    before, after = _earlier(doc, lcp, least), _earlier(doc[::-1], np.r_[0, lcp[:0:-1]], least)[::-1]
    out[sa] = np.maximum(before, after)
    return out


# ---- blocks and their runs ----


def window_keys(data: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For each start of a ``least``-byte string, the least hash of the GRAM-byte strings in it."""
    n, span = max(0, len(data) - least + 1), least - GRAM + 1
    out = np.empty(n, np.uint64)
    for a in range(0, n, _SLICE):
        h = _LETTER[data[a : a + _SLICE + least - 1]]
        k = 1
        while k < GRAM:
            h, k = h[:-k] * np.uint64(pow(_ODD, k, 1 << 64)) + h[k:], 2 * k
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD)
        k = 1
        while 2 * k <= span:
            h, k = np.minimum(h[:-k], h[k:]), 2 * k
        out[a : a + _SLICE] = np.minimum(h[: len(h) - span + k], h[span - k :])[: n - a]
    return out


class Runs(NamedTuple):
    """Runs of starts with one key: the first start, how many, the row of the text, and shard << 32 | mark of the key."""

    start: np.ndarray
    n: np.ndarray
    row: np.ndarray
    code: np.ndarray


def _code(h: np.ndarray, shards: int) -> np.ndarray:
    h = mixed(h)
    return (h >> np.uint64(32)) % np.uint64(shards) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def runs_of(data: np.ndarray, sizes: np.ndarray, least: int, shards: int) -> Runs:
    keys, ends = window_keys(data, least), np.cumsum(sizes)
    begins, stops = ends - sizes, np.maximum(ends - least + 1, ends - sizes)
    change = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    change[begins[begins < len(keys)]] = True
    for a, b in zip(stops, ends, strict=True):  # strings don't cross texts
        change[a:b] = False
    start = np.flatnonzero(change)
    row = np.searchsorted(ends, start, "right")
    return Runs(start, np.minimum(np.r_[start[1:], len(data)], stops[row]) - start, row, _code(keys[start], shards))


def _blocks(docs: DataFrame, size: int, many: int) -> DataFrame:
    """Rows of whole texts, about ``size`` bytes together, end to end, in sets of up to ``many``; to be written once, so that a block keeps its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi in text_slices(b.column("text"), size):
                data, offsets = utf8(b.column("text").slice(lo, hi - lo))
                ids = b.column("id").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array([k - (k & 0xFFFFFFFF) % many]), pa.array([k]), pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids), pa.array([np.diff(offsets)], pa.list_(pa.int64())), pa.array([_packed(data)], pa.binary()), pa.array([len(data)])], ["set", "block", "ids", "sizes", "data", "n"])
                k += 1

    return docs.mapInArrow(run, _BLOCK)


def _block_of(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, sizes and ids (null: last) of the one block in t."""
    ids = t.column("ids")[0].values.fill_null(LAST).to_numpy(zero_copy_only=False)
    return _unpacked(t.column("data")[0].as_py()), t.column("sizes")[0].values.to_numpy(zero_copy_only=False), ids


# ---- marks: which keys do other texts have? ----

_MARKS = "shard bigint, set bigint, block bigint, marks binary, twice binary"
_BITS = "shard bigint, set bigint, block bigint, bits binary"


def _marks(blocks: DataFrame, least: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(i, 1)])
                data, sizes, ids = _block_of(t)
                r = runs_of(data, sizes, least, shards)
                if not len(r.code):
                    continue
                order = np.lexsort([ids[r.row], r.code])
                code, doc = r.code[order], ids[r.row][order]
                heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                lasts = np.r_[heads[1:], len(code)] - 1
                twice, code = doc[heads] != doc[lasts], code[heads]
                shard, at = np.unique(code >> np.uint64(32), return_index=True)
                spans = list(zip(at, [*at[1:], len(code)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), *(pa.array([t.column(c)[0].as_py()] * len(shard), pa.int64()) for c in ("set", "block")), pa.array([_packed_steps(code[x:y] & np.uint64(0xFFFFFFFF)) for x, y in spans], pa.binary()), pa.array([np.packbits(twice[x:y]).tobytes() for x, y in spans], pa.binary())], ["shard", "set", "block", "marks", "twice"])

    return blocks.select("set", "block", "ids", "sizes", "data").mapInArrow(run, _MARKS)


def _answered(marks: DataFrame, hot: int) -> DataFrame:
    """For each mark, in the order sent, two bits: another text has it; at least ``hot`` blocks have it."""

    def run(t: pa.Table) -> pa.Table:
        own = [_unpacked_steps(x).astype("<u4") for x in t.column("marks").to_pylist()]
        sizes = np.array([len(x) for x in own])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t.column("twice").to_pylist(), sizes, strict=True)]).astype(bool)
        every = np.concatenate(own)
        order = np.argsort(every)
        first = np.r_[True, every[order][1:] != every[order][:-1]]
        of, count = np.cumsum(first) - 1, np.diff(np.r_[np.flatnonzero(first), len(every)])
        also = np.bincount(of, weights=twice[order], minlength=len(count)) > 0
        bits = np.empty((len(every), 2), bool)
        bits[order] = np.stack([(count > 1) | also, count >= hot], 1)[of]
        parts = np.split(bits, np.cumsum(sizes)[:-1])
        return pa.table({"shard": t.column("shard"), "set": t.column("set"), "block": t.column("block"), "bits": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})

    return marks.groupBy("shard").applyInArrow(run, _BITS)


# ---- pieces ----


_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("set", pa.int64()), ("of", pa.binary()), ("at", pa.binary()), ("size", pa.binary()), ("id", pa.binary()), ("data", pa.binary())])
SPAN, PIECE = 0, 1


class Pieces(NamedTuple):
    """Pieces of texts, or spans: block less set, place in the block, and size; of pieces also the id of the text, and where they start in some data."""

    of: np.ndarray
    at: np.ndarray
    size: np.ndarray
    id: np.ndarray
    start: np.ndarray

    def take(self, which: np.ndarray) -> Pieces:
        return Pieces(*(x[which] for x in self))


def _message(kind: int, shard: int, at: int, p: Pieces, data: np.ndarray | None = None) -> dict:
    """A row of the set ``at``."""
    sent = {} if data is None else {"id": _packed_steps(p.id), "data": _packed(data[_ramp(p.start, p.size)])}
    return {"kind": kind, "shard": shard, "set": at, "of": _packed_steps(p.of), "at": _packed_steps(p.at), "size": _packed_steps(p.size), "id": None, "data": None} | sent


def _joined(starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that strings at these sorted starts cover: first bytes and sizes."""
    if not len(starts):
        return starts, starts
    new = np.r_[True, np.diff(starts) > least]
    first, last = starts[new], starts[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]
    return first, last + least - first


def _spans(of: np.ndarray, starts: np.ndarray, least: int) -> Pieces:
    """The runs that strings at these starts of these blocks cover, block by block."""
    order = np.lexsort([starts, of])
    of, starts = of[order], starts[order]
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
    found = [(of[a], *_joined(np.unique(starts[a:b]), least)) for a, b in zip(heads, [*heads[1:], len(of)], strict=False)]
    none = np.zeros(0, np.int64)
    at, size = (np.concatenate([none, *(x[k] for x in found)]) for k in (1, 2))
    return Pieces(np.repeat(of[heads], [len(x[1]) for x in found]), at, size, none, none)


def _pieces(blocks: DataFrame, bits: DataFrame, least: int, shards: int, split: int) -> DataFrame:
    """What the blocks of each set find by themselves (kind SPAN), and the pieces that the set sends on."""

    def dealt(code: np.ndarray) -> np.ndarray:
        return ((code >> np.uint64(32)) * np.uint64(split) + code % np.uint64(split)).astype(np.int64)

    def found(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, sent: dict[int, bytes], of: int) -> tuple[Pieces, Pieces, np.ndarray, np.ndarray]:
        """Of one block: its spans, its pieces, their shards and their bytes."""
        r = runs_of(data, sizes, least, shards)
        code, own = np.unique(r.code, return_inverse=True)
        shard, n = np.unique(code >> np.uint64(32), return_counts=True)
        told = np.concatenate([np.unpackbits(np.frombuffer(sent[int(s)], np.uint8), count=2 * k).reshape(-1, 2) for s, k in zip(shard, n, strict=True)]).astype(bool)[own]
        r, hot = Runs(*(x[told[:, 0]] for x in r)), told[told[:, 0], 1]
        starts, owner = _ramp(r.start, r.n), np.repeat(np.arange(len(r.n)), r.n)
        docs = ids[r.row][owner]
        old = longest_previous_factors(data, starts, docs, least) >= least
        open_ = np.bincount(owner[~old], minlength=len(r.n)) > 0
        cold, alone = open_ & ~hot, ~old & hot[owner]
        at = starts[alone]
        h = np.zeros(len(at), np.uint64)
        for k in range(least):
            h = h * np.uint64(_ODD) + _LETTER[data[at + k]]
        at, size = np.r_[r.start[cold], at], np.r_[r.n[cold] + least - 1, np.full(len(at), least)]
        p = Pieces(np.full(len(at), of), at, size, np.r_[ids[r.row][cold], docs[alone]], np.cumsum(size) - size)
        return _spans(np.full(int(old.sum()), of), starts[old], least), p, np.r_[dealt(r.code[cold]), dealt(_code(h, shards))], data[_ramp(at, size)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _ARROW.empty_table()
        sent: dict[int, dict[int, bytes]] = {}
        for b, s, x in zip(*(right.column(c).to_pylist() for c in ("block", "shard", "bits")), strict=True):
            sent.setdefault(b, {})[s] = x
        at, many = left.column("set")[0].as_py(), []
        for i in np.argsort(left.column("block").to_numpy()):
            t = left.slice(i, 1)
            if (b := t.column("block")[0].as_py()) in sent:
                many.append(found(*_block_of(t), sent[b], b - at))
        spans, pieces, shard, data = zip(*many, strict=True)
        begin = np.cumsum([0, *(len(x) for x in data)])
        pieces = [p._replace(start=p.start + x) for p, x in zip(pieces, begin[:-1], strict=True)]
        spans, pieces = (Pieces(*map(np.concatenate, zip(*x, strict=True))) for x in (spans, pieces))
        shard, data = np.concatenate(shard), np.concatenate(data)
        rows = [_message(SPAN, -1 - at % shards, at, spans)]
        order = np.argsort(shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
            rows.append(_message(PIECE, int(shard[own[0]]), at, pieces.take(own), data))
        return pa.Table.from_pylist(rows, _ARROW)

    return blocks.select("set", "block", "ids", "sizes", "data").groupBy("set").cogroup(bits.groupBy("set")).applyInArrow(run, _ROW)


def _met(rows: DataFrame, parts: int, least: int) -> DataFrame:
    """Pieces of one shard and of one of ``parts`` parts of the sets in suffix order: the starts that a smaller doc has there, and the pieces that go on if there are several parts."""

    def run(t: pa.Table) -> pa.Table:
        t = t.select(_ARROW.names)
        if t.column("kind")[0].as_py() == SPAN:
            return t
        rows = t.to_pylist()
        of, at, size, ids = ([_unpacked_steps(x[c]) for x in rows] for c in ("of", "at", "size", "id"))
        data = np.concatenate([_unpacked(x["data"]) for x in rows])
        row = np.repeat(np.arange(len(rows)), [len(x) for x in at])
        size = np.concatenate(size)
        p = Pieces(np.concatenate(of), np.concatenate(at), size, np.concatenate(ids), np.cumsum(size) - size)
        n = size - least + 1
        starts, owner = _ramp(p.start, n), np.repeat(np.arange(len(n)), n)
        old = longest_previous_factors(data, starts, p.id[owner], least) >= least
        own, place = owner[old], (starts - p.start[owner] + p.at[owner])[old]
        cut = np.searchsorted(row[own], np.arange(len(rows) + 1))
        out = [_message(SPAN, -1 - x["shard"], x["set"], _spans(p.of[own[a:b]], place[a:b], least)) for x, a, b in zip(rows, cut, cut[1:], strict=False) if b > a]
        if parts > 1:
            open_ = np.bincount(owner[~old], minlength=len(n)) > 0
            for i, x in enumerate(rows):
                on = np.flatnonzero(open_ & (row == i))
                if len(on):
                    out.append(_message(PIECE, x["shard"], x["set"], p.take(on), data))
        return pa.Table.from_pylist(out, _ARROW)

    return rows.withColumn("part", F.pmod(F.xxhash64("set"), F.lit(parts))).groupBy("shard", "part").applyInArrow(run, _ROW)


_OUT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,size:bigint>>, kept binary"


def _cut(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    def kept(t: pa.Table, at: np.ndarray, size: np.ndarray) -> pa.Table:
        """Of one block, by the spans found in it."""
        data, sizes, _ = _block_of(t)
        gone = np.zeros(len(data) + 1, np.int32)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + size, -1)
        gone = np.cumsum(gone[:-1]) > 0
        ends = np.cumsum(sizes)
        begins = ends - sizes
        head = np.zeros(len(gone) + 1, bool)
        head[begins], head[-1] = True, True
        edge = np.flatnonzero(gone & (head[:-1] | ~np.r_[False, gone[:-1]])) if len(gone) else ends[:0]
        stop = np.flatnonzero(gone & (head[1:] | ~np.r_[gone[1:], False])) + 1 if len(gone) else ends[:0]
        row = np.searchsorted(ends, edge, "right")
        offsets = np.searchsorted(row, np.arange(len(sizes) + 1))
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(edge - begins[row]), pa.array(stop - edge)], ["start", "size"]))
        rest = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(begins, ends, strict=True)]
        return pa.table({"doc_id": t.column("ids")[0].values, "n_bytes": pa.array(sizes), "spans": runs, "kept": pa.array(rest, pa.binary())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))), "kept": pa.array([], pa.binary())})
        of, at, size = (np.concatenate([np.zeros(0, np.int64), *map(_unpacked_steps, right.column(c).to_pylist())]) for c in ("of", "at", "size"))
        order = np.argsort(of, kind="stable")
        of, at, size = of[order], at[order], size[order]
        out = []
        for i, b in enumerate(left.column("block").to_numpy() - left.column("set").to_numpy()):
            lo, hi = np.searchsorted(of, [b, b + 1])
            out.append(kept(left.slice(i, 1), at[lo:hi], size[lo:hi]))
        return pa.concat_tables(out)

    return blocks.select("set", "block", "ids", "sizes", "data").groupBy("set").cogroup(spans.groupBy("set")).applyInArrow(run, _OUT)


def without_repeats(docs: DataFrame, least: int = LEAST, sizes: Sizes = Sizes()) -> DataFrame:
    """Per row of docs: doc_id, n_bytes of its UTF-8 text, the maximal runs (start, size) of bytes that strings of ``least`` bytes cover which also start in a row with a smaller doc_id, and the bytes kept."""
    if least < GRAM + 8:
        raise ValueError(f"least must be {GRAM + 8} bytes or more")
    spark = docs.sparkSession
    with Scratch(spark) as tables:
        tables.kept |= {"blocks", "bits"}
        blocks = tables.add("blocks", _blocks(docs.selectExpr("CAST(doc_id AS bigint) AS id", "text"), sizes.block, sizes.set), "set", int(spark.conf.get("spark.sql.shuffle.partitions")))
        total, n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        shards = max(1, -(-total // sizes.shard))
        bits = tables.add("bits", _answered(_marks(blocks, least, shards), sizes.hot))
    rows, parts = _pieces(blocks, bits, least, shards, sizes.split), n
    while True:
        parts = max(1, -(-parts // sizes.fan))
        rows = _met(rows, parts, least)
        if parts == 1:
            break
    return _cut(blocks, rows.filter(F.col("kind") == SPAN).select("set", "of", "at", "size"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes kept."""
    kept = without_repeats(docs)
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same by comparing all strings, as hexadecimal text, cut into chunks because a place in a long string is dear to find.
_CHUNKS = "(SELECT r, doc_id, n, c * 500 AS o, substring(h, c * 1000 + 1, {more}) AS h FROM (SELECT *, unnest(range(n // 500 + 1)) AS c FROM d))"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, doc_id, o + p AS p, substring(h, 2 * p + 1, {2 * LEAST}) AS s FROM (SELECT *, unnest(range(500)) AS p FROM {_CHUNKS.format(more=1000 + 2 * LEAST)}) WHERE o + p + {LEAST} <= n),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY 1 HAVING count(*) > 1),
old AS (SELECT r, p FROM w JOIN f USING (s) WHERE low < doc_id OR (doc_id IS NULL AND low IS NOT NULL)),
gone AS (SELECT DISTINCT r, p + unnest(range({LEAST})) AS p FROM old),
runs AS (SELECT r, count(*) AS n_removed, count(*) FILTER (new) AS n_spans FROM (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 1, true) AS new FROM gone) GROUP BY 1),
rest AS (SELECT r, string_agg(c, '' ORDER BY p) AS k FROM (SELECT r, o + p AS p, substring(h, 2 * p + 1, 2) AS c FROM (SELECT *, unnest(range(500)) AS p FROM {_CHUNKS.format(more=1000)} WHERE r IN (SELECT r FROM runs)) WHERE o + p < n) ANTI JOIN gone USING (r, p) GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN n_removed > 0 THEN coalesce(k, '') ELSE h END)) AS kept_sha256
FROM d LEFT JOIN runs USING (r) LEFT JOIN rest USING (r)"""
