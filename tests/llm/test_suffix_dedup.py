import hashlib
import random

import numpy as np
import pytest

from larder.llm import suffix_dedup
from larder.llm.suffix_dedup import LEAST, Sizes, longest_previous_factors

SCHEMA = "doc_id long, text string"


def plain(rows):
    """Removed bytes and kept bytes of each row, by comparing all strings."""
    last = 1 << 63
    data = [((last if i is None else i), (t or "").encode()) for i, t in rows]
    low = {}
    for i, b in data:
        for p in range(len(b) - LEAST + 1):
            low[b[p : p + LEAST]] = min(low.get(b[p : p + LEAST], last), i)
    out = []
    for (i, _), (own, b) in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for p in range(len(b) - LEAST + 1):
            if low[b[p : p + LEAST]] < own:
                gone[p : p + LEAST] = [True] * LEAST
        spans = sum(g and (not p or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 9)))
    passages = ["".join(word() for _ in range(20)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(word() for _ in range(rng.randrange(25))) for _ in range(rng.randrange(5))]
        rows.append((rng.choice([None, *range(40)]), "".join(parts)))
    rows += [(7, None), (8, ""), (9, "x" * LEAST), (3, "x" * (LEAST - 1)), (2, "x" * (3 * LEAST)), (1, "y" * LEAST + passages[0][:LEAST]), (41, rows[0][1]), (42, rows[0][1]), (42, rows[0][1])]
    return rows


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(500, 700, 3, 2, 2), Sizes(300, 10_000, 2, 3, 1000)])
def test_equals_comparing_all_strings(spark, sizes, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = suffix_dedup.without_repeats
    monkeypatch.setattr(suffix_dedup, "without_repeats", lambda d: whole(d, sizes=sizes))
    assert sorted((tuple(r) for r in suffix_dedup.digests(docs).collect()), key=repr) == plain(rows)


def test_spans_and_kept_bytes(spark):
    a, b = "first passage of some sixty bytes that both texts hold in full,", " and what only one of them has"
    rows = suffix_dedup.without_repeats(spark.createDataFrame([(1, a), (2, "No. " + a + b)], SCHEMA)).collect()
    second = next(r for r in rows if r.doc_id == 2)
    assert [tuple(s) for s in second.spans] == [(4, len(a))] and bytes(second.kept).decode() == "No. " + b
    assert next(r for r in rows if r.doc_id == 1).spans == []


def test_factors_equal_the_plain_way():
    rng = np.random.default_rng(3)
    data = np.frombuffer(b"".join(rng.choice([b"abcabcabd" * 4, b"q" * 30, b"abd" * 15], 40)), np.uint8)
    starts = np.arange(len(data) - 24)
    docs = starts // 100
    strings = [data[s : s + 24].tobytes() for s in starts]
    low = {}
    for s, d in zip(strings, docs, strict=True):
        low[s] = min(low.get(s, d), d)
    got = longest_previous_factors(data, starts, docs, 24)
    assert [int(x) for x in got] == [24 if low[s] < d else 0 for s, d in zip(strings, docs, strict=True)]


def test_very_long_text_extra_columns_and_empty_table(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    docs = spark.createDataFrame([(1, text, 0, "x"), (2, "tail " + text[200_000:200_090], 1, "y")], "doc_id long, text string, block int, kept string")
    got = {r.doc_id: tuple(r) for r in suffix_dedup.digests(docs).collect()}
    assert got[1][1:4] == (400_000, 0, 0) and got[2][2] in (90, 91) and got[2][3] == 1
    assert suffix_dedup.digests(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="least"):
        suffix_dedup.without_repeats(docs, 20)


def test_positions_travel_as_steps():
    for values in ([], [7], [0, 5, 5, 90_000], [-3, suffix_dedup.LAST, -(2**63), 4]):
        assert suffix_dedup._unpacked_steps(suffix_dedup._packed_steps(np.array(values, np.int64))).tolist() == values
    starts = np.cumsum(np.random.default_rng(1).integers(1, 9000, 400))
    assert len(suffix_dedup._packed_steps(starts)) < 2.1 * len(starts)
    marks = np.sort(np.random.default_rng(2).integers(0, 1 << 32, 3500))
    assert len(suffix_dedup._packed_steps(marks)) < 3 * len(marks)


def test_equal_strings_are_put_in_order_once(monkeypatch):
    put, order = [], suffix_dedup._suffix_order
    monkeypatch.setattr(suffix_dedup, "_suffix_order", lambda words, starts, steps: put.append(len(starts)) or order(words, starts, steps))
    rng = np.random.default_rng(4)
    a, b, c = (rng.integers(97, 123, LEAST, np.uint8) for _ in range(3))
    b[:20] = a[:20]
    data = np.concatenate([b, *[a] * 40, b, c])
    got = longest_previous_factors(data, np.arange(43) * LEAST, np.array([3, *[5] * 20, *[4] * 20, 9, 1]))
    assert got.tolist() == [0, *[LEAST] * 20, *[0] * 20, LEAST, 0]
    assert put == [2]  # before, all 42 starts with a partner were sorted


def test_unlike_strings_with_one_hash_are_told_apart():
    a = np.random.default_rng(6).integers(0, 256, LEAST, np.uint8)
    x, y = (int.from_bytes(a[k : k + 8].tobytes(), "big") for k in (0, 8))
    mixed = lambda v: (v ^ (v >> 29)) * (suffix_dedup._ODD + 16)
    b = np.concatenate([np.frombuffer(v.to_bytes(8, "big"), np.uint8) for v in (x ^ 1, (y + mixed(x) - mixed(x ^ 1)) % 2**64)] + [a[16:]])
    got = longest_previous_factors(np.concatenate([a, b, b, a]), np.arange(4) * LEAST, np.array([1, 2, 3, 4]))
    assert got.tolist() == [0, 0, LEAST, LEAST]


def test_many_blocks_meet_in_one_round_by_a_message_a_set(spark, monkeypatch):
    met, seen = suffix_dedup._met, []
    monkeypatch.setattr(suffix_dedup, "_met", lambda rows, parts, least: seen.append((parts, rows)) or met(rows, parts, least))
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(60))
    rows = [(i, passage + "".join(rng.choice("ijklmnop ") for _ in range(20))) for i in range(1100)]
    kept = suffix_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA).coalesce(1), sizes=Sizes(80, 10**9, 1))
    assert {r.doc_id: 80 - len(r.kept) for r in kept.collect()} == {i: gone for i, _, gone, *_ in plain(rows)}
    (parts, sent), *more = seen
    assert parts == 1 and not more  # before, a second round shuffled the pieces of more than 1,024 blocks again
    assert sent.filter("kind = 1").count() <= -(-1100 // 16)  # before, each block sent a message
