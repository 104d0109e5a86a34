import math
import random
from collections import Counter

import numpy as np

from larder.llm import ranked_search
from larder.llm.ranked_search import Best, _search_cluster, asked, terms_of


def plain(docs, items, k=10):
    """All scores of all documents, without an index."""
    own = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    own = [x for x in own if x[2]]
    n_docs, n_terms, df = len(own), sum(n for _, _, n in own), Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in own:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            scored += [(-s, 1 << 62 if i is None else i)] if s else []
        out += [(item, r + 1, None if i == 1 << 62 else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)] + ["Élan", "ÉLAN", "über", "x1", "don't"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words[: rng.choice((20, 405))]) for _ in range(n))
    docs = [(i, text(rng.randrange(40))) for i in range(700)] + [(None, "w1 w2 w3 w4"), (5, None), (6, ""), (7, " .,; "), (8, "W1 w2\x00w3"), (8, "W1 w2\x00w3")]
    docs += [(1000 + i, "exact copy of w5 w6 w7") for i in range(200)]
    items = [(f"i{i}", text(rng.randrange(1, 30))) for i in range(20)] + [("none", None), ("empty", ""), ("unknown", "zzz qqq"), ("copies", "w5 copy w6"), ("wide", " ".join(words)), ("twice", "w1 w1 w2"), ("twice", "w1 w1 w2")]
    return docs, items


def test_equals_scoring_everything(spark, monkeypatch):
    docs, items = corpus()
    want = plain(docs, items)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked_for = spark.createDataFrame(items, "item_id string, text string")
    for size in (64_000, 300):
        monkeypatch.setattr(ranked_search, "ITEM_BYTES", size)
        assert sorted((tuple(r) for r in ranked_search.search(frame, asked_for).collect()), key=repr) == want
    assert sorted((tuple(r) for r in ranked_search.search(frame, asked_for, 3).collect()), key=repr) == plain(docs, items, 3)


def test_blocks_are_skipped_only_under_the_tenth(spark):
    docs, items = corpus()
    docs = [(100_000 + i, "rare1 rare2 rare3 rare4") for i in range(20)] + docs
    own = asked(["rare1 rare2 rare3 w1 w2", *(t for _, t in items[:5])])
    slices = ranked_search.forward(spark.createDataFrame(docs, "id long, text string").coalesce(1), own.vocabulary)
    n_docs, n_terms = slices.selectExpr("sum(n_docs)", "sum(n_terms)").first()
    weights = ranked_search.weights_of(ranked_search.document_frequencies(slices, len(own.vocabulary)), n_docs)
    rows = [r.asDict() for r in ranked_search.index(slices, own, weights, n_docs, n_terms).collect()]
    weighted = [weights[t] * m for t, m in zip(own.terms, own.times, strict=True)]
    places = [np.array([np.searchsorted(own.beside[t], ts) for t in ts]) for ts in own.terms]
    best, seen = [Best(10) for _ in own.terms], Counter()
    for row in rows:
        _search_cluster(row, own, weighted, places, best, seen)
    assert 0 < seen["skipped"] < seen["blocks"]
    assert list(best[0].ids) == list(range(100_000, 100_010))


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, item_id string, score int")
    items = spark.createDataFrame([(4, "b", 9)], "item_id int, text string, doc_id int")
    assert [(r.item_id, r.rank, r.doc_id) for r in ranked_search.search(docs, items).collect()] == [(4, 1, 1)]
    assert ranked_search.search(docs.limit(0), items).collect() == []
    assert ranked_search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    long = spark.createDataFrame([(1, "needle " + "hay " * 300_000), (2, "hay")], "doc_id long, text string")
    assert ranked_search.search(long, spark.createDataFrame([("n", "needle")], "item_id string, text string")).first().doc_id == 1
