"""Words near a pool, by a trie, against plain loops over all pairs."""

import random

from pyspark.sql import functions as F

from larder.functions.distance import TriesByPool, WordTrie, osa
from larder.operators import audit


def word_list(rng, n, most=9):
    return ["".join(rng.choice("abc") for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_trie_equals_all_pairs():
    rng = random.Random(3)
    for _ in range(60):
        pool, shortest = word_list(rng, 25), rng.randint(0, 3)
        trie = WordTrie(pool)
        for word in word_list(rng, 15):
            for most in range(5):
                want = next((i for i, p in enumerate(pool) if len(p) >= shortest and osa(word, p, most) <= most), None)
                assert trie.near(word, most, shortest) == want, (word, pool, most, shortest)
            assert trie.start_of(word, 3) == next((i for i, p in enumerate(pool) if len(p) >= 3 and word.startswith(p)), None)


def test_empty_and_repeated_words():
    assert WordTrie([]).near("abc", 5) is None and WordTrie([""]).near("ab", 2) == 0 and WordTrie([""]).near("ab", 2, 1) is None
    assert WordTrie(["abc", "abc"]).near("abc", 0) == 0 and WordTrie(["ab", "ba"]).near("ba", 1) == 0
    tries = TriesByPool()
    assert tries.of(["a", "b"]) is tries.of(("a", "b")) and tries.of(["b", "a"]) is not tries.of(["a", "b"])


def test_near_and_damaged_columns_equal_plain_loops(spark):
    rng = random.Random(5)
    rows = [(word_list(rng, 6, 12), word_list(rng, 12, 12)) for _ in range(60)] + [([], ["abcde"]), (["abcde"], []), (None, ["abcde"]), (["abcde"], None)]
    got = spark.createDataFrame(rows, "own array<string>, pool array<string>").select("*", audit.near_words(F.col("own"), F.col("pool"), 7).alias("near"), audit.damaged_words(F.col("own"), F.col("pool")).alias("damaged"))
    for r in got.collect():
        own, pool = r["own"] or [], r["pool"] or []
        most = lambda w: 2 if len(w) >= 7 else 1
        assert r["near"] == [w for w in own if len(w) >= 5 and any(osa(w, p, most(w)) <= most(w) for p in pool)]
        far = lambda w: 1 if len(w) <= 3 else 2 if len(w) <= 7 else -(-len(w) * 2 // 5)
        piece = lambda w: next((p for p in pool if len(p) >= 2 and ((len(p) >= 3 and w.startswith(p)) or osa(w, p, far(w)) <= far(w))), None)
        assert [tuple(x) for x in r["damaged"] or []] == [(w, piece(w)) for w in own if piece(w) is not None]
