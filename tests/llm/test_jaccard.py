"""The n-gram Jaccard join: links counted against all pairs, hot shingles, loose groups, very long and clashing rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import jaccard_join
from tests.llm.test_llm_corpus import DOCS, corpus, plain_components, sets_of


def plain_links(rows):
    classes = {}
    for i, s in sets_of(rows).items():
        classes.setdefault(frozenset(s) or i, []).append(i)
    out = {}
    for a, ids in classes.items():
        links = 0 if isinstance(a, int) else sum(1 for b in classes if b != a and not isinstance(b, int) and 100 * len(a & b) >= 75 * len(a | b))
        out |= {i: (links, min(ids)) for i in ids}
    return out


@pytest.mark.parametrize(("hot", "block"), [(16, 256), (2, 3)])
def test_links_and_classes_against_all_pairs(spark, monkeypatch, hot, block):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_join, "BATCH_TOKENS", 500)
    monkeypatch.setattr(jaccard_join, "SHARD_TOKENS", 700)
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 3)
    rows = corpus(5)
    got = {r["doc_id"]: r for r in jaccard_join.link_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert {i: (r["n_links"], r["class_id"]) for i, r in got.items()} == plain_links(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == plain_components(rows)


def test_cells_derive_every_answer_from_the_hub():
    rng = np.random.default_rng(3)
    base = np.arange(400)
    sets = [np.unique(np.concatenate([rng.choice(base, 400 - k, replace=False), 1000 + rng.integers(0, 90, k)])) for k in rng.integers(0, 70, 40)]
    own, sizes = np.arange(40) < 15, np.array([len(s) for s in sets])
    alike = np.array([[7 * len(np.intersect1d(a, b)) >= 3 * (len(a) + len(b)) and i != k for k, b in enumerate(sets)] for i, a in enumerate(sets)])
    inside, open_ = jaccard_join.cell_links(own, sizes, sets, True)
    assert (inside == alike).all() and 0 < open_ < 40 * 39 // 2
    assert (jaccard_join.cell_links(own, sizes, sets, False)[0] == (alike & (own[:, None] != own[None, :]))).all()


def test_loose_groups_emit_no_pairs(spark):
    shared = [f"w{i}" for i in range(84)]
    rows = [(i, " ".join([*shared, *(f"own{i}x{k}" for k in range(20))]), "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "text")
    table = jaccard_join.set_table(docs)
    index = jaccard_join.lists(jaccard_join.indexed_sets(docs, table))
    assert jaccard_join.hub_pairs(index).count() == 0
    assert jaccard_join.families(index.withColumns({"comp": F.col("cls"), "size": F.lit(1).cast("long")})).count() == 0
    assert jaccard_join.link_components(docs).filter("n_links > 0 OR component_id <> doc_id").count() == 0


def test_one_id_on_several_texts_and_long_texts(spark):
    rng = random.Random(1)
    long_text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(7, "a b c d e f g", "en", "s", 1), (7, "h i j k l m n", "en", "s", 1), (9, "h i j k l m n", "en", "s", 1), (8, "A B C D E F G", "en", "s", 1), (1, long_text, "en", "s", 1), (2, long_text + " end", "en", "s", 1)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.link_components(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, 59_996, 1, 1), (2, 59_997, 1, 1), (7, 3, 7, 0), (7, 3, 7, 0), (8, 3, 7, 0), (9, 3, 7, 0)]


def test_small_batches_restore_the_setting(spark):
    from larder.llm.common import BATCH_ROWS, small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for held, inside in (("10000", BATCH_ROWS), ("10", 10), ("0", BATCH_ROWS)):
            spark.conf.set(name, held)
            with pytest.raises(ValueError), small_batches(spark):
                assert int(spark.conf.get(name)) == inside
                raise ValueError
            assert spark.conf.get(name) == held
    finally:
        spark.conf.set(name, before)
