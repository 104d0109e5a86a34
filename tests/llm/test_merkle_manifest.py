import hashlib
import random
import zlib
from collections import defaultdict

from larder.llm import merkle_manifest
from larder.llm.merkle_manifest import fold, hashed, height, paths

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(doc_id, text, lang, source, n_chars):
    return H(*map(field, (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][a : a + 8]) for a in range(0, len(out[-1]), 8)])
    return out


def plain(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0], plain_leaf(*r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in names:
        trees[lang].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        built[lang] = levels_of([x[2] for x in trees[lang]])
    top = levels_of([built[lang][-1][0] for lang in names])
    out = []
    for k, lang in enumerate(names):
        for i, (_, doc_id, own, r) in enumerate(trees[lang]):
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            at = plain_leaf(r[0], r[1] if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:]) if hit else own
            proof = ""
            for levels, place in ((built[lang], i), (top, k)):
                for level in levels[:-1]:
                    run, d = level[place // 8 * 8 : place // 8 * 8 + 8], place % 8
                    proof += "".join(run[:d] + run[d + 1 :])
                    at, place = H(*run[:d], at, *run[d + 1 :]), place // 8
            out.append((doc_id, own, built[lang][-1][0], top[-1][0], H(proof), at, at == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in merkle_manifest.proofs(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_equals_the_plain_tree(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "Some Text", "no capitals", f"É Über {i}"]), rng.choice([None, "", "en", "en", "de", "é", "alone" if i == 3 else "en"]), rng.choice([None, "s"]), rng.choice([None, i])) for i in range(150)]
    rows += [(None, "A", "en", "s", 1), (None, "B", "en", "s", 1), (7, "again", "en", None, 1), (7, "again", "en", None, 1), (-4, "minus", "de", "s", None)] + [(200, "Same", "xx", "s", 1)] * 20
    rows += [(1000 + i, "t", f"lang{i}", "s", i) for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert got(df.repartition(5)) == want
    assert {v for *_, v in want} == {True, False}


def test_several_segments(spark):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(8197)] + [(i, "x", "de", "s", i) for i in range(4096)] + [(i, "x", "fr", "s", i) for i in range(4097)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(df) == plain(rows)


def test_proofs_lead_to_the_root(spark):
    rows = [(i, f"T{i}", "en" if i % 3 else "de", "s", i) for i in range(40)]
    found, records = merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA))
    nodes = {n["digest"]: n["children"] for df in records for r in df.collect() for n in r["nodes"]}
    assert all(H(*children) == d for d, children in nodes.items())
    row = found.filter("doc_id = 5").first()
    assert H(*row["proof"]) == row["proof_sha256"] and row["root"] in nodes


def test_paths_of_one_segment():
    for n in (1, 2, 8, 9, 64, 65, 513):
        leaves = [H(str(i)) for i in range(n)]
        top, nodes = hashed(leaves, height(n))
        assert top == levels_of(leaves)[-1][0]
        own = list(paths(top, {x["digest"]: x["children"] for x in nodes}, n))
        assert [d for d, _ in own] == leaves and all(fold(d, s) == top for d, s in own)


def test_empty_table_long_texts_and_extra_columns(spark):
    df = spark.createDataFrame([(3, "Z" * 2_000_000, "en", "s", 1, 9, "x")], SCHEMA + ", tree int, digest string")
    assert got(df) == plain([(3, "Z" * 2_000_000, "en", "s", 1)])
    assert got(df.limit(0)) == []
