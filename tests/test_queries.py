"""Every registered query with SQL gives DuckDB's rows; the others give rows."""

import math
import re
import unicodedata
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from larder.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(rows):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = rows_of(tuple(r) for r in got.select(columns).collect())
    if name in SQL:
        want = db.sql(SQL[name])
        assert sorted(want.columns) == columns
        assert rows == rows_of(want.select(*[f'"{c}"' for c in columns]).fetchall())
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_languages_are_normalised(spark, tmp_path):
    texts = {1: ("Über Café, über", "de"), 2: ("naïve cafe\u0301 X1", "en"), 3: ("Ñandú", None), 4: ("Señor été", "xx"), 5: (None, "fr"), 6: ("", "es")}
    spark.createDataFrame([(i, *t) for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    views = {}
    for i, (text, _) in texts.items():
        plain = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c)).lower()
        views[i] = None if text is None else re.sub("[^a-z0-9]+", " ", plain).strip()
    n = Counter(w for v in views.values() for w in (v or "").split())
    docs = Counter(w for v in views.values() for w in set((v or "").split()))
    assert {r["word"]: (r["n"], r["docs"]) for r in QUERIES["q38_normalize_all_words"](spark, str(tmp_path)).collect()} == {w: (n[w], docs[w]) for w in n}
    assert {r["doc_id"]: r["n_chars"] for r in QUERIES["q39_fold_all_accents"](spark, str(tmp_path)).collect()} == {i: v if v is None else len(v) for i, v in views.items()}
