"""BM25 against SQLite's own, and the fusion's exact scores."""

import sqlite3

import pytest

from lodeline.operators import search as S

DOCS = ["red apple pie", "red red apples and pears", "green pear apple", "nothing here", "apple red pie pie", "the redder apple", "apricot red", "pie"]


@pytest.mark.parametrize("query", ["red app", "pie", "red apple", "a"])
def test_bm25_matches_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(content, scope, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into f(rowid, content, scope) values (?, ?, ?)", [(i, d, "s") for i, d in enumerate(DOCS)])
    *whole, last = query.split()
    want = dict(db.execute("select rowid, -bm25(f) from f where f match ?", (" ".join([*(f'"{w}"' for w in whole), f'"{last}"*']),)).fetchall())
    df = spark.createDataFrame([(i, d, "s") for i, d in enumerate(DOCS)], "id long, content string, scope string")
    got = {r.id: r.score for r in S.bm25(df, query).collect()}
    assert got == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("query", ['"red apple"', '"apple pie"', '"red app"', 'pie "red pie', '"the redder" apple', '"red apple" "apple p"', 'call(red) ap', '"pie s"', '"red red"', '"zz top"', 'apple "pie pie"'])
def test_phrases_match_sqlite(spark, query):
    """Over token arrays and over positional postings; the scope never continues a phrase."""
    docs = DOCS + ["call red apple", "red apple red apple pie red", None]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(content, scope, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into f(rowid, content, scope) values (?, ?, ?)", [(i, d, "s red") for i, d in enumerate(docs)])
    clauses = [" ".join(c) for c in S.parse_clauses(query)]
    want = dict(db.execute("select rowid, -bm25(f) from f where f match ?", (" ".join([*(f'"{c}"' for c in clauses[:-1]), f'"{clauses[-1]}"*']),)).fetchall())
    df = spark.createDataFrame([(i, d, "s red") for i, d in enumerate(docs)], "id long, content string, scope string")
    for held in (None, S.postings(df)):
        assert {r.id: r.score for r in S.bm25(df, query, held).collect()} == pytest.approx(want, rel=1e-6)


def test_clauses():
    assert S.parse_clauses('Foo-bar "Red  apple" get(x) la') == [["foo"], ["bar"], ["red", "apple"], ["get", "x"], ["la"]]
    assert S.parse_clauses('"" " * (') == [] and S.parse_query('a "b c"') == ["a", "b", "c"]


@pytest.mark.parametrize("path,kind,centrality,score", [("a.py", "function", 0.0, 1.2 / 61), ("a_test.py", "function", 0.0, 0.12 / 61), ("a.py", "import", None, 0.12 / 61), ("a.py", "function", 0.5, 1.2 * 3.5 / 61), ("a_test.py", "function", 0.2, 1.2 * 0.2 / 61)])
def test_fusion_scores(spark, path, kind, centrality, score):
    chunks = spark.createDataFrame([(1, path, kind, centrality)], "id long, path string, kind string, centrality double")
    ranked = S.ranked(spark.createDataFrame([(1, 1.0)], "id long, score double"), 5)
    assert S.fuse({"symbol": ranked}, chunks, 5).first().score == pytest.approx(score, abs=1e-8)


def test_symbol_tiers(spark):
    names = spark.createDataFrame([(1, "foo"), (2, "FOO"), (3, "foobar"), (4, "a_foo"), (5, "bar")], "id long, name string")
    assert [(r.id, r.score) for r in S.symbols(names, "foo", 10).orderBy("rank").collect()] == [(1, 1.0), (2, 0.8), (3, 0.8), (4, 0.5)]


def test_postings_take_texts_apart_once(spark):
    """Ranges would be found by a sample, for which every text is taken apart once more."""
    chunks = spark.createDataFrame([(1, "the red apple", "s")], "id long, content string, scope string")
    assert "rangepartitioning" not in S.postings(chunks)._jdf.queryExecution().executedPlan().toString().lower()


def test_no_posting_is_shuffled(spark):
    """Texts are dealt by id once; terms and their positions stay in that task."""
    chunks = spark.createDataFrame([(k, d, "s") for k, d in enumerate(DOCS)], "id long, content string, scope string")
    plan = S.postings(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Exchange" in plan.split("Generate")[-1]
