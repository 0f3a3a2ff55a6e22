"""Grammar, matching, BM25 and snippets against the full-text engine of the standard library's database."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quire.errors import SearchQueryError
from quire.operators import textindex as T
from quire.plans.textquery import fold, parse, tokenize

WORDS = ["ab", "abc", "b", "c", "da", "e", "f"]


def has_fts() -> bool:
    try:
        sqlite3.connect(":memory:").execute("create virtual table t using fts5(text)")
        return True
    except sqlite3.Error:
        return False


def random_query(rng, depth=2):
    r = rng.random()
    if depth == 0 or r < 0.4:
        r = rng.random()
        if r < 0.5:
            return rng.choice(WORDS)
        if r < 0.65:
            return f'"{rng.choice(WORDS)} {rng.choice(WORDS)}"'
        if r < 0.75:
            return rng.choice(["a", "d", "ab"]) + "*"
        if r < 0.82:
            return "^" + rng.choice(WORDS)
        if r < 0.88:
            return f"{rng.choice(WORDS)} + {rng.choice(WORDS)}"
        return f"NEAR({rng.choice(WORDS)} {rng.choice(WORDS)}, {rng.randint(0, 4)})"
    a, b = random_query(rng, depth - 1), random_query(rng, depth - 1)
    return f"{random_query(rng, 0)} {random_query(rng, 0)}" if r < 0.55 else f"{a} AND {b}" if r < 0.7 else f"{a} OR {b}" if r < 0.85 else f"{a} NOT {b}" if r < 0.93 else f"({a})"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", ":"]) for _ in range(rng.randint(0, 70))) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1).cache()
    return texts, df


@pytest.mark.skipif(not has_fts(), reason="no FTS5 here")
def test_against_fts5(corpus):
    texts, df = corpus
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(text)")
    con.executemany("insert into t(rowid, text) values (?, ?)", enumerate(texts))
    rng = random.Random(9)
    for _ in range(25):
        query = random_query(rng)
        want = {r[0]: (-r[1], r[2]) for r in con.execute("select rowid, bm25(t), snippet(t, 0, '<mark>', '</mark>', '…', 32) from t where t match ?", (query,))}
        got = {r["id"]: (r["score"], T.snippet_text(texts[r["id"]], query)) for r in T.scored(df, "text", query).rows.collect()}
        assert got.keys() == want.keys(), query
        for i in want:
            assert got[i][0] == pytest.approx(want[i][0], abs=1e-9), query
            assert got[i][1] == want[i][1], query


@pytest.mark.parametrize("bad", ["", "   ", "AND", "a AND", "OR b", "a NOT", "(a", "a)", '"a', "*", "don't", "love-god", "col: a", "NEAR()", "NEAR(a b, x)", "^", "a + ", "a b)"])
def test_refused(bad):
    with pytest.raises(SearchQueryError):
        parse(bad)


def test_tokens(spark):
    texts = ["Café, don't stop_2 ΑΒγ", None, "", "ﷺ ٣ x", "שָׁל"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t"))).collect()]
    assert got[0] == ["cafe", "don", "t", "stop", "2", "αβγ"] == tokenize(texts[0])
    assert got[1] == got[2] == []
    assert got[4] == tokenize(texts[4])
    assert fold("ÀÉ") == "ae"


def test_postings_give_the_same_hits(corpus):
    _, df = corpus
    index = T.postings(df, "id", "text")
    for query in ("ab c", '"ab c" OR da*', "NEAR(b c, 2) NOT e"):
        scan = {r["id"]: round(r["score"], 9) for r in T.scored(df, "text", query).rows.collect()}
        lengths = df.withColumn("_length", F.size(T.tokens(F.col("text"))))
        hits = T.hits_from_postings(lengths, "id", index, query)
        assert {r["id"]: round(r["score"], 9) for r in T.scored(df, "text", query, hits=hits).rows.collect()} == scan


def test_a_stored_index_gives_the_same_scores(spark, corpus, tmp_path):
    texts, df = corpus
    T.build_index(df, "text", str(tmp_path))
    index = T.open_index(spark, str(tmp_path))
    for query in ("ab c", '"ab c" OR da*', "NEAR(b c, 2) NOT e", "^ab OR zz", '"..."'):
        scan = {r["id"]: round(r["score"], 9) for r in T.scored(df, "text", query).rows.collect()}
        assert {r["id"]: round(r["score"], 9) for r in index.scored(query).rows.collect()} == scan
    assert "EqualTo(term,ab)" in index.scored("ab").rows._jdf.queryExecution().toString()


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "a b")], "id int, text string")
    got = T.ranked(T.scored(df, "text", "a").rows, F.asc("id"), limit=10).collect()
    assert [r["id"] for r in got] == [3, 4]
    assert T.scored(df, "text", '"..."').rows.count() == 0
    assert T.scored(df.limit(0), "text", "a").rows.count() == 0
    assert [r["snippet"] for r in T.with_snippet(df, "text", "a").orderBy("id").collect()] == [None, "", "<mark>a</mark> b", "<mark>a</mark> b"]


def test_pages_do_not_overlap(corpus):
    _, df = corpus
    found = T.scored(df, "text", "ab OR c").rows
    pages = [[r["id"] for r in T.ranked(found, F.asc("id"), limit=7, offset=o).collect()] for o in (0, 7, 14)]
    assert len({i for p in pages for i in p}) == sum(map(len, pages))
