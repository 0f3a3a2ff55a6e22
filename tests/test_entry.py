"""The driver contract, and plans that must stay as they are."""

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quire.queries import registry

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in registry.QUERIES
    assert {"p2_found", "p3_found", "p7_found"} <= set(registry.QUERIES)


def test_core_stands_alone(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quire.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quire.llm", None)
    assert set(entry.queries()) == set(registry.QUERIES)
    assert set(entry.oracle_sql()) == set(registry.SQL)


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["book_id", "chapter", "verse", "score", "n_matches"]


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.startswith(("a", "p", "n8"))))
def test_no_cross_joins(spark, name):
    shown = plan(registry.QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


@needs_data
def test_pushdown_and_pruning(spark):
    shown = plan(registry.QUERIES["d2_span_cross"](spark, SMALL))
    assert "EqualTo(book_id,AAA)" in shown and "Or(GreaterThan(chapter,1)" in shown
    words = plan(registry.QUERIES["f6_word_verse_counts"](spark, SMALL))
    read = words[words.rindex("ReadSchema") :]
    assert "surface_form" not in read and "IsNotNull(strongs_id)" in words
    for name in ("h3_page", "l1_cosine_topk", "k2_search"):
        assert "TakeOrderedAndProject" in plan(registry.QUERIES[name](spark, SMALL))
