import pytest

from quire.errors import ReferenceSyntaxError, UnknownBook
from quire.plans.reference import AliasResolver, Book, Span, parse_reference

BOOKS = AliasResolver([Book("1AB", "1 Abbot"), Book("CHR", "Chronicle of Reeds"), Book("ISA", "Isana")], {"First Abbot": "1AB", "reeds": "CHR", "missing": "ZZZ"})


@pytest.mark.parametrize(
    ("text", "book", "spans", "echo"),
    [
        ("CHR 3", "CHR", (Span(3, None, 3, None),), "Chronicle of Reeds 3"),
        ("Chronicle of Reeds 3:16", "CHR", (Span(3, 16, 3, 16),), "Chronicle of Reeds 3:16"),
        ("reeds 3.16", "CHR", (Span(3, 16, 3, 16),), "Chronicle of Reeds 3:16"),
        ("Reeds. 3:16-18", "CHR", (Span(3, 16, 3, 18),), "Chronicle of Reeds 3:16-18"),
        ("reeds 3 : 16 – 16", "CHR", (Span(3, 16, 3, 16),), "Chronicle of Reeds 3:16"),
        ("reeds 3-4", "CHR", (Span(3, None, 4, None),), "Chronicle of Reeds 3-4"),
        ("reeds 3-3", "CHR", (Span(3, None, 3, None),), "Chronicle of Reeds 3"),
        ("I Abbot 3:16-4:2", "1AB", (Span(3, 16, 4, 2),), "1 Abbot 3:16-4:2"),
        ("first abbot 3:16-3:17", "1AB", (Span(3, 16, 3, 17),), "1 Abbot 3:16-17"),
        ("isana 3:9,4,9,2", "ISA", (Span(3, 2, 3, 2), Span(3, 4, 3, 4), Span(3, 9, 3, 9)), "Isana 3:2,4,9"),
    ],
)
def test_accepted(text, book, spans, echo):
    found = parse_reference(text, BOOKS)
    assert (found.book_id, found.spans, found.echo) == (book, spans, echo)
    assert parse_reference(found.echo, BOOKS) == found


@pytest.mark.parametrize(
    "text",
    ["", "  ", "reeds", "3:16", "reeds 0", "reeds 3:0", "reeds 4-3", "reeds 3:5-4", "reeds 3:9-3:8", "reeds 3-4:2", "reeds 3:1-2-3", "reeds 3:", "reeds :3", "reeds 3:1,", "reeds 3,4", "reeds 3:1,4-5", "reeds 3:1,4:5", "reeds 3:1;4", "reeds 3:a", "reeds 3:1-", "reeds 3/4", "reeds ٣", "reeds 3:" + ",".join(["1"] * 101)],
)
def test_refused(text):
    with pytest.raises(ReferenceSyntaxError):
        parse_reference(text, BOOKS)


def test_unknown_book_is_told_apart():
    with pytest.raises(UnknownBook):
        parse_reference("missing 3:1", BOOKS)
    with pytest.raises(ReferenceSyntaxError):
        parse_reference("reeds 3" + " " * 300, BOOKS, longest=256)
    assert len(parse_reference("reeds 3:" + ",".join(map(str, range(1, 101))), BOOKS).spans) == 100


def test_predicates(spark):
    grid = spark.createDataFrame([("CHR", c, v) for c in range(1, 6) for v in range(1, 6)] + [("CHR", 3, None), (None, 3, 3)], "book_id string, chapter int, verse int")
    pick = lambda text: {(r.chapter, r.verse) for r in grid.where(parse_reference(text, BOOKS).predicate()).collect()}
    assert pick("reeds 2:4-4:1") == {(2, 4), (2, 5), (4, 1)} | {(3, v) for v in range(1, 6)} | {(3, None)}
    assert pick("reeds 2:2-3") == {(2, 2), (2, 3)}
    assert pick("reeds 9") == set()
    assert len(pick("reeds 2-3")) == 11
