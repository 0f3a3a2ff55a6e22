"""M: references in words (``"Book 3:16-4:2"``) as spans, and spans as range predicates.

Ranges stay symbolic: a span is never expanded into verses, it becomes comparisons that reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.errors import ReferenceSyntaxError, UnknownBook
from quire.functions.scalars import normal_name_text

# Dashes that count as a hyphen; most elements of a verse list; most characters of a reference.
DASHES = "‐‑‒–—―−"
MOST_ELEMENTS, MOST_CHARACTERS = 100, 256

_POINT = r"(?P<c1>\d+):(?P<v1>\d+)"
#: The forms of a numeric part and what they select; tried in order.
_FORMS = [
    re.compile(r"(?P<c1>\d+)", re.ASCII),
    re.compile(_POINT, re.ASCII),
    re.compile(r"(?P<c1>\d+)-(?P<c2>\d+)", re.ASCII),
    re.compile(_POINT + r"-(?P<v2>\d+)", re.ASCII),
    re.compile(_POINT + r"-(?P<c2>\d+):(?P<v2>\d+)", re.ASCII),
]
_LIST = re.compile(_POINT + r"(?P<more>(?:,\d+)+)", re.ASCII)


@dataclass(frozen=True, order=True)
class Span:
    """From ``(chapter, verse)`` to ``(to_chapter, to_verse)``; without verses, whole chapters."""

    chapter: int
    verse: int | None
    to_chapter: int
    to_verse: int | None

    def __str__(self) -> str:
        if self.verse is None:
            return f"{self.chapter}" if self.chapter == self.to_chapter else f"{self.chapter}-{self.to_chapter}"
        start = f"{self.chapter}:{self.verse}"
        if self.chapter != self.to_chapter:
            return f"{start}-{self.to_chapter}:{self.to_verse}"
        return start if self.verse == self.to_verse else f"{start}-{self.to_verse}"

    def predicate(self, chapter: str = "chapter", verse: str = "verse") -> Column:
        """D2. The form with ``OR`` is kept for spans over chapters, as Spark pushes it down to Parquet."""
        c, v = F.col(chapter), F.col(verse)
        if self.verse is None:
            return c.between(self.chapter, self.to_chapter)
        if self.chapter == self.to_chapter:
            return (c == self.chapter) & v.between(self.verse, self.to_verse)
        after = (c > self.chapter) | ((c == self.chapter) & (v >= self.verse))
        return after & ((c < self.to_chapter) | ((c == self.to_chapter) & (v <= self.to_verse)))


@dataclass(frozen=True)
class Book:
    id: str
    name: str


class BookResolver(Protocol):
    def resolve(self, token: str) -> Book | None: ...


class AliasResolver:
    """Books by alias, name and id, all matched in normal form."""

    def __init__(self, books: Iterable[Book], aliases: Mapping[str, str] | None = None):
        by_id = {b.id: b for b in books}
        self.known = {normal_name_text(x): b for b in by_id.values() for x in (b.name, b.id)}
        self.known |= {normal_name_text(a): by_id[i] for a, i in (aliases or {}).items() if i in by_id}

    @classmethod
    def from_tables(cls, books: DataFrame, aliases: DataFrame | None = None) -> AliasResolver:
        """From the book catalog (a few hundred rows; the catalog is what bounds it)."""
        rows = books.select("id", "name").distinct().collect()
        extra = {r["alias"]: r["book_id"] for r in aliases.select("alias", "book_id").collect()} if aliases is not None else {}
        return cls((Book(r["id"], r["name"]) for r in rows if r["id"] and r["name"]), extra)

    def resolve(self, token: str) -> Book | None:
        return self.known.get(normal_name_text(token))


@dataclass(frozen=True)
class Reference:
    book_id: str
    book_name: str
    spans: tuple[Span, ...]

    @property
    def echo(self) -> str:
        """The reference in canonical form; parsing it again gives the same reference."""
        if len(self.spans) == 1:
            return f"{self.book_name} {self.spans[0]}"
        return f"{self.book_name} {self.spans[0].chapter}:" + ",".join(str(s.verse) for s in self.spans)

    def predicate(self, book: str = "book_id", chapter: str = "chapter", verse: str = "verse") -> Column:
        """D3: all spans in one predicate, so one scan answers them."""
        return (F.col(book) == self.book_id) & any_span(self.spans, chapter, verse)


def any_span(spans: Sequence[Span], chapter: str = "chapter", verse: str = "verse") -> Column:
    return reduce(or_, (s.predicate(chapter, verse) for s in spans)) if spans else F.lit(False)


def parse_reference(text: str, resolver: BookResolver, longest: int | None = None) -> Reference:
    """One reference; ReferenceSyntaxError if it is none, UnknownBook if only the book is unknown. Numbers are not checked against
    any text: a verse that does not exist selects nothing. ``longest``: most characters (``MOST_CHARACTERS`` for untrusted input)."""
    raw = text.strip()
    if not raw:
        raise ReferenceSyntaxError("the reference is empty")
    if longest is not None and len(text) > longest:
        raise ReferenceSyntaxError(f"a reference has at most {longest} characters")
    if ";" in raw:
        raise ReferenceSyntaxError("one reference at a time: ';' separates several")
    # the book ends with the last ASCII letter, the rest is numbers
    m = re.fullmatch(r"(?s)(.*[A-Za-z])(.*)", re.sub(f"[{DASHES}]", "-", raw))
    if not m:
        raise ReferenceSyntaxError(f"{raw!r} names no book")
    name, numbers = m[1].strip(), m[2].lstrip(" .'’\t")
    if not numbers:
        raise ReferenceSyntaxError(f"{raw!r} names no chapter")
    book = resolver.resolve(name)
    if book is None:
        raise UnknownBook(f"unknown book {name!r}")
    return Reference(book.id, book.name, _spans(re.sub(r"\s+", "", numbers).replace(".", ":"), raw))


def _spans(numbers: str, raw: str) -> tuple[Span, ...]:
    found = {k: int(v) for form in _FORMS if (m := form.fullmatch(numbers)) for k, v in m.groupdict().items()}
    if m := _LIST.fullmatch(numbers):
        verses = [int(m["v1"]), *map(int, m["more"][1:].split(","))]
        if len(verses) > MOST_ELEMENTS:
            raise ReferenceSyntaxError(f"a list has at most {MOST_ELEMENTS} verses")
        chapter = int(m["c1"])
        if min(chapter, *verses) < 1:
            raise ReferenceSyntaxError(f"numbers start at 1 in {raw!r}")
        return tuple(Span(chapter, v, chapter, v) for v in sorted(set(verses)))
    if not found:
        raise ReferenceSyntaxError(f"cannot read {numbers!r} in {raw!r}")
    if min(found.values()) < 1:
        raise ReferenceSyntaxError(f"numbers start at 1 in {raw!r}")
    first = found["c1"], found.get("v1")
    last = found.get("c2", found["c1"]), found.get("v2", found.get("v1"))
    if (last[0], last[1] or 0) < (first[0], first[1] or 0):
        raise ReferenceSyntaxError(f"the range {numbers!r} runs backwards")
    return (Span(*first, *last),)
