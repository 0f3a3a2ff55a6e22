"""Relations that hang off coordinates: cross references, places, topics, notes, headings, words, journeys (E, F)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.errors import NoMatch, UnknownValue
from quire.functions.scalars import contains_ci, leading_number, reference_text
from quire.operators.passages import bounded
from quire.plans.reference import Reference

COORDINATE = ["book_id", "chapter", "verse"]


def book_names(books: DataFrame) -> DataFrame:
    return books.select(F.col("id").alias("book_id"), F.col("name").alias("book_name"), "canonical_order").distinct()


def cross_references_of(edges: DataFrame, books: DataFrame, where: Column | None = None, min_votes: int | None = None) -> DataFrame:
    """References with the names of both books and their target in words; ``min_votes`` (at least 0, C10) drops null votes too."""
    if min_votes is not None:
        bounded("min_votes", min_votes, 0)
    if where is not None:
        edges = edges.where(where)
    if min_votes is not None:
        edges = edges.where(F.col("votes") >= min_votes)
    start = book_names(books).select(F.col("book_id").alias("from_book_id"), F.col("book_name").alias("from_name"))
    end = book_names(books).select(F.col("book_id").alias("to_book_id"), F.col("book_name").alias("to_name"), F.col("canonical_order").alias("to_order"))
    return edges.distinct().join(start, "from_book_id").join(end, "to_book_id").withColumn("target", reference_text(F.col("to_name"), F.col("to_chapter"), F.col("to_verse_start"), F.col("to_verse_end")))


def cross_reference_order() -> list[Column]:
    """H1: votes first, then the coordinates, then id, which makes it total."""
    return [F.desc("votes"), *map(F.asc, ("from_chapter", "from_verse", "to_order", "to_chapter", "to_verse_start", "to_verse_end", "id"))]


def hydrated(df: DataFrame, verses: DataFrame, version: str, *, book: str = "book_id", chapter: str = "chapter", verse: str = "verse") -> DataFrame:
    """``df`` with the ``text`` of one version at a coordinate, null where it has none: one join instead of a lookup a row."""
    text = verses.where(F.col("translation_id") == version).select(F.col("book_id").alias(book), F.col("chapter").alias(chapter), F.col("verse").alias(verse), "text")
    text = text.groupBy(book, chapter, verse).agg(F.min("text").alias("text"))
    return df.join(text, [book, chapter, verse], "left")


def nested(parents: DataFrame, children: DataFrame, key: str, parent_key: str, fields: Sequence[str], name: str) -> DataFrame:
    """``parents`` with their children as an ordered array of structs, empty if there are none.

    For parents with a bounded number of children (references of a note, stops of a journey). For others use the flat join.
    """
    own = children.groupBy(F.col(parent_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array().cast(own.schema[name].dataType)
    return parents.join(own, key, "left").withColumn(name, F.coalesce(name, empty))


def links_of(links: DataFrame, books: DataFrame, entity: str, value: str | None = None) -> DataFrame:
    """The coordinates of an entity (or of all) with book names, each once."""
    own = links if value is None else links.where(F.col(entity) == value)
    return own.select(entity, *COORDINATE).distinct().join(book_names(books), "book_id")


def entities_at(entities: DataFrame, links: DataFrame, key: str, link_key: str, reference: Reference | None = None) -> DataFrame:
    """The entities linked to any verse of a reference, each once: a semi join instead of a join and DISTINCT. Without a reference: to any row of ``links``."""
    here = (links if reference is None else links.where(reference.predicate())).select(F.col(link_key).alias(key))
    return entities.distinct().join(here, key, "left_semi")


def link_counts(entities: DataFrame, links: DataFrame, key: str, link_key: str, name: str = "n_links") -> DataFrame:
    """each entity with how many distinct links it has, 0 if none."""
    n = links.distinct().groupBy(F.col(link_key).alias(key)).agg(F.count("*").alias(name))
    return entities.distinct().join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def listed(df: DataFrame, columns: Sequence[str], query: str | None = None, **equal: object) -> DataFrame:
    """Rows where any of ``columns`` contains ``query`` (ASCII case folded; blank: no such filter), and the given columns have the
    given values (None: no such filter)."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    if query and query.strip():
        found = F.lit(False)
        for name in columns:
            found = found | contains_ci(F.col(name), query.strip())
        df = df.where(found)
    return df.distinct()


# The columns of the short shapes.
SUMMARIES = {
    "place": ("id", "friendly_id", "name", "type", "latitude", "longitude", "confidence", "confidence_score", "status"),
    "journey": ("id", "name", "scripture", "dating", "stop_count"),
    "topic": ("id", "name", "section", "see_also"),
    "word": ("strongs_id", "language", "lemma", "transliteration", "gloss"),
}


def summary(df: DataFrame, entity: str) -> DataFrame:
    """The columns of the short shape, in its order (the long shape is the table itself)."""
    return df.select(*SUMMARIES[entity])


def lookup(df: DataFrame, value: object, *columns: str) -> DataFrame:
    """The row whose first of ``columns`` with that value has it (an id before a slug); NoMatch if none does. Repeats count once."""
    has = lambda c: F.col(c).eqNullSafe(F.lit(value).try_cast(df.schema[c].dataType))
    found = df.where(reduce(or_, map(has, columns)))
    turn = F.coalesce(*(F.when(has(c), i) for i, c in enumerate(columns)))
    one = found.orderBy(turn, *columns).limit(1)
    if one.isEmpty():
        raise NoMatch(f"no row with {' or '.join(columns)} {value!r}")
    return one


def allowed_value(df: DataFrame, column: str, value: str | None, known: Sequence[str] | None = None) -> str | None:
    """A filter value, trimmed; None if it is blank; UnknownValue, with what there is, if it is neither among ``known`` nor, without that, in
    the column. Meant for columns of few values."""
    if value is None or not value.strip():
        return None
    own = value.strip()
    there = list(known) if known is not None else sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())
    if own not in there:
        raise UnknownValue(column, own, there)
    return own


def stops_of(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Stops with name and position of their place, in the order of the journey; NaN positions are null."""
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    own = places.select(F.col("id").alias("place_id"), "name", number("latitude"), number("longitude")).distinct()
    return stops.join(own, "place_id", "left")


def lexicon_order(language: str = "language", key: str = "strongs_id") -> list[Column]:
    """H2: language, then the number after the letter, then the id."""
    return [F.asc(language), leading_number(F.substring(key, 2, 100)).asc(), F.asc(key)]


def headings_of(headings: DataFrame, books: DataFrame, version: str | None = None, book_id: str | None = None, chapter: int | None = None) -> DataFrame:
    """Section headings with book names, in the order of the text. Each filter left out: all."""
    for name, value in (("translation_id", version), ("book_id", book_id), ("chapter", chapter)):
        if value is not None:
            headings = headings.where(F.col(name) == value)
    own = headings.select("id", "translation_id", "book_id", "chapter", "before_verse", "ordinal", "text").distinct()
    return own.join(book_names(books), "book_id").orderBy("translation_id", "canonical_order", "chapter", "before_verse", "ordinal", "id")


def words_at(words: DataFrame, entries: DataFrame, reference: Reference | None = None, text_id: str | None = None) -> DataFrame:
    """Word tokens with their lexicon entry, null where they have none. Without a reference: of all verses."""
    if reference is not None:
        words = words.where(reference.predicate())
    if text_id is not None:
        words = words.where(F.col("text_id") == text_id)
    entry = entries.select("strongs_id", "lemma", "transliteration", "gloss").distinct()
    return words.distinct().join(entry, "strongs_id", "left")


def verses_of_word(words: DataFrame, books: DataFrame, strongs_id: str, text_id: str | None = None) -> DataFrame:
    """The distinct coordinates that hold a word."""
    own = words.where(F.col("strongs_id") == strongs_id)
    if text_id is not None:
        own = own.where(F.col("text_id") == text_id)
    return own.select(*COORDINATE).distinct().join(book_names(books), "book_id")


def text_of(words: DataFrame) -> DataFrame:
    """the surface forms of each verse record, joined by blanks in order. A verse record bounds the arrays."""
    own = words.select("text_id", *COORDINATE, "position", "surface_form").distinct()
    return own.groupBy("text_id", *COORDINATE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "surface_form"))), lambda w: w["surface_form"]), " ").alias("text")
    )


def journeys_at(journeys: DataFrame, stops: DataFrame, place_id: str) -> DataFrame:
    """Journeys that stop at a place, each with the number of *all* its stops."""
    counted = link_counts(journeys, stops, "journey_id", "journey_id", "stop_count")
    return counted.join(stops.where(F.col("place_id") == place_id), "journey_id", "left_semi")
