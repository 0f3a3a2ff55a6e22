"""Queries of the passage, overlay, aggregate, window, scalar, search and vector operators, by operator id, over whole tables.

Names begin with the operator's id. Repeated deliveries of a row count once everywhere. Arrays are joined to texts, so that results can be
compared by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import constraints, overlays, passages, textindex, vectors
from quire.plans.reference import AliasResolver, parse_reference
from quire.plans.textquery import latin_folds
from quire.session import derived
from quire.sources.tables import delivered_once, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VERSIONS = ("DE00", "EL00", "EN00", "RU00")
COORDINATE = overlays.COORDINATE


def query(sql: str | None = None):
    """Registers a query under its name, with SQL for the same result."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def once(*names: str) -> str:
    """CTEs ``d_<table>`` with repeated deliveries counted once."""
    return "WITH " + ", ".join(f"d_{n} AS (SELECT DISTINCT * FROM {n})" for n in names) + " "


def at(spark: SparkSession, d: str, text: str):
    return parse_reference(text, AliasResolver.from_tables(table(spark, d, "books", "id", "name")))


# -- passages ---------------------------------------------------------------------
_VERSE = "translation_id, book_id, chapter, verse, text"
_BOOK = "book_id = 'AAA'"
CROSS = "((chapter > 1 OR (chapter = 1 AND verse >= 30)) AND (chapter < 2 OR (chapter = 2 AND verse <= 9)))"


def _span(name: str, reference: str, predicate: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return passages.in_order(passages.verses_of(table(spark, d, "verses"), at(spark, d, reference), VERSIONS))

    QUERIES[name] = f
    SQL[name] = f"SELECT DISTINCT {_VERSE} FROM verses WHERE {_BOOK} AND {predicate}"


_span("d2_span_chapter", "Book of Thresholds 1-2", "chapter BETWEEN 1 AND 2")
_span("d2_span_same", "Book of Thresholds 1:5-12", "chapter = 1 AND verse BETWEEN 5 AND 12")
_span("d2_span_cross", "Book of Thresholds 1:30-2:9", CROSS)
_span("d3_span_or", "Book of Thresholds 1:3,9,4,3", "chapter = 1 AND verse IN (3, 4, 9)")
_span("m_point", "aaa 2.7", "chapter = 2 AND verse = 7")


@query(f"SELECT DISTINCT {_VERSE} FROM verses WHERE {_BOOK} AND chapter = 1 AND translation_id IN ('EN00', 'DE00')")
def d4_versions(spark, d):
    return passages.verses_of(table(spark, d, "verses"), at(spark, d, "AAA 1"), ("EN00", "DE00"))


@query(f"SELECT count(*) > 0 AS found FROM verses WHERE {_BOOK} AND {CROSS}")
def d9_exists(spark, d):
    return table(spark, d, "verses").where(at(spark, d, "AAA 1:30-2:9").predicate()).limit(1).agg((F.count("*") > 0).alias("found"))


@query("SELECT DISTINCT id, chapter, verse, text FROM verses v WHERE EXISTS (SELECT 1 FROM place_verses p WHERE p.book_id = v.book_id AND p.chapter = v.chapter AND p.verse = v.verse)")
def d5_row_value_in(spark, d):
    return passages.among(table(spark, d, "place_verses"), table(spark, d, "verses"), COORDINATE).select("id", "chapter", "verse", "text").distinct()


@query("SELECT DISTINCT id, name, type, status FROM places WHERE lower(name) LIKE '%dul%'")
def d6_like_ci(spark, d):
    return overlays.listed(table(spark, d, "places", "id", "name", "type", "status"), ["name"], " DUL ")


@query("SELECT DISTINCT strongs_id, lemma, gloss FROM strongs_entries WHERE language = 'grc' AND (lemma LIKE '%or%' OR lower(transliteration) LIKE '%or%' OR lower(gloss) LIKE '%or%')")
def d7_like_any(spark, d):
    return overlays.listed(table(spark, d, "strongs_entries", "strongs_id", "language", "lemma", "transliteration", "gloss"), ["lemma", "transliteration", "gloss"], "or", language="grc").select("strongs_id", "lemma", "gloss").distinct()


@query("SELECT DISTINCT type, status FROM places WHERE type IS NOT NULL ORDER BY ALL")
def h6_sorted_distinct(spark, d):
    return table(spark, d, "places", "type", "status").where("type is not null").distinct().orderBy("type", "status")


@query(
    once("verses")
    + ", ".join(["SELECT book_id, chapter, verse"] + [f"min(CASE WHEN translation_id = '{v}' THEN text END) AS {v}" for v in VERSIONS])
    + f" FROM d_verses WHERE {_BOOK} AND {CROSS} GROUP BY book_id, chapter, verse"
)
def f10_parallel_pivot(spark, d):
    return passages.parallel(passages.verses_of(table(spark, d, "verses"), at(spark, d, "AAA 1:30-2:9"), VERSIONS), VERSIONS)


@query(once("verses") + f"SELECT translation_id, count(*) AS n, string_agg(chapter || ':' || verse || ' ' || text, ' | ' ORDER BY chapter, verse, text) AS verses FROM d_verses WHERE {_BOOK} GROUP BY 1")
def f9_grouped(spark, d):
    g = passages.grouped(passages.verses_of(table(spark, d, "verses"), at(spark, d, "AAA 1-2")), VERSIONS)
    line = F.transform("verses", lambda v: F.concat(v["chapter"].cast("string"), F.lit(":"), v["verse"].cast("string"), F.lit(" "), v["text"]))
    return g.select("translation_id", F.size("verses").cast("long").alias("n"), F.array_join(line, " | ").alias("verses"))


@query(
    once("verses")
    + ", ".join(["SELECT book_id, chapter, verse"] + [f"min(CASE WHEN translation_id = '{v}' THEN text END) AS {v}" for v in VERSIONS])
    + " FROM d_verses GROUP BY book_id, chapter, verse"
)
def f10_parallel_pivot_all(spark, d):
    return passages.parallel(delivered_once(table(spark, d, "verses")), VERSIONS)


@query(once("verses") + "SELECT translation_id, book_id, chapter, count(*) AS n, string_agg(verse || ' ' || text, ' | ' ORDER BY verse, text) AS verses FROM (SELECT DISTINCT translation_id, book_id, chapter, verse, text FROM d_verses) GROUP BY ALL")
def f9_grouped_all(spark, d):
    g = passages.grouped_chapters(table(spark, d, "verses", "translation_id", *COORDINATE, "text").distinct())
    line = F.transform("verses", lambda v: F.concat(v["verse"].cast("string"), F.lit(" "), v["text"]))
    return g.select("translation_id", "book_id", "chapter", F.size("verses").cast("long").alias("n"), F.array_join(line, " | ").alias("verses"))


@query(once("verses", "books") + "SELECT v.id, b.name AS book_name, b.canonical_order, v.chapter, v.verse, v.text FROM d_verses v JOIN d_books b ON b.id = v.book_id WHERE v.translation_id = 'EN00'")
def a14_whole_version(spark, d):
    return passages.whole_version(table(spark, d, "verses"), table(spark, d, "books"), "EN00").select("id", "book_name", "canonical_order", "chapter", "verse", "text")


@query()
def h4_random(spark, d):
    return passages.random_verse(table(spark, d, "verses"), table(spark, d, "books"), "EN00", testament="OT").select("id", "book_id", "chapter", "verse", "text")


# -- overlays -----------------------------------------------------------------------
_TARGET = "t.name || ' ' || x.to_chapter || ':' || x.to_verse_start || CASE WHEN x.to_verse_end IS NOT NULL AND x.to_verse_end <> x.to_verse_start THEN '-' || x.to_verse_end ELSE '' END"
_XREFS = f"FROM d_cross_references x JOIN d_books f ON f.id = x.from_book_id JOIN d_books t ON t.id = x.to_book_id WHERE x.from_book_id = 'AAA' AND x.from_chapter = 1 AND x.from_verse BETWEEN 1 AND 5 AND x.votes >= 2"


def _cross_references(spark, d):
    where = at(spark, d, "AAA 1:1-5").predicate("from_book_id", "from_chapter", "from_verse")
    return overlays.cross_references_of(table(spark, d, "cross_references"), table(spark, d, "books"), where, min_votes=2)


@query(once("cross_references", "books") + f"SELECT x.id, f.name AS from_name, {_TARGET} AS target, x.votes {_XREFS}")
def e4_double_dim(spark, d):
    return _cross_references(spark, d).select("id", "from_name", "target", "votes")


@query(
    once("cross_references", "books")
    + f"SELECT x.id, {_TARGET} AS target, x.votes {_XREFS} ORDER BY x.votes DESC, x.from_chapter, x.from_verse, t.canonical_order, x.to_chapter, x.to_verse_start NULLS FIRST, x.to_verse_end NULLS FIRST, x.id LIMIT 20 OFFSET 10"
)
def h3_page(spark, d):
    return passages.page(_cross_references(spark, d), *overlays.cross_reference_order(), limit=20, offset=10).rows.select("id", "target", "votes")


@query(once("cross_references", "books") + f"SELECT count(*) AS total {_XREFS}")
def f4_total(spark, d):
    return _cross_references(spark, d).agg(F.count("*").alias("total"))


# The same over whole tables: the votes are the only filter.
_ALL_XREFS = "FROM d_cross_references x JOIN d_books f ON f.id = x.from_book_id JOIN d_books t ON t.id = x.to_book_id WHERE x.votes >= 2"


def _all_cross_references(spark, d):
    return overlays.cross_references_of(table(spark, d, "cross_references"), table(spark, d, "books"), min_votes=2)


@query(once("cross_references", "books") + f"SELECT x.id, f.name AS from_name, {_TARGET} AS target, x.votes {_ALL_XREFS}")
def e4_double_dim_all(spark, d):
    return _all_cross_references(spark, d).select("id", "from_name", "target", "votes")


@query(
    once("cross_references", "books")
    + f"SELECT x.id, {_TARGET} AS target, x.votes {_ALL_XREFS} ORDER BY x.votes DESC, x.from_chapter, x.from_verse, t.canonical_order, x.to_chapter, x.to_verse_start NULLS FIRST, x.to_verse_end NULLS FIRST, x.id LIMIT 20 OFFSET 10"
)
def h3_page_all(spark, d):
    return passages.page(_all_cross_references(spark, d), *overlays.cross_reference_order(), limit=20, offset=10).rows.select("id", "target", "votes")


@query(once("cross_references", "books") + f"SELECT count(*) AS total {_ALL_XREFS}")
def f4_total_all(spark, d):
    return _all_cross_references(spark, d).agg(F.count("*").alias("total"))


_TEXT = "SELECT book_id, chapter, verse, min(text) AS text FROM verses WHERE translation_id = 'EN00' GROUP BY ALL"


@query(once("place_verses") + f", t AS ({_TEXT}) SELECT p.id, p.place_id, p.book_id, p.chapter, p.verse, t.text FROM d_place_verses p LEFT JOIN t USING (book_id, chapter, verse)")
def e14_hydrate(spark, d):
    return overlays.hydrated(delivered_once(table(spark, d, "place_verses")), table(spark, d, "verses"), "EN00").select("id", "place_id", *COORDINATE, "text")


@query(
    once("documents", "note_cross_references", "books")
    + """SELECT n.doc_id, n.book_id, coalesce((SELECT string_agg(r.id || '>' || b.name || ' ' || r.to_chapter || ':' || r.to_verse_start, ', ' ORDER BY r.id)
      FROM d_note_cross_references r JOIN d_books b ON b.id = r.to_book_id WHERE r.note_id = n.doc_id), '') AS refs FROM d_documents n WHERE n.doc_type = 'note'"""
)
def e5_nested_notes(spark, d):
    names = overlays.book_names(table(spark, d, "books")).select(F.col("book_id").alias("to_book_id"), "book_name")
    refs = delivered_once(table(spark, d, "note_cross_references")).join(names, "to_book_id")
    notes = table(spark, d, "documents", "doc_id", "book_id", "doc_type").where("doc_type = 'note'").distinct()
    own = overlays.nested(notes, refs.select("note_id", "id", "book_name", "to_chapter", "to_verse_start"), "doc_id", "note_id", ["id", "book_name", "to_chapter", "to_verse_start"], "refs")
    line = F.transform("refs", lambda r: F.concat(r["id"].cast("string"), F.lit(">"), r["book_name"], F.lit(" "), r["to_chapter"].cast("string"), F.lit(":"), r["to_verse_start"].cast("string")))
    return own.select("doc_id", "book_id", F.array_join(line, ", ").alias("refs"))


@query(once("place_verses", "books") + "SELECT DISTINCT p.place_id, b.name AS book_name, p.chapter, p.verse FROM d_place_verses p JOIN d_books b ON b.id = p.book_id")
def e7_links(spark, d):
    return overlays.links_of(table(spark, d, "place_verses"), table(spark, d, "books"), "place_id").select("place_id", "book_name", "chapter", "verse")


@query(f"SELECT DISTINCT id, name, type FROM places WHERE id IN (SELECT place_id FROM place_verses WHERE {_BOOK} AND chapter BETWEEN 1 AND 40)")
def e8_semi_distinct(spark, d):
    return overlays.entities_at(table(spark, d, "places", "id", "name", "type"), table(spark, d, "place_verses"), "id", "place_id", at(spark, d, "AAA 1-40"))


@query("SELECT DISTINCT id, name, type FROM places WHERE id IN (SELECT place_id FROM place_verses)")
def e8_semi_distinct_all(spark, d):
    return overlays.entities_at(table(spark, d, "places", "id", "name", "type"), table(spark, d, "place_verses", "place_id"), "id", "place_id")


@query(once("word_tokens", "strongs_entries") + "SELECT w.text_id, w.book_id, w.chapter, w.verse, w.position, w.surface_form, w.strongs_id, e.lemma, e.gloss FROM d_word_tokens w LEFT JOIN d_strongs_entries e ON e.strongs_id = w.strongs_id")
def e9_left_lexicon(spark, d):
    return overlays.words_at(table(spark, d, "word_tokens"), table(spark, d, "strongs_entries")).select("text_id", *COORDINATE, "position", "surface_form", "strongs_id", "lemma", "gloss")


@query(once("books") + "SELECT DISTINCT w.strongs_id, b.name AS book_name, w.chapter, w.verse FROM word_tokens w JOIN d_books b ON b.id = w.book_id WHERE w.strongs_id IS NOT NULL")
def e10_word_verses(spark, d):
    words = table(spark, d, "word_tokens", "strongs_id", *COORDINATE).where("strongs_id is not null").distinct()
    return words.join(overlays.book_names(table(spark, d, "books")), "book_id").select("strongs_id", "book_name", "chapter", "verse")


#: Itineraries for the stops operators: the places of a chapter in verse order.
_STOPS = "SELECT DISTINCT book_id || ' ' || chapter AS journey_id, place_id, verse, id FROM place_verses WHERE verse IS NOT NULL AND book_id IS NOT NULL AND chapter IS NOT NULL"


def _stops(spark, d):
    return table(spark, d, "place_verses", "book_id", "chapter", "place_id", "verse", "id").dropna(subset=["verse", "book_id", "chapter"]).select(F.concat_ws(" ", "book_id", "chapter").alias("journey_id"), "place_id", "verse", "id").distinct()


_AT_PLACE = "p AS (SELECT DISTINCT id AS place_id, name, CASE WHEN NOT isnan(latitude) THEN round(latitude, 6) END AS latitude, CASE WHEN NOT isnan(longitude) THEN round(longitude, 6) END AS longitude FROM places)"


@query(f"WITH s AS ({_STOPS}), {_AT_PLACE} SELECT s.journey_id, s.id, s.place_id, p.name, p.latitude, p.longitude FROM s LEFT JOIN p USING (place_id)")
def e11_stops(spark, d):
    found = overlays.stops_of(_stops(spark, d), table(spark, d, "places", "id", "name", "latitude", "longitude"))
    return found.select("journey_id", "id", "place_id", "name", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(f"WITH s AS ({_STOPS}), top AS (SELECT place_id FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT journey_id, count(*) AS stop_count FROM s WHERE journey_id IN (SELECT journey_id FROM s WHERE place_id = (SELECT place_id FROM top)) GROUP BY 1")
def e12_journeys_at(spark, d):
    """The journeys of the place with the most stops, which is asked for first."""
    stops = _stops(spark, d)
    place = stops.groupBy("place_id").count().orderBy(F.desc("count"), "place_id").first()[0]
    return overlays.journeys_at(stops.select("journey_id").distinct(), stops, place)


# Bounds and filters of lookups: the values are checked, then they are predicates.
@query("SELECT DISTINCT id, friendly_id, name, type, CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude, CASE WHEN NOT isnan(longitude) THEN longitude END AS longitude, confidence, confidence_score, status FROM places WHERE type = 'river' AND status = 'identified'")
def d15_places_of_type(spark, d):
    """The short shape of places of a type and status, both checked against what there is."""
    places = table(spark, d, "places", *overlays.SUMMARIES["place"])
    kind, status = overlays.allowed_value(places, "type", " river "), overlays.allowed_value(places, "status", "identified")
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    found = overlays.summary(overlays.listed(places, ["name"], None, type=kind, status=status), "place")
    return found.withColumns({c: number(c) for c in ("latitude", "longitude")}).distinct()


@query("SELECT DISTINCT strongs_id, language, lemma, transliteration, gloss FROM strongs_entries")
def d12_word_summaries(spark, d):
    return overlays.summary(table(spark, d, "strongs_entries"), "word").distinct()


@query("SELECT DISTINCT strongs_id, language, lemma, transliteration, gloss, definition, source FROM strongs_entries WHERE strongs_id = 'G1'")
def d1_word(spark, d):
    """An entry by its id, as asked for."""
    asked = spark.range(1).select(scalars.strongs_route(F.lit(" g0001 "))).first()[0]
    return overlays.lookup(table(spark, d, "strongs_entries"), asked, "strongs_id")


@query("SELECT DISTINCT id, name, url_slug FROM places WHERE url_slug = (SELECT min(url_slug) FROM places) ORDER BY id LIMIT 1")
def d1_place_by_slug(spark, d):
    """A place by id or slug."""
    places = table(spark, d, "places", "id", "name", "url_slug")
    slug = places.agg(F.min("url_slug")).first()[0]
    return overlays.lookup(places.orderBy("id"), slug, "id", "url_slug").select("id", "name", "url_slug")


@query("SELECT DISTINCT strongs_id, CASE WHEN upper(strongs_id) LIKE 'H%' THEN 'OSHB' ELSE 'SBLGNT' END AS text_id FROM strongs_entries")
def d16_default_text(spark, d):
    """Where the verses of a word are looked up if no text is asked for."""
    return table(spark, d, "strongs_entries", "strongs_id").distinct().select("strongs_id", scalars.default_text_of_word(F.col("strongs_id")).alias("text_id"))


#: Chapter headings for the headings operators: one a version and chapter that it has.
_HEADS = "SELECT DISTINCT translation_id || ' ' || book_id || ' ' || chapter AS id, translation_id, book_id, chapter, 1 AS before_verse, 0 AS ordinal, 'Chapter ' || chapter AS text FROM verses"


@query(once("books") + f", h AS ({_HEADS}) SELECT h.id, b.name AS book_name, b.canonical_order, h.chapter, h.text FROM h JOIN d_books b ON b.id = h.book_id WHERE translation_id = 'EN00'")
def e6_headings(spark, d):
    own = table(spark, d, "verses", "translation_id", "book_id", "chapter").distinct()
    heads = own.select(F.concat_ws(" ", "translation_id", "book_id", "chapter").alias("id"), "translation_id", "book_id", "chapter", F.lit(1).alias("before_verse"), F.lit(0).alias("ordinal"), F.concat(F.lit("Chapter "), F.col("chapter").cast("string")).alias("text"))
    return overlays.headings_of(heads, table(spark, d, "books"), "EN00").select("id", "book_name", "canonical_order", "chapter", "text")


@query(f"WITH s AS ({_STOPS}), top AS (SELECT place_id FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT journey_id, count(*) AS stop_count FROM s WHERE journey_id IN (SELECT journey_id FROM s WHERE place_id = (SELECT place_id FROM top)) GROUP BY 1")
def f7_correlated_count(spark, d):
    stops = _stops(spark, d)
    top = stops.groupBy("place_id").count().orderBy(F.desc("count"), "place_id").limit(1)
    here = stops.join(top, "place_id", "left_semi").select("journey_id")
    return overlays.link_counts(stops.select("journey_id"), stops, "journey_id", "journey_id", "stop_count").join(here, "journey_id", "left_semi")


@query(once("places", "place_verses") + "SELECT p.id, p.name, count(v.id) AS n_links FROM d_places p LEFT JOIN d_place_verses v ON v.place_id = p.id GROUP BY p.id, p.name")
def f5_link_counts(spark, d):
    return overlays.link_counts(table(spark, d, "places", "id", "name"), table(spark, d, "place_verses"), "id", "place_id")


@query("SELECT strongs_id, count(DISTINCT (book_id, chapter, verse)) AS n_verses FROM word_tokens WHERE strongs_id IS NOT NULL GROUP BY 1")
def f6_word_verse_counts(spark, d):
    return table(spark, d, "word_tokens", "strongs_id", *COORDINATE).where("strongs_id is not null").distinct().groupBy("strongs_id").agg(F.count("*").alias("n_verses"))


# -- aggregates ---------------------------------------------------------------------
@query(once("books") + ", n AS (SELECT book_id, count(DISTINCT chapter)::INT AS n_chapters FROM verses GROUP BY 1) SELECT b.id, b.name, b.chapter_count, n.n_chapters FROM d_books b LEFT JOIN n ON n.book_id = b.id")
def f1_chapter_counts(spark, d):
    return constraints.chapter_counts(table(spark, d, "books", "id", "name", "chapter_count"), table(spark, d, "verses", "book_id", "chapter"))


@query("WITH n AS (SELECT book_id, translation_id, count(DISTINCT chapter) AS n FROM verses GROUP BY ALL) SELECT book_id, min(n) AS least, max(n) AS most FROM n GROUP BY 1 HAVING min(n) <> max(n)")
def c7_agreement(spark, d):
    return constraints.disagreeing_books(table(spark, d, "verses", "book_id", "translation_id", "chapter"))


# As above where a version lacks the last chapter of each book that has several.
@query(
    """WITH v AS (SELECT DISTINCT book_id, translation_id, chapter FROM verses), l AS (SELECT *, max(chapter) OVER (PARTITION BY book_id) AS most FROM v),
    n AS (SELECT book_id, translation_id, count(DISTINCT chapter) AS n FROM l WHERE NOT (translation_id = 'DE00' AND chapter = most AND most > 1) GROUP BY ALL) SELECT book_id, min(n) AS least, max(n) AS most FROM n GROUP BY 1 HAVING min(n) <> max(n)"""
)
def c7_disagreement(spark, d):
    own = table(spark, d, "verses", "book_id", "translation_id", "chapter").distinct()
    last = own.groupBy("book_id").agg(F.max("chapter").alias("most"))
    return constraints.disagreeing_books(own.join(last, "book_id").where("not (translation_id = 'DE00' and chapter = most and most > 1)"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT book_id, chapter, verse FROM verses)")
def f3_distinct_groups(spark, d):
    return table(spark, d, "verses", *COORDINATE).distinct().agg(F.count("*").alias("n"))


@query(once("places") + "SELECT coalesce(type, 'other') AS type, status, count(*) AS n, count(*) FILTER (WHERE confidence = 'high') AS high FROM d_places GROUP BY 1, 2")
def f8_counters(spark, d):
    own = delivered_once(table(spark, d, "places", "id", "type", "status", "confidence"))
    return own.groupBy(F.coalesce("type", F.lit("other")).alias("type"), "status").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("high"))


@query("WITH w AS (SELECT DISTINCT text_id, book_id, chapter, verse, position, surface_form FROM word_tokens) SELECT text_id, book_id, chapter, verse, string_agg(surface_form, ' ' ORDER BY position, surface_form) AS text FROM w GROUP BY ALL")
def f11_join_words(spark, d):
    return overlays.text_of(table(spark, d, "word_tokens"))


@query(
    once("cross_references")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY from_book_id, from_chapter, from_verse ORDER BY votes DESC, id) AS k FROM d_cross_references WHERE votes IS NOT NULL)
    SELECT from_book_id, from_chapter, from_verse, max(CASE WHEN k = 1 THEN id END) AS best, max(CASE WHEN k = 1 THEN votes END) AS top, max(CASE WHEN k = 2 THEN votes END) AS runner_up FROM r WHERE k <= 2 GROUP BY ALL"""
)
def f12_argmax_runner_up(spark, d):
    from_verse = ["from_book_id", "from_chapter", "from_verse"]
    own = table(spark, d, "cross_references", *from_verse, "id", "votes").where("votes is not null").distinct()
    place = Window.partitionBy(*from_verse).orderBy(F.desc("votes"), "id")
    two = own.withColumn("k", F.row_number().over(place)).where("k <= 2")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return two.groupBy(*from_verse).agg(pick("id", 1).alias("best"), pick("votes", 1).alias("top"), pick("votes", 2).alias("runner_up"))


@query(once("verses") + "SELECT book_id, chapter, max(verse) AS last_verse, count(DISTINCT verse) AS n FROM d_verses GROUP BY 1, 2")
def f13_last_verse(spark, d):
    return table(spark, d, "verses", "book_id", "chapter", "verse").groupBy("book_id", "chapter").agg(F.max("verse").alias("last_verse"), F.countDistinct("verse").alias("n"))


_TABLES = ("books", "cross_references", "documents", "note_cross_references", "place_verses", "places", "strongs_entries", "verses", "word_tokens")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM (SELECT DISTINCT * FROM {n})" for n in _TABLES))
def f14_row_counts(spark, d):
    return constraints.row_counts({n: delivered_once(table(spark, d, n)) for n in _TABLES})


# -- windows ------------------------------------------------------------------------
@query("WITH r AS (SELECT DISTINCT id, note_id, to_book_id, to_verse_end FROM note_cross_references) SELECT id, note_id, coalesce(to_verse_end::BIGINT, row_number() OVER (PARTITION BY note_id, to_book_id ORDER BY id)) AS ordinal FROM r")
def g1_default_ordinal(spark, d):
    own = table(spark, d, "note_cross_references", "id", "note_id", "to_book_id", "to_verse_end").distinct()
    place = F.row_number().over(Window.partitionBy("note_id", "to_book_id").orderBy("id"))
    return own.select("id", "note_id", F.coalesce(F.col("to_verse_end").cast("long"), place.cast("long")).alias("ordinal"))


@query("WITH p AS (SELECT DISTINCT id, name FROM places) SELECT id, slug || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS slug FROM (SELECT id, slug, row_number() OVER (PARTITION BY slug ORDER BY id) AS k FROM (SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM p))")
def g4_slug_dedup(spark, d):
    own = table(spark, d, "places", "id", "name").distinct().select("id", scalars.slug(F.col("name")).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    return own.select("id", F.concat("base", F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise("")).alias("slug"))


@query("SELECT from_book_id, from_chapter, from_verse, to_book_id, id, votes FROM (SELECT DISTINCT * FROM cross_references) QUALIFY row_number() OVER (PARTITION BY from_book_id, from_chapter, from_verse, to_book_id ORDER BY id) = 1")
def g5_first_wins(spark, d):
    key = ["from_book_id", "from_chapter", "from_verse", "to_book_id"]
    return passages.first_by(table(spark, d, "cross_references").distinct(), key, F.asc("id")).select(*key, "id", "votes")


@query(once("verses") + "SELECT DISTINCT book_id, chapter, lead(chapter) OVER (PARTITION BY book_id ORDER BY chapter) AS following FROM (SELECT DISTINCT book_id, chapter FROM d_verses)")
def g8_next_chapter(spark, d):
    own = table(spark, d, "verses", "book_id", "chapter").distinct()
    return own.select("book_id", "chapter", F.lead("chapter").over(Window.partitionBy("book_id").orderBy("chapter")).alias("following"))


# Ids G and H with numbers of uneven length: the number decides, not the text.
@query(once("strongs_entries") + "SELECT strongs_id, language, gloss FROM d_strongs_entries ORDER BY language, try_cast(regexp_extract(substr(strongs_id, 2), '^[0-9]+') AS BIGINT), strongs_id LIMIT 100")
def h2_numeric_suffix(spark, d):
    own = delivered_once(table(spark, d, "strongs_entries", "strongs_id", "language", "gloss"))
    return passages.page(own, *overlays.lexicon_order(), limit=100).rows


# -- scalars ------------------------------------------------------------------------
_ORD = "CASE w[1] WHEN 'i' THEN '1' WHEN 'ii' THEN '2' WHEN 'iii' THEN '3' WHEN 'first' THEN '1' WHEN 'second' THEN '2' WHEN 'third' THEN '3' ELSE w[1] END"


@query(f"WITH n AS (SELECT DISTINCT id, list_filter(regexp_split_to_array(replace(replace(replace(lower(name), '.', ''), '''', ''), '’', ''), '\\s+'), lambda x: x <> '') AS w FROM places) SELECT id, CASE WHEN len(w) > 1 THEN {_ORD} || array_to_string(w[2:], '') ELSE coalesce(w[1], '') END AS normal FROM n")
def j1_normalize(spark, d):
    return table(spark, d, "places", "id", "name").distinct().select("id", scalars.normal_name(F.col("name")).alias("normal"))


@query("SELECT DISTINCT id, trim(regexp_replace(lower(friendly_id), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(friendly_id, '^(.*) [0-9]+$', '\\1', 's') AS display FROM places")
def j2_slugify(spark, d):
    return table(spark, d, "places", "id", "friendly_id").distinct().select("id", scalars.slug(F.col("friendly_id")).alias("slug"), scalars.display_name(F.col("friendly_id")).alias("display"))


@query("SELECT DISTINCT strongs_id, regexp_replace(upper(trim(strongs_id)), '^([GH])0*([0-9]+)$', '\\1\\2') AS id FROM word_tokens WHERE strongs_id IS NOT NULL")
def j4_strongs_ids(spark, d):
    return table(spark, d, "word_tokens", "strongs_id").where("strongs_id is not null").distinct().select("strongs_id", scalars.strongs_route(F.col("strongs_id")).alias("id"))


_HTML = "'<b>' || replace(text, chr(10), '<br />') || '</b>__ <i>' || source || '</i>'"


@query(f"SELECT DISTINCT doc_id, trim(regexp_replace(replace(regexp_replace(regexp_replace({_HTML}, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '__', ''), '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL")
def j5_strip_html(spark, d):
    html = F.concat(F.lit("<b>"), F.replace(F.col("text"), F.lit("\n"), F.lit("<br />")), F.lit("</b>__ <i>"), "source", F.lit("</i>"))
    return table(spark, d, "documents", "doc_id", "text", "source").where("text is not null").distinct().select("doc_id", scalars.strip_html(html).alias("plain"))


_SPEC = "verse || ',' || (verse + 2) || '-' || (verse + chapter)"


@query(f"WITH v AS (SELECT DISTINCT id, chapter, verse FROM place_verses WHERE verse IS NOT NULL) SELECT id, CASE WHEN chapter >= 2 THEN array_to_string(list_concat([verse], range(verse + 2, verse + chapter + 1)), ',') END AS verses FROM v")
def j8_expand_spec(spark, d):
    own = table(spark, d, "place_verses", "id", "chapter", "verse").where("verse is not null").distinct()
    spec = F.concat(F.col("verse").cast("string"), F.lit(","), (F.col("verse") + 2).cast("string"), F.lit("-"), (F.col("verse") + F.col("chapter")).cast("string"))
    return own.select("id", F.array_join(scalars.verse_spec(spec).cast("array<string>"), ",").alias("verses"))


@query("SELECT DISTINCT id, CASE WHEN confidence_score >= 500 THEN 'high' WHEN confidence_score >= 100 THEN 'medium' WHEN confidence_score IS NOT NULL THEN 'low' END AS bucket FROM places")
def j10_bucket(spark, d):
    return table(spark, d, "places", "id", "confidence_score").distinct().select("id", scalars.confidence_bucket(F.col("confidence_score")).alias("bucket"))


@query("SELECT DISTINCT doc_id, substr(sha256(text), 1, 32) AS etag FROM documents WHERE text IS NOT NULL")
def j12_etag(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").distinct().select("doc_id", scalars.etag(F.col("text")).alias("etag"))


# -- constraints --------------------------------------------------------------------
@query("SELECT from_book_id, from_chapter, from_verse, to_book_id, to_chapter, count(*) AS n_rows FROM cross_references GROUP BY ALL HAVING count(*) > 1")
def c1_dups(spark, d):
    return constraints.duplicate_keys(table(spark, d, "cross_references"), ["from_book_id", "from_chapter", "from_verse", "to_book_id", "to_chapter"])


@query(once("word_tokens") + "SELECT text_id, book_id, chapter, verse, position, strongs_id FROM d_word_tokens w WHERE strongs_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM strongs_entries e WHERE e.strongs_id = w.strongs_id)")
def c2_fk_anti(spark, d):
    return constraints.missing_parents(delivered_once(table(spark, d, "word_tokens")), ["strongs_id"], table(spark, d, "strongs_entries"), ["strongs_id"]).select("text_id", *COORDINATE, "position", "strongs_id")


@query("SELECT DISTINCT doc_id, lang FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'de', 'el', 'ru', 'fr', 'es', 'he', 'zh', 'ja', 'ar', 'hi', 'am', 'th')")
def c3_enum(spark, d):
    return constraints.outside_values(table(spark, d, "documents", "doc_id", "lang"), "lang", ["en", "de", "el", "ru", "fr", "es", "he", "zh", "ja", "ar", "hi", "am", "th"]).distinct()


@query("SELECT DISTINCT id, CASE WHEN to_verse_start IS NULL THEN 'to_verse_start is missing' WHEN votes IS NULL THEN 'votes is missing' WHEN votes < 1 THEN 'votes is below 1' END AS broken FROM cross_references WHERE to_verse_start IS NULL OR votes IS NULL OR votes < 1")
def c4_broken_rows(spark, d):
    return constraints.broken_rows(table(spark, d, "cross_references", "id", "to_verse_start", "votes"), required=["to_verse_start"], positive=["votes"]).select("id", "broken").distinct()


# -- full text ----------------------------------------------------------------------
@lru_cache(maxsize=1)
def _tokens_sql() -> str:
    a, b = latin_folds()
    return f"regexp_extract_all(lower(translate(text, '{a}', '{b}')), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def _term(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


def fts_sql(name: str, columns: str, phrases: list[str], matched: str, active: list[str], tail: str, alone: list[str] | None = None) -> str:
    """BM25 in SQL. ``phrases``: frequency of each phrase over tokens ``t``; ``matched`` and ``active`` over ``f0, f1, ...``."""
    fs = ", ".join(f"{p} AS f{i}" for i, p in enumerate(phrases))
    als = ", ".join(f"{p} AS a{i}" for i, p in enumerate(alone or phrases))
    dfs = ", ".join(f"count_if(a{i} > 0)::DOUBLE AS df{i}" for i in range(len(phrases)))
    part = lambda i: f"CASE WHEN ({active[i]}) AND f{i} > 0 THEN greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 0.000001::DOUBLE) * (f{i} * 2.2::DOUBLE) / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ELSE 0 END"
    return (
        f"WITH tok AS (SELECT {columns}, coalesce({_tokens_sql()}, []) AS t FROM (SELECT DISTINCT {columns}, text FROM {name})), "
        f"ph AS (SELECT * EXCLUDE (t), len(t)::DOUBLE AS dl, {fs}, {als} FROM tok), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {dfs} FROM ph), "
        f"hit AS (SELECT ph.*, {' + '.join(map(part, range(len(phrases))))} AS score FROM ph, st WHERE {matched}), bk AS (SELECT DISTINCT id AS bid, canonical_order FROM books) {tail}"
    )


_VERSE_COLUMNS = "id, translation_id, book_id, chapter, verse"
_SINGLE = "SELECT id, chapter, verse, round(score, 6) AS score FROM hit JOIN bk ON bid = book_id WHERE translation_id = 'EN00' ORDER BY round(score, 9) DESC, canonical_order, chapter, verse, id LIMIT 50"


def _rows(spark, d):
    return table(spark, d, "verses", "id", "translation_id", "book_id", "chapter", "verse", "text").distinct()


def _index(spark, d, name: str, *columns: str) -> textindex.Index:
    """The stored index of a table, built at the first search of a session."""
    source = f"{d}/{name}.parquet"
    folder = derived(spark, source, "postings", lambda into: textindex.build_index(table(spark, d, name, *columns, "text"), "text", into))
    return textindex.open_index(spark, folder)


def _verses_index(spark, d) -> textindex.Index:
    return _index(spark, d, "verses", "id", "translation_id", "book_id", "chapter", "verse")


def _search(spark, d, text: str):
    names = overlays.book_names(table(spark, d, "books"))
    return _verses_index(spark, d).scored(text).rows.where("translation_id = 'EN00'").join(names, "book_id")


def _k2(name: str, text: str, phrases: list[str], matched: str, active: list[str], alone: list[str] | None = None):
    def f(spark: SparkSession, d: str) -> DataFrame:
        found = _search(spark, d, text)
        return textindex.ranked(found, *map(F.asc, ("canonical_order", "chapter", "verse", "id")), limit=50).select("id", "chapter", "verse", F.round("score", 6).alias("score"))

    QUERIES[name] = f
    SQL[name] = fts_sql("verses", _VERSE_COLUMNS, phrases, matched, active, _SINGLE, alone)


_CLUMP = "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = '{a}' AND len(list_filter(range(1, len(t) + 1), lambda j: t[j] = '{b}' AND abs(i - j) - 1 <= 5)) > 0))"
_k2("k2_search", "shepherd feast", [_term("shepherd"), _term("feast")], "f0 > 0 AND f1 > 0", ["true", "true"])
_k2("k2_phrase", '"after the feast"', ["len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'after' AND t[i + 1] = 'the' AND t[i + 2] = 'feast'))"], "f0 > 0", ["true"])
_k2("k2_prefix", "thresh*", ["len(list_filter(t, lambda x: starts_with(x, 'thresh')))"], "f0 > 0", ["true"])
_k2("k2_near", "NEAR(men near, 5)", [_CLUMP.format(a="men", b="near"), _CLUMP.format(a="near", b="men")], "f0 > 0 AND f1 > 0", ["true", "true"], [_term("men"), _term("near")])
_k2("k2_bool_not", "(lamp AND river) OR beacon NOT feast", [_term("lamp"), _term("river"), _term("beacon"), _term("feast")], "(f0 > 0 AND f1 > 0) OR (f2 > 0 AND f3 = 0)", ["f0 > 0 AND f1 > 0", "f0 > 0 AND f1 > 0", "f2 > 0 AND f3 = 0", "false"])

_MULTI = """, best AS (SELECT book_id, chapter, verse, max(score) AS score, count(*) AS n_matches FROM hit WHERE translation_id IN ('EN00', 'DE00') GROUP BY ALL)
SELECT book_id, chapter, verse, round(score, 6) AS score, n_matches FROM best JOIN bk ON bid = book_id ORDER BY round(score, 9) DESC, canonical_order, chapter, verse LIMIT 50"""


@query(fts_sql("verses", _VERSE_COLUMNS, [_term("turm"), _term("tower")], "f0 > 0 OR f1 > 0", ["f0 > 0", "f1 > 0"], _MULTI))
def k3_search_multi(spark, d):
    names = overlays.book_names(table(spark, d, "books"))
    found = _verses_index(spark, d).scored("turm OR tower").rows.where(F.col("translation_id").isin("EN00", "DE00"))
    best = textindex.best_by_key(found, COORDINATE).join(names, "book_id")
    return textindex.ranked(best, *map(F.asc, ("canonical_order", "chapter", "verse")), limit=50).select(*COORDINATE, F.round("score", 6).alias("score"), "n_matches")


@query(fts_sql("verses", _VERSE_COLUMNS, [_term("turm"), _term("tower")], "f0 > 0 OR f1 > 0", ["f0 > 0", "f1 > 0"], "SELECT count(DISTINCT (book_id, chapter, verse)) AS total FROM hit WHERE translation_id IN ('EN00', 'DE00')"))
def k3_total(spark, d):
    found = _verses_index(spark, d).scored("turm OR tower").rows.where(F.col("translation_id").isin("EN00", "DE00"))
    return found.select(*COORDINATE).distinct().agg(F.count("*").alias("total"))


@query(
    fts_sql(
        "documents", "doc_id, doc_type, lang, book_id", [_term("shekels")], "f0 > 0", ["true"],
        ", names AS (SELECT DISTINCT id AS bid, name AS book_name FROM books) SELECT doc_id, book_name, round(score, 6) AS score FROM hit JOIN bk ON bk.bid = book_id JOIN names ON names.bid = book_id WHERE doc_type = 'note' ORDER BY round(score, 9) DESC, canonical_order, doc_id LIMIT 50",
    )
)
def k4_search_notes(spark, d):
    """Hits of notes with the names of their books, by score and canonical order."""
    index = _index(spark, d, "documents", "doc_id", "doc_type", "lang", "book_id")
    found = index.scored("shekels").rows.where("doc_type = 'note'").join(overlays.book_names(table(spark, d, "books")), "book_id")
    return textindex.ranked(found, F.asc("canonical_order"), F.asc("doc_id"), limit=50).select("doc_id", "book_name", F.round("score", 6).alias("score"))


@query(f"WITH t AS (SELECT id, unnest({_tokens_sql()}) AS term FROM (SELECT DISTINCT id, text FROM verses)) SELECT term, count(*) AS occurrences, count(DISTINCT id) AS n_rows FROM t GROUP BY 1")
def k1_postings_stats(spark, d):
    """The postings are made anew, as they are when an index is built."""
    index = textindex.postings(_rows(spark, d), "id", "text")
    return index.groupBy("term").agg(F.sum(F.size("positions")).alias("occurrences"), F.count("*").alias("n_rows"))


@query()
def k8_snippet(spark, d):
    found = textindex.ranked(_search(spark, d, "shepherd AND (feast OR wall)"), *map(F.asc, ("canonical_order", "chapter", "verse", "id")), limit=50)
    page = found.select("id").join(_rows(spark, d).select("id", "text"), "id")
    return textindex.with_snippet(page, "text", "shepherd AND (feast OR wall)").select("id", "snippet")


@query(fts_sql("verses", _VERSE_COLUMNS, [_term("lamp")], "f0 > 0", ["true"], "SELECT id, round(score, 6) AS score FROM hit"))
def k7_scores_by_scan(spark, d):
    """K7 without an index: one pass over all texts, for tables that are searched once."""
    return textindex.scored(_rows(spark, d), "text", "lamp").rows.select("id", F.round("score", 6).alias("score"))


# -- vectors ------------------------------------------------------------------------
def _store(spark, d):
    return vectors.usable(table(spark, d, "verse_embeddings", "vec_id", *COORDINATE, "vector").dropDuplicates(["vec_id"]), "vector", 64)


def _asked(spark, d) -> list[float]:
    return list(_store(spark, d).orderBy("vec_id").select("vector").first()[0])


_VECTORS = """WITH s AS (SELECT DISTINCT ON (vec_id) vec_id, book_id, chapter, verse, vector::DOUBLE[] AS v FROM verse_embeddings WHERE vector IS NOT NULL AND len(vector) = 64
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
q AS (SELECT v FROM s ORDER BY vec_id LIMIT 1),
r AS (SELECT s.*, round(list_dot_product(s.v, q.v) / sqrt(list_dot_product(s.v, s.v)) / sqrt(list_dot_product(q.v, q.v)), 9) AS cosine FROM s, q)
"""


@query(_VECTORS + "SELECT vec_id, round(cosine, 6) AS score FROM r ORDER BY cosine DESC, vec_id LIMIT 20")
def l1_cosine_topk(spark, d):
    return vectors.cosine_top_k(_store(spark, d), "vector", _asked(spark, d), 20, order=["vec_id"]).select("vec_id", F.round("score", 6).alias("score"))


@query(_VECTORS + "SELECT vec_id, round(cosine, 6) AS score FROM r WHERE cosine >= 0.3 ORDER BY cosine DESC, vec_id LIMIT 200")
def l1_min_score(spark, d):
    return vectors.cosine_top_k(_store(spark, d), "vector", _asked(spark, d), 200, order=["vec_id"], floor=0.3, fast=False).select("vec_id", F.round("score", 6).alias("score"))


@query(_VECTORS + f", t AS ({_TEXT}), best AS (SELECT * FROM r ORDER BY cosine DESC, vec_id LIMIT 20) SELECT b.vec_id, b.book_id, b.chapter, b.verse, round_even(b.cosine, 4) AS score, t.text FROM best b LEFT JOIN t USING (book_id, chapter, verse)")
def l5_semantic_hydrate(spark, d):
    best = vectors.cosine_top_k(_store(spark, d), "vector", _asked(spark, d), 20, order=["vec_id"])
    return overlays.hydrated(best.drop("vector"), table(spark, d, "verses"), "EN00").select("vec_id", *COORDINATE, scalars.round4(F.col("score")).alias("score"), "text")
