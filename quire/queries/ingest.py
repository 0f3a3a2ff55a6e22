"""Queries that send tables through files and back: nested documents, tab-separated and CSV files, JSON lines, and the transforms from raw files.

The files lie in a folder beside the shared checkpoints which is deleted when they are read; the result is cut first. The same rows
are derived in SQL from the tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import constraints, etl, overlays, passages, vectors
from quire.session import cut, scratch
from quire.sources import corpora, sinks
from quire.sources.tables import delivered_once, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def files(sql: str | None = None):
    """Registers a query that gets a folder for its files."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            with scratch(spark) as folder:
                return cut(f(spark, d, folder))

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return run

    return add


def _json(*fields) -> F.Column:
    return F.to_json(F.struct(*fields))


def _catalog(spark, d) -> corpora.BookTable:
    return corpora.catalog_of(table(spark, d, "books"))


def _known(df: DataFrame, catalog: corpora.BookTable, column: str) -> DataFrame:
    return df.join(catalog.books.select(F.col("id").alias(column)), column, "left_semi")


# -- A1, N6, B5, G3: version files -----------------------------------------------------
def _versions(spark, d, folder):
    catalog = _catalog(spark, d)
    verses = _known(table(spark, d, "verses", "translation_id", "book_id", "chapter", "verse", "text").distinct(), catalog, "book_id")
    chapters = verses.groupBy("translation_id", "book_id", "chapter").agg(F.max("verse").alias("last"))
    titles = F.array(F.struct(F.lit(1).alias("ordinal"), F.col("last").alias("before_verse"), F.concat(F.lit(" On "), "book_id").alias("text")), F.struct(F.lit(2).alias("ordinal"), F.lit(1).alias("before_verse"), F.lit("Start").alias("text")))
    headings = chapters.select("translation_id", "book_id", "chapter", F.explode(titles).alias("h")).select("translation_id", "book_id", "chapter", "h.*")
    sinks.write_documents(etl.version_lines(verses, catalog.books, headings), folder, "translation_id", ["canonical_order", "chapter"])
    return corpora.versions(spark, [folder], catalog)


@files("SELECT DISTINCT translation_id, book_id, chapter, verse, trim(text) AS text FROM verses WHERE book_id IN (SELECT id FROM books)")
def a1_version_files(spark, d, folder):
    """One nested document a version, streamed to its file and read by the scan with its checks."""
    return _versions(spark, d, folder)[1].select("translation_id", "book_id", "chapter", "verse", "text")


@files(
    """WITH c AS (SELECT translation_id, book_id, chapter, max(verse) AS l FROM verses WHERE book_id IN (SELECT id FROM books) GROUP BY ALL)
    SELECT translation_id, book_id, chapter, l AS before_verse, 'On ' || book_id AS text, 1 AS ordinal FROM c UNION ALL SELECT translation_id, book_id, chapter, 1, 'Start', 2 FROM c"""
)
def a1_version_headings(spark, d, folder):
    """Ordinals of headings by their place in the array, whatever verse they stand before."""
    return _versions(spark, d, folder)[2].select("translation_id", "book_id", "chapter", "before_verse", "text", "ordinal")


# -- A2: cross references --------------------------------------------------------------
# Every fifth id has a range into the next chapter, which is cut to its first verse.
_EDGES = "votes IS NOT NULL AND to_verse_start >= 1 AND from_book_id IN (SELECT id FROM books) AND to_book_id IN (SELECT id FROM books)"


@files(f"SELECT from_book_id, from_chapter, from_verse, to_book_id, to_chapter, to_verse_start, CASE WHEN id % 5 <> 0 THEN to_verse_end END AS to_verse_end, votes, count(*) AS n FROM (SELECT DISTINCT * FROM cross_references) WHERE {_EDGES} GROUP BY ALL")
def a2_cross_reference_files(spark, d, folder):
    back, _ = _edge_files(spark, d, folder)
    return back.groupBy(*back.columns).agg(F.count("*").alias("n"))


@files(f"SELECT count(*) AS clamped FROM (SELECT DISTINCT * FROM cross_references) WHERE id % 5 = 0 AND {_EDGES}")
def a2_clamped_ranges(spark, d, folder):
    return _edge_files(spark, d, folder)[1]


def _edge_files(spark, d, folder):
    catalog = _catalog(spark, d)
    edges = table(spark, d, "cross_references").where("votes is not null and to_verse_start >= 1").distinct()
    edges = _known(_known(edges, catalog, "from_book_id"), catalog, "to_book_id")
    token = lambda b, c, v: F.concat_ws(".", b, F.col(c).cast("string"), F.col(v).cast("string"))
    beyond = F.concat_ws(".", "to_book_id", (F.col("to_chapter") + 1).cast("string"), F.lit("1"))
    last = F.when(F.col("id") % 5 == 0, F.concat(F.lit("-"), beyond)).when(F.col("to_verse_end").isNotNull(), F.concat(F.lit("-"), token("to_book_id", "to_chapter", "to_verse_end"))).otherwise("")
    out = f"{folder}/edges"
    edges.select(token("from_book_id", "from_chapter", "from_verse").alias("a"), F.concat(token("to_book_id", "to_chapter", "to_verse_start"), last).alias("b"), "votes").write.option("sep", "\t").option("header", True).csv(out)
    return corpora.cross_references(spark, out, catalog)


# -- A5, G1, G2: notes -----------------------------------------------------------------
# Notes are documents with a book; file 1 lies under a hidden name, file 2 in a second directory.
_NOTES = """WITH n AS (SELECT DISTINCT doc_id, book_id, text, (doc_id % 3)::INT AS file FROM documents WHERE doc_type = 'note' AND trim(text, chr(32)) <> '' AND book_id IN (SELECT id FROM books)),
  o AS (SELECT doc_id, row_number() OVER (ORDER BY file, doc_id) AS id, book_id, (1 + doc_id % 4)::INT AS verse,
    coalesce(CASE WHEN doc_id % 7 = 0 THEN 50::INT END, row_number() OVER (PARTITION BY file, book_id, 1 + doc_id % 4 ORDER BY doc_id))::INT AS ordinal, text FROM n),
  r AS (SELECT DISTINCT id, note_id, to_book_id, to_chapter, to_verse_start, CASE WHEN to_verse_end >= to_verse_start THEN to_verse_end END AS to_verse_end FROM note_cross_references WHERE to_book_id IN (SELECT id FROM books) AND to_verse_start >= 1)
"""


def _note_files(spark, d, folder):
    catalog = _catalog(spark, d)
    notes = table(spark, d, "documents", "doc_id", "book_id", "doc_type", "text").where("doc_type = 'note' and trim(text) <> ''").distinct()
    notes = _known(notes, catalog, "book_id")
    refs = _known(table(spark, d, "note_cross_references", "id", "note_id", "to_book_id", "to_chapter", "to_verse_start", "to_verse_end").where("to_verse_start >= 1").distinct(), catalog, "to_book_id")
    reference = F.struct("id", F.col("to_book_id").alias("book"), F.col("to_chapter").alias("chapter"), F.col("to_verse_start").alias("verse_start"), F.when(F.col("to_verse_end") >= F.col("to_verse_start"), F.col("to_verse_end")).otherwise(-1).alias("verse_end"))
    own = refs.groupBy(F.col("note_id").alias("doc_id")).agg(F.array_sort(F.collect_list(reference)).alias("cross_references"))
    one = F.lit(1)
    item = _json(F.col("book_id").alias("book"), one.alias("chapter"), (1 + F.col("doc_id") % 4).cast("int").alias("verse"), "text", F.when(F.col("doc_id") % 7 == 0, 50).alias("ordinal"), "cross_references")
    rows = notes.join(own, "doc_id", "left").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("number"), item.alias("item")).withColumn("file", F.element_at(F.array(F.lit("notes"), F.lit("_more"), F.lit("a")), F.col("number") + 1))
    lines = etl.document_lines(rows, "file", ["doc_id"], "item", F.lit('{"translation":"EN00","notes":['), F.lit("]}"))
    sinks.write_documents(lines.where("file <> 'a'"), f"{folder}/first", "file", ["doc_id"])
    sinks.write_documents(lines.where("file = 'a'"), f"{folder}/second", "file", ["doc_id"])
    versions = table(spark, d, "verses", "translation_id").distinct().withColumnRenamed("translation_id", "id")
    return corpora.notes(spark, [f"{folder}/first", f"{folder}/second"], catalog, versions)


# By path, "_more" comes before "notes".
_TURN = _NOTES.replace("(doc_id % 3)::INT AS file", "CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS file")


@files(_TURN + "SELECT id, book_id, verse, ordinal, text FROM o")
def a5_note_files(spark, d, folder):
    """Ids count over directories and files, hidden names included."""
    return _note_files(spark, d, folder)[0].select("id", "book_id", "verse", "ordinal", "text")


@files(_TURN + "SELECT o.id AS note_id, r.to_book_id, r.to_chapter, r.to_verse_start, r.to_verse_end, count(*) AS n FROM r JOIN o ON o.doc_id = r.note_id GROUP BY ALL")
def a5_note_references(spark, d, folder):
    refs = _note_files(spark, d, folder)[1].drop("at")
    return refs.groupBy("note_id", "to_book_id", "to_chapter", "to_verse_start", "to_verse_end").agg(F.count("*").alias("n"))


# -- A6: topics ------------------------------------------------------------------------
@files("SELECT DISTINCT place_id AS topic_id, b.id AS book_id, chapter, verse FROM place_verses v JOIN books b ON lower(b.id) = lower(trim(v.book_id)) WHERE verse >= 1 AND chapter >= 1 AND place_id IN (SELECT id FROM places)")
def a6_topic_files(spark, d, folder):
    """Places as topics, a file a type; links to unknown books are skipped."""
    links = table(spark, d, "place_verses", "place_id", "book_id", "chapter", "verse").where("verse >= 1 and chapter >= 1 and book_id is not null").distinct()
    places = table(spark, d, "places", "id", "name", "type").distinct().withColumn("type", F.coalesce("type", F.lit("other")))
    rows = places.join(links.withColumnRenamed("place_id", "id"), "id", "left").withColumn("item", F.when(F.col("verse").isNotNull(), _json(F.col("book_id").alias("book"), "chapter", "verse")))
    head = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"verses":['))
    rows = rows.withColumn("_head", _json("id", F.coalesce("name", F.lit("-")).alias("name"), F.col("type").alias("section"), F.lit(" ").alias("see_also")))
    order = ["id", "book_id", "chapter", "verse"]
    sinks.write_documents(etl.document_lines(rows, "type", order, "item", F.lit('{"source":"places","topics":['), F.lit("]}"), group="id", opening=head, closing=F.lit("]}")), folder, "type", order)
    return corpora.topics(spark, [folder], _catalog(spark, d))[1]


# -- A7, A8: lexicon and tokens ---------------------------------------------------------
_ENTRY = "strongs_id, language, lemma, transliteration, gloss, definition"


@files(f"SELECT DISTINCT {_ENTRY}, 'lexicon' AS source FROM strongs_entries WHERE trim(lemma) <> '' AND trim(gloss) <> '' AND trim(definition) <> '' AND transliteration IS NOT NULL AND strongs_id IS NOT NULL AND language IS NOT NULL")
def a7_lexicon_files(spark, d, folder):
    """Entries in files whose names begin like those of tokens, one of them hidden; a file of tokens lies beside them and is not read."""
    own = table(spark, d, "strongs_entries", *_ENTRY.split(", ")).where("trim(lemma) <> '' and trim(gloss) <> '' and trim(definition) <> '' and transliteration is not null and strongs_id is not null and language is not null").distinct()
    names = F.array(*map(F.lit, ("t", "thayer", "_x", "tokens", "lexicon")))
    rows = own.withColumns({"item": _json(*own.columns), "file": F.element_at(names, (F.pmod(F.xxhash64("strongs_id"), F.lit(5)) + 1).cast("int"))})
    sinks.write_documents(etl.document_lines(rows, "file", ["strongs_id"], "item", F.lit('{"source":"lexicon","entries":['), F.lit("]}")), folder, "file", ["strongs_id"])
    sinks.write_documents(spark.createDataFrame([("tokens-x", 0, '{"text_id":"T","entries":7,"source":[]}')], "file string, at int, line string"), f"{folder}/beside", "file", ["at"])
    corpora.move(spark, f"{folder}/beside/tokens-x.json", f"{folder}/tokens-x.json")
    return corpora.lexicon(spark, [folder])


_WORDS = "SELECT DISTINCT text_id, book_id, chapter, verse, position, surface_form, strongs_id, morph_code FROM word_tokens WHERE trim(surface_form) <> '' AND book_id IN (SELECT id FROM books)"


def _words(spark, d):
    return _known(table(spark, d, "word_tokens").distinct().where("trim(surface_form) <> ''"), _catalog(spark, d), "book_id")


@files(_WORDS)
def a8_token_files(spark, d, folder):
    """Word tokens as one file a text, and back through the scan with its checks."""
    order = [*overlays.COORDINATE, "position"]
    rows = _words(spark, d).withColumns({"item": _json(F.col("book_id").alias("book"), "chapter", "verse", "position", "surface_form", "strongs_id", "morph_code"), "file": F.concat(F.lit("tokens-"), "text_id")})
    head = F.concat(F.lit('{"text_id":"'), "text_id", F.lit('","tokens":['))
    sinks.write_documents(etl.document_lines(rows, "file", order, "item", head, F.lit("]}")), folder, "file", order)
    return corpora.word_tokens(spark, [folder], _catalog(spark, d))[0]


# -- A9: journeys ----------------------------------------------------------------------
_TRIPS = """WITH t AS (SELECT DISTINCT book_id || ' ' || chapter AS journey_id, id, place_id FROM place_verses WHERE book_id IS NOT NULL AND chapter IS NOT NULL AND verse IS NOT NULL AND place_id IN (SELECT id FROM places))
SELECT journey_id, row_number() OVER (PARTITION BY journey_id ORDER BY id)::INT AS ordinal, place_id, 'r' || id AS reference FROM t"""


@files(_TRIPS)
def a9_journey_files(spark, d, folder):
    """The places of a chapter as an itinerary, a file a book."""
    known = table(spark, d, "places", "id").distinct()
    trips = table(spark, d, "place_verses", "book_id", "chapter", "verse", "id", "place_id").dropna(subset=["book_id", "chapter", "verse"]).join(known.withColumnRenamed("id", "place_id"), "place_id", "left_semi").drop("verse").distinct()
    turn = F.row_number().over(Window.partitionBy("book_id", "chapter").orderBy("id"))
    rows = trips.withColumn("turn", turn).withColumn("item", _json(F.col("turn").alias("ordinal"), "place_id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("reference")))
    name = F.concat_ws(" ", "book_id", "chapter")
    text = lambda *names: [F.lit("-").alias(n) for n in names]
    rows = rows.withColumn("_head", _json(name.alias("id"), *text("name", "scripture", "source", "note")))
    head = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"stops":['))
    order = ["chapter", "turn"]
    sinks.write_documents(etl.document_lines(rows, "book_id", order, "item", F.lit('{"journeys":['), F.lit("]}"), group="chapter", opening=head, closing=F.lit("]}")), folder, "book_id", order)
    return corpora.journeys(spark, [folder], known)[1].select("journey_id", "ordinal", "place_id", "reference")


# -- A10, C5: the catalog --------------------------------------------------------------
@files("SELECT id, name || ' ' || id AS name, testament, row_number() OVER (ORDER BY canonical_order, id)::INT AS canonical_order FROM (SELECT DISTINCT id, name, testament, canonical_order FROM books)")
def a10_catalog(spark, d, folder):
    """The book table as Markdown and back; a catalog has a line a book, so it is read on the driver."""
    books = table(spark, d, "books", "id", "name", "testament", "canonical_order").distinct().orderBy("canonical_order", "id").collect()
    text = "\n".join(["| # | id | Name | Testament | Aliases |", "|---|---|---|---|---|", *(f"| {i} | {b.id} | {b.name} {b.id} | {b.testament} | {b.id.lower()}x |" for i, b in enumerate(books, 1))])
    return corpora.book_table(spark, text).books


# -- A11, N1 to N3: raw tab-separated files ------------------------------------------------
_EDITION = "(chapter + verse + position) % 4 <> 0"
_BASE = "CASE WHEN regexp_matches(trim({0}), '^[GH]0*[0-9]+') THEN regexp_replace(regexp_extract(trim({0}), '^[GH]0*[0-9]+'), '^([GH])0*([0-9]+)', '\\1\\2') END"


@files(
    f"""WITH w AS ({_WORDS}), k AS (SELECT * FROM w WHERE {_EDITION} QUALIFY row_number() OVER (PARTITION BY book_id, chapter, verse, position ORDER BY text_id) = 1)
    SELECT book_id, chapter, verse, position, nfc_normalize(trim(surface_form)) AS surface_form, {_BASE.format("strongs_id")} AS strongs_id, nullif(trim(coalesce(morph_code, '')), '') AS morph_code FROM k"""
)
def n1_tagged_greek(spark, d, folder):
    """Words as lines of an edition file a text; the first of a position counts, text after text."""
    own = _words(spark, d)
    ref = F.concat(F.concat_ws(".", "book_id", "chapter", "verse"), F.lit("#"), F.col("position").cast("string"))
    line = F.concat_ws("\t", ref, F.concat("surface_form", F.lit(" (gloss)")), F.lit("-"), F.concat(F.coalesce("strongs_id", F.lit("")), F.lit("="), F.coalesce("morph_code", F.lit(""))), F.lit("-"), F.when(F.expr(_EDITION), "X+SBL").otherwise("X"))
    order = [*overlays.COORDINATE, "position"]
    sinks.write_documents(own.withColumn("line", line), folder, "text_id", order, ".tsv")
    return etl.tagged_greek(corpora.tab_lines(spark, folder, 6), _catalog(spark, d)).where("reason is null").drop("reason")


@files(
    f"""WITH w AS ({_WORDS}), k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY book_id, chapter, verse, position ORDER BY text_id) = 1)
    SELECT book_id, chapter, verse, position, nfc_normalize(trim(surface_form)) AS surface_form, {_BASE.format("strongs_id")} AS strongs_id, coalesce(nullif(trim(morph_code), ''), 'C/') AS morph_code FROM k"""
)
def n2_tagged_hebrew(spark, d, folder):
    """Words with separators between their parts and the morphology of the root."""
    own = _words(spark, d)
    ref = F.concat(F.concat_ws(".", "book_id", "chapter", "verse"), F.lit("#"), F.col("position").cast("string"))
    empty = F.lit("")
    surface = F.concat(F.substring("surface_form", 1, 1), F.lit("/"), F.expr("substring(surface_form, 2)"), F.lit("\\"))
    line = F.concat_ws("\t", ref, surface, empty, empty, F.lit("H9/{H7}"), F.concat(F.lit("C/"), F.coalesce("morph_code", empty)), empty, empty, F.coalesce("strongs_id", empty))
    order = [*overlays.COORDINATE, "position"]
    sinks.write_documents(own.withColumn("line", line), folder, "text_id", order, ".tsv")
    return etl.tagged_hebrew(corpora.tab_lines(spark, folder, 9), _catalog(spark, d)).where("reason is null").drop("reason")


@files(
    """SELECT strongs_id, language, nfc_normalize(trim(lemma)) AS lemma, nfc_normalize(trim(transliteration)) AS transliteration, trim(gloss) AS gloss,
    trim(regexp_replace(definition, '\\s+', ' ', 'g')) AS definition FROM (SELECT DISTINCT strongs_id, language, lemma, transliteration, gloss, definition FROM strongs_entries)
    WHERE trim(lemma) <> '' AND trim(gloss) <> '' AND transliteration IS NOT NULL AND definition IS NOT NULL"""
)
def n3_lexicon_entries(spark, d, folder):
    """Two senses of each entry, the second is dropped."""
    own = table(spark, d, "strongs_entries", *_ENTRY.split(", ")).where("transliteration is not null and definition is not null and lemma is not null and gloss is not null").distinct()
    empty = F.lit("")
    sense = lambda suffix, text: F.concat_ws("\t", F.concat("strongs_id", F.lit(suffix)), empty, empty, "lemma", "transliteration", empty, "gloss", text)
    rows = own.withColumn("line", F.explode(F.array(sense("", F.concat(F.lit("<b>"), "definition", F.lit("</b>"))), sense("B", F.lit("later")))))
    sinks.write_documents(rows, folder, "language", ["strongs_id", "line"], ".tsv")
    found = [etl.lexicon_entries(corpora.tab_lines(spark, f"{folder}/{language}.tsv", 1), language) for language in ("grc", "hbo")]
    return found[0].unionByName(found[1]).where("reason is null").drop("reason")


# -- A12, N4, N5, E16, G4, G6 -----------------------------------------------------------------
# The index knows books of up to three digits and two to five letters; only those come into its entries.
_CODE = "^[1-3]?[A-Za-z]{2,5}$"
_ENTRIES = f"""WITH v AS (SELECT DISTINCT place_id, book_id, chapter, verse FROM place_verses WHERE chapter >= 1 AND verse >= 1 AND regexp_matches(book_id, '{_CODE}') AND book_id IN (SELECT id FROM books)),
p AS (SELECT DISTINCT id, name FROM places WHERE trim(name) <> ''),
e AS (SELECT DISTINCT p.id || ' ' || v.book_id AS position, p.name, v.book_id, v.place_id FROM p JOIN v ON v.place_id = p.id),
s AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM e),
t AS (SELECT *, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY position) > 1 THEN '-' || row_number() OVER (PARTITION BY base ORDER BY position) ELSE '' END AS id FROM s WHERE base <> '')
"""


@files(_ENTRIES + "SELECT DISTINCT t.id AS topic_id, v.book_id, v.chapter, v.verse FROM t JOIN v ON v.place_id = t.place_id AND v.book_id = t.book_id")
def n4_topical_index(spark, d, folder):
    """An entry a place and book, in which only the first reference names its book."""
    catalog = _catalog(spark, d)
    links = table(spark, d, "place_verses", "place_id", "book_id", "chapter", "verse").where(F.col("book_id").rlike(_CODE)).where("chapter >= 1 and verse >= 1").distinct()
    places = table(spark, d, "places", "id", "name").where("trim(name) <> ''").distinct()
    own = places.join(_known(links, catalog, "book_id").withColumnRenamed("place_id", "id"), "id")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("chapter", "verse"))), lambda r: F.concat(r["chapter"].cast("string"), F.lit(":"), r["verse"].cast("string")))
    entry = F.concat(F.lit("in "), "book_id", F.lit(" "), F.array_join("refs", "; "))
    rows = own.groupBy("id", "name", "book_id").agg(refs.alias("refs")).select(F.concat_ws(" ", "id", "book_id").alias("position"), F.lit("A").alias("section"), F.col("name").alias("subject"), entry.alias("entry"))
    rows.write.option("header", True).option("escape", '"').csv(f"{folder}/index")
    records = corpora.csv_records(spark, f"{folder}/index", "position string, section string, subject string, entry string")
    return etl.topical_index(records, catalog)[1]


@files("SELECT DISTINCT v.id, b.id AS book, CASE WHEN b.id IS NULL THEN 'unresolved_book' WHEN trim(v.text) = '' THEN 'empty_text' END AS reason FROM verses v LEFT JOIN (SELECT DISTINCT id, canonical_order FROM books) b ON b.id = v.book_id AND b.canonical_order % 5 <> 0")
def n5_footnotes(spark, d, folder):
    """Footnotes by index of the book, some beyond the catalog."""
    order = table(spark, d, "books", "id", "canonical_order").distinct().withColumnRenamed("id", "book_id")
    index = F.when(F.col("canonical_order") % 5 == 0, 999_999).otherwise(F.coalesce("canonical_order", F.lit(999_999)))
    records = table(spark, d, "verses", "id", "book_id", "text").distinct().join(order, "book_id", "left").select("id", "text", index.alias("book_index"))
    return etl.footnotes(records, _catalog(spark, d).books).select("id", "book", "reason")


# -- N7, G8, J14, B6: fused headings -----------------------------------------------------------
_FUSED = """WITH v AS (SELECT DISTINCT translation_id, book_id, chapter, verse FROM verses), m AS (SELECT translation_id, book_id, chapter, max(verse) AS l FROM v GROUP BY ALL), c AS (SELECT *, lead(chapter) OVER (PARTITION BY translation_id, book_id ORDER BY chapter) AS following FROM m),
f AS (SELECT v.*, 'The Road of ' || CASE WHEN translation_id = 'EN00' THEN 'Reeds' ELSE 'Stones' END AS heading, verse + 1 <= l AS fits, following FROM v JOIN c USING (translation_id, book_id, chapter) WHERE verse % 7 = 0)
"""


def _repaired(spark, d):
    verses = table(spark, d, "verses", "translation_id", "book_id", "chapter", "verse").distinct()
    title = F.concat(F.lit(" The Road of "), F.when(F.col("translation_id") == "EN00", "Reeds").otherwise("Stones"))
    return etl.repaired_headings(verses.withColumn("text", F.concat(F.lit("So it was told."), F.when(F.col("verse") % 7 == 0, title).otherwise(""))))


@files(_FUSED + "SELECT translation_id, book_id, CASE WHEN fits THEN chapter ELSE following END AS chapter, CASE WHEN fits THEN verse + 1 ELSE 1 END AS before_verse, heading AS text FROM f WHERE fits OR following IS NOT NULL")
def n7_headings(spark, d, folder):
    """Headings planted at the ends of verses are cut off and set before the verse after."""
    return _repaired(spark, d)[1]


@files("SELECT DISTINCT translation_id, book_id, chapter, verse, 'So it was told.' AS text FROM verses")
def n7_cleaned(spark, d, folder):
    return _repaired(spark, d)[0]


@files(
    _FUSED
    + """, n AS (SELECT book_id, chapter, verse, heading, count(DISTINCT translation_id) AS n FROM f GROUP BY ALL)
    SELECT 'code,ref,before_verse,heading,corroboration,low_confidence,skipped' AS value UNION ALL
    SELECT translation_id || ',' || book_id || ' ' || chapter || ':' || verse || ',' || CASE WHEN fits THEN (verse + 1)::VARCHAR WHEN following IS NOT NULL THEN '1' ELSE 'None' END || ',"' || heading || '",' || n || ',' || (n < 2)::INT || ',' || (NOT fits AND following IS NULL)::INT
    FROM f JOIN n USING (book_id, chapter, verse, heading)"""
)
def b6_manifest(spark, d, folder):
    """The manifest's lines, as read from its file."""
    changes = _repaired(spark, d)[2]
    sinks.write_manifest(changes, etl.corroboration(changes), f"{folder}/md", f"{folder}/csv")
    return spark.read.text(f"{folder}/csv")


# -- A3, A4, N8, N9: places ----------------------------------------------------------------------
def _place_files(spark, d, folder):
    """Places as JSON lines: each with an association that has a position, a weaker one north of the equator, and rivers with a stronger one
    that has none."""
    places = table(spark, d, "places", "id", "friendly_id", "type", "confidence_score", "status", "latitude", "longitude").distinct()
    special = F.when(F.col("status") == "symbolic", "nonspecific_place").when(F.col("status") == "multiple", "multiple_locations")
    top = F.coalesce("confidence_score", F.lit(0))
    one = lambda prefix, score: F.struct(F.concat(F.lit(prefix), "id").alias("key"), F.struct(score.cast("string").alias("score"), F.concat(F.lit("n"), "id").alias("name")).alias("value"))
    several = F.array_compact(F.array(one("m", top), F.when(F.col("latitude") > 0, one("w", top - 20)), F.when(F.col("type") == "river", one("z", top + 30))))
    ancient = places.select("id", "friendly_id", F.array("type").alias("types"), F.map_from_entries(several).alias("modern_associations"), F.array(F.struct(F.array(F.struct(special.alias("special"))).alias("resolutions"))).alias("identifications"))
    ancient.write.json(f"{folder}/ancient")
    usable = places.where("not isnan(latitude) and not isnan(longitude) and latitude is not null and longitude is not null")
    position = F.concat_ws(",", "longitude", "latitude").alias("lonlat")
    usable.select(F.concat(F.lit("m"), "id").alias("id"), position).write.json(f"{folder}/modern")
    return corpora.json_lines(spark, f"{folder}/ancient", corpora.PLACES_LINES), corpora.positions(spark, f"{folder}/modern")


@files(
    """WITH p AS (SELECT DISTINCT id, friendly_id, type, confidence_score, status, latitude, longitude FROM places),
q AS (SELECT *, CASE WHEN status IN ('symbolic', 'multiple') THEN status END AS marked, latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AS located,
  coalesce(confidence_score, 0) AS s, coalesce(latitude > 0, false) AS north, coalesce(type = 'river', false) AS river FROM p),
r AS (SELECT *, located AND marked IS NULL AS placed, s + CASE WHEN river THEN 30 ELSE 0 END AS top, CASE WHEN river THEN s WHEN north THEN s - 20 END AS second FROM q)
SELECT id, regexp_replace(friendly_id, '^(.*) [0-9]+$', '\\1', 's') AS name, coalesce(marked, CASE WHEN placed THEN CASE WHEN top < 0 OR coalesce(top >= 100 AND second >= 100 AND second >= 0.8 * top, false) THEN 'disputed' ELSE 'identified' END ELSE 'unknown' END) AS status,
  CASE WHEN placed THEN CASE WHEN top >= 500 THEN 'high' WHEN top >= 100 THEN 'medium' ELSE 'low' END END AS confidence, CASE WHEN placed THEN top END AS confidence_score, CASE WHEN placed THEN 'n' || id END AS modern_name FROM r"""
)
def n8_place_status(spark, d, folder):
    """Status from all associations, position from the best that has one, a near runner-up makes it disputed."""
    return etl.derived_places(*_place_files(spark, d, folder)).select("id", "name", "status", "confidence", "confidence_score", "modern_name")


@files(
    "SELECT DISTINCT place_id, b.id AS book_id, chapter, verse FROM place_verses v JOIN books b ON lower(b.id) = lower(trim(v.book_id)) WHERE verse >= 1 AND chapter >= 1 AND place_id IN (SELECT id FROM places)"
)
def n9_place_links(spark, d, folder):
    """Links by sort key where the book's number has two digits and the id is even, else by name."""
    order = table(spark, d, "books", "id", "canonical_order").distinct().withColumnRenamed("id", "book_id")
    links = table(spark, d, "place_verses", "id", "place_id", "book_id", "chapter", "verse").where("verse >= 1 and chapter >= 1").distinct().join(order, "book_id", "left")
    number = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    key = F.when((F.col("id") % 2 == 0) & (F.col("canonical_order") <= 99) & (F.col("chapter") <= 999) & (F.col("verse") <= 999), F.concat(number("canonical_order", 2), number("chapter", 3), number("verse", 3)))
    name = F.when(F.col("id") % 2 == 1, F.concat_ws(".", "book_id", "chapter", "verse")).when(key.isNull(), F.concat_ws(".", "book_id", "chapter", "verse")).otherwise("x")
    # a line a place and book, so that no array holds a whole place
    lines = links.groupBy(F.col("place_id").alias("id"), "book_id").agg(F.collect_list(F.struct(key.alias("sort"), name.alias("osis"))).alias("verses")).drop("book_id")
    lines.write.json(f"{folder}/links")
    read = corpora.json_lines(spark, f"{folder}/links", corpora.PLACES_LINES)
    return etl.place_links(read, table(spark, d, "places", "id").distinct(), _catalog(spark, d))[0]


# -- B1, C9: build and start-up ---------------------------------------------------------------------
_BUILT = ("books", "verses", "cross_references", "places")


@files(" UNION ALL ".join([*(f"SELECT '{n}' AS name, count(*) AS n_rows FROM (SELECT DISTINCT * FROM {n})" for n in _BUILT), "SELECT 'translations', count(DISTINCT translation_id) FROM verses"]))
def c9_startup(spark, d, folder):
    """The tables built in order, then checked as at start-up."""
    tables = {n: delivered_once(table(spark, d, n)) for n in _BUILT}
    tables["translations"] = table(spark, d, "verses", "translation_id").distinct().withColumnRenamed("translation_id", "id")
    sinks.build(tables, folder)
    return spark.createDataFrame(list(constraints.verify(spark, folder, "EN00").items()), "name string, n_rows long")


# -- B4, A15, C8, L2 -----------------------------------------------------------------------------------
def _store(spark, d, folder) -> tuple[vectors.Store, vectors.Embedder]:
    embedder = vectors.HashingEmbedder(32)
    texts = table(spark, d, "verses", "id", "translation_id", *overlays.COORDINATE, "text").where("translation_id = 'EN00'").drop("translation_id").distinct()
    vectors.write_store(texts, [*overlays.COORDINATE, "id"], "text", embedder, folder, model="trigrams", revision="1")
    return vectors.Store(spark, folder, embedder, [*overlays.COORDINATE, "id"]), embedder


@files("SELECT DISTINCT id, book_id, chapter, verse, 32 AS dim, 1.0::DOUBLE AS length FROM verses WHERE translation_id = 'EN00' AND text IS NOT NULL")
def b4_embedding_store(spark, d, folder):
    """Every text of a version embedded (by the stand-in), stored and loaded again: vectors of length one."""
    store, _ = _store(spark, d, folder)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    found = cut(store.ordered().select("id", *overlays.COORDINATE, F.size("vector").alias("dim"), F.round(length, 5).alias("length")))
    store.rows.unpersist()
    return found


@files("SELECT * FROM (VALUES ('model', 'trigrams', 'trigrams', true), ('dim', '32', '64', false), ('normalized', 'true', 'True', true)) t(name, found, expected, fits)")
def c8_vector_guard(spark, d, folder):
    """What the store says of itself against what is expected."""
    store, _ = _store(spark, d, folder)
    store.rows.unpersist()
    return vectors.guard_report(spark.read.parquet(f"{folder}/meta.parquet"), {"model": "trigrams", "dim": 64, "normalized": True})


@files()
def l2_semantic_search(spark, d, folder):
    """L2, L4: a query in words over the resident store; checked against numpy in the tests."""
    store, _ = _store(spark, d, folder)
    found = cut(store.search("the feast of the shepherd", 20, min_score=0.1).select("id", F.round("score", 6).alias("score")))
    store.rows.unpersist()
    return found


# -- J6, J7, J13 ----------------------------------------------------------------------------------------
@files("SELECT DISTINCT id, nfc_normalize(text) AS text FROM verses")
def j6_nfc(spark, d, folder):
    return table(spark, d, "verses", "id", "text").distinct().select("id", scalars.nfc(F.col("text")).alias("text"))


@files("SELECT DISTINCT text_id, position, surface_form, trim(surface_form) AS bare FROM word_tokens WHERE position > 0 AND surface_form IS NOT NULL AND surface_form NOT LIKE '%(%'")
def j7_without_gloss(spark, d, folder):
    own = table(spark, d, "word_tokens", "text_id", "position", "surface_form").where("position > 0 and surface_form not like '%(%'").distinct()
    return own.withColumn("bare", scalars.without_separators(scalars.without_gloss(F.concat("surface_form", F.lit(" (/"), F.col("position").cast("string"), F.lit(") ")))))


@files("SELECT * FROM (VALUES ('EN00', 1), ('DE00', 2)) t(id, position)")
def j13_resolve_ids(spark, d, folder):
    """Ids as asked for, each once, checked against the versions there are."""
    known = sorted(r[0] for r in table(spark, d, "verses", "translation_id").distinct().collect())
    return spark.createDataFrame([(v, i) for i, v in enumerate(passages.resolve_ids(" en00, de00 ,EN00", known, "EN00"), 1)], "id string, position int")
