"""A: scans of corpus files with explicit schemas. A file that breaks its contract fails the load, with the first offender.

Schemas are never inferred. Each file is parsed once, to a staged table; all checks of a scan are one job over it. Files are read in sorted order; whatever needs a sequence (note ids, ordinals) is numbered by
(directory, file, position), so a rebuild gives the same rows whatever the partitioning.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.errors import ContractError
from quire.functions.scalars import normal_name, osis
from quire.operators.constraints import broken_rows, duplicate_keys, missing_parents, outside_values, require, require_all
from quire.operators.numbering import numbered
from quire.operators.passages import first_by
from quire.session import staged, workspace

# What a note type, a direction and a testament may be.
NOTE_TYPES = ("tn", "sn", "tc", "map", "other")
DIRECTIONS = ("ltr", "rtl")
TESTAMENTS = ("OT", "NT", "DC")

VERSION_FILE = """code string, name string, language string, copyright string, direction string,
  books array<struct<abbreviation string, name string, order_index int, chapters array<struct<number int,
    verses array<struct<number int, text string>>, headings array<struct<before_verse int, text string>>>>>>"""
NOTES_FILE = """translation string, notes array<struct<book string, chapter int, verse int, text string, type string, char_offset int,
  marker string, ordinal int, cross_references array<struct<book string, chapter int, verse_start int, verse_end int>>>>"""
TOPICS_FILE = "source string, topics array<struct<id string, name string, section string, see_also string, verses array<struct<book string, chapter int, verse int>>>>"
LEXICON_FILE = "source string, entries array<struct<strongs_id string, language string, lemma string, transliteration string, gloss string, definition string>>"
TOKENS_FILE = "text_id string, tokens array<struct<book string, chapter int, verse int, position int, surface_form string, strongs_id string, morph_code string>>"
JOURNEYS_FILE = "journeys array<struct<id string, name string, scripture string, dating string, source string, note string, stops array<struct<ordinal int, place_id string, reference string>>>>"
PLACES_LINES = """id string, friendly_id string, url_slug string, preceding_article string, types array<string>,
  modern_associations map<string, struct<score: string, name: string, url_slug: string>>,
  identifications array<struct<resolutions array<struct<special string>>>>, verses array<struct<sort string, osis string>>"""
POSITIONS_LINES = "id string, lonlat string"


def other_names(prefix: str) -> str:
    """A glob for the names of JSON files that do not begin with ``prefix``: those that end within it, and those that leave it at some letter."""
    leaves = [f"{prefix[:i]}[^{ch}]*" for i, ch in enumerate(prefix)]
    return "{" + ",".join([*(prefix[:i] for i in range(1, len(prefix))), *leaves]) + "}.json"


def _hidden(spark: SparkSession, directory: str, pattern: str, target: str) -> str | None:
    """Files of ``directory`` whose names begin with ``_`` or a period, which Spark's readers pass over, copied to ``target`` under names that
    they read (an ``h`` in front); None if there are none. They are listed on the driver, as Spark lists a directory itself."""
    jvm = spark.sparkContext._jvm
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path
    where = path(directory)
    fs = where.getFileSystem(conf)
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return None
    found = fs.globStatus(path(where, "[_.]*.json"), jvm.org.apache.hadoop.fs.GlobFilter(pattern))
    for status in found:
        own = status.getPath()
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, own, path(target).getFileSystem(conf), path(target, f"h{own.getName()}"), False, conf)
    return fs.makeQualified(where).toString() if len(found) else None


def move(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        raise OSError(f"cannot move {source} to {target}")


def json_documents(spark: SparkSession, dirs: Sequence[str], schema: str, pattern: str = "*.json") -> DataFrame:
    """One row a file of the directories (I2), with ``dir_rank`` and ``path``. Unreadable JSON or a value of another type fails. Missing or
    empty directories have no rows. Files that Spark takes for hidden (``_x.json``) are read too. The files are parsed once: what is returned
    reads a staged table."""
    found = []
    reader = lambda: spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", pattern)
    for rank, directory in enumerate(dirs):
        try:
            found.append(reader().json(directory).withColumn("path", F.col("_metadata.file_path")).withColumn("dir_rank", F.lit(rank)))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        copies = f"{workspace(spark)}/hidden-{uuid.uuid4().hex}"
        if own := _hidden(spark, directory, pattern, copies):
            name = F.concat(F.lit(f"{own}/"), F.expr("substring(_metadata.file_name, 2)"))
            found.append(reader().option("pathGlobFilter", "*.json").json(copies).withColumn("path", name).withColumn("dir_rank", F.lit(rank)))
    if not found:
        return spark.createDataFrame([], f"{schema}, path string, dir_rank int")
    return staged(reduce(DataFrame.unionByName, found))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A3: one object a line; blank lines are skipped, anything else that is no object fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


@dataclass(frozen=True)
class BookTable:
    """The book catalog: ``books(id, name, testament, canonical_order)`` and ``aliases(alias, book_id)``, aliases in normal form."""

    books: DataFrame
    aliases: DataFrame

    def resolve(self, df: DataFrame, column: str, into: str = "book_id") -> DataFrame:
        """``df`` with the id of the book that ``column`` names, null if none does. The catalog has a row a name; its measured size decides how it is joined."""
        keys = self.aliases.select(F.col("alias").alias("_alias"), F.col("book_id").alias(into))
        return df.withColumn("_alias", normal_name(F.col(column))).join(keys, "_alias", "left").drop("_alias")


def book_table(spark: SparkSession, text: str) -> BookTable:
    """The catalog from a Markdown table ``| # | id | name | testament | aliases |``, validated. It is small by
    nature, so it is read on the driver."""
    rows, aliases = [], {}
    for line in text.splitlines():
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if len(cells) != 5 or not line.lstrip().startswith("|") or not cells[0].isdigit():
            continue
        order, book, name, testament, names = int(cells[0]), *cells[1:]
        if not (len(book) == 3 and book.isalnum() and book == book.upper()) or testament not in TESTAMENTS:
            raise ContractError(f"book row {line!r}")
        rows.append((book, name, testament, order))
        for alias in (a.strip() for a in names.split(",") if a.strip()):
            if aliases.setdefault(alias, book) != book:
                raise ContractError(f"alias {alias!r} names two books")
    if sorted(r[3] for r in rows) != list(range(1, len(rows) + 1)) or len({r[0] for r in rows}) != len(rows):
        raise ContractError("book numbers must run from 1 without gaps, ids must differ")
    books = spark.createDataFrame(rows, "id string, name string, testament string, canonical_order int")
    listed = spark.createDataFrame(list(aliases.items()), "alias string, book_id string")
    normal = listed.select(normal_name(F.col("alias")).alias("alias"), "book_id")
    own = books.select(normal_name(F.col("name")).alias("alias"), F.col("id").alias("book_id")).union(books.select(normal_name(F.col("id")), "id"))
    every = normal.union(own).distinct()
    require(duplicate_keys(every, ["alias"]), "an alias names two books", "alias")
    return BookTable(books, every)


def catalog_of(books: DataFrame) -> BookTable:
    """A catalog whose aliases are the names and ids of an existing ``books`` table."""
    own = books.select("id", "name", "testament", "canonical_order").distinct()
    keys = own.select(normal_name(F.col("name")).alias("alias"), F.col("id").alias("book_id")).union(own.select(normal_name(F.col("id")), "id"))
    return BookTable(own, first_by(keys, ["alias"], F.asc("book_id")))


def versions(spark: SparkSession, dirs: Sequence[str], catalog: BookTable) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(translations, verses, headings)`` of version files. Texts are stripped; a heading's ordinal is its place in the array."""
    files = json_documents(spark, dirs, VERSION_FILE)
    if files.isEmpty():
        raise ContractError("no version files")
    shown = files.select(F.col("code").alias("id"), "name", "language", F.coalesce("direction", F.lit("ltr")).alias("direction"), F.col("copyright").alias("attribution"))
    books = files.select("path", F.col("code").alias("translation_id"), F.explode("books").alias("b")).select("path", "translation_id", "b.abbreviation", "b.order_index", "b.chapters")
    books = catalog.resolve(books, "abbreviation")
    by_order = catalog.books.select(F.col("canonical_order").alias("order_index"), F.col("id").alias("by_order"))
    checked = books.join(by_order, "order_index", "left")
    chapters = books.select("path", "translation_id", "book_id", F.explode("chapters").alias("c")).select("path", "translation_id", "book_id", F.col("c.number").alias("chapter"), "c.verses", "c.headings")
    verses = chapters.select("path", "translation_id", "book_id", "chapter", F.explode("verses").alias("v")).select("path", "translation_id", "book_id", "chapter", F.col("v.number").alias("verse"), F.btrim("v.text").alias("text"))
    key = ["translation_id", "book_id", "chapter", "verse"]
    headings = chapters.select("translation_id", "book_id", "chapter", F.posexplode("headings").alias("p", "h")).select("translation_id", "book_id", "chapter", F.col("h.before_verse").alias("before_verse"), F.btrim("h.text").alias("text"), (F.col("p") + 1).alias("ordinal"))
    require_all(
        (broken_rows(files, non_empty=["code", "name", "language"], required=["books"]).select("path", "broken"), "version file", ["path"]),
        (duplicate_keys(files, ["code"]), "a code comes twice", ["code"]),
        (outside_values(shown, "direction", DIRECTIONS), "direction", ["id"]),
        (checked.where("book_id is null or by_order is null or book_id <> by_order").select("path", "abbreviation", "order_index", "book_id", "by_order"), "book identity", ["path", "order_index"]),
        (broken_rows(verses, non_empty=["text"], positive=["chapter", "verse"]), "verse", ["path", "chapter", "verse"]),
        (duplicate_keys(verses, key), "a verse comes twice", key),
        (broken_rows(headings, non_empty=["text"], positive=["before_verse"]), "heading", [*key[:3], "ordinal"]),
    )
    return shown, verses.drop("path"), headings


def cross_references(spark: SparkSession, path: str, catalog: BookTable) -> tuple[DataFrame, DataFrame]:
    """A2: ``(references, clamped)`` of tab-separated files ``from, to, votes`` with a header. A range that leaves its chapter or book is
    cut to its first verse; ``clamped`` has one row with how many were."""
    lines = staged(spark.read.option("header", True).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").schema("from_token string, to_token string, votes int").csv(path))
    ends = F.split("to_token", "-")
    parts = lines.where("from_token is not null").select("from_token", "to_token", "votes", osis(F.col("from_token")).alias("f"), osis(ends[0]).alias("s"), osis(F.try_element_at(ends, F.lit(2))).alias("e"), F.size(ends).alias("n"))
    wide = parts.select("from_token", "to_token", "votes", *(F.col(f"{a}.{b}").alias(f"{a}_{b}") for a in "fse" for b in ("book", "chapter", "verse")))
    for a in "fse":
        wide = catalog.resolve(wide, f"{a}_book", f"{a}_id")
    tokens = ["from_token", "to_token"]
    require_all(
        (parts.where("f is null or s is null or votes is null or n > 2 or (n = 2 and e is null)").select(*tokens, "votes"), "cross reference", tokens),
        (wide.where("f_id is null or s_id is null or (e_book is not null and e_id is null)").select(*tokens), "unknown book", tokens),
    )
    stays = (F.col("e_id") == F.col("s_id")) & (F.col("e_chapter") == F.col("s_chapter"))
    out = wide.select(
        F.col("f_id").alias("from_book_id"), F.col("f_chapter").alias("from_chapter"), F.col("f_verse").alias("from_verse"), F.col("s_id").alias("to_book_id"), F.col("s_chapter").alias("to_chapter"),
        F.col("s_verse").alias("to_verse_start"), F.when(stays, F.col("e_verse")).alias("to_verse_end"), "votes", (F.col("e_id").isNotNull() & ~stays).alias("was_clamped"),
    )
    return out.drop("was_clamped"), out.agg(F.count_if("was_clamped").alias("clamped"))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """A4: ``(modern_id, longitude, latitude)``; unusable records are dropped."""
    part = F.split("lonlat", ",")
    own = json_lines(spark, path, POSITIONS_LINES).where((F.size(part) == 2) & F.col("id").isNotNull())
    own = own.select(F.col("id").alias("modern_id"), F.trim(part[0]).try_cast("double").alias("longitude"), F.trim(part[1]).try_cast("double").alias("latitude"))
    return own.where("longitude is not null and latitude is not null")


def notes(spark: SparkSession, dirs: Sequence[str], catalog: BookTable, translations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(notes, references)``. Ids count from 1 over directories, files and positions; a missing ordinal is the place among
    the notes of the verse in the file. An unknown book or version fails."""
    files = json_documents(spark, dirs, NOTES_FILE)
    flat = files.select("dir_rank", "path", F.col("translation").alias("translation_id"), F.posexplode("notes").alias("position", "n")).select("dir_rank", "path", "translation_id", "position", "n.*")
    turn = F.row_number().over(Window.partitionBy("dir_rank", "path", "book_id", "chapter", "verse").orderBy("position"))
    own = numbered(catalog.resolve(flat, "book").withColumn("turn", turn), ["dir_rank", "path", "position"], "id")
    refs = own.select(F.col("id").alias("note_id"), "path", F.posexplode("cross_references").alias("at", "r")).select("note_id", "path", "at", "r.book", F.col("r.chapter").alias("to_chapter"), F.col("r.verse_start").alias("to_verse_start"), F.when(F.col("r.verse_end") >= 0, F.col("r.verse_end")).alias("to_verse_end"))
    refs = catalog.resolve(refs, "book", "to_book_id")
    place = ["path", "position"]
    require_all(
        (missing_parents(files, ["translation"], translations, ["id"]).select("path", "translation"), "unknown version", ["path"]),
        (own.where("book_id is null").select(*place, "book"), "unknown book", place),
        (broken_rows(own, non_empty=["text"], positive=["chapter", "verse"]).select(*place, "broken"), "note", place),
        (outside_values(own, "type", NOTE_TYPES).select(*place, "type"), "note type", place),
        (own.where("char_offset < 0").select(*place, "char_offset"), "negative offset", place),
        (refs.where("to_book_id is null or to_verse_end < to_verse_start").select("path", "note_id", "at", "book", "to_verse_start", "to_verse_end"), "note reference", ["note_id", "at"]),
    )
    out = own.select("id", "translation_id", "book_id", "chapter", "verse", F.col("type").alias("note_type"), "text", F.coalesce("char_offset", F.lit(0)).alias("char_offset"), "marker", F.coalesce("ordinal", "turn").alias("ordinal"))
    return out, refs.drop("book", "path")


def topics(spark: SparkSession, dirs: Sequence[str], catalog: BookTable) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(topics, links, skipped)``; links to unknown books are skipped and counted, a repeated link is one, a repeated id fails."""
    files = json_documents(spark, dirs, TOPICS_FILE)
    flat = files.select("path", "source", F.explode("topics").alias("t")).select("path", "source", "t.*")
    links = catalog.resolve(flat.select(F.col("id").alias("topic_id"), F.explode("verses").alias("v")).select("topic_id", "v.*"), "book")
    require_all(
        (broken_rows(flat, non_empty=["id", "name"], required=["section"]).select("path", "id", "broken"), "topic", ["path", "id"]),
        (duplicate_keys(flat, ["id"]), "a topic id comes twice", ["id"]),
        (broken_rows(links, required=["book"], positive=["chapter", "verse"]), "topic link", ["topic_id"]),
    )
    kept = links.where("book_id is not null").select("topic_id", "book_id", "chapter", "verse").distinct()
    see = F.when(F.trim("see_also") != "", F.trim("see_also"))
    return flat.select("id", "name", "section", see.alias("see_also"), "source"), kept, links.agg(F.count_if(F.col("book_id").isNull()).alias("skipped"))


def lexicon(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """Entries of all JSON files but those of tokens. Only a transliteration may be empty; a repeated id fails."""
    files = json_documents(spark, dirs, LEXICON_FILE, other_names("tokens-"))
    flat = files.select("source", F.explode("entries").alias("e")).select("e.*", "source")
    require_all(
        (broken_rows(flat, non_empty=["strongs_id", "language", "lemma", "gloss", "definition"], required=["transliteration"]), "lexicon entry", ["strongs_id"]),
        (duplicate_keys(flat, ["strongs_id"]), "an entry comes twice", ["strongs_id"]),
    )
    return flat


def word_tokens(spark: SparkSession, dirs: Sequence[str], catalog: BookTable) -> tuple[DataFrame, DataFrame]:
    """``(tokens, skipped)``; tokens of unknown books are skipped and counted, of a repeated position the first counts."""
    files = json_documents(spark, dirs, TOKENS_FILE, "tokens-*.json")
    flat = files.select("dir_rank", "path", "text_id", F.posexplode("tokens").alias("at", "t")).select("dir_rank", "path", "text_id", "at", "t.*")
    require(broken_rows(flat, non_empty=["text_id", "book", "surface_form"], positive=["chapter", "verse", "position"]).select("path", "at", "broken"), "token", "path", "at")
    flat = catalog.resolve(flat, "book")
    key = ["text_id", "book_id", "chapter", "verse", "position"]
    kept = first_by(flat.where("book_id is not null"), key, F.asc("dir_rank"), F.asc("path"), F.asc("at"))
    return kept.select(*key, "surface_form", "strongs_id", "morph_code"), flat.agg(F.count_if(F.col("book_id").isNull()).alias("skipped"))


def journeys(spark: SparkSession, dirs: Sequence[str], places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(journeys, stops)``; ids differ, every journey has stops with different ordinals from 1, every place exists."""
    files = json_documents(spark, dirs, JOURNEYS_FILE)
    flat = files.select("path", F.explode("journeys").alias("j")).select("path", "j.*")
    stops = flat.select(F.col("id").alias("journey_id"), F.explode("stops").alias("s")).select("journey_id", "s.*")
    stop = ["journey_id", "ordinal"]
    require_all(
        (broken_rows(flat, non_empty=["id", "name", "scripture", "source", "note"], required=["stops"]).select("path", "id", "broken"), "journey", ["path", "id"]),
        (duplicate_keys(flat, ["id"]), "a journey id comes twice", ["id"]),
        (flat.where(F.size("stops") == 0).select("id"), "a journey without stops", ["id"]),
        (broken_rows(stops, non_empty=["place_id"], positive=["ordinal"]), "stop", stop),
        (duplicate_keys(stops, stop), "a stop comes twice", stop),
        (missing_parents(stops, ["place_id"], places, ["id"]), "unknown place", stop),
    )
    return flat.drop("path", "stops"), stops


def tab_lines(spark: SparkSession, paths: Sequence[str] | str, least: int) -> DataFrame:
    """``(path, line, cols)`` of raw tab-separated files, a leading byte-order mark removed (the line reader does that), rows with
    fewer than ``least`` columns left out. Files are split like any text; ``line`` (where its split begins, its turn there) orders
    the lines of a file."""
    turn = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), turn.alias("line"), "value")
    return lines.select("path", "line", F.split("value", "\t").alias("cols")).where(F.size("cols") >= least)


def csv_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header; a byte-order mark is no part of the first name."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)


def blank_to_null(column: Column) -> Column:
    return F.when(F.trim(column) != "", column)
