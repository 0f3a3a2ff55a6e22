"""N: transforms from raw corpus files to tables. Skipped rows are counted by reason, in the order in which the reasons apply."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators.passages import first_by
from quire.sources.corpora import BookTable, blank_to_null

# What special markers of a place mean, most telling first; markers of what is no place.
SPECIAL_STATUS = {"unknown_place": "unknown", "multiple_locations": "multiple", "nonspecific_place": "symbolic"}
NO_PLACE = ["not_a_place", "not_a_proper_name"]
# A runner-up of at least this score and this share of the best score makes an identification disputed.
COMPETING_LEAST, COMPETING_SHARE = 100, 0.8
# Book codes of the topical index that are no aliases.
TOPIC_CODES = {"1JHN": "1JN", "2JHN": "2JN", "3JHN": "3JN"}
# A reference of the topical index (book, chapter, verses) and a redirect.
TOPIC_REFERENCE = r"(?:([1-3]?[A-Za-z]{2,5})\s+)?(\d+):(\d+(?:[-,]\d+)*)"
TOPIC_SEE = r"(?i)^-?\s*See\s+([^;\n]+)"


def reasons(df: DataFrame, name: str = "reason") -> DataFrame:
    """F8: ``(reason, n)``; kept rows have the reason ``kept``."""
    return df.groupBy(F.coalesce(name, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _tagged(lines: DataFrame, catalog: BookTable) -> DataFrame:
    """Rows of tagged texts by reference and position: ``Book.c.v#p`` in the first column."""
    ref = F.col("cols")[0]
    own = lines.where(ref.rlike(r"^[A-Za-z0-9]+\.[0-9]+\.[0-9]+") & ref.rlike("#[0-9]+"))
    pattern = r"^([A-Za-z0-9]+)\.([0-9]+)\.([0-9]+)"
    own = own.select(
        "path", "line", "cols", F.regexp_extract(ref, pattern, 1).alias("book"), F.regexp_extract(ref, pattern, 2).cast("int").alias("chapter"),
        F.regexp_extract(ref, pattern, 3).cast("int").alias("verse"), F.regexp_extract(ref, "#([0-9]+)", 1).cast("int").alias("position"),
    )
    return catalog.resolve(own, "book")


def _first_position(df: DataFrame) -> DataFrame:
    """Among the rows without a reason, the later ones of a position get one."""
    turn = F.row_number().over(Window.partitionBy("book_id", "chapter", "verse", "position", F.col("reason").isNull()).orderBy("path", "line"))
    return df.withColumn("_turn", turn).withColumn("reason", F.coalesce("reason", F.when(F.col("_turn") > 1, "dup_position"))).drop("_turn")


_WORD = ("book_id", "chapter", "verse", "position", "surface_form", "strongs_id", "morph_code")


def tagged_greek(lines: DataFrame, catalog: BookTable, edition: str = "SBL") -> DataFrame:
    """Words of one edition, with ``reason`` for those skipped. Columns: reference, surface with a gloss, -, ``strong=morph``, -, editions."""
    own = _tagged(lines, catalog)
    cell = F.split(F.col("cols")[3], "=", 2)
    in_edition = F.exists(F.split(F.col("cols")[5], r"\+"), lambda e: F.trim(e) == edition)
    own = own.withColumns(
        {
            "surface_form": scalars.nfc(scalars.without_gloss(F.col("cols")[1])),
            "strongs_id": scalars.strongs_base(cell[0]),
            "morph_code": blank_to_null(F.trim(F.try_element_at(cell, F.lit(2)))),
        }
    )
    reason = F.when(~in_edition, "not_edition").when(F.col("book_id").isNull(), "unresolved_book").when(F.col("surface_form") == "", "empty_surface")
    return _first_position(own.withColumn("reason", reason)).select(*_WORD, "reason")


def tagged_hebrew(lines: DataFrame, catalog: BookTable) -> DataFrame:
    """Words with the number of their root and the morphology aligned with it; verse 0 (titles) is skipped."""
    own = _tagged(lines, catalog)
    own = own.withColumns(
        {
            "surface_form": scalars.nfc(F.trim(scalars.without_separators(F.col("cols")[1]))),
            "strongs_id": scalars.strongs_base(F.col("cols")[8]),
            "morph_code": scalars.head_morph(F.col("cols")[4], F.col("cols")[5]),
        }
    )
    reason = F.when(F.col("verse") == 0, "verse_0").when(F.col("book_id").isNull(), "unresolved_book").when(F.col("surface_form") == "", "empty_surface")
    return _first_position(own.withColumn("reason", reason)).select(*_WORD, "reason")


def lexicon_entries(lines: DataFrame, language: str) -> DataFrame:
    """The first sense of each base id, with ``reason`` for rows skipped (too short, a repeated id, empty); ``lines`` has rows of any length."""
    own = lines.select("path", "line", "cols", scalars.strongs_base(F.col("cols")[0], suffix=True).alias("strongs_id")).where("strongs_id is not null")
    part = lambda i: F.trim(F.get("cols", F.lit(i)))
    own = own.withColumns({"lemma": scalars.nfc(part(3)), "transliteration": scalars.nfc(part(4)), "gloss": part(6), "definition": scalars.strip_html(F.get("cols", F.lit(7)))})
    # a row that is kept closes its id for later ones; empty rows before it do not
    whole = F.size("cols") >= 8
    good = whole & (F.col("lemma") != "") & (F.col("gloss") != "")
    earlier = F.max(good.cast("int")).over(Window.partitionBy("strongs_id").orderBy("path", "line").rowsBetween(Window.unboundedPreceding, -1))
    reason = F.when(~whole, "short").when(earlier == 1, "dup_base").when(~good, "empty")
    return own.withColumn("reason", reason).select("strongs_id", F.lit(language).alias("language"), "lemma", "transliteration", "gloss", "definition", "reason")


def topic_references(records: DataFrame, catalog: BookTable, key: str, entry: str) -> DataFrame:
    """Every reference of each entry in order: ``(key, at, book_id, chapter, verses, reason)``. A reference without a book has the book
    of the one before; after an unknown book there is none until the next."""
    found = records.select(F.col(key).alias("key"), F.regexp_extract_all(F.coalesce(entry, F.lit("")), F.lit(TOPIC_REFERENCE), F.lit(0)).alias("refs"))
    own = found.select("key", F.posexplode("refs").alias("at", "ref")).select(
        "key", "at", F.when(F.regexp_extract("ref", TOPIC_REFERENCE, 1) != "", F.regexp_extract("ref", TOPIC_REFERENCE, 1)).alias("token"),
        F.regexp_extract("ref", TOPIC_REFERENCE, 2).try_cast("int").alias("chapter"), F.regexp_extract("ref", TOPIC_REFERENCE, 3).alias("spec"),
    )
    own = catalog.resolve(own, "token", "own_book")
    codes = F.create_map(*(F.lit(x) for pair in TOPIC_CODES.items() for x in pair))
    own = own.withColumn("own_book", F.coalesce("own_book", F.try_element_at(codes, F.upper("token"))))
    upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("run", F.count("token").over(upto)).withColumn("book_id", F.max("own_book").over(Window.partitionBy("key", "run")))
    verses = scalars.verse_spec(F.col("spec"))
    reason = F.when(F.col("token").isNotNull() & F.col("book_id").isNull(), "unresolved_book").when(F.col("book_id").isNull(), "no_book").when(verses.isNull(), "bad_range")
    return own.select("key", "at", "book_id", "chapter", verses.alias("verses"), reason.alias("reason"))


def topical_index(records: DataFrame, catalog: BookTable) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(topics, links, references)`` of ``records(position, section, subject, entry)``. Ids are slugs, the k-th of one slug gets ``-k``;
    a topic without verses whose entry says "See X" redirects."""
    own = records.withColumn("name", F.trim(F.coalesce("subject", F.lit("")))).withColumn("base", scalars.slug(F.col("name"))).where("base <> ''")
    turn = F.row_number().over(Window.partitionBy("base").orderBy("position"))
    own = own.withColumn("id", F.concat("base", F.when(turn > 1, F.concat(F.lit("-"), turn.cast("string"))).otherwise("")))
    refs = topic_references(own, catalog, "id", "entry")
    links = refs.where("reason is null").select(F.col("key").alias("topic_id"), "book_id", "chapter", F.explode("verses").alias("verse")).distinct()
    see = F.regexp_extract(F.trim("entry"), TOPIC_SEE, 1)
    linked = links.select(F.col("topic_id").alias("id")).distinct().withColumn("has_verses", F.lit(True))
    topics = own.join(linked, "id", "left").select("id", "name", F.trim(F.coalesce("section", F.lit(""))).alias("section"), F.when(F.col("has_verses").isNull() & (see != ""), scalars.slug(see)).alias("see_also"))
    return topics, links, refs


def footnotes(records: DataFrame, books: DataFrame) -> DataFrame:
    """Notes of ``records(book_index, chapter, verse, text, ...)`` with the abbreviation of the book at that index; ``reason`` where there
    is none or the text is empty."""
    names = books.select(F.col("canonical_order").alias("book_index"), F.col("id").alias("book"))
    own = records.join(names, "book_index", "left")
    reason = F.when(F.col("book").isNull(), "unresolved_book").when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty_text")
    return own.withColumn("reason", reason)


def document_lines(rows: DataFrame, key: str, order: Sequence[str], item: str, head: Column, tail: Column, *, group: str | None = None, opening: Column | None = None, closing: Column | None = None) -> DataFrame:
    """``(key, *order, line)``: a JSON document a key, in lines: ``head``, the texts of ``item`` divided by commas, ``tail``. With ``group``
    (which ``order`` begins with), items stand between ``opening`` and ``closing`` of their group; a null item leaves its group empty.
    A row holds one item, so a document may be of any length."""
    place = Window.partitionBy(key).orderBy(*order)
    first, last = F.row_number().over(place) == 1, F.lead(F.lit(1)).over(place).isNull()
    comma = F.when(first, head).otherwise(",")
    before, after = comma, F.lit("")
    if group is not None:
        begins = first | ~F.lag(group).over(place).eqNullSafe(F.col(group))
        ends = last | ~F.lead(group).over(place).eqNullSafe(F.col(group))
        before, after = F.when(begins, F.concat(comma, opening)).otherwise(","), F.when(ends, closing).otherwise("")
    return rows.withColumn("line", F.concat(before, F.coalesce(item, F.lit("")), after, F.when(last, tail).otherwise(""))).select(key, *order, "line")


def version_lines(verses: DataFrame, books: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """``(translation_id, canonical_order, chapter, line)``: version documents, books in canonical order, their chapters, their verses, and headings
    ``(translation_id, book_id, chapter, ordinal, before_verse, text)`` by ordinal. The arrays hold one chapter each."""
    chapter = ["translation_id", "book_id", "chapter"]
    own = verses.groupBy(*chapter).agg(F.array_sort(F.collect_list(F.struct(F.col("verse").alias("number"), "text"))).alias("verses"))
    if headings is not None:
        titles = headings.groupBy(*chapter).agg(F.array_sort(F.collect_list(F.struct("ordinal", "before_verse", "text"))).alias("headings"))
        own = own.join(titles, chapter, "left")
    fields = [F.col("chapter").alias("number"), "verses", *([] if headings is None else ["headings"])]
    own = own.join(books.select(F.col("id").alias("book_id"), "name", "canonical_order"), "book_id").withColumn("item", F.to_json(F.struct(*fields)))
    code = F.to_json(F.struct(F.col("translation_id").alias("code"), F.col("translation_id").alias("name"), F.lit("und").alias("language")))
    book = F.to_json(F.struct(F.col("canonical_order").alias("order_index"), F.col("book_id").alias("abbreviation"), "name"))
    within = lambda text, name: F.concat(F.expr(f"substring({text}, 1, length({text}) - 1)"), F.lit(f',"{name}":['))
    own = own.withColumns({"_code": code, "_book": book})
    return document_lines(own, "translation_id", ["canonical_order", "chapter"], "item", within("_code", "books"), F.lit("]}"), group="canonical_order", opening=within("_book", "chapters"), closing=F.lit("]}"))


def repaired_headings(verses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(verses, headings, changes)``. A heading fused onto a verse's end is cut off and set before the verse after (or after the stray number
    it follows); past the chapter's end before verse 1 of the next chapter, past the book's end nowhere (``skipped``)."""
    own = verses.withColumn("fused", scalars.fused_heading(F.col("text")))
    last = F.max("verse").over(Window.partitionBy("translation_id", "book_id", "chapter"))
    chapters = verses.select("translation_id", "book_id", "chapter").distinct()
    chapters = chapters.withColumn("following", F.lead("chapter").over(Window.partitionBy("translation_id", "book_id").orderBy("chapter")))
    own = own.withColumn("last", last).join(chapters, ["translation_id", "book_id", "chapter"])
    target = F.coalesce(F.col("fused.anchor"), F.col("verse")) + 1
    fits = target <= F.col("last")
    changes = own.where("fused is not null").select(
        "translation_id", "book_id", "chapter", "verse", F.col("fused.heading").alias("heading"), F.when(fits, F.col("chapter")).otherwise(F.col("following")).alias("to_chapter"),
        F.when(fits, target).when(F.col("following").isNotNull(), 1).alias("before_verse"), (~fits & F.col("following").isNull()).alias("skipped"),
    )
    headings = changes.where("not skipped").select("translation_id", "book_id", F.col("to_chapter").alias("chapter"), "before_verse", F.col("heading").alias("text")).distinct()
    return own.withColumn("text", F.coalesce("fused.cleaned", "text")).select(*verses.columns), headings, changes


def corroboration(changes: DataFrame) -> DataFrame:
    """In how many versions a heading was cut off at a place; one alone is of low confidence."""
    n = changes.groupBy("book_id", "chapter", "verse", "heading").agg(F.countDistinct("translation_id").alias("n_versions"))
    return n.withColumn("low_confidence", F.col("n_versions") < 2)


def derived_places(ancient: DataFrame, modern: DataFrame) -> DataFrame:
    """Places with status and position, on two axes.

    A special marker decides the status and suppresses the position. Else the best located association places it: confidence and status come from the
    scores of *all* associations, position and name from the best one *that has a position* (ties: the smaller modern id). A place of only
    "no place" markers is left out. Scores that are no integers count as 0.
    """
    specials = F.array_distinct(F.array_compact(F.flatten(F.transform(F.coalesce("identifications", F.array().cast("array<struct<resolutions:array<struct<special:string>>>>")), lambda i: F.transform(F.coalesce(i["resolutions"], F.array().cast("array<struct<special:string>>")), lambda r: r["special"])))))
    score = F.coalesce(F.when(F.col("a.score").rlike("^-?[0-9]+$"), F.col("a.score").try_cast("int")), F.lit(0))
    own = ancient.select("id", F.explode("modern_associations").alias("modern_id", "a")).where("a is not null").select("id", "modern_id", F.col("a.name").alias("modern_name"), score.alias("score"))
    scores = own.groupBy("id").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))
    best = first_by(own.join(modern, "modern_id"), ["id"], F.desc("score"), F.asc("modern_id")).select("id", "modern_name", "latitude", "longitude")
    joined = ancient.select("id", "friendly_id", "url_slug", F.coalesce("preceding_article", F.lit("")).alias("preceding_article"), F.coalesce(F.get("types", F.lit(0)), F.lit("unknown")).alias("type"), specials.alias("specials")).join(scores, "id", "left").join(best, "id", "left")
    marked = F.coalesce(*(F.when(F.array_contains("specials", m), s) for m, s in SPECIAL_STATUS.items()))
    top, second = F.get("scores", F.lit(0)), F.get("scores", F.lit(1))
    competing = F.coalesce((top >= COMPETING_LEAST) & (second >= COMPETING_LEAST) & (second >= COMPETING_SHARE * top), F.lit(False))
    placed = F.col("latitude").isNotNull() & marked.isNull()
    status = F.coalesce(marked, F.when(placed, F.when((top < 0) | competing, "disputed").otherwise("identified")), F.lit("unknown"))
    no_place = marked.isNull() & ~placed & ~F.array_contains("specials", "recursive") & (F.size("specials") > 0) & (F.size(F.array_except("specials", F.array(*map(F.lit, NO_PLACE)))) == 0)
    shown = lambda c: F.when(placed, c)
    return joined.where(~no_place).select(
        "id", "friendly_id", scalars.display_name(F.col("friendly_id")).alias("name"), "url_slug", "type", "preceding_article", shown(F.col("latitude")).alias("latitude"), shown(F.col("longitude")).alias("longitude"),
        shown(scalars.confidence_bucket(top)).alias("confidence"), shown(top).alias("confidence_score"), status.alias("status"), shown(F.col("modern_name")).alias("modern_name"),
    )


def place_links(ancient: DataFrame, places: DataFrame, catalog: BookTable) -> tuple[DataFrame, DataFrame]:
    """``(place_verses, skipped)``: links by sort key, else by their other name; a sort key with a book outside the catalog is final. Repeats
    are one link; places that were left out have none."""
    own = ancient.join(places.select("id"), "id", "left_semi").select(F.col("id").alias("place_id"), F.explode("verses").alias("v"))
    own = own.select("place_id", scalars.sort_key(F.col("v.sort")).alias("s"), scalars.osis(F.col("v.osis")).alias("o")).withColumn("osis_book", F.col("o.book"))
    own = catalog.resolve(own, "osis_book", "by_name").join(catalog.books.select(F.col("canonical_order").alias("_order"), F.col("id").alias("by_order")), F.col("s.book_order") == F.col("_order"), "left")
    first = F.col("by_order").isNotNull() & (F.col("s.chapter") >= 1) & (F.col("s.verse") >= 1)
    second = F.col("by_name").isNotNull() & (F.col("s").isNull() | F.col("by_order").isNotNull())
    pick = lambda a, b: F.when(first, a).when(second, b)
    out = own.select("place_id", pick(F.col("by_order"), F.col("by_name")).alias("book_id"), pick(F.col("s.chapter"), F.col("o.chapter")).alias("chapter"), pick(F.col("s.verse"), F.col("o.verse")).alias("verse"))
    return out.where("book_id is not null").distinct(), out.agg(F.count_if(F.col("book_id").isNull()).alias("skipped"))


def counters(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """F8: several conditional counts in one pass."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in columns.items()))
