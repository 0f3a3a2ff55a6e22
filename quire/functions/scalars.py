"""Scalar functions as Column expressions (J). Only NFC needs Python, as Spark has no such function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a leading ordinal token stands for.
ORDINALS = {"i": "1", "ii": "2", "iii": "3", "first": "1", "second": "2", "third": "3", "1": "1", "2": "2", "3": "3"}
# Punctuation that book names are matched without.
NAME_PUNCTUATION = ".'’"
# Least scores of the confidence buckets.
HIGH_SCORE, MEDIUM_SCORE = 500, 100


def normal_name(column: Column) -> Column:
    """A book name as it is matched: lower case, no periods or apostrophes, a leading ordinal (if more follows) as a digit, no blanks. Null stays null."""
    words = F.filter(F.split(F.translate(F.lower(column), NAME_PUNCTUATION, ""), r"\s+"), lambda w: w != "")
    table = F.create_map(*(F.lit(x) for pair in ORDINALS.items() for x in pair))
    head = F.get(words, F.lit(0))
    first = F.when(F.size(words) > 1, F.coalesce(F.try_element_at(table, head), head)).otherwise(head)
    rest = F.when(F.size(words) > 1, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.when(column.isNotNull(), F.concat(F.coalesce(first, F.lit("")), F.array_join(rest, "")))


def normal_name_text(name: str) -> str:
    """J1 for one string on the driver."""
    words = "".join(ch for ch in name.lower() if ch not in NAME_PUNCTUATION).split()
    if len(words) > 1:
        words[0] = ORDINALS.get(words[0], words[0])
    return "".join(words)


def slug(column: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "-"), F.lit("-"))


def display_name(column: Column) -> Column:
    """Without a trailing number that tells namesakes apart."""
    return F.regexp_replace(column, "(?s)^(.*) [0-9]+$", "$1")


def strongs_route(column: Column) -> Column:
    """J4, as asked for: ``[GH]`` and a number in any case loses leading zeros, anything else is upper case and trimmed."""
    text = F.upper(F.trim(column))
    return F.when(text.rlike("^[GH]0*[0-9]+$"), F.regexp_replace(text, "^([GH])0*(?=[0-9])", "$1")).otherwise(text)


def strongs_base(column: Column, suffix: bool = False) -> Column:
    """J4, as in raw files: the leading letter and number without leading zeros; what follows is ignored, or with
    ``suffix`` may only be one letter. Null if there is none."""
    text = F.trim(column)
    pattern = "^([GH])0*([0-9]+)[A-Za-z]?$" if suffix else "^([GH])0*([0-9]+)"
    return F.when(text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)))


def strip_html(column: Column) -> Column:
    """Line breaks as blanks, other tags and ``__`` removed, blanks collapsed and trimmed."""
    text = F.regexp_replace(column, r"(?i)<br\s*/?>", " ")
    text = F.replace(F.regexp_replace(text, r"<[^>]*>", ""), F.lit("__"), F.lit(""))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(column: Column) -> Column:
    """Canonical composition."""
    return F.pandas_udf(_compose, T.StringType())(column)


def without_gloss(column: Column) -> Column:
    """Without a trailing parenthetical; trimmed."""
    return F.trim(F.regexp_replace(column, r"\s*\([^()]*\)\s*$", ""))


def without_separators(column: Column) -> Column:
    """Without morpheme separators."""
    return F.translate(column, "/\\", "")


def verse_spec(column: Column, most: int = 200) -> Column:
    """``3,8-10`` as an array of numbers; null if a part is no number or range, runs backwards or spans more than ``most``."""
    parts = F.split(column, ",")
    low = lambda p: F.try_element_at(F.split(p, "-", 2), F.lit(1)).try_cast("int")
    high = lambda p: F.try_element_at(F.split(p, "-", 2), F.lit(-1)).try_cast("int")
    bad = F.exists(parts, lambda p: ~p.rlike("^[0-9]+(-[0-9]+)?$") | low(p).isNull() | high(p).isNull() | (high(p) < low(p)) | (high(p) - low(p) > most))
    return F.when(~bad, F.flatten(F.transform(parts, lambda p: F.sequence(low(p), F.greatest(low(p), F.least(high(p), low(p) + most))))))


def osis(column: Column) -> Column:
    """``Book.Chapter.Verse`` as struct(book, chapter, verse); null unless it has three parts with numbers of at least 1."""
    part = F.split(column, r"\.")
    chapter, verse = F.try_element_at(part, F.lit(2)).try_cast("int"), F.try_element_at(part, F.lit(3)).try_cast("int")
    return F.when((F.size(part) == 3) & (chapter >= 1) & (verse >= 1), F.struct(part[0].alias("book"), chapter.alias("chapter"), verse.alias("verse")))


def sort_key(column: Column) -> Column:
    """``BBCCCVVV`` as struct(book_order, chapter, verse); null unless it is eight digits."""
    number = lambda a, n: F.substring(column, a, n).try_cast("int")
    return F.when(column.rlike("^[0-9]{8}$"), F.struct(number(1, 2).alias("book_order"), number(3, 3).alias("chapter"), number(6, 3).alias("verse")))


def confidence_bucket(score: Column) -> Column:
    """J10."""
    return F.when(score >= HIGH_SCORE, "high").when(score >= MEDIUM_SCORE, "medium").when(score.isNotNull(), "low")


def unit_vector(vector: Column) -> Column:
    """Of length one, in doubles; a zero vector is an error."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / F.when(length > 0, length).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("double")))


def etag(column: Column) -> Column:
    """The first 32 hex digits of SHA-256."""
    return F.substring(F.sha2(column, 256), 1, 32)


def fold_ascii(column: Column) -> Column:
    """ASCII letters in lower case, all others as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_ci(column: Column, text: str) -> Column:
    """``LIKE '%text%'`` with ASCII case folding; ``%`` and ``_`` in ``text`` are wildcards, a backslash is itself."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\\", "\\\\")
    return fold_ascii(column).like(f"%{folded}%")


def leading_number(column: Column) -> Column:
    """Digits at the start as a number, else 0."""
    return F.coalesce(F.regexp_extract(column, "^[0-9]+", 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def reference_text(name: Column, chapter: Column, verse: Column, end: Column | None = None) -> Column:
    """``Name c:v``, with ``-e`` if an end is given that is not the start."""
    text = F.concat(name, F.lit(" "), chapter.cast("string"), F.lit(":"), verse.cast("string"))
    return text if end is None else F.concat(text, F.when(end.isNotNull() & (end != verse), F.concat(F.lit("-"), end.cast("string"))).otherwise(""))


def head_morph(parts: Column, grammar: Column) -> Column:
    """The element of ``/``-split ``grammar`` at the part with a brace; all of it (trimmed) if there is none. Blank is null."""
    at = F.array_position(F.transform(F.split(parts, "/"), lambda p: p.contains("{")), F.lit(True))
    own = F.trim(F.get(F.split(grammar, "/"), (at - 1).cast("int")))
    whole = F.trim(grammar)
    return F.when((at > 0) & (own != ""), own).when(whole != "", whole)


def round4(column: Column) -> Column:
    """Four places, halves to even."""
    return F.bround(column, 4)


# Words that may stand uncapitalised in a heading; words that are content, not headings.
HEADING_SMALL = "of|the|and|to|in|a|against|before|from|for|over|with|into"
NOTATION = ["selah", "higgaion"]


def fused_heading(text: Column) -> Column:
    """struct(heading, cleaned, anchor) if a title-like tail of two or more words, mostly capitalised, follows the last
    final mark of ``text``; a number before it is the anchor. Else null."""
    own = F.regexp_replace(text, r"\s+$", "")
    word = r"[A-Z][A-Za-z’']*"
    pattern = rf"""(?s)^(.*?[”’"'.!?])\s+(?:([0-9]+)\s+)?({word}(?:\s+(?:{word}|{HEADING_SMALL}))*)$"""
    heading = F.regexp_extract(own, pattern, 3)
    words = F.filter(F.split(heading, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    notation = F.forall(words, lambda w: F.lower(F.btrim(w, F.lit(".,;'’"))).isin(NOTATION))
    good = own.rlike(pattern) & (F.size(words) >= 2) & (capital >= F.greatest(F.lit(2), F.size(words) - 2)) & ~notation
    return F.when(good, F.struct(heading.alias("heading"), F.regexp_replace(F.regexp_extract(own, pattern, 1), r"\s+$", "").alias("cleaned"), F.regexp_extract(own, pattern, 2).try_cast("int").alias("anchor")))


#: Texts that words are looked up in where none is asked for.
HEBREW_TEXT, GREEK_TEXT = "OSHB", "SBLGNT"


def default_text_of_word(strongs_id: Column) -> Column:
    """The Hebrew text for ids H..., else the Greek one."""
    return F.when(strongs_route(strongs_id).startswith("H"), HEBREW_TEXT).otherwise(GREEK_TEXT)


def default_text_of_testament(testament: Column) -> Column:
    """The Hebrew text for the OT, else the Greek one."""
    return F.when(testament == "OT", HEBREW_TEXT).otherwise(GREEK_TEXT)
