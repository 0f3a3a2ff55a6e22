"""p5: one form for texts that read the same, by a compiled longest-match transducer over grapheme clusters.

The mapping is computed once from rules and a short list, checked for conflicts, and compiled to a trie. Text is
cut into grapheme clusters; each cluster is read once, the longest entry winning, and written in canonical form
(decomposed, marks in canonical order). Clusters repeat, so what the transducer says of one is remembered.

Equal: canonically equivalent spellings (composed or combining accents, in any order of independent marks), full-width
and ordinary forms, all kinds of blanks, invisible characters or none, Latin, Greek and Cyrillic letters of one shape.
Kept apart: other letters, case, accents or points that are present or absent, raised or lowered digits, ligatures,
number of blanks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, spread

# Letters of one shape, as "the Latin letter: others that look like it".
LOOK_ALIKE = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "F": "Ϝ", "G": "Ԍ", "H": "ΗНҺ", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚК", "M": "ΜМϺ", "N": "Ν",
    "O": "ΟО", "P": "ΡР", "Q": "Ԛ", "S": "Ѕ", "T": "ΤТ", "W": "Ԝ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "οо", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у", "v": "ѵ",
    "Γ": "Г", "Π": "П", "Φ": "Ф", "ə": "ә",
    "-": "\u2010\u2011",
}
# Characters that show nothing (single points and ranges).
INVISIBLE = "00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF9-FFFB 1D173-1D17A E0000-E0FFF"
# Blanks (Unicode White_Space).
BLANK = "0009-000D 0020 0085 00A0 1680 2000-200A 2028-2029 202F 205F 3000"


def points(spec: str) -> Iterator[int]:
    for part in spec.split():
        first, _, last = part.partition("-")
        yield from range(int(first, 16), int(last or first, 16) + 1)


class MappingConflict(ValueError):
    pass


class Transducer:
    """Longest match over a trie of ``entries`` (input, output). Refuses entries that contradict each other, and outputs
    that would change when read again."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        table: dict[str, str] = {}
        for source, target in entries:
            if not source:
                raise MappingConflict("an entry reads nothing")
            if table.setdefault(source, target) != target:
                raise MappingConflict(f"{source!r} is written as {table[source]!r} and {target!r}")
        self.trie: dict = {}
        for source, target in table.items():
            node = self.trie
            for ch in source:
                node = node.setdefault(ch, {})
            node[""] = target
        for source, target in table.items():
            if self.read(target) != target:
                raise MappingConflict(f"{source!r} is written as {target!r}, which would be written as {self.read(target)!r}")
        self.remember = lru_cache(maxsize=1 << 16)(self.cluster)

    def read(self, text: str) -> str:
        out, at, end = [], 0, len(text)
        while at < end:
            node, best, upto, i = self.trie, None, at + 1, at
            while i < end and (node := node.get(text[i])) is not None:
                i += 1
                if "" in node:
                    best, upto = node[""], i
            out.append(text[at] if best is None else best)
            at = upto
        return "".join(out)

    def cluster(self, cluster: str) -> str:
        """One grapheme cluster: written form, its marks in canonical order."""
        return unicodedata.normalize("NFD", self.read(cluster))


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """The compiled mapping. Canonical decompositions, widths and blanks follow from the Unicode data by rule."""
    invisible, blank = set(points(INVISIBLE)), set(points(BLANK))
    alike = {other: latin for latin, others in LOOK_ALIKE.items() for other in others}
    entries: dict[str, str] = {}

    def settle(ch: str) -> str:
        if ord(ch) in invisible:
            return ""
        if ord(ch) in blank:
            return " "
        return alike.get(ch, ch)

    for cp in (*range(0x30000), *range(0xE0000, 0xE1000)):  # no other plane has decompositions or blanks
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:  # Hangul syllables decompose by arithmetic, in the last step
            continue
        ch = chr(cp)
        kind = unicodedata.decomposition(ch)
        if kind.startswith(("<wide>", "<narrow>")):
            base = unicodedata.normalize("NFKC", ch)
        else:
            base = unicodedata.normalize("NFD", ch) if kind and kind[0] != "<" else ch
        out = "".join(settle(x) for x in unicodedata.normalize("NFD", base))
        if out != ch:
            entries[ch] = out
    # a letter with a following mark that together are one character: read as one, written like that character
    for ch, out in list(entries.items()):
        spelled = unicodedata.normalize("NFD", ch)
        if len(spelled) == 2 and spelled != ch and unicodedata.combining(spelled[1]):
            entries.setdefault(spelled, out)
    return Transducer((a, b) for a, b in entries.items() if a != b)


def same_form(text: str) -> str:
    """``text`` in the form that all texts a reader cannot tell from it share; applying it twice changes nothing."""
    if text.isascii() and text.isprintable():
        return text
    # no mapping and no reordering of marks goes across an ordinary blank, so words can be remembered too
    return " ".join(map(_word, text.split(" ")))


@lru_cache(maxsize=1 << 17)
def _word(word: str) -> str:
    if word.isascii() and word.isprintable():
        return word
    import regex

    return unicodedata.normalize("NFD", "".join(map(transducer().remember, regex.findall(r"\X", word))))


def with_form(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """``df`` with the common form of ``text``; null stays null, the empty text stays empty. An existing column of that name is an error."""
    if form in df.columns:
        raise ValueError(f"there is a column {form} already")
    schema = df.select("*", F.col(text).cast("string").alias(form)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(text)).to_pylist()
            out = pa.array([None if v is None else same_form(v) for v in column], pa.string())
            yield pa.record_batch([*batch.columns, out], names=[*batch.schema.names, form])

    return df.mapInArrow(run, schema)


def alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(class_id, spelling, key)``: every row whose text has at least one other spelling that reads the same. ``class_id`` tells the forms apart,
    ``spelling`` the stored texts of one form (both are digests of 128 bits). Null keys and texts are in no class; copies of rows count once.

    Each text is folded once, and only digests go on, so long texts cost no more to shuffle than short ones. No class is gathered: it is found
    mixed by an aggregate with map-side combination, and its rows stay rows.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("t")).where("key is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        digest = lambda t: blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            texts = batch.column("t").to_pylist()
            forms = pa.array([digest(same_form(t)) for t in texts], pa.binary())
            yield pa.record_batch([forms, pa.array(map(digest, texts), pa.binary()), batch.column("key")], names=["class_id", "spelling", "key"])

    folded = cut(spread(rows, "key").mapInArrow(run, "class_id binary, spelling binary, key string"))
    # only forms with more than one stored text go on
    mixed = folded.groupBy("class_id").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("class_id")
    return folded.join(mixed, "class_id", "left_semi").distinct()


def alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(left_key, right_key)``, ``left_key < right_key`` as strings: rows whose texts differ as stored but not to a reader, from :func:`alike_classes`.

    The number of pairs is that of the result asked for; a crowded form is one join key, whose partition adaptive execution can split.
    For results that grow no faster than the table, take the classes.
    """
    rows = cut(alike_classes(df, key, text))
    left, right = rows.selectExpr("class_id", "key as left_key", "spelling as s1"), rows.selectExpr("class_id", "key as right_key", "spelling as s2")
    return left.join(right, "class_id").where("left_key < right_key and s1 <> s2").select("left_key", "right_key").distinct()
