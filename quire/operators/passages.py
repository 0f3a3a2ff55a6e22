"""Passage reads: spans of one or more versions, side by side or grouped (D, F9, F10, H, A14)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quire.errors import InvalidParameter, NoVersesFound, UnknownValue
from quire.plans.reference import Reference


def bounded(name: str, value: int, low: int, high: int | None = None) -> int:
    """``value`` if it lies within bounds."""
    if isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
        raise InvalidParameter(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else ""))
    return value


@dataclass(frozen=True)
class Page:
    """H3: the rows of a page, and the same rows unpaged for the total."""

    rows: DataFrame
    all_rows: DataFrame

    def total(self) -> int:
        return self.all_rows.count()


def page(df: DataFrame, *order: Column, limit: int = 100, offset: int = 0, most: int = 200) -> Page:
    """H3: ``order`` must be total, so that pages don't overlap. Planned as TakeOrderedAndProject."""
    bounded("limit", limit, 1, most)
    bounded("offset", offset, 0)
    return Page(df.orderBy(*order).offset(offset).limit(limit), df)


def in_versions(df: DataFrame, versions: Sequence[str] | None, column: str = "translation_id") -> DataFrame:
    """Rows of the versions; none asked for: no rows; None: all."""
    if versions is None:
        return df
    return df.where(F.col(column).isin(*versions)) if versions else df.where(F.lit(False))


def resolve_ids(asked: str | None, known: Sequence[str], default: str, what: str = "translation") -> tuple[str, ...]:
    """A comma list as distinct ids in the order asked for; blank: the default; ``*``: all, sorted."""
    names = [x.strip().upper() for x in (asked or "").split(",") if x.strip()]
    if names == ["*"]:
        return tuple(sorted(known))
    names = list(dict.fromkeys(names)) or [default]
    for name in names:
        if name not in known:
            raise UnknownValue(what, name, sorted(known))
    return tuple(names)


def verses_of(verses: DataFrame, reference: Reference, versions: Sequence[str] | None = None) -> DataFrame:
    """All spans in one scan; the predicate reaches Parquet. Repeated deliveries of a verse count once."""
    found = in_versions(verses.where(reference.predicate()), versions)
    return found.select("translation_id", "book_id", "chapter", "verse", "text").distinct()


def in_order(df: DataFrame) -> DataFrame:
    """H1: the order of passages."""
    return df.orderBy("chapter", "verse", "translation_id")


def require_rows(df: DataFrame, reference: Reference) -> DataFrame:
    """The passage, or NoVersesFound if it is empty."""
    if df.isEmpty():
        raise NoVersesFound(f"no verses at {reference.echo}")
    return df


def reference_exists(verses: DataFrame, reference: Reference) -> bool:
    """Stops at the first verse, in any version."""
    return not verses.where(reference.predicate()).isEmpty()


def parallel(df: DataFrame, versions: Sequence[str]) -> DataFrame:
    """a row a coordinate, a column a version, null where it has no text. The values are fixed, so no extra job finds them."""
    return df.groupBy("book_id", "chapter", "verse").pivot("translation_id", list(versions)).agg(F.min("text"))


def grouped(df: DataFrame, versions: Sequence[str]) -> DataFrame:
    """a row a version with its verses in order; versions without verses have an empty array. A passage bounds the arrays."""
    spark = df.sparkSession
    own = df.groupBy("translation_id").agg(F.array_sort(F.collect_list(F.struct("chapter", "verse", "text"))).alias("verses"))
    asked = spark.createDataFrame([(v, i) for i, v in enumerate(versions)], "translation_id string, position int")
    empty = F.array().cast(own.schema["verses"].dataType)
    return asked.join(own, "translation_id", "left").select("position", "translation_id", F.coalesce("verses", empty).alias("verses"))


def grouped_chapters(df: DataFrame) -> DataFrame:
    """F9 over whole tables: a row a version and chapter with its verses in order. A chapter bounds the arrays."""
    return df.groupBy("translation_id", "book_id", "chapter").agg(F.array_sort(F.collect_list(F.struct("verse", "text"))).alias("verses"))


def whole_version(verses: DataFrame, books: DataFrame, version: str) -> DataFrame:
    """One version in canonical order (book, chapter, verse). A range sort: no single task sees the whole corpus."""
    names = books.select(F.col("id").alias("book_id"), F.col("name").alias("book_name"), "canonical_order").distinct()
    own = verses.where(F.col("translation_id") == version).select("id", "book_id", "chapter", "verse", "text").distinct()
    return own.join(names, "book_id").orderBy("canonical_order", "chapter", "verse", "id")


def stream_version(verses: DataFrame, books: DataFrame, version: str) -> Iterator[Row]:
    """The same as a cursor; a partition at a time comes to the driver."""
    return whole_version(verses, books, version).toLocalIterator(prefetchPartitions=True)


def random_verse(verses: DataFrame, books: DataFrame, version: str, *, book: str | None = None, testament: str | None = None, seed: int | None = None) -> DataFrame:
    """H4: one row, or none. With a seed the same row each time, whatever the partitioning: a hash of the id orders the rows."""
    names = books.select(F.col("id").alias("book_id"), F.col("name").alias("book_name"), "testament").distinct()
    if book is not None:
        names = names.where(F.col("book_id") == book)
    if testament is not None:
        if testament.upper() not in ("OT", "NT", "DC"):
            raise InvalidParameter("testament is OT, NT or DC")
        names = names.where(F.col("testament") == testament.upper())
    own = verses.where(F.col("translation_id") == version).join(names, "book_id")
    key = F.rand() if seed is None else F.xxhash64(F.lit(seed), "id")
    return own.orderBy(key).limit(1)


def among(keys: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose ``columns`` are among those of ``keys``."""
    return df.join(keys.select(*columns).distinct(), list(columns), "left_semi")


def first_by(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key. A group limit is planned below the shuffle, so hot keys arrive already cut down."""
    place = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
