"""C: contract checks as aggregate jobs. ``*_violations`` give the offending rows; ``require`` raises for the first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import ContractError
from quire.sources.tables import delivered_once, table


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def missing_parents(child: DataFrame, columns: Sequence[str], parent: DataFrame, target: Sequence[str]) -> DataFrame:
    """Rows whose key (if not null) is no row of ``parent``."""
    known = parent.select(*(F.col(t).alias(c) for t, c in zip(target, columns))).distinct()
    return child.dropna(subset=list(columns)).join(known, list(columns), "left_anti")


def outside_values(df: DataFrame, column: str, allowed: Sequence[object]) -> DataFrame:
    """Rows with another value (null is allowed)."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def broken_rows(df: DataFrame, *, required: Sequence[str] = (), non_empty: Sequence[str] = (), positive: Sequence[str] = ()) -> DataFrame:
    """C4: rows with a null, an empty text or a number below 1 where none may be, and the first such column as ``broken``."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in (*required, *non_empty, *positive)]
    reasons += [F.when(F.trim(F.col(c)) == "", F.lit(f"{c} is empty")) for c in non_empty]
    reasons += [F.when(F.col(c) < 1, F.lit(f"{c} is below 1")) for c in positive]
    return df.withColumn("broken", F.coalesce(*reasons, F.lit(None).cast("string"))).where("broken is not null")


def disagreeing_books(verses: DataFrame) -> DataFrame:
    """Books whose versions have different numbers of chapters: ``(book_id, least, most)``."""
    per = verses.groupBy("book_id", "translation_id").agg(F.countDistinct("chapter").alias("n"))
    return per.groupBy("book_id").agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least <> most")


def chapter_counts(books: DataFrame, verses: DataFrame) -> DataFrame:
    """books with the number of chapters that their verses have, null for books without verses."""
    n = verses.groupBy(F.col("book_id").alias("id")).agg(F.countDistinct("chapter").cast("int").alias("n_chapters"))
    return books.distinct().join(n, "id", "left")


def require(violations: DataFrame, what: str, *order: Column | str) -> None:
    """Raises ContractError with the first offender in ``order``; the rest stays on the cluster."""
    first = (violations.orderBy(*order) if order else violations).limit(1).collect()
    if first:
        raise ContractError(f"{what}: {first[0].asDict(recursive=True)}")


def require_all(*checks: tuple[DataFrame, str, Sequence[Column | str]]) -> None:
    """Several ``(violations, what, order)`` in one job; raises ContractError with the first offender of the first check that has one."""
    parts = []
    for rank, (violations, what, order) in enumerate(checks):
        first = (violations.orderBy(*order) if order else violations).limit(1)
        parts.append(first.select(F.lit(rank).alias("rank"), F.lit(what).alias("what"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in first.columns))).alias("row")))
    found = reduce(DataFrame.unionByName, parts).collect()
    if found:
        worst = min(found, key=lambda r: r["rank"])
        raise ContractError(f"{worst['what']}: {worst['row']}")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(name, n_rows)`` of each table, in one job."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, df in tables.items()))


#: Tables a corpus folder must have.
REQUIRED = ("translations", "verses", "cross_references", "books", "places")


def verify(spark: SparkSession, folder: str, default: str, *, embedded: str | None = None, required: Sequence[str] = REQUIRED) -> dict[str, int]:
    """Row counts of the tables of ``folder`` at start-up; ContractError if one is missing, or if the default version or that of the vectors is not loaded."""
    found, missing = {}, []
    for name in required:
        try:
            found[name] = delivered_once(table(spark, folder, name))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing.append(name)
    if missing:
        raise ContractError(f"{folder} has no table {', '.join(missing)}")
    loaded = {r["id"] for r in table(spark, folder, "translations", "id").distinct().collect()}
    for what, version in (("default version", default), ("embedded version", embedded)):
        if version is not None and version not in loaded:
            raise ContractError(f"{what} {version!r} is not loaded; loaded: {sorted(loaded)}")
    return {r["name"]: r["n_rows"] for r in row_counts(found).collect()}
