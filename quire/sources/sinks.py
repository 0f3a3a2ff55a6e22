"""B: writing a catalog of tables. A table is written beside the old one first, and takes its place when complete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Order in which tables are built: parents before what refers to them.
BUILD_ORDER = ("books", "book_aliases", "translations", "verses", "section_headings", "cross_references", "places", "place_verses", "translator_notes", "note_cross_references", "topics", "topic_verses", "strongs_entries", "word_tokens", "journeys", "journey_stops")
# Columns a table is clustered by, so that row groups outside a span are skipped.
CLUSTER = {"verses": ("book_id", "chapter", "verse"), "word_tokens": ("book_id", "chapter", "verse"), "cross_references": ("from_book_id", "from_chapter", "from_verse"), "place_verses": ("place_id",), "postings": ("term",)}


def write_table(df: DataFrame, folder: str, name: str, *, cluster: Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> int:
    """B1: ``df`` as ``folder/name.parquet``, clustered; returns the number of rows, counted while they are written."""
    from pyspark.sql import Observation

    keys = tuple(cluster or CLUSTER.get(name, ()))
    seen = Observation(f"rows-{name}")
    if keys:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    df = df.observe(seen, F.count("*").alias("n"))
    staged, final = f"{folder}/_staged-{name}", f"{folder}/{name}.parquet"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    _replace(df.sparkSession, staged, final)
    return int(seen.get["n"])


def _replace(spark: SparkSession, staged: str, final: str) -> None:
    """The staged folder takes the place of the final one; the old one is deleted only when the new one is complete."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(final).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{final}.old"
    fs.delete(path(old), True)
    if fs.exists(path(final)):
        fs.rename(path(final), path(old))
    if not fs.rename(path(staged), path(final)):
        raise OSError(f"cannot move {staged} to {final}")
    fs.delete(path(old), True)


def build(tables: Mapping[str, DataFrame], folder: str) -> dict[str, int]:
    """B1: all tables in build order; returns their row counts."""
    order = [n for n in BUILD_ORDER if n in tables] + [n for n in tables if n not in BUILD_ORDER]
    return {name: write_table(tables[name], folder, name) for name in order}


def write_json(df: DataFrame, folder: str, files: int | None = None) -> None:
    """Rows as JSON lines, in at most ``files`` files (None: one a task)."""
    (df if files is None else df.coalesce(files)).write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def write_documents(lines: DataFrame, folder: str, key: str, order: Sequence[str], suffix: str = ".json") -> None:
    """A file ``folder/<key><suffix>`` of each key, its ``line`` column in ``order``. A file is streamed by one task, never held; files
    are named on the driver, one rename a file."""
    spark = lines.sparkSession
    parts = f"{folder}/_parts"
    lines.repartition(key).sortWithinPartitions(key, *order).select(key, "line").write.mode("overwrite").partitionBy(key).text(parts)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(parts).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(path(f"{parts}/{key}=*/part-*")):
        name = unquote(status.getPath().getParent().getName().split("=", 1)[1])
        fs.rename(status.getPath(), path(f"{folder}/{name}{suffix}"))
    fs.delete(path(parts), True)


def with_etag(df: DataFrame, name: str = "etag") -> DataFrame:
    """Each row with the hash of its JSON."""
    from quire.functions.scalars import etag

    return df.withColumn(name, etag(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))


def write_manifest(changes: DataFrame, corroborated: DataFrame, markdown: str, csv: str) -> None:
    """Headings that were cut off (``etl.repaired_headings``), with the number of versions that agree (``etl.corroboration``), as one
    Markdown and one CSV file in these folders, by version and coordinate."""
    place = ["book_id", "chapter", "verse", "heading"]
    order = ["translation_id", *place]
    n, low = F.col("n_versions").cast("string"), F.col("low_confidence")
    ref = F.concat("book_id", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("verse").cast("string"))
    before = F.coalesce(F.col("before_verse").cast("string"), F.lit("None"))
    rows = changes.join(corroborated, place)
    total = rows.agg(F.count("*").alias("n"), F.countDistinct("translation_id").alias("versions"), F.count_if(low).alias("low"), F.count_if("skipped").alias("skipped")).first()
    quoted = F.concat(F.lit('"'), F.replace("heading", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", "translation_id", ref, before, quoted, n, low.cast("int").cast("string"), F.col("skipped").cast("int").cast("string"))
    _write_lines(["code,ref,before_verse,heading,corroboration,low_confidence,skipped"], rows.select(*order, line.alias("line")), order, csv)
    head = [
        "# Fused-heading cleanup manifest",
        "",
        f"Total strips: **{total.n}** across **{total.versions}** translations. Low-confidence (single-translation) strips: **{total.low}**. Unanchored/skipped: **{total.skipped}**.",
        "",
        "`LOW_CONFIDENCE` = the same (verse, heading) was not corroborated by any other translation.",
        "",
        "| Translation | Reference | before_verse | Heading | Corrob. | Flag |",
        "| --- | --- | --- | --- | --- | --- |",
    ]
    flag = F.when(F.col("skipped"), "SKIPPED").when(low, "LOW_CONFIDENCE").otherwise("")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", "translation_id", ref, before, "heading", n, flag), F.lit(" |"))
    _write_lines(head, rows.select(*order, cells.alias("line")), order, markdown)


def _write_lines(head: Sequence[str], rows: DataFrame, order: Sequence[str], folder: str) -> None:
    """One text file: ``head``, then the column ``line`` of ``rows`` in ``order``."""
    first = rows.sparkSession.createDataFrame(list(enumerate(head)), "position int, line string")
    both = first.unionByName(rows.withColumn("position", F.lit(len(head))), allowMissingColumns=True)
    both.coalesce(1).sortWithinPartitions("position", *order).select("line").write.mode("overwrite").text(folder)
