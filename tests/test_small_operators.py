"""Headings with book names (E6), default texts (D16), the start-up check (C9) and the manifest."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.errors import ContractError
from quire.functions import scalars
from quire.operators import constraints, etl, overlays
from quire.sources import sinks


def test_headings(spark):
    books = spark.createDataFrame([("B", "Second", 2), ("A", "First", 9), ("A", "First", 9)], "id string, name string, canonical_order int")
    rows = [(4, "X", "A", 1, 5, 1, "late"), (3, "X", "A", 1, 5, 0, "early"), (2, "X", "A", 1, 1, 0, "top"), (1, "X", "B", 3, 1, 0, "b"), (5, "Y", "A", 1, 1, 0, "y"), (6, "X", "Q", 1, 1, 0, "no book")]
    df = spark.createDataFrame(rows + rows[:2], "id int, translation_id string, book_id string, chapter int, before_verse int, ordinal int, text string")
    got = overlays.headings_of(df, books, "X", "A", 1).select("book_name", "before_verse", "text").collect()
    assert [tuple(r) for r in got] == [("First", 1, "top"), ("First", 5, "early"), ("First", 5, "late")]
    assert [r.text for r in overlays.headings_of(df, books).collect()] == ["b", "top", "early", "late", "y"]
    assert overlays.headings_of(df, books, "X", "A", 2).count() == 0


def test_default_text(spark, rows):
    df = spark.createDataFrame([("H430", "OT"), (" h07 ", "NT"), ("G26", None), (None, "DC")], "word string, testament string")
    got = df.select(scalars.default_text_of_word(F.col("word")).alias("w"), scalars.default_text_of_testament(F.col("testament")).alias("t"))
    assert [tuple(r) for r in got.collect()] == [("OSHB", "OSHB"), ("OSHB", "SBLGNT"), ("SBLGNT", "SBLGNT"), ("SBLGNT", "SBLGNT")]


def test_verify(spark, tmp_path):
    for name in constraints.REQUIRED[1:]:
        spark.range(3).union(spark.range(1)).write.parquet(f"{tmp_path}/{name}.parquet")
    with pytest.raises(ContractError, match="translations"):
        constraints.verify(spark, str(tmp_path), "EN")
    spark.createDataFrame([("EN",), ("DE",)], "id string").write.parquet(f"{tmp_path}/translations.parquet")
    assert constraints.verify(spark, str(tmp_path), "EN", embedded="DE") == {"translations": 2, "verses": 3, "cross_references": 3, "books": 3, "places": 3}
    for default, embedded in (("FR", None), ("EN", "FR")):
        with pytest.raises(ContractError, match="FR"):
            constraints.verify(spark, str(tmp_path), default, embedded=embedded)


def test_manifest(spark, tmp_path):
    rows = [("Y", "A", 1, 2, 'The "Hill"', 1, 3, False), ("X", "A", 1, 2, 'The "Hill"', 1, 3, False), ("X", "A", 1, 10, "End", None, None, True), ("X", "A", 1, 9, "Alone", 2, 1, False)]
    changes = spark.createDataFrame(rows, "translation_id string, book_id string, chapter int, verse int, heading string, to_chapter int, before_verse int, skipped boolean")
    sinks.write_manifest(changes, etl.corroboration(changes), f"{tmp_path}/md", f"{tmp_path}/csv")
    read = lambda d: [x for p in sorted(Path(tmp_path, d).glob("part-*")) for x in p.read_text().splitlines()]
    assert read("csv") == ["code,ref,before_verse,heading,corroboration,low_confidence,skipped", 'X,A 1:2,3,"The ""Hill""",2,0,0', 'X,A 1:9,1,"Alone",1,1,0', 'X,A 1:10,None,"End",1,1,1', 'Y,A 1:2,3,"The ""Hill""",2,0,0']
    md = read("md")
    assert "Total strips: **4** across **2** translations." in md[2] and "strips: **2**" in md[2] and "skipped: **1**" in md[2]
    assert md[8:] == ['| X | A 1:2 | 3 | The "Hill" | 2 |  |', "| X | A 1:9 | 1 | Alone | 1 | LOW_CONFIDENCE |", "| X | A 1:10 | None | End | 1 | SKIPPED |", '| Y | A 1:2 | 3 | The "Hill" | 2 |  |']
