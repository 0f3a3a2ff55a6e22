"""Contracts of the file scans, the transforms and the sinks, on files of our own."""

import json

import pytest

from quire.errors import ContractError, InvalidParameter, NoVersesFound, UnknownValue, VectorGuardError
from quire.operators import constraints, etl, overlays, passages, vectors
from quire.plans.reference import AliasResolver, parse_reference
from quire.sources import corpora, sinks

BOOKS = """
## Old
| # | id | Name | Testament | Aliases |
|---|---|---|---|---|
| 1 | AAA | Acorn | OT | acorn, ac |
| 2 | 1BB | 1 Birch | NT | 1 bir, i birch |
"""


@pytest.fixture(scope="module")
def catalog(spark):
    return corpora.book_table(spark, BOOKS)


def write(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    (folder / name).write_text(text, "utf-8")
    return str(folder)


def version(code="EN1", **over):
    chapters = [{"number": 1, "verses": [{"number": 1, "text": " In the oak. "}, {"number": 2, "text": "It grew."}], "headings": [{"before_verse": 2, "text": "Growth"}, {"before_verse": 1, "text": "Start"}]}, {"number": 2, "verses": [{"number": 1, "text": "End."}]}]
    return {"code": code, "name": "Test", "language": "en", "copyright": "none", "books": [{"abbreviation": "ac", "name": "Acorn", "order_index": 1, "chapters": chapters}]} | over


def test_book_table(spark, catalog, rows):
    assert rows(catalog.books, "id", "canonical_order") == [("1BB", 2), ("AAA", 1)]
    named = catalog.resolve(spark.createDataFrame([("I. Birch",), ("Acorn",), ("oak",), (None,)], "t string"), "t")
    assert rows(named, "t", "book_id") == sorted([("Acorn", "AAA"), ("I. Birch", "1BB"), ("oak", None), (None, None)], key=repr)
    for bad in (BOOKS.replace("| 2 |", "| 3 |"), BOOKS.replace("1BB", "1bb"), BOOKS.replace("1 bir", "acorn"), BOOKS.replace("| NT |", "| XX |")):
        with pytest.raises(ContractError):
            corpora.book_table(spark, bad)


def test_versions(spark, catalog, rows, tmp_path):
    folder = write(tmp_path / "v", "en.json", version())
    write(tmp_path / "v", "he.json", version("HE1", direction="rtl"))
    shown, verses, headings = corpora.versions(spark, [folder, str(tmp_path / "absent")], catalog)
    assert rows(shown, "id", "direction") == [("EN1", "ltr"), ("HE1", "rtl")]
    assert rows(verses.where("translation_id = 'EN1'"), "book_id", "chapter", "verse", "text") == [("AAA", 1, 1, "In the oak."), ("AAA", 1, 2, "It grew."), ("AAA", 2, 1, "End.")]
    assert rows(headings.where("translation_id = 'EN1'"), "before_verse", "ordinal", "text") == [(1, 2, "Start"), (2, 1, "Growth")]


@pytest.mark.parametrize("change", [{"code": ""}, {"direction": "up"}, {"books": [{"abbreviation": "oak", "order_index": 1, "chapters": []}]}, {"books": [{"abbreviation": "ac", "order_index": 2, "chapters": []}]}, {"books": None}, {"code": 5.5, "books": "x"}])
def test_bad_versions(spark, catalog, tmp_path, change):
    folder = write(tmp_path, "a.json", version(**change))
    with pytest.raises(Exception):
        [df.collect() for df in corpora.versions(spark, [folder], catalog)]


def test_versions_must_differ_and_exist(spark, catalog, tmp_path):
    write(tmp_path / "x", "a.json", version())
    with pytest.raises(ContractError, match="twice"):
        corpora.versions(spark, [write(tmp_path / "x", "b.json", version())], catalog)
    with pytest.raises(ContractError, match="no version"):
        corpora.versions(spark, [str(tmp_path / "none")], catalog)


def test_cross_references(spark, catalog, rows, tmp_path):
    lines = ["From\tTo\tVotes", "ac.1.1\tAcorn.2.3\t5", "", "AAA.1.2\tAAA.2.3-AAA.2.7\t-4", "AAA.1.2\tAAA.2.3-AAA.3.1\t0", "AAA.1.2\tAAA.9.1-1BB.1.1\t1"]
    path = write(tmp_path, "x.tsv", "\n".join(lines) + "\n") + "/x.tsv"
    refs, clamped = corpora.cross_references(spark, path, catalog)
    assert rows(refs, "from_verse", "to_chapter", "to_verse_start", "to_verse_end", "votes") == [(1, 2, 3, None, 5), (2, 2, 3, 7, -4), (2, 2, 3, None, 0), (2, 9, 1, None, 1)]
    assert clamped.first()[0] == 2
    for bad in ("AAA.1\tAAA.1.1\t1", "oak.1.1\tAAA.1.1\t1", "AAA.1.1\tAAA.1.1-x\t1"):
        with pytest.raises(ContractError):
            corpora.cross_references(spark, write(tmp_path, "y.tsv", f"a\tb\tc\n{bad}\n") + "/y.tsv", catalog)


def test_notes(spark, catalog, rows, tmp_path):
    note = lambda **o: {"book": "ac", "chapter": 1, "verse": 1, "text": "n"} | o
    a = write(tmp_path / "a", "1.json", {"translation": "EN1", "notes": [note(), note(ordinal=9, type="tn"), note(), note(verse=2, cross_references=[{"book": "1BB", "chapter": 1, "verse_start": 3, "verse_end": -1}, {"book": "ac", "chapter": 1, "verse_start": 3, "verse_end": 4}])]})
    b = write(tmp_path / "b", "0.json", {"translation": "EN1", "notes": [note(text="z")]})
    versions = spark.createDataFrame([("EN1",)], "id string")
    notes, refs = corpora.notes(spark, [a, b], catalog, versions)
    assert rows(notes, "id", "verse", "ordinal", "text", "char_offset") == [(1, 1, 1, "n", 0), (2, 1, 9, "n", 0), (3, 1, 3, "n", 0), (4, 2, 1, "n", 0), (5, 1, 1, "z", 0)]
    assert rows(refs, "note_id", "to_book_id", "to_verse_start", "to_verse_end") == [(4, "1BB", 3, None), (4, "AAA", 3, 4)]
    for bad in (note(book="oak"), note(type="zz"), note(text=" "), note(char_offset=-1), note(verse=0), note(cross_references=[{"book": "ac", "chapter": 1, "verse_start": 5, "verse_end": 4}])):
        with pytest.raises(ContractError):
            corpora.notes(spark, [write(tmp_path / "bad", "x.json", {"translation": "EN1", "notes": [bad]})], catalog, versions)
    with pytest.raises(ContractError, match="unknown version"):
        corpora.notes(spark, [a], catalog, spark.createDataFrame([("XX",)], "id string"))


def test_topics_lexicon_tokens_journeys(spark, catalog, rows, tmp_path):
    folder = write(tmp_path / "t", "t.json", {"source": "s", "topics": [{"id": "a", "name": "A", "section": "x", "see_also": " ", "verses": [{"book": "ac", "chapter": 1, "verse": 1}] * 2 + [{"book": "oak", "chapter": 1, "verse": 1}]}, {"id": "b", "name": "B", "section": "x", "see_also": "a", "verses": []}]})
    topics, links, skipped = corpora.topics(spark, [folder], catalog)
    assert rows(topics, "id", "see_also") == [("a", None), ("b", "a")] and links.count() == 1 and skipped.first()[0] == 1
    entry = {"strongs_id": "G1", "language": "grc", "lemma": "λ", "transliteration": "", "gloss": "g", "definition": "d"}
    folder = write(tmp_path / "l", "lexicon.json", {"source": "s", "entries": [entry]})
    token = {"book": "ac", "chapter": 1, "verse": 1, "position": 1, "surface_form": "w"}
    write(tmp_path / "l", "tokens-x.json", {"text_id": "T", "tokens": [token | {"strongs_id": "G1"}, token | {"surface_form": "late"}, token | {"book": "oak"}, token | {"position": 2}]})
    assert corpora.lexicon(spark, [folder]).count() == 1
    words, skipped = corpora.word_tokens(spark, [folder], catalog)
    assert rows(words, "position", "surface_form", "strongs_id") == [(1, "w", "G1"), (2, "w", None)] and skipped.first()[0] == 1
    with pytest.raises(ContractError):
        corpora.lexicon(spark, [write(tmp_path / "l2", "a.json", {"source": "s", "entries": [entry, entry]})])
    trip = {"id": "j", "name": "J", "scripture": "x", "source": "s", "note": "n", "stops": [{"ordinal": 1, "place_id": "p"}, {"ordinal": 2, "place_id": "p", "reference": "ac 1:1"}]}
    places = spark.createDataFrame([("p",)], "id string")
    _, stops = corpora.journeys(spark, [write(tmp_path / "j", "j.json", {"journeys": [trip]})], places)
    assert rows(stops, "ordinal", "reference") == [(1, None), (2, "ac 1:1")]
    for bad in ([trip, trip], [trip | {"stops": []}], [trip | {"stops": [{"ordinal": 1, "place_id": "q"}]}], [trip | {"stops": [{"ordinal": 1, "place_id": "p"}] * 2}]):
        with pytest.raises(ContractError):
            corpora.journeys(spark, [write(tmp_path / "j2", "j.json", {"journeys": bad})], places)


def test_names_of_files(spark, tmp_path):
    entry = lambda i: {"source": "s", "entries": [{"strongs_id": i, "language": "grc", "lemma": "l", "transliteration": "", "gloss": "g", "definition": "d"}]}
    for i, name in enumerate(("t.json", "thayer.json", "_x.json", ".y.json", "token.json", "tokens.json", "a-tokens-b.json")):
        folder = write(tmp_path / "n", name, entry(f"G{i}"))
    write(tmp_path / "n", "tokens-x.json", {"source": ["not a lexicon"], "entries": 1})
    write(tmp_path / "n", "notes.txt", "x")
    assert sorted(r.strongs_id for r in corpora.lexicon(spark, [folder]).collect()) == [f"G{i}" for i in range(7)]


def test_lines_keep_their_order(spark, tmp_path):
    text = "\ufeff" + "\n".join(f"{i}\tx" for i in range(20_000))
    path = write(tmp_path, "long.tsv", text) + "/long.tsv"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [r.cols[0] for r in corpora.tab_lines(spark, path, 2).orderBy("path", "line").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [str(i) for i in range(20_000)]


def test_numbers_run_on(spark):
    from quire.operators.numbering import numbered

    df = spark.range(1000).selectExpr("id * 7919 % 1000 as k")
    assert [(r.k, r.n) for r in numbered(df, ["k"], "n").orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]
    assert numbered(df.limit(0), ["k"], "n").count() == 0


def test_stores_and_lookups(spark, tmp_path):
    import numpy as np

    embedder = vectors.HashingEmbedder(16)
    words = ["feast of the shepherd", "river", "the feast", "wall and gate", None]
    texts = spark.createDataFrame(list(enumerate(words)), "id int, text string")
    assert vectors.write_store(texts, ["id"], "text", embedder, str(tmp_path / "s"), model="m") == 4
    store = vectors.Store.of(spark, str(tmp_path / "s"), embedder, ["id"])
    assert store is vectors.Store.of(spark, str(tmp_path / "s"), embedder, ["id"]) and [r.id for r in store.ordered().collect()] == [0, 1, 2, 3]
    scores = embedder.embed(words[:4]) @ embedder.embed(["the feast"])[0]
    assert [r.id for r in store.search("the feast", 3).collect()] == np.argsort(-scores, kind="stable")[:3].tolist()
    with pytest.raises(InvalidParameter):
        store.search("x", 3, min_score=2.0)
    with pytest.raises(VectorGuardError, match="no texts"):
        vectors.write_store(texts.where("text is null"), ["id"], "text", embedder, str(tmp_path / "e"), model="m")
    with pytest.raises(VectorGuardError):
        vectors.Store(spark, str(tmp_path / "s"), vectors.HashingEmbedder(8), ["id"])
    assert vectors.write_store(texts, ["id"], "text", embedder, str(tmp_path / "l"), model="m", limit=2) == 2
    from quire.errors import NoMatch

    assert overlays.lookup(texts, "river", "id", "text").first()["id"] == 1
    with pytest.raises(NoMatch):
        overlays.lookup(texts, "none", "text")
    assert overlays.allowed_value(texts, "text", " river ") == "river" and overlays.allowed_value(texts, "text", " ") is None
    with pytest.raises(UnknownValue):
        overlays.allowed_value(texts, "text", "sea")


def test_places(spark, catalog, rows, tmp_path):
    special = lambda *s: [{"resolutions": [{"special": x} for x in s]}]
    far = {"m1": {"score": 600, "name": "One"}, "m9": {"score": 700, "name": "Unlocated"}}
    ancient = [
        {"id": "a", "friendly_id": "Aro 2", "types": ["river"], "modern_associations": far, "verses": [{"sort": "01001002", "osis": "x"}, {"sort": "01001002"}, {"sort": "99001001", "osis": "AAA.1.1"}, {"sort": "01000001", "osis": "1BB.1.7"}, {"osis": "Acorn.3.4"}, {"osis": "oak.1.1"}]},
        {"id": "b", "friendly_id": "Bo", "modern_associations": {"m1": {"score": 100, "name": "One"}, "m2": {"score": 100, "name": "Two"}}},
        {"id": "c", "friendly_id": "Co", "modern_associations": far, "identifications": special("unknown_place", "multiple_locations")},
        {"id": "d", "friendly_id": "Do", "modern_associations": {"m2": {"score": -5}}},
        {"id": "e", "friendly_id": "Eo", "identifications": special("not_a_place")},
        {"id": "f", "friendly_id": "Fo", "identifications": special("recursive", "not_a_place")},
        {"id": "g", "friendly_id": "Go", "modern_associations": {"m1": {"score": "high"}}},
    ]
    path = write(tmp_path, "ancient.jsonl", "\n\n".join(map(json.dumps, ancient)))
    write(tmp_path, "modern.jsonl", "\n".join(map(json.dumps, [{"id": "m1", "lonlat": "41.5,40.25"}, {"id": "m2", "lonlat": "1, 2"}, {"id": "m3", "lonlat": "x,1"}, {"id": "m4"}])))
    modern = corpora.positions(spark, f"{path}/modern.jsonl")
    assert rows(modern) == [("m1", 41.5, 40.25), ("m2", 1.0, 2.0)]
    lines = corpora.json_lines(spark, f"{path}/ancient.jsonl", corpora.PLACES_LINES)
    places = etl.derived_places(lines, modern)
    assert rows(places, "id", "name", "type", "status", "confidence", "confidence_score", "latitude", "modern_name") == [
        ("a", "Aro", "river", "disputed", "high", 700, 40.25, "One"), ("b", "Bo", "unknown", "disputed", "medium", 100, 40.25, "One"), ("c", "Co", "unknown", "unknown", None, None, None, None),
        ("d", "Do", "unknown", "disputed", "low", -5, 2.0, None), ("f", "Fo", "unknown", "unknown", None, None, None, None), ("g", "Go", "unknown", "identified", "low", 0, 40.25, None),
    ]
    links, skipped = etl.place_links(lines, places, catalog)
    assert rows(links) == [("a", "1BB", 1, 7), ("a", "AAA", 1, 2), ("a", "AAA", 3, 4)] and skipped.first()[0] == 2
    with pytest.raises(Exception):
        corpora.json_lines(spark, write(tmp_path / "bad", "x.jsonl", "[1]\n") + "/x.jsonl", corpora.PLACES_LINES).collect()


def test_tagged_texts(spark, catalog, rows, tmp_path):
    greek = ["﻿head", "AAA.1.1#01\tλόγος (logos)\t-\tG0026K=N-NSM\t-\tSBL+X", "AAA.1.1#01\tlate\t-\tG1=N\t-\tSBL", "AAA.1.1#02\tx\t-\tG1=N\t-\tX", "oak.1.1#03\tx\t-\tG1\t-\tSBL", "AAA.1.1#04\t(x)\t-\tG1\t-\tSBL", "AAA.1.1#05\ty\t-\tzz=\t-\t SBL ", "short\t1"]
    path = write(tmp_path, "g.tsv", "\r\n".join(greek))
    own = etl.tagged_greek(corpora.tab_lines(spark, f"{path}/g.tsv", 6), catalog)
    assert rows(own.where("reason is null"), "position", "surface_form", "strongs_id", "morph_code") == [(1, "λόγος", "G26", "N-NSM"), (5, "y", None, None)]
    assert rows(etl.reasons(own)) == sorted([("kept", 2), ("dup_position", 1), ("not_edition", 1), ("unresolved_book", 1), ("empty_surface", 1)])
    cell = lambda ref, s, d="{H1}", g="N", r="H0007G": "\t".join([ref, s, "", "", d, g, "", "", r])
    write(tmp_path, "h.tsv", "\n".join([cell("AAA.1.0#01", "t"), cell("AAA.1.1#01", "a/b\\", "H9/{H7}", "C/N"), cell("AAA.1.1#01", "v"), cell("AAA.1.1#02", "/", r="")]))
    own = etl.tagged_hebrew(corpora.tab_lines(spark, f"{path}/h.tsv", 9), catalog)
    assert rows(own, "position", "surface_form", "strongs_id", "morph_code", "reason") == sorted([(1, "t", "H7", "N", "verse_0"), (1, "ab", "H7", "N", None), (1, "v", "H7", "N", "dup_position"), (2, "", None, "N", "empty_surface")], key=repr)
    write(tmp_path, "l.tsv", "\n".join(["intro", "G0001\ta", "\t".join(["G0002", "", "", "", "t", "", "g", "d"]), "\t".join(["G0002A", "", "", "λ", "t", "", "g", "<b>d</b>"]), "\t".join(["G0002B", "", "", "μ", "t", "", "g", "e"])]))
    own = etl.lexicon_entries(corpora.tab_lines(spark, f"{path}/l.tsv", 1), "grc")
    assert rows(own, "strongs_id", "lemma", "definition", "reason") == sorted([("G1", None, None, "short"), ("G2", "", "d", "empty"), ("G2", "λ", "d", None), ("G2", "μ", "e", "dup_base")], key=repr)


def test_topical_index(spark, catalog, rows, tmp_path):
    text = '﻿section,subject,entry\nA,"Oak, old","AAA 1:3,5-6; 2:1 oak 4:4; 5:5 1BB 1:9-2"\nA,Oak old,See ELM TREE; x\nB,---,AAA 1:1\nB,Elm,\n'
    path = write(tmp_path, "n.csv", text)
    records = corpora.csv_records(spark, f"{path}/n.csv", "section string, subject string, entry string").coalesce(1)
    from pyspark.sql import functions as F

    topics, links, refs = etl.topical_index(records.withColumn("position", F.monotonically_increasing_id()), catalog)
    assert rows(topics, "id", "see_also") == sorted([("oak-old", None), ("oak-old-2", "elm-tree"), ("elm", None)])
    assert rows(links) == [("oak-old", "AAA", 1, 3), ("oak-old", "AAA", 1, 5), ("oak-old", "AAA", 1, 6), ("oak-old", "AAA", 2, 1)]
    assert rows(etl.reasons(refs)) == [("bad_range", 1), ("kept", 2), ("no_book", 1), ("unresolved_book", 1)]


def test_repaired_headings(spark, rows):
    verses = spark.createDataFrame([("E", "AAA", 1, 1, "He went. The Song of Reeds"), ("E", "AAA", 1, 2, "She said. The Long Road"), ("E", "AAA", 2, 1, "All. The Last Word"), ("F", "AAA", 1, 1, "Er ging. The Song of Reeds"), ("E", "AAA", 1, 3, None)], "translation_id string, book_id string, chapter int, verse int, text string")
    fixed, headings, changes = etl.repaired_headings(verses)
    assert rows(fixed.where("translation_id = 'E'"), "chapter", "verse", "text") == sorted([(1, 1, "He went."), (1, 2, "She said."), (2, 1, "All."), (1, 3, None)], key=repr)
    assert rows(headings, "translation_id", "chapter", "before_verse", "text") == [("E", 1, 2, "The Song of Reeds"), ("E", 1, 3, "The Long Road")]
    assert rows(changes.where("skipped"), "translation_id", "chapter") == [("E", 2), ("F", 1)]
    assert rows(etl.corroboration(changes).where("not low_confidence"), "heading", "n_versions") == [("The Song of Reeds", 2)]


def test_documents_go_round(spark, catalog, rows, tmp_path):
    verses = spark.createDataFrame([("EN1", "AAA", 2, 1, "c"), ("EN1", "AAA", 1, 2, "b"), ("EN1", "AAA", 1, 1, "a"), ("EN1", "1BB", 1, 1, "d")], "translation_id string, book_id string, chapter int, verse int, text string")
    headings = spark.createDataFrame([("EN1", "AAA", 1, 1, 2, "B"), ("EN1", "AAA", 1, 2, 1, "A")], "translation_id string, book_id string, chapter int, ordinal int, before_verse int, text string")
    sinks.write_documents(etl.version_lines(verses, catalog.books, headings), str(tmp_path / "out"), "translation_id", ["canonical_order", "chapter"])
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["EN1.json"]
    assert [b["abbreviation"] for b in json.loads((tmp_path / "out" / "EN1.json").read_text())["books"]] == ["AAA", "1BB"]
    _, back, titles = corpora.versions(spark, [str(tmp_path / "out")], catalog)
    assert rows(back) == rows(verses)
    assert rows(titles, "ordinal", "before_verse", "text") == [(1, 2, "B"), (2, 1, "A")]
    sinks.write_json(verses, str(tmp_path / "lines"), files=1)
    assert spark.read.json(str(tmp_path / "lines")).count() == 4


def test_sinks(spark, rows, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 as book_id")
    assert sinks.write_table(df, str(tmp_path), "t", cluster=["book_id"]) == 100
    assert sinks.write_table(df.limit(7), str(tmp_path), "t") == 7
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 7
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t.parquet"]
    assert list(sinks.build({"verses": df.selectExpr("'A' as book_id", "1 as chapter", "id as verse"), "books": df}, str(tmp_path))) == ["books", "verses"]
    assert len({r.etag for r in sinks.with_etag(df.limit(3)).collect()}) == 3


def test_constraints(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), (None, 0, " "), ("b", None, "z")], "k string, n int, t string")
    assert rows(constraints.duplicate_keys(df, ["k", "n"])) == [("a", 1, 2)]
    assert rows(constraints.missing_parents(df, ["k"], spark.createDataFrame([("a",)], "id string"), ["id"]), "k") == [("b",)]
    assert rows(constraints.outside_values(df, "t", ["x", "y", "z"]), "t") == [(" ",)]
    assert rows(constraints.broken_rows(df, required=["k"], non_empty=["t"], positive=["n"]), "broken") == [("k is missing",), ("n is missing",)]
    with pytest.raises(ContractError, match="twice"):
        constraints.require(constraints.duplicate_keys(df, ["k"]), "a key comes twice")


def test_passages(spark, rows):
    verses = spark.createDataFrame([(i, t, "AAA", c, v, f"{t}{c}{v}") for i, (t, c, v) in enumerate((t, c, v) for t in ("E", "D") for c in (1, 2) for v in (1, 2, 3) if (t, c, v) != ("D", 1, 2))], "id long, translation_id string, book_id string, chapter int, verse int, text string")
    verses = verses.union(verses.limit(3))
    books = spark.createDataFrame([("AAA", "Acorn", "OT", 1)], "id string, name string, testament string, canonical_order int")
    at = lambda t: parse_reference(t, AliasResolver.from_tables(books))
    own = passages.verses_of(verses, at("acorn 1:2-2:1"), ["D", "E", "X"])
    assert rows(passages.parallel(own, ["E", "D", "X"])) == [("AAA", 1, 2, "E12", None, None), ("AAA", 1, 3, "E13", "D13", None), ("AAA", 2, 1, "E21", "D21", None)]
    assert [(r.translation_id, len(r.verses)) for r in passages.grouped(own, ["X", "D", "E"]).orderBy("position").collect()] == [("X", 0), ("D", 2), ("E", 3)]
    assert passages.verses_of(verses, at("acorn 1"), []).count() == 0
    assert passages.reference_exists(verses, at("acorn 2:3")) and not passages.reference_exists(verses, at("acorn 9"))
    with pytest.raises(NoVersesFound):
        passages.require_rows(passages.verses_of(verses, at("acorn 9"), None), at("acorn 9"))
    assert [r.text for r in passages.stream_version(verses, books, "D")] == ["D11", "D13", "D21", "D22", "D23"]
    assert passages.random_verse(verses, books, "E", seed=5).first() == passages.random_verse(verses.repartition(3), books, "E", seed=5).first()
    assert passages.random_verse(verses, books, "E", testament="nt").count() == 0
    assert passages.resolve_ids(" e , d,E ", ["D", "E"], "D") == ("E", "D") and passages.resolve_ids("", ["D"], "D") == ("D",) and passages.resolve_ids("*", ["E", "D"], "D") == ("D", "E")
    with pytest.raises(UnknownValue):
        passages.resolve_ids("q", ["D"], "D")
    for bad in ({"limit": 0}, {"limit": 999}, {"offset": -1}):
        with pytest.raises(InvalidParameter):
            passages.page(verses, "id", **bad)


def test_overlays(spark, rows):
    journeys = spark.createDataFrame([("j1",), ("j2",), ("j3",)], "journey_id string")
    stops = spark.createDataFrame([("j1", 1, "p"), ("j1", 2, "q"), ("j1", 3, "p"), ("j2", 1, "q"), ("j1", 1, "p")], "journey_id string, ordinal int, place_id string")
    assert rows(overlays.journeys_at(journeys, stops, "p")) == [("j1", 3)]
    assert rows(overlays.link_counts(journeys, stops, "journey_id", "journey_id")) == [("j1", 3), ("j2", 1), ("j3", 0)]
    nested = overlays.nested(journeys, stops, "journey_id", "journey_id", ["ordinal", "place_id"], "stops")
    assert {r.journey_id: len(r.stops) for r in nested.collect()} == {"j1": 4, "j2": 1, "j3": 0}
    entries = spark.createDataFrame([("grc", "G10"), ("grc", "G9"), ("grc", "G"), ("hbo", "H1")], "language string, strongs_id string")
    assert [r.strongs_id for r in entries.orderBy(*overlays.lexicon_order()).collect()] == ["G", "G9", "G10", "H1"]


def test_vectors(spark):
    df = spark.createDataFrame([("b", [0.0, 2.0, 0.0]), ("a", [0.0, 1.0, 0.0]), ("c", [1.0, 1.0, 0.0]), ("d", None), ("e", [0.0, 0.0, 0.0]), ("f", [-1.0, 0.0, 0.0])], "id string, v array<float>")
    for fast in (True, False):
        top = lambda k, **o: [(r.id, round(r.score, 4)) for r in vectors.cosine_top_k(df, "v", [0, 5, 0], k, order=["id"], fast=fast, **o).collect()]  # noqa: E731, B023
        assert top(2) == [("a", 1.0), ("b", 1.0)]
        assert top(9) == [("a", 1.0), ("b", 1.0), ("c", 0.7071), ("f", 0.0)]
        assert top(9, floor=0.5) == [("a", 1.0), ("b", 1.0), ("c", 0.7071)] and top(0) == []
    made = vectors.embedded(spark.createDataFrame([("one",), (None,), ("",)], "t string"), "t", vectors.HashingEmbedder(8), batch=1).collect()
    assert made[1].vector is None and abs(sum(x * x for x in made[0].vector) - 1) < 1e-5
    meta = spark.createDataFrame([("m", "r", 8, "fp32", 1)], "model string, model_revision string, dim int, precision string, normalized int")
    vectors.guard(meta, {"model": "m", "dim": 8})
    with pytest.raises(VectorGuardError, match="dim.*precision"):
        vectors.guard(meta, {"dim": 9, "precision": "int8", "model": "m"})
    with pytest.raises(VectorGuardError):
        vectors.guard(meta.limit(0), {})
