"""Queries p2, p3 and p7 over whole tables, with SQL for the same results where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import nearby, orphans, shred
from quire.sources.tables import table

COORDINATE = ("book_id", "chapter", "verse")


def corpus_cascade(spark: SparkSession, d: str, keys: list[orphans.ForeignKey]) -> DataFrame:
    """Foreign keys of the corpus, through the cascade."""
    whole = {"start": "loaded_at", "until": "withdrawn_at"}
    columns = {
        "books": ("id", "loaded_at", "withdrawn_at"),
        "verses": ("id", *COORDINATE, "loaded_at", "withdrawn_at"),
        "places": ("id",),
        "documents": ("doc_id", "loaded_at"),
        "cross_references": ("id", "to_book_id", "to_chapter", "to_verse_start", "loaded_at"),
        "place_verses": ("id", "place_id", *COORDINATE, "loaded_at"),
        "note_cross_references": ("id", "note_id", "to_book_id", "loaded_at"),
    }
    entities = []
    for name in dict.fromkeys(n for key in keys for n in (key.parent, key.child)):
        times = {k: v for k, v in whole.items() if v in columns[name]}
        entities.append(orphans.Entity(name, table(spark, d, name, *columns[name]), key=columns[name][0], **times))
    return orphans.orphan_cascade(entities, keys)


CORPUS_KEYS = [
    orphans.ForeignKey("verses", ("book_id",), "books", ("id",)),
    orphans.ForeignKey("cross_references", ("to_book_id", "to_chapter", "to_verse_start"), "verses", COORDINATE),
    orphans.ForeignKey("place_verses", COORDINATE, "verses", COORDINATE),
    orphans.ForeignKey("place_verses", ("place_id",), "places", ("id",)),
    orphans.ForeignKey("note_cross_references", ("to_book_id",), "books", ("id",)),
    orphans.ForeignKey("note_cross_references", ("note_id",), "documents", ("doc_id",)),
]
#: The keys the problem names.
FOUND_KEYS = [CORPUS_KEYS[i].name for i in (1, 2, 4)]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans of the keys the problem names; verses without a book are in the cascade too, as their references inherit that."""
    found = corpus_cascade(spark, d, [CORPUS_KEYS[i] for i in (0, 1, 2, 4)]).where(F.col("fk").isin(FOUND_KEYS) & (F.col("kind") == "direct"))
    return found.select("ref_table", F.col("ref_id").cast("long").alias("ref_id")).distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(corpus_cascade(spark, d, CORPUS_KEYS))


_FORCE = "v.loaded_at <= r.loaded_at AND (v.withdrawn_at IS NULL OR v.withdrawn_at > r.loaded_at)"
_P2 = f"""
SELECT DISTINCT 'cross_references' AS ref_table, r.id AS ref_id FROM cross_references r WHERE r.to_verse_start IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM verses v WHERE v.book_id = r.to_book_id AND v.chapter = r.to_chapter AND v.verse = r.to_verse_start AND {_FORCE})
UNION ALL SELECT DISTINCT 'place_verses', r.id FROM place_verses r WHERE r.verse IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM verses v WHERE v.book_id = r.book_id AND v.chapter = r.chapter AND v.verse = r.verse AND {_FORCE})
UNION ALL SELECT DISTINCT 'note_cross_references', r.id FROM note_cross_references r WHERE r.to_book_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM books v WHERE v.id = r.to_book_id AND {_FORCE})
"""

#: Direct and inherited orphans: a verse is an orphan if its book was not in force when it was loaded.
_P2_REPORT = f"""
WITH orphan_verses AS (
  SELECT DISTINCT r.id, r.loaded_at AS m FROM verses r WHERE r.book_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM books v WHERE v.id = r.book_id AND {_FORCE})),
refs AS (
  SELECT DISTINCT 'cross_references' AS ref_table, '{FOUND_KEYS[0]}' AS fk, id, to_book_id AS b, to_chapter AS c, to_verse_start AS w, loaded_at FROM cross_references
  UNION ALL SELECT DISTINCT 'place_verses', '{FOUND_KEYS[1]}', id, book_id, chapter, verse, loaded_at FROM place_verses),
known AS (SELECT DISTINCT v.book_id, v.chapter, v.verse, v.loaded_at, v.withdrawn_at, o.id IS NULL AS sound FROM verses v LEFT JOIN orphan_verses o ON o.id = v.id),
judged AS (
  SELECT r.ref_table, r.fk, r.id, r.loaded_at, count(v.loaded_at) AS n, coalesce(bool_or(v.sound), false) AS sound FROM refs r
  LEFT JOIN known v ON v.book_id = r.b AND v.chapter = r.c AND v.verse = r.w AND {_FORCE} WHERE r.b IS NOT NULL AND r.c IS NOT NULL AND r.w IS NOT NULL GROUP BY ALL),
verdicts AS (
  SELECT 'verses' AS ref_table, '{CORPUS_KEYS[0].name}' AS fk, m AS ts, 'direct' AS kind FROM orphan_verses
  UNION ALL SELECT ref_table, fk, loaded_at, CASE WHEN n = 0 THEN 'direct' ELSE 'inherited' END FROM judged WHERE n = 0 OR NOT sound
  UNION ALL SELECT 'note_cross_references', '{FOUND_KEYS[2]}', loaded_at, 'direct' FROM (SELECT DISTINCT r.id, r.loaded_at FROM note_cross_references r
    WHERE r.to_book_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM books v WHERE v.id = r.to_book_id AND {_FORCE}))
  UNION ALL SELECT 'note_cross_references', '{CORPUS_KEYS[5].name}', loaded_at, 'direct' FROM (SELECT DISTINCT r.id, r.loaded_at FROM note_cross_references r
    WHERE r.note_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents v WHERE v.doc_id = r.note_id AND v.loaded_at <= r.loaded_at))
  UNION ALL SELECT 'place_verses', '{CORPUS_KEYS[3].name}', loaded_at, 'direct' FROM (SELECT DISTINCT r.id, r.loaded_at FROM place_verses r
    WHERE r.place_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM places v WHERE v.id = r.place_id)))
SELECT ref_table, fk, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS period, count_if(kind = 'direct')::BIGINT AS direct, count_if(kind = 'inherited')::BIGINT AS inherited FROM verdicts GROUP BY ALL
"""


def _nodes(spark: SparkSession, d: str, name: str, parent: str, child: str) -> DataFrame:
    return shred.shredded(table(spark, d, name, "raw_id", "payload"), "raw_id", "payload", (parent, child))


#: Raw tables with the entities in them and the value asked for.
RAW = (("raw_journeys", "journeys", "stops", "place_id"), ("raw_notes", "notes", "cross_references", "book"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, parent, child, value in RAW:
        found = shred.stored(_nodes(spark, d, name, parent, child)).records(parent, child)
        parts.append(found.select(F.lit(name).alias("raw_table"), F.col("key").alias("raw_id"), "parent_pos", "child_pos", shred.value_of("body", value).alias("value")).distinct())
    return parts[0].unionByName(parts[1])


def p3_objects(spark: SparkSession, d: str) -> DataFrame:
    """How often each distinct stop or note reference occurs: objects stored once against bridge rows."""
    parts = []
    for name, parent, child, _ in RAW:
        links = _nodes(spark, d, name, parent, child).drop("body").where((F.col("field") == child) & F.col("ordinal").isNotNull())
        parts.append(links.groupBy("hash").agg(F.count("*").alias("occurrences"), F.countDistinct("key").alias("files")).select(F.lit(name).alias("raw_table"), "hash", "occurrences", "files"))
    return parts[0].unionByName(parts[1])


KM = 2.0


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    points = nearby.usable_points(table(spark, d, "places", "id", "latitude", "longitude"), "id", "latitude", "longitude")
    return nearby.near_pairs(points, KM).select(F.col("id_a").alias("place_id_a"), F.col("id_b").alias("place_id_b"))


_P7 = f"""
WITH p AS (SELECT DISTINCT id, latitude AS lat, longitude AS lon FROM places WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
  AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0))
SELECT DISTINCT a.id AS place_id_a, b.id AS place_id_b FROM p a JOIN p b ON a.id < b.id AND b.lat BETWEEN a.lat - 0.0181 AND a.lat + 0.0181
WHERE 2 * {nearby.EARTH_KM} * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= {KM}
"""

#: Half the diagonals of the regions, in degrees: a rhombus around each place that is a region.
HALF_LAT, HALF_LON = 0.5, 0.75


def p7_regions(spark: SparkSession, d: str) -> DataFrame:
    """The usable places inside each region, a polygon of four corners around every usable place of the type region."""
    places = table(spark, d, "places", "id", "latitude", "longitude", "type")
    points = nearby.usable_points(places, "id", "latitude", "longitude")
    centres = nearby.usable_points(places.where("type = 'region'"), "id", "latitude", "longitude").where(f"abs(lat) <= 89 and abs(lon) <= {180 - HALF_LON}")
    corner = lambda i, j: F.struct((F.col("lat") + i * HALF_LAT).alias("lat"), (F.col("lon") + j * HALF_LON).alias("lon"))
    regions = centres.select(F.col("id").alias("region_id"), F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1)).alias("ring"))
    return nearby.points_in_regions(points, regions).select(F.col("id").alias("place_id"), "region_id")


_P7_REGIONS = f"""
WITH p AS (SELECT DISTINCT id, type, latitude AS lat, longitude AS lon FROM places WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
  AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0))
SELECT DISTINCT p.id AS place_id, r.id AS region_id FROM p JOIN p r ON r.type = 'region' AND abs(r.lat) <= 89 AND abs(r.lon) <= {180 - HALF_LON} AND p.lat BETWEEN r.lat - 1 AND r.lat + 1
WHERE abs(p.lat - r.lat) / {HALF_LAT} + abs(p.lon - r.lon) / {HALF_LON} <= 1
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_objects": p3_objects, "p7_found": p7_found, "p7_regions": p7_regions}
SQL = {"p2_found": _P2, "p2_report": _P2_REPORT, "p7_found": _P7, "p7_regions": _P7_REGIONS}
