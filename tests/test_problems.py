"""Orphans, shredding and proximity against brute force on small fixtures."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest

from quire.operators import nearby, orphans, shred

START = datetime(2021, 1, 1)


def day(n):
    return None if n is None else START + timedelta(days=n)


def test_direct_and_inherited_orphans(spark):
    books = spark.createDataFrame([("A", day(0), None), ("B", day(0), day(50)), ("A", day(0), None)], "id string, loaded_at timestamp, withdrawn_at timestamp")
    verses = spark.createDataFrame([(1, "A", 1, day(1), None), (2, "B", 1, day(60), None), (3, "A", 2, day(5), day(10)), (4, "A", 2, day(20), None), (5, None, 9, day(1), None)], "id long, book string, verse int, loaded_at timestamp, withdrawn_at timestamp")
    rows = [(1, "A", 1, day(0)), (2, "A", 1, day(1)), (3, "B", 1, day(61)), (4, "A", 2, day(10)), (5, "A", 2, day(9)), (6, "A", 2, day(25)), (7, "A", None, day(9)), (8, "Z", 1, day(9)), (9, "A", 1, None), (8, "Z", 1, day(9))]
    refs = spark.createDataFrame(rows, "id long, book string, verse int, loaded_at timestamp").withColumnRenamed("id", "ref")
    entities = [orphans.Entity("books", books, start="loaded_at", until="withdrawn_at"), orphans.Entity("verses", verses, start="loaded_at", until="withdrawn_at"), orphans.Entity("refs", refs, key="ref", start="loaded_at")]
    keys = [orphans.ForeignKey("verses", ("book",), "books", ("id",)), orphans.ForeignKey("refs", ("book", "verse"), "verses", ("book", "verse"))]
    found = orphans.orphan_cascade(entities, keys)
    assert {(r.ref_table, r.ref_id, r.kind, r.period) for r in found.collect()} == {
        ("verses", "2", "direct", "2021-03"), ("refs", "1", "direct", "2021-01"), ("refs", "3", "inherited", "2021-03"), ("refs", "4", "direct", "2021-01"), ("refs", "8", "direct", "2021-01"),
    }
    report = {(r.ref_table, r.period): (r.direct, r.inherited) for r in orphans.orphan_report(found).collect()}
    assert report["refs", "2021-01"] == (3, 0) and report["refs", "2021-03"] == (0, 1)


def test_orphans_of_cycles_and_empty_tables(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 9), (4, 3), (5, 4), (6, 7), (7, 6)], "id long, up long")
    key = [orphans.ForeignKey("n", ("up",), "n", ("id",))]
    got = {(r.ref_id, r.kind, r.period) for r in orphans.orphan_cascade([orphans.Entity("n", nodes)], key).collect()}
    assert got == {("3", "direct", None), ("4", "inherited", None), ("5", "inherited", None)}
    empty = orphans.Entity("p", nodes.limit(0))
    one = [orphans.ForeignKey("n", ("up",), "p", ("id",))]
    assert orphans.orphan_cascade([orphans.Entity("n", nodes), empty], one).count() == 6
    assert orphans.orphan_cascade([orphans.Entity("n", nodes.limit(0)), empty], one).count() == 0


def test_a_long_chain_is_followed_to_its_end(spark):
    nodes = spark.createDataFrame([(i, i - 1) for i in range(1, 7)] + [(20, 21), (21, 20)], "id long, up long")
    got = orphans.orphan_cascade([orphans.Entity("n", nodes)], [orphans.ForeignKey("n", ("up",), "n", ("id",))]).collect()
    assert {(r.ref_id, r.kind) for r in got} == {(str(i), "direct" if i == 1 else "inherited") for i in range(1, 7)}


@pytest.mark.parametrize("crowded", [250_000, 2])
def test_orphans_against_brute_force(spark, crowded):
    rng = random.Random(3)
    targets = [(i, rng.randint(0, 5), rng.randint(0, 40), rng.choice([None, rng.randint(0, 60)])) for i in range(60)]
    refs = [(i, rng.choice([None, *range(8)]), rng.randint(0, 60)) for i in range(200)]
    t = spark.createDataFrame([(i, k, day(a), day(b)) for i, k, a, b in targets], "id long, k int, a timestamp, b timestamp")
    r = spark.createDataFrame([(i, k, day(a)) for i, k, a in refs], "id long, k int, a timestamp")
    got = {x.ref_id for x in orphans.orphan_cascade([orphans.Entity("t", t, start="a", until="b"), orphans.Entity("r", r, start="a")], [orphans.ForeignKey("r", ("k",), "t", ("k",))], crowded).collect()}
    want = {str(i) for i, k, at in refs if k is not None and not any(k2 == k and a <= at and (b is None or b > at) for _, k2, a, b in targets)}
    assert got == want


@pytest.mark.parametrize("text", ["", " ", "nul", "{", '{"a":1}x', "[1,]", '{"a" 1}', "NaN", "[Infinity]", "'a'", '{"a":1,}', "﻿{}", '"\t"', "01", "[1 2]", "{]", "]"])
def test_no_json(text):
    for parse in (shred.parse_json, shred._parse_deep):
        with pytest.raises(ValueError):
            parse(text)
    assert list(shred.shred(text, ("a",))) == []


@pytest.mark.parametrize("value", [{}, [], {"a": [1, {"b": None}]}, "x", True, [[[]]], {"a": {"b": {}}, "c": "é\n"}, ["a", 1.5, -2e10]])
def test_deep_parser_agrees(value):
    text = json.dumps(value, indent=1)
    assert shred._parse_deep(text) == shred.parse_json(text)


def test_depth_is_no_limit():
    deep = "[" * 50_000 + "]" * 50_000
    assert shred.parse_json('{"a":' + deep + "}") is not None


PAYLOAD = {"data": {"js": [{"id": "x", "ss": [{"p": "a"}, None, {"p": None}, {"q": 1}]}, None, {"ss": {"p": "b"}}, {"ss": json.dumps([{"p": "a"}])}, {"ss": None}, {"ss": []}, 7]}}


def test_shredding(spark, tmp_path):
    payloads = [(1, json.dumps(PAYLOAD)), (1, json.dumps(PAYLOAD)), (2, None), (3, "broken {"), (4, json.dumps({"js": json.dumps(PAYLOAD["data"]["js"][0])})), (None, '{"js": {"ss": {"p": "\\ud800"}}}'), (5, "")]
    df = spark.createDataFrame([(k, p, "extra") for k, p in payloads], "raw long, body string, hash string")
    nodes = shred.shredded(df, "raw", "body", ("js", "ss")).cache()
    got = sorted((tuple(r) for r in shred.stored(nodes).records("js", "ss").select("key", "parent_pos", "child_pos", shred.value_of("body", "p").alias("v")).collect()), key=repr)
    first = [(1, 0, 0, "a"), (1, 0, 2, ""), (1, 0, 3, ""), (1, 2, 0, "b"), (1, 3, 0, "a")]
    assert got == sorted([*first, (4, 0, 0, "a"), (4, 0, 2, ""), (4, 0, 3, ""), (None, 0, 0, "?")], key=repr)
    # identical objects are stored once, every occurrence is kept
    same = shred.bridge(nodes).where("field = 'ss' and ordinal is not null").groupBy("hash").count().collect()
    assert sorted(r["count"] for r in same) == [1, 1, 2, 2, 3]
    kept = shred.stored(nodes)
    kept.write(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/bridge.parquet").count() == nodes.count() and spark.read.parquet(f"{tmp_path}/objects.parquet").count() == kept.objects.count()
    assert shred.objects(nodes).count() == nodes.select("hash").distinct().count()
    assert shred.stored(shred.shredded(df.limit(0), "raw", "body", ("js", "ss"))).records("js", "ss").count() == 0


def test_numbers_are_no_texts():
    bodies = {text: list(shred.shred(text, ("a",)))[-1][6] for text in ('{"v":1}', '{"v":"1"}', '{"v":1.0}', '{"v":true}', '{"v":"true"}', '{"v":null}', '{"v":{}}', '{"v":[]}')}
    assert len(set(bodies.values())) == len(bodies)


def distance(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * nearby.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("km", [2.0, 300.0])
def test_near_pairs_against_brute_force(spark, km):
    rng = random.Random(5)
    spots = [(40 + rng.gauss(0, 0.03), 41 + rng.gauss(0, 0.03)) for _ in range(350)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(100)]
    spots += [(89.9999, x) for x in (-170.0, 0.0, 90.0)] + [(10.0, 180.0), (10.0, -180.0), (10.0, 179.99), (-90.0, 0.0), (-90.0, 77.0), (0.0, 1.0), (5.0, 5.0), (5.0, 5.0)]
    points = [(f"p{i:04d}", a, b) for i, (a, b) in enumerate(spots)]
    bad = [("n1", None, 1.0), ("n2", 1.0, float("nan")), ("n3", 91.0, 0.0), ("n4", 0.0, 181.0), ("n5", 0.0, 0.0), ("n6", -0.0, 0.0), (None, 40.0, 41.0)]
    df = spark.createDataFrame(points + points[:20] + bad, "x string, latitude double, longitude double")
    got = [tuple(r) for r in nearby.near_pairs(nearby.usable_points(df, "x", "latitude", "longitude"), km).collect()]
    want = {(a[0], b[0]) for i, a in enumerate(points) for b in points[i + 1 :] if distance(a, b) <= km}
    assert len(got) == len(set(got)) and set(got) == want


def test_interior_cells_are_used(spark):
    df = spark.createDataFrame([(i, 40 + i * 1e-6, 41.0) for i in range(300)], "x long, latitude double, longitude double")
    assert nearby.near_pairs(nearby.usable_points(df, "x", "latitude", "longitude"), 2.0).count() == 300 * 299 // 2
    assert nearby.near_pairs(nearby.usable_points(df.limit(0), "x", "latitude", "longitude"), 2.0).count() == 0


def test_points_in_regions(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(400)] + [(1000, 2.0, 2.0), (1001, 5.0, 2.0)]
    rings = {"square": [(2, 2), (2, 8), (8, 8), (8, 2)], "dart": [(1, 1), (9, 5), (1, 9), (4, 5)], "flat": [(1, 1), (2, 2)]}
    regions = spark.createDataFrame([(k, [{"lat": float(a), "lon": float(b)} for a, b in r]) for k, r in rings.items()] + [("none", None)], "region_id string, ring array<struct<lat:double,lon:double>>")
    df = nearby.usable_points(spark.createDataFrame(points, "x long, latitude double, longitude double"), "x", "latitude", "longitude")
    import numpy as np

    lat, lon = np.array([p[1] for p in points]), np.array([p[2] for p in points])
    want = {(points[i][0], k) for k in ("square", "dart") for i in np.flatnonzero(nearby.contains(rings[k], lat, lon))}
    assert {tuple(r) for r in nearby.points_in_regions(df, regions, depth=8).collect()} == want
