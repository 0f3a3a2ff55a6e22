import pytest
from pyspark.sql import functions as F

from quire.functions import scalars as S


def one(spark, make, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_names(spark):
    given = ["I Samuel", "Isaiah", "i", " First  of. It's ", "", None, "2 Kings", "III", "Song of Songs"]
    want = ["1samuel", "isaiah", "i", "1ofits", "", None, "2kings", "iii", "songofsongs"]
    assert one(spark, S.normal_name, *given) == want
    assert [None if x is None else S.normal_name_text(x) for x in given] == want


def test_slugs_and_display(spark):
    assert one(spark, S.slug, "The -- Road, to X!", "---", "", None, "Ärger 2") == ["the-road-to-x", "", "", None, "rger-2"]
    assert one(spark, S.display_name, "Aro 2", "Aro", "Aro 2 3", "7", None, "A\nB 4") == ["Aro", "Aro", "Aro 2", "7", None, "A\nB"]


def test_strongs(spark):
    assert one(spark, S.strongs_route, " g0026 ", "H1a", "x", None, "G0") == ["G26", "H1A", "X", None, "G0"]
    assert one(spark, S.strongs_base, "G0026K=x", "H00", "zz", None) == ["G26", "H0", None, None]
    assert one(spark, lambda c: S.strongs_base(c, suffix=True), "G0026K", "G26xx") == ["G26", None]


def test_html_and_glosses(spark):
    assert one(spark, S.strip_html, "a<BR />b <i>c</i>__  d ", "", None) == ["a b c d", "", None]
    assert one(spark, S.without_gloss, "λόγος, (logos)", "x (a) (b) ", "y") == ["λόγος,", "x (a)", "y"]
    assert one(spark, S.nfc, "é", None) == ["é", None]


def test_verse_specs(spark):
    assert one(spark, S.verse_spec, "3,8-10", "5-3", "1-300", "x", "", None, "4-4") == [[3, 8, 9, 10], None, None, None, None, None, [4]]


def test_coordinates(spark):
    assert [tuple(x) if x else None for x in one(spark, S.osis, "Gen.1.2", "Gen.1", "Gen.0.2", "a.b.c", None)] == [("Gen", 1, 2), None, None, None, None]
    assert [tuple(x) if x else None for x in one(spark, S.sort_key, "01002003", "1002003", "0100200x")] == [(1, 2, 3), None, None]


def test_like(spark):
    assert one(spark, lambda c: S.contains_ci(c, "A_b%"), "xaQbz", "ÄAxB", "ab", None) == [True, True, False, None]
    assert one(spark, lambda c: S.contains_ci(c, "ä"), "Ä", "ä") == [False, True]
    assert one(spark, lambda c: S.contains_ci(c, "\\"), "a\\b", "ab") == [True, False]


def test_numbers(spark):
    assert one(spark, S.leading_number, "26a", "a", "", "007") == [26, 0, 0, 7]
    assert one(spark, S.confidence_bucket, 500, 499, 100, 99, -5, None, kind="int") == ["high", "medium", "medium", "low", "low", None]
    assert one(spark, S.round4, 0.00005, 0.00015, kind="double") == [0.0, 0.0002]


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "x array<float>")
    assert df.select(S.unit_vector(F.col("x"))).first()[0] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="direction"):
        spark.createDataFrame([([0.0, 0.0],)], "x array<float>").select(S.unit_vector(F.col("x"))).collect()


def test_morphology(spark):
    df = spark.createDataFrame([("H1/{H2}/H3", "A/ B /C"), ("H1", "A"), ("{H1}", " "), ("a/{b}", "x")], "p string, g string")
    assert [r[0] for r in df.select(S.head_morph(F.col("p"), F.col("g"))).collect()] == ["B", "A", None, "x"]


def test_fused_headings(spark):
    texts = ["He went. The Song of Reeds", "He went. 7 The Long Road Home", "He went. Selah Higgaion", "He went to Reeds", "He said. Ehud", "“Go!” The fall of many the into", None]
    got = [None if x is None else (x["heading"], x["cleaned"], x["anchor"]) for x in one(spark, S.fused_heading, *texts)]
    assert got == [("The Song of Reeds", "He went.", None), ("The Long Road Home", "He went.", 7), None, None, None, None, None]
