"""Queries of the training-data operators over whole tables; SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, lookalike, neighbours, packing, sentences, termfreq, topn
from quire.sources.tables import table

CAPACITY = 2048
BEST = 3


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(neighbours.nearest(table(spark, d, "verse_embeddings", "vec_id", "vector")))


# Brute force over all pairs; only for tables as small as those it is compared on.
_P1 = """
WITH s AS (SELECT DISTINCT ON (vec_id) vec_id, vector::DOUBLE[] AS v FROM verse_embeddings WHERE vec_id IS NOT NULL AND vector IS NOT NULL AND len(vector) = 64
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM s),
c AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.v, b.v) / a.l / b.l, 12) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id),
n AS (SELECT i, j FROM c WHERE cosine >= 0.85 QUALIFY row_number() OVER (PARTITION BY i ORDER BY cosine DESC, j) <= 5)
SELECT DISTINCT least(i, j) AS left_id, greatest(i, j) AS right_id FROM n
"""
RECORD = ["text_id", "book_id", "chapter", "verse"]


def _terms(spark: SparkSession, d: str) -> DataFrame:
    term = F.upper(F.trim("strongs_id"))
    return termfreq.marked(termfreq.term_counts(table(spark, d, "word_tokens"), F.when(term != "", term), RECORD))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("mark", F.col("term").alias("strongs_id"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select(F.col("term").alias("strongs_id"), "occurrences", "records").distinct()


_COUNTS = """
WITH t AS (SELECT DISTINCT * FROM word_tokens), n AS (SELECT count(*) AS total FROM (SELECT DISTINCT text_id, book_id, chapter, verse FROM t)),
c AS (SELECT upper(trim(strongs_id)) AS strongs_id, count(*) AS occurrences, count(DISTINCT (text_id, book_id, chapter, verse)) AS records FROM t WHERE trim(strongs_id) <> '' GROUP BY 1)
"""
_P4 = _COUNTS + "SELECT 'rare' AS mark, strongs_id FROM c WHERE records < 3 UNION ALL SELECT 'common', strongs_id FROM c, n WHERE records >= 0.08 * total"


TEXTS = (("verses", "id", "text"), ("strongs_entries", "strongs_id", "lemma"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [lookalike.alike_pairs(table(spark, d, name, key, text), key, text).select(F.lit(name).alias("src_table"), "left_key", "right_key") for name, key, text in TEXTS]
    return parts[0].unionByName(parts[1])


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """A row a text that has other spellings: its class (named by its smallest key), and how many spellings and rows the class has."""
    parts = []
    for name, key, text in TEXTS:
        rows = lookalike.alike_classes(table(spark, d, name, key, text), key, text)
        whole = rows.groupBy("class_id", "spelling").agg(F.min("key").alias("least"), F.count("*").alias("n")).groupBy("class_id").agg(F.min("least").alias("class_key"), F.count("*").alias("spellings"), F.sum("n").alias("members"))
        parts.append(rows.join(whole, "class_id").select(F.lit(name).alias("src_table"), "class_key", "key", "spellings", "members"))
    return parts[0].unionByName(parts[1])


FROM_VERSE = ["from_book_id", "from_chapter", "from_verse"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "cross_references", *FROM_VERSE, "votes", "id"), FROM_VERSE, "votes", "id", BEST).select(*FROM_VERSE, "id")


_P6 = f"""
SELECT from_book_id, from_chapter, from_verse, id FROM (SELECT DISTINCT from_book_id, from_chapter, from_verse, id, votes FROM cross_references WHERE votes IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY from_book_id, from_chapter, from_verse ORDER BY votes DESC, id) <= {BEST}
"""


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.token_counts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "tokens", CAPACITY)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_counts": p4_counts, "p5_found": p5_found, "p5_classes": p5_classes, "p6_found": p6_found, "p8_ids": p8_ids, "p9_pack": p9_pack, "p10_found": p10_found}
SQL = {"p1_found": _P1, "p4_found": _P4, "p4_counts": _COUNTS + "SELECT * FROM c", "p6_found": _P6}
