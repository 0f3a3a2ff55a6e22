"""L: exact cosine search over stored vectors, with a guard of the store and a seam for an embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.errors import InvalidParameter, VectorGuardError
from quire.functions.scalars import unit_vector
from quire.operators.passages import bounded

META = ("model", "model_revision", "dim", "precision", "normalized")


def usable(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows with ``dim`` numbers, none null or NaN, not all zero."""
    v = F.col(vector)
    return df.where(v.isNotNull()).where(F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False)))


def similarity(vector: str, query: Sequence[float]):
    """Dot product in doubles with a query that is part of the plan (one vector, so its size is bounded)."""
    array = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(F.col(vector), array, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)


def cosine_top_k(df: DataFrame, vector: str, query: Sequence[float], k: int, *, order: Sequence[str], floor: float | None = None, dim: int | None = None, fast: bool = True) -> DataFrame:
    """The ``k`` rows of highest cosine with ``query`` (as ``score``, 9 digits), ties by ``order``; with ``floor``, only scores of at least that.

    ``k`` <= 0 gives no rows, a larger ``k`` than rows gives all. Scores are made in Arrow batches by one matrix product
    each (``fast``) or as a Column; either way every partition keeps only its best ``k`` (TakeOrderedAndProject).
    """
    q = np.asarray(query, np.float64)
    if not q.any():
        raise ValueError("a zero vector has no direction")
    q = q / np.linalg.norm(q)
    df = usable(df, vector, dim or len(q))
    if fast:

        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=float)
            m = np.stack(rows.to_numpy()).astype(np.float64)
            return pd.Series(np.einsum("ij,j->i", m, q) / np.linalg.norm(m, axis=1))

        scored = df.withColumn("score", F.round(score(F.col(vector)), 9))
    else:
        scored = df.withColumn("_unit", unit_vector(F.col(vector))).withColumn("score", F.round(similarity("_unit", q.tolist()), 9)).drop("_unit")
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    return scored.orderBy(F.desc("score"), *order).limit(max(k, 0))


class Embedder(Protocol):
    """L3: what makes vectors of texts. The engine ships no model."""

    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A stand-in for tests: signed hashed character trigrams, of length one. It knows nothing of meaning."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            padded = f"  {text.lower()} "
            for i in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
            norm = np.linalg.norm(row)
            row[:] = row / norm if norm else np.eye(1, self.dim, dtype=np.float32)[0]
        return out


def embedded(df: DataFrame, text: str, embedder: Embedder, batch: int = 64) -> DataFrame:
    """``df`` with ``vector``; texts are embedded in batches within Arrow batches. Null texts have null vectors."""
    if batch < 1:
        raise ValueError("batch must be positive")
    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].tolist()
            out: list = [None] * len(texts)
            real = [i for i, t in enumerate(texts) if t is not None]
            for s in range(0, len(real), batch):
                part = real[s : s + batch]
                for i, v in zip(part, embedder.embed([texts[i] for i in part])):
                    out[i] = v.tolist()
            yield frame.assign(vector=out)

    return df.mapInPandas(run, schema)


def write_store(texts: DataFrame, order: Sequence[str], text: str, embedder: Embedder, folder: str, *, model: str, revision: str = "", batch: int = 64, limit: int | None = None) -> int:
    """``folder/vectors.parquet`` with the vectors of all texts (with ``limit``, of the first in ``order``), and the row of ``folder/meta.parquet``
    that tells what made them; the number of vectors. An empty corpus is an error, and leaves no store."""
    from quire.sources.sinks import write_table

    own = texts.where(F.col(text).isNotNull())
    if limit is not None:
        own = own.orderBy(*order).limit(limit)
    if own.isEmpty():
        raise VectorGuardError("no texts to embed")
    n = write_table(embedded(own, text, embedder, batch).drop(text), folder, "vectors", cluster=order)
    row = (model, revision, embedder.dim, "float32", True, n)
    write_table(texts.sparkSession.createDataFrame([row], "model string, model_revision string, dim int, precision string, normalized boolean, n long"), folder, "meta")
    return n


class Store:
    """A store of vectors in memory of the executors, loaded once a process and folder."""

    _loaded: dict[tuple[int, str], Store] = {}

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder, order: Sequence[str]):
        meta = spark.read.parquet(f"{folder}/meta.parquet")
        guard(meta, {"dim": embedder.dim, "normalized": True})
        self.embedder, self.order = embedder, list(order)
        self.rows = spark.read.parquet(f"{folder}/vectors.parquet").cache()
        odd = self.rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != embedder.dim).alias("odd")).first()
        if not odd["n"] or odd["odd"]:
            self.rows.unpersist()
            raise VectorGuardError(f"{folder} holds no vectors" if not odd["n"] else f"{odd['odd']} vectors of {folder} are not of length {embedder.dim}")

    @classmethod
    def of(cls, spark: SparkSession, folder: str, embedder: Embedder, order: Sequence[str]) -> Store:
        """L4: the store of a folder, loaded at the first call."""
        key = (id(spark), folder)
        if key not in cls._loaded:
            cls._loaded[key] = cls(spark, folder, embedder, order)
        return cls._loaded[key]

    def ordered(self) -> DataFrame:
        """All vectors in the order of the store."""
        return self.rows.orderBy(*self.order)

    def search(self, query: str, k: int, min_score: float | None = None) -> DataFrame:
        """L2: the ``k`` texts nearest to ``query``, with ``score``. ``min_score`` lies in [-1, 1]."""
        if min_score is not None and not -1.0 <= min_score <= 1.0:
            raise InvalidParameter("min_score must be at least -1 and at most 1")
        bounded("k", k, 1)
        asked = self.embedder.embed([query])[0]
        return cosine_top_k(self.rows, "vector", asked.tolist(), k, order=self.order, floor=min_score)


def guard_report(meta: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """``(name, found, expected, fits)`` of each expected value against the rows of ``meta``."""
    rows = [meta.select(F.lit(n).alias("name"), F.col(n).cast("string").alias("found"), F.lit(str(v)).alias("expected"), F.col(n).eqNullSafe(F.lit(v)).alias("fits")) for n, v in expected.items()]
    return reduce(DataFrame.unionByName, rows)


def guard(meta: DataFrame, expected: Mapping[str, object], names: Iterable[str] = META) -> None:
    """The one row of ``meta`` has the expected values; VectorGuardError names every one that differs."""
    rows = meta.limit(2).collect()
    if len(rows) != 1:
        raise VectorGuardError(f"the store has {'no' if not rows else 'several'} meta rows")
    wrong = [f"{n}: {rows[0][n]!r} instead of {expected[n]!r}" for n in names if n in expected and rows[0][n] != expected[n]]
    if wrong:
        raise VectorGuardError("; ".join(wrong))
