"""Parquet tables of a corpus folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; with ``columns``, only those (the scan reads no others)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def delivered_once(df: DataFrame) -> DataFrame:
    """``df`` without repeated deliveries: rows equal in every column count once (nulls are equal)."""
    return df.distinct()
