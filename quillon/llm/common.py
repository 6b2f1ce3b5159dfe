"""Shared pieces: scratch tables, table reading, word patterns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.scratch import materialize, scratch_dir  # noqa: F401

#: Words split at ASCII white space, as a Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.array().cast("array<string>"))


def word_count(text: Column, pattern: str = WORD) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


@contextmanager
def rows_at_once(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Tables written meanwhile go to Python workers in batches of so many rows at most: the buffers of a
    batch of texts, on both sides, are much of an executor's memory outside its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
