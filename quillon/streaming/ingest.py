"""Resumable ingest: a file stream in micro-batches, each written as a delta and all merged once at the end.

The stream's checkpoint says which files are done; a manifest keeps the batch size with which it was
begun, and a restart with another one is refused. A batch reads and writes its own files only, so the
work of a run grows with its files and not with the graph. A batch that fails is not marked and runs
again; its delta is replaced, so a batch that was written but not marked changes nothing. The merge
is one aggregation over the graph and all deltas; deltas go when its snapshot stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import DEFAULT
from quillon.operators import graph as g
from quillon.plans import jobs
from quillon.sources import files


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The latest manifest; None where there is none or it can't be read."""
    try:
        row = spark.read.json(f"{path}/manifest").orderBy(F.desc("updated_at"), F.desc("last_completed_batch")).first()
        return {"last_completed_batch": row["last_completed_batch"], "batch_size": row.asDict().get("batch_size"), "updated_at": row["updated_at"]} if row else None
    except (AnalysisException, KeyError, ValueError):
        return None


def write_manifest(spark: SparkSession, path: str, batch: int, batch_size: int) -> None:
    row = spark.range(1).select(F.lit(batch).alias("last_completed_batch"), F.lit(batch_size).alias("batch_size"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("updated_at"))
    row.coalesce(1).write.mode("append").json(f"{path}/manifest")


def fold(spark: SparkSession, state: str) -> g.Graph:
    """Merges the deltas into the graph, if there are any, and returns it."""
    deltas = files.load_deltas(spark, f"{state}/delta")
    old = files.load_graph(spark, f"{state}/graph") if files.exists(spark, f"{state}/graph/current") else None
    if deltas is None:
        return old or g.empty(spark)
    if old:
        deltas = {name: df.unionByName(old[name].withColumn("batch", F.lit(-1).cast("long"))) for name, df in deltas.items()}
    files.save_graph(g.combine(deltas), f"{state}/graph")
    files.delete(spark, f"{state}/delta")
    return files.load_graph(spark, f"{state}/graph")


def run_ingest(spark: SparkSession, source: str, state: str, batch_size: int = DEFAULT.ingest_batch_size, ingest: Callable[[g.Graph, DataFrame, str], g.Graph] = jobs.ingest_chunks, limit: int | None = None) -> g.Graph:
    """Ingests the .md files of source that no finished batch holds, batch_size at a time; returns the graph. With a
    limit, only the first files by name, for a trial of its own state."""
    seen = read_manifest(spark, state)
    if seen and seen["batch_size"] not in (None, batch_size):
        raise ValueError(f"begun with batches of {seen['batch_size']}, not {batch_size}; resume with the same size")

    def write(batch: DataFrame, number: int) -> None:
        chunks = batch.select(F.regexp_replace("file_name", r"\.[^.]*$", "").alias("stem"), F.col("value").alias("body")).filter(F.col("stem") != "README")
        if chunks.limit(1).count():
            files.save_delta(ingest(g.empty(spark), chunks, f"batch-{number}"), f"{state}/delta", number)
        write_manifest(spark, state, number, batch_size)

    stream = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", batch_size).schema("value string").load(source)
    named = stream.select("value", F.col("_metadata.file_name").alias("file_name"))
    if limit is not None:
        named = named.filter(F.col("file_name").isin([r.file_name for r in files.article_files(spark, source, limit).select("file_name").collect()]))
    query = named.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return fold(spark, state)


def reset(spark: SparkSession, state: str) -> None:
    """Forgets which files are done; the graph stays."""
    for part in ("stream", "manifest", "delta"):
        files.delete(spark, f"{state}/{part}")
