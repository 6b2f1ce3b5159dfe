"""Migration of an ingested corpus to a renewed extraction: dry run, apply, resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import DEFAULT
from quillon.functions import text
from quillon.operators import graph as g
from quillon.sources import files
from quillon.streaming import ingest


def _counts(graph: g.Graph, vectors: DataFrame) -> dict[str, int]:
    return g.snapshot(graph, vectors.select(text.article_of_vector(F.col("vec_id")).alias("article_id"))).first().asDict()


def run_migration(spark: SparkSession, source: str, state: str, vector_path: str, *, apply: bool = False, resume: bool = False, most: float = DEFAULT.max_stale_share, reingest: Callable[[SparkSession, str, str], g.Graph] = ingest.run_ingest) -> dict[str, dict[str, int]]:
    """Counts before and after. Without apply and resume nothing is changed, and both are equal.

    apply, in this order: stale documents (if plausible), all citations and placeholders without an edge go, as one
    new snapshot; the ingest's checkpoint is forgotten; all files of source are ingested again; vectors are
    reconciled. An error in ingesting is not caught: the graph then lacks citations, and resume goes on from the
    ingest's checkpoint without deleting again. Without a checkpoint there is nothing to resume, which is refused.
    """
    if resume and not ingest.read_manifest(spark, state):
        raise ValueError("no checkpoint to resume from; run with apply")
    files.settle(spark, vector_path)
    graph, vectors = files.load_graph(spark, f"{state}/graph"), spark.read.parquet(vector_path)
    before = _counts(graph, vectors)
    stems = files.article_files(spark, source).select("stem")
    if not apply and not resume:
        g.check_plausible(graph, stems, most)
        return {"before": before, "after": before}
    if not resume:
        stale = g.check_plausible(graph, stems, most)
        files.save_graph(g.without_orphans(g.without_references(g.without_documents(graph, stale))), f"{state}/graph")
        ingest.reset(spark, state)
    graph = reingest(spark, source, state)
    files.replace(g.reconcile_vectors(graph, vectors), vector_path)
    return {"before": before, "after": _counts(graph, spark.read.parquet(vector_path))}
