"""Command line: python -m quillon ingest | build | migrate | evaluate. Settings come from the environment and the session.

Models are given as module:function, a function that makes the model (see quillon.operators.retrieve).
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon import config
from quillon.operators import evaluate, retrieve
from quillon.plans import jobs, migration
from quillon.sources import files
from quillon.streaming import ingest


def named(path: str):
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillon")
    sub = out.add_subparsers(dest="job", required=True)
    p = sub.add_parser("ingest", help="article files into the graph, resumable")
    p.add_argument("source")
    p.add_argument("--state", required=True, help="folder of graph, deltas, manifest and stream checkpoint")
    p.add_argument("--batch-size", type=int)
    p.add_argument("--limit", type=int, help="only the first files by name, for a trial")
    p = sub.add_parser("build", help="documents into a new graph and vectors")
    p.add_argument("source")
    p.add_argument("--encoder", required=True)
    p.add_argument("--catalogue", help="JSON file of url, che_do, ngay_hieu_luc")
    p.add_argument("--no-check", action="store_true")
    p = sub.add_parser("migrate", help="renew citations; a dry run unless --apply or --resume is given")
    p.add_argument("source")
    p.add_argument("--state", required=True)
    p.add_argument("--apply", action="store_true")
    p.add_argument("--resume", action="store_true")
    p = sub.add_parser("evaluate", help="recall and MRR of eval sets")
    p.add_argument("questions", nargs="+")
    p.add_argument("--encoder", required=True)
    p.add_argument("--scorer")
    p.add_argument("--ablation", action="store_true")
    return out


def run_evaluate(spark: SparkSession, a: argparse.Namespace, s: config.Settings) -> list[dict]:
    sets = [files.questions(spark, path).select("at", "question", F.col("gold_article_ids").alias("gold")) for path in a.questions]
    asked = retrieve.embed(evaluate.question_set(*sets), "question", named(a.encoder), s.embed_batch_size)
    vectors, graph = spark.read.parquet(s.vector_path), files.load_graph(spark, s.graph_path)
    texts = vectors.select(F.col("vec_id").alias("article_id"), F.col("document").alias("full_text"))
    scorer = named(a.scorer) if a.scorer else None
    if a.ablation:
        if not scorer:
            raise ValueError("an ablation reranks; give --scorer")
        return [r.asDict() for r in evaluate.run_ablation(asked, vectors, graph, texts, scorer, s).collect()]
    return [evaluate.summary(evaluate.run_retrieval(asked, vectors, graph, texts, scorer=scorer if s.rerank_enabled else None, settings=s)).first().asDict()]


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict | list:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName(f"quillon {a.job}").getOrCreate()
    s = config.load(spark)
    if a.job == "ingest":
        graph = ingest.run_ingest(spark, a.source, a.state, a.batch_size or s.ingest_batch_size, limit=a.limit)
        out = {name: df.count() for name, df in graph.items()}
    elif a.job == "build":
        docs = files.document_files(spark, a.source)
        if a.catalogue:
            docs, missing = files.catalogued(files.catalogue(spark, a.catalogue), docs)
            print(json.dumps({"missing": missing.count()}))
        graph, vectors = jobs.build_corpus(spark, docs, named(a.encoder), s.graph_path, s.vector_path, check=not a.no_check)
        out = {name: df.count() for name, df in graph.items()} | {"vectors": vectors.count()}
    elif a.job == "migrate":
        again = lambda sp, source, state: ingest.run_ingest(sp, source, state, s.ingest_batch_size)
        out = migration.run_migration(spark, a.source, a.state, s.vector_path, apply=a.apply, resume=a.resume, most=s.max_stale_share, reingest=again)
    else:
        out = run_evaluate(spark, a, s)
    print(json.dumps(out, ensure_ascii=False, default=str))
    return out


if __name__ == "__main__":
    main()
