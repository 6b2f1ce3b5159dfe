"""Typed settings: defaults, overridden by the environment and then by ``spark.quillon.*``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    max_hop: int = 2
    similarity_threshold: float = 0.65
    overfetch: int = 6
    max_context_articles: int = 10
    ingest_batch_size: int = 200
    rerank_enabled: bool = True
    rerank_fetch_k: int = 15
    reranker_max_length: int = 1024
    embed_batch_size: int = 32
    embedding_model: str = ""
    reranker_model: str = ""
    reranker_device: str = "cpu"
    generator_model: str = ""
    generator_url: str = ""
    generator_context: int = 8192
    generator_temperature: float = 0.2
    generator_timeout_seconds: float = 120.0
    graph_path: str = "graph"
    vector_path: str = "vectors"
    max_stale_share: float = 0.05


#: What operators and jobs take where nothing else is said.
DEFAULT = Settings()


def _cast(kind: str, value: str):
    return {"int": int, "float": float, "bool": lambda v: v.strip().lower() == "true", "str": str}[kind](value)


def load(spark: SparkSession | None = None) -> Settings:
    """Settings from QUILLON_<NAME> variables and spark.quillon.<name>, the latter winning."""
    found = {}
    for f in fields(Settings):
        value = os.environ.get(f"QUILLON_{f.name.upper()}")
        if spark is not None:
            value = spark.conf.get(f"spark.quillon.{f.name}", value)
        if value is not None:
            found[f.name] = _cast(f.type, value)
    return replace(Settings(), **found)
