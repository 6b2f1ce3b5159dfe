"""Shared scratch tables: how lineage is cut and how several consumers share one pass."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the one the session was given. Where neither
    is set, a local session (one machine, as in tests) gets a temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillon-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, so that a lost
    executor costs no recomputation, and lets several consumers share one pass over the input.
    A join on such a table has plain shuffles on both sides, whose hot keys Spark can split.
    The files go when the session ends."""
    spark = df.sparkSession
    where = f"{scratch_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)
