"""Places in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.scratch import materialize


def numbered(df: DataFrame, *order: str, name: str = "nth") -> DataFrame:
    """Adds name, the place of each row (from 0) in the order of columns; ties are in any order, but each run of
    the result sees the same one. Ranges of the order are numbered each by itself; a count per range, a
    row each, says where it begins."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "numbered-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return materialize(ranged.join(starts, "_range").withColumn(name, nth).drop("_range", "_before"), "numbered")
