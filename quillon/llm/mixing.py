"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Rows of a source are ordered by it; buckets of the key space are
a range partitioning of that order, so the running word count is a sum inside a bucket plus the
sum of the buckets before it, and no source ever has to fit into one task. A source's budget is
then cut exactly: whole epochs of all its rows plus the first words of the order.

Defined cases: a null or empty text has size 0 and is never taken from; a very long text counts as any
other and may be cut inside; ties of the hash order (equal doc_id and text) follow one another; a null
source is a source of its own, last in order; rows that repeat count each by itself; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, word_count


def hash_key(seed: str) -> Column:
    """Hex key of a row, random over rows and equal on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def placed_sources(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """sources (src, src_null, source_size): adds weight by the place in order, room (what cap allows) and full_at
    (the level room / weight at which a source is full).

    Ranges of the order are numbered each by itself; a count per range says where each begins. So no task
    holds all sources, of which there may be as many as hosts.
    """
    ranges = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(sources.repartitionByRange(ranges, "src_null", "src").withColumn("range", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("src_null", "src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    placed = ranged.join(starts, "range").withColumn("weight", weight).withColumn("room", F.col("source_size").cast("double") * cap)
    return materialize(placed.select("src", "src_null", "source_size", "weight", "room", (F.col("room") / F.col("weight")).alias("full_at")), "mix-sources")


def source_targets(placed: DataFrame, share: float) -> DataFrame:
    """placed_sources with target instead of weight, room and full_at.

    Targets share ``share`` of all sizes by weight; none exceeds its source's room, and what is cut off
    goes to the others by weight. The level is the share per weight: sources that are full below it get
    their room, and what they leave raises the level of the others, until no further source is full.
    Every step is an aggregation that gives the driver one row.
    """
    level, full = 0.0, -1
    while True:
        is_full = F.col("full_at") < level
        seen = placed.agg(
            F.sum("source_size").cast("double").alias("total"), F.count_if(is_full).alias("full"),
            F.sum(F.when(is_full, F.col("room")).otherwise(0.0)).alias("used"), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not seen["open"] or seen["full"] == full:
            break
        full, level = seen["full"], (seen["total"] * share - seen["used"]) / seen["open"]
    target = F.when(F.col("full_at") < level, F.col("room")).otherwise(F.least("room", F.lit(level) * F.col("weight")))
    return placed.select("src", "src_null", "source_size", target.alias("target"))


def taken_rows(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, cap: int = 3, seed: str = "mix", rows_per_bucket: int = 65_536) -> DataFrame:
    """A row per row of docs: doc_id, key, size, source_size, target, taken, source."""
    spark = docs.sparkSession
    sized = materialize(
        docs.select(
            "doc_id", "source", F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("src_null"),
            word_count(F.col("text")).alias("size"), hash_key(seed).alias("key"),
        ),
        "mix-sizes",
    )
    rows = sized.count()
    # several buckets for each partition, so that a source with a third of all rows spreads over all of them
    buckets = max(-(-rows // rows_per_bucket), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = sized.withColumn("bucket", F.shiftright(place * F.lit(buckets), 32))
    by_bucket = placed.groupBy("src", "src_null", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_source = sized.groupBy("src", "src_null").agg(F.sum("size").alias("source_size"))
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * cap)
    plan = source_targets(placed_sources(by_source, weights, cap), share).withColumn("budget", budget)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    earlier = Window.partitionBy("src", "src_null").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).join(plan, ["src", "src_null"])
    here = Window.partitionBy("src", "src_null", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("upto", F.sum("size").over(here))
    start = F.col("offset") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return summed.join(offsets.drop("bucket_size", "budget"), ["src", "src_null", "bucket"]).select(
        "doc_id", "key", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "source"
    )


def mix(docs: DataFrame, **params) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, source.

    taken is the number of its words in the mix, repeats counted: one size for each whole epoch of
    the source, and of the last, partial epoch what lies before the cut. The words taken from a
    source are its target, rounded.
    """
    return taken_rows(docs, **params).drop("key")


def mix_documents(docs: DataFrame, seed: str = "mix", **params) -> DataFrame:
    """The mix itself: the documents with words taken, with all their columns, and taken (words to
    train on) beside them, in place of a column of that name. Rows of one doc_id are told apart by text
    and source; where those are equal too, the rows take equal parts, rounded down."""
    plan = taken_rows(docs, seed=seed, **params).groupBy(F.col("key").alias("of_key"), F.col("source").alias("of_source")).agg(F.floor(F.sum("taken") / F.count("*")).cast("long").alias("taken"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "taken"]).alias("row"), hash_key(seed).alias("row_key"), F.col("source").alias("row_source"))
    here = (F.col("row_key") == F.col("of_key")) & F.col("row_source").eqNullSafe(F.col("of_source"))
    return keyed.join(plan.filter("taken > 0"), here).select("row.*", "taken")
