"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard on full shingle sets.

Signatures use two permutations (circulant MinHash): shingles are first permuted into a ring, and
one second permutation of the ring, circularly shifted by k, gives coordinate k. The K shifted
values of a shingle lie side by side in the permutation, so a signature is a minimum over slices.

Steps, on classes of documents with equal sets, so that copies weigh nothing:

1. bands of the signature are buckets; in each, the class that meets most others in all its buckets
   is the centre, and every member is verified against it on full sets (a star, not all pairs);
2. links make components; a bucket inside one component is done;
3. classes of buckets that hold several components go to an exact prefix-filtered join: shingles
   in order of rarity, prefixes as short as the sizes of both sides allow, then verification.
   Families of thousands of edited copies don't meet there, as what sets them apart is rare.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; a
text shorter than a shingle is one shingle; very long texts are hashed whole, in parts that fit a cache;
repeated rows share a verdict, of which keep_one keeps one; a null doc_id is kept only if no other
document is linked with it; ties for a bucket's centre go to the greater class; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, rows_at_once
from quillon.llm.components import components
from quillon.llm.tokens import U64, chunks, mix, pieces

RING_BITS = 20


@cache
def ring(k: int, seed: int = 1) -> np.ndarray:
    """Row i: the k values that the second permutation, shifted by 0 to k-1, gives slot i."""
    perm = np.random.default_rng(seed).permutation(1 << RING_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([perm, perm[: k - 1]]), k)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    slots = (mix(shingles ^ U64(0x5851F42D4C957F2D)) >> U64(64 - RING_BITS)).astype(np.int64)
    table, out = ring(k), None
    for at in range(0, len(slots), 2048):  # whole sets, a cache-sized part at a time
        least = table[slots[at : at + 2048]].min(axis=0)
        out = least if out is None else np.minimum(out, least)
    return out


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text shorter than width, one for all its words."""
    for _, rows, w in chunks(texts, fold=True, most=1 << 18):
        hashes, at = w.windows(width)
        edges = np.searchsorted(at, w.first)
        for i in range(rows):
            lo, hi = w.first[i], w.first[i + 1]
            if hi - lo >= width:
                yield np.unique(hashes[edges[i] : edges[i + 1]])
            elif hi > lo:
                h = U64(hi - lo)
                for x in w.hashes[lo:hi]:
                    h = mix(np.array([h], U64) * U64(0x9FB21C651E98DF25) ^ x)[0]
                yield np.array([h], U64)
            else:
                yield np.zeros(0, U64)


def set_class(s: np.ndarray) -> bytes:
    """128 bits that only equal sets share."""
    return b"".join(int(np.bitwise_xor.reduce(mix(s ^ U64(c))) ^ mix(np.array([np.sum(mix(s + U64(c)), dtype=U64)]))[0]).to_bytes(8, "big") for c in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95))


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, cls, bands for every row; cls and bands are null for an empty set."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, bands + 1, dtype=U64))
        for b in (p for whole in batches for p in pieces(whole)):
            sizes, classes, keys = [], [], []
            for s in shingle_sets(b.column("text"), width):
                sizes.append(len(s))
                if len(s):
                    sig = signature(s, bands * rows).reshape(bands, rows).astype(U64)
                    h = salts.copy()
                    for c in range(rows):
                        h = mix((h ^ sig[:, c]) * U64(0x9E3779B97F4A7C15))
                    classes.append(set_class(s))
                    keys.append(h.view(np.int64))
                else:
                    classes.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "cls", "bands"]
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {id_type}, text_key long, n_shingles long, cls binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, set) for the classes of wanted (cls, doc_id, text_key, copies): a text that has each, hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole)):
            sets = [s.view(np.int64) for s in shingle_sets(b.column("text"), width)]
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(sets, pa.list_(pa.int64()))], ["cls", "set"])

    own = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"), "text")
    here = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key"))
    met = own.join(wanted.hint("merge"), here).select("cls", "text", "copies")  # wanted grows with the documents: never broadcast
    if wanted.filter("copies > 1").limit(1).count():  # rows that repeat, in doc_id too, give one set
        met = met.filter("copies = 1").union(met.filter("copies > 1").dropDuplicates(["cls"]))
    return met.select("cls", "text").mapInArrow(run, "cls binary, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those with 100 * intersection >= percent * union."""
    left = sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def stars(members: DataFrame) -> DataFrame:
    """members: distinct (band, cls). Distinct pairs (a, b): a class and the centre of a bucket of its."""
    sized = members.join(members.groupBy("band").agg(F.count("*").alias("near")), "band")
    score = sized.groupBy("cls").agg(F.sum("near").alias("score"))
    centre = members.join(score, "cls").groupBy("band").agg(F.max(F.struct("score", "cls")).alias("top")).select("band", F.col("top.cls").alias("b"))
    return members.join(centre, "band").filter("cls <> b").select(F.col("cls").alias("a"), "b").distinct()


def prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int, step: float = 1.06) -> DataFrame:
    """Pairs (a, b) of classes with different labels that share a token of both prefixes.

    Two sets linked at percent share at least percent/(100+percent) of the sum of their sizes. With
    tokens in one order, rarest first, the first n - share + 1 tokens of a set hold one of them for
    a partner of the size that gives share. The shorter side of a pair counts on a partner of its
    own size at least; the longer one has a prefix for each class of shorter sizes, by its least size.
    """
    tokens = sets.select("cls", F.explode("set").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")

    # a set's own tokens are as many as it is large: ordering them is work of one row's size
    found = tokens.join(frequency, "token").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    sized = sets.select("cls", F.size("set").alias("n")).distinct()
    rows = found.join(sized, "cls").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    log = lambda c: F.floor(F.log(c.cast("double")) / F.log(F.lit(step)) + 1e-9).cast("int")
    need = lambda n, m: F.ceil((F.lit(percent) * (n + m)).cast("double") / (100 + percent) - 1e-9)
    n, alone = F.col("n"), F.col("n") - F.size("shared")  # tokens that no other set has come first
    short = F.greatest(n - need(n, n) + 1 - alone, F.lit(0)).cast("int")
    entry = lambda size: F.posexplode(F.slice("shared", 1, size)).alias("i", "t")
    index = rows.filter(short > 0).select("cls", "label", "n", log(n).alias("size_class"), alone.alias("alone"), entry(short))
    classes = F.sequence(log(F.ceil(n * percent / 100.0 - 1e-9)), log(n))
    least = F.greatest(F.ceil(F.pow(F.lit(step), F.col("size_class")) - 1e-6), F.ceil(n * percent / 100.0 - 1e-9)).cast("long")
    long = F.greatest(n - need(n, least) + 1 - alone, F.lit(0)).cast("int")
    probe = rows.select("*", F.explode(classes).alias("size_class")).filter(long > 0).select("cls", "label", "n", "size_class", alone.alias("alone"), entry(long))
    # rest: tokens from this one on, the most that a pair whose first shared token it is can share
    keyed = lambda df, p: df.select(
        F.col("t.token").alias("token"), "size_class", F.col("cls").alias(p), F.col("label").alias(f"l{p}"), F.col("n").alias(f"n{p}"), (n - F.col("alone") - F.col("i")).alias(f"rest_{p}")
    )
    one, two = keyed(index, "a"), keyed(probe, "b")
    met = one.select("token", "size_class", F.col("la").alias("l")).union(two.select("token", "size_class", "lb"))
    met = met.groupBy("token", "size_class").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).filter("lo <> hi").select("token", "size_class")
    key = ["token", "size_class"]
    able = F.least("rest_a", "rest_b") * (100 + percent) >= F.lit(percent) * (F.col("na") + F.col("nb"))
    pairs = one.join(met, key).join(two.join(met, key), key).filter(F.expr("la <> lb AND na <= nb") & able)
    return pairs.select("a", "b").distinct()


def verdicts(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, exact: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, text_key, n_shingles, label (of its component; null for an empty set),
    component_id (least doc_id reachable), kept. With exact, all classes go to the prefix join, those
    that share no bucket too, and no link can be missed."""
    with rows_at_once(docs.sparkSession):
        base = materialize(signed(docs, width, bands, rows), "near-dup-bands")
    exploded = base.filter("cls IS NOT NULL").select("cls", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("band")
    shared = materialize(shared, "near-dup-shared")  # so that the join's shuffles are plain ones, and hot buckets split
    members = materialize(exploded.join(shared, "band").select("band", "cls").distinct(), "near-dup-buckets")
    named = base.filter("cls IS NOT NULL")
    named = named if exact else named.join(members.select("cls").distinct(), "cls")
    wanted = named.groupBy("cls", "doc_id", "text_key").agg(F.count("*").alias("copies")).groupBy("cls").agg(F.min(F.struct("doc_id", "text_key", "copies")).alias("one"))
    wanted = materialize(wanted.select("cls", "one.*"), "near-dup-wanted")
    with rows_at_once(docs.sparkSession):
        sets = materialize(sets_of(docs, wanted, width), "near-dup-sets")
    edges = materialize(verified(stars(members), sets, percent), "near-dup-links")
    labels = components(edges).withColumnRenamed("node", "cls")
    labelled = members.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band")
    open_ = members.join(mixed, "band").select("cls").distinct()
    rest = sets if exact else materialize(sets.join(open_, "cls", "left_semi"), "near-dup-rest")
    more = materialize(verified(prefix_pairs(rest, labels, percent), rest, percent), "near-dup-links")
    labels = components(edges.union(more)).withColumnRenamed("node", "cls")
    placed = materialize(base.join(labels, "cls", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("label", "cls").alias("label")), "near-dup-placed")
    # a table of its own: the shuffles of the join are plain, so that Spark can split a hot label
    least = materialize(placed.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least")), "near-dup-least")
    return placed.join(least, "label", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        "label",
        F.coalesce("least", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("least", "doc_id")).alias("kept"),
    )


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable), kept."""
    return verdicts(docs, **params).drop("text_key", "label")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One document of each group, with its own columns: the one with the least doc_id, a null doc_id
    last, and of those the least hash of the text; of rows equal in both, any one. Documents with an
    empty set are in no group and all stay."""
    said = verdicts(docs, **params).filter("label IS NOT NULL").groupBy("label", F.col("doc_id").alias("said_id"), F.col("text_key").alias("said_key")).agg(F.count("*").alias("n"))
    said = materialize(said, "near-dup-said")
    first = materialize(said.groupBy("label").agg(F.min(F.struct(F.col("said_id").isNull().alias("none"), "said_id", "said_key")).alias("first")), "near-dup-first")
    is_first = F.col("said_id").eqNullSafe(F.col("first.said_id")) & (F.col("said_key") == F.col("first.said_key"))
    judged = materialize(said.join(first, "label").select("said_id", "said_key", "n", is_first.alias("first")).filter("NOT first OR n > 1"), "near-dup-judged")
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("row_key"))
    here = F.col("row.doc_id").eqNullSafe(F.col("said_id")) & (F.col("row_key") == F.col("said_key"))
    once = keyed.join(judged, here, "left_anti")
    again = keyed.join(judged.filter("first"), here, "left_semi").select("row", F.col("row.doc_id").alias("id"), "row_key").dropDuplicates(["id", "row_key"])
    return once.select("row.*").union(again.select("row.*"))
