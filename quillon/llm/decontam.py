"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item is cut into windows of consecutive words. The tokens of a window are ordered by their
rarity in the documents, counted over all of them; since containment asks for every token, a prefix
of one, the rarest, is necessary. Document words join on it; length and position bound where the
window could begin; then all its words are compared in place, so a hit is an exact containment.

The windows are broadcast only if their measured size is small; else they are joined by a shuffle
on the prefix token and the candidates are verified after a join back to the documents.

Texts are split into words once, into a table that the count, the search and the result share.

Defined cases: null and empty texts have no words; a very long text is searched whole, in parts that
overlap by a window; of equally rare words of a window the least one, at its first place, is the prefix;
null item ids count as ''; rows with equal doc_id and text are judged alike and each returned; an empty
benchmark hits nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, words

#: Letters and digits in ASCII, and everything beyond it.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(word: Column) -> Column:
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(w: Column) -> Column:
    """Words with A-Z lower-cased, as one string: the form in which they are compared. Documents are
    joined on the full lower case of single words, which equal forms share and which is much cheaper
    for a whole corpus; only the words of a possible window are folded exactly."""
    return ascii_lower(F.array_join(w, " "))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """window (its folded words), size, items (sorted distinct ids as strings): a row per distinct window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text"), ITEM_WORD).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    each = items.select("item", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("words"))
    return each.groupBy(folded(F.col("words")).alias("window"), "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def with_prefix(windows: DataFrame, docs: DataFrame, small: bool) -> DataFrame:
    """Adds token, the window's rarest word in docs, and offset, its first place there."""
    each = windows.select("window", F.posexplode(F.split(F.lower("window"), " ")).alias("offset", "token"))
    vocabulary = each.select("token").distinct()
    said = docs.select(F.explode("w").alias("word")).select(F.lower("word").alias("token"))
    counts = said.join(F.broadcast(vocabulary) if small else vocabulary, "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("prefix"))
    return windows.join(ranked, "window").select("window", "size", "items", F.col("prefix.token").alias("token"), F.col("prefix.offset").alias("offset"))


#: Words of a document that travel with each of its tokens, at most: a long text goes in several parts.
PART = 4096


def tokens(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, text_key, n_words, w): a row per word: doc_id, text_key, n_words, pos, token, around
    (the words from base on in which every window of the word lies)."""
    pad = width - 1
    base = lambda c: F.greatest(c * PART - pad, F.lit(0))
    part = lambda c: F.struct((c * PART).alias("at"), base(c).alias("base"), F.slice("w", base(c) + 1, F.lit(PART + 2 * pad)).alias("around"))
    parts = docs.filter("n_words > 0").select("doc_id", "text_key", "n_words", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n_words") - 1) / PART).cast("int")), part)).alias("p"))
    parts = parts.select("doc_id", "text_key", "n_words", "p.at", "p.base", "p.around")
    own = F.slice("around", F.col("at") - F.col("base") + 1, F.lit(PART))
    return parts.select("doc_id", "text_key", "n_words", "at", "base", "around", F.posexplode(own).alias("i", "word")).select(
        "doc_id", "text_key", "n_words", (F.col("at") + F.col("i")).alias("pos"), F.lower("word").alias("token"), "base", "around"
    )


def verdicts(docs: DataFrame, benchmark: DataFrame, width: int = 13, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """A row per row of docs: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text"), ITEM_WORD).alias("w"))
    base = materialize(base.select("doc_id", "text_key", F.size("w").alias("n_words"), "w"), "decontam-words")
    windows = materialize(item_windows(benchmark, width), "decontam-windows")
    held = windows.agg(F.sum(F.length("window") * 2 + F.length(F.array_join("items", " ")) + 256)).first()[0] or 0
    small = held * 4 <= broadcast_bytes  # characters may be 4 bytes
    plan = materialize(with_prefix(windows, base, small), "decontam-plan")
    said = tokens(base, width)
    # first the bounds, then every word
    start = F.col("pos") - F.col("offset")
    bounds = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = lambda w, at: folded(F.slice(w, F.greatest(at, F.lit(0)) + 1, F.col("size"))) == F.col("window")
    out = ["doc_id", "text_key", start.alias("start"), "size", "items"]
    if small:
        hits = said.join(F.broadcast(plan), "token").filter(F.when(bounds, same("around", start - F.col("base"))).otherwise(F.lit(False))).select(*out)
    else:
        near = said.drop("base", "around").join(plan, "token").filter(bounds).select("window", *out)
        own = base.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "w").dropDuplicates(["own_id", "own_key"])
        here = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))
        hits = near.join(own, here).filter(same("w", F.col("start"))).select("doc_id", "text_key", "start", "size", "items")
    by_doc = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size")).alias("places"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    hit = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["size"] - 1))))
    by_doc = materialize(by_doc.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), F.size(hit).cast("long").alias("n_hit"), "items"), "decontam-hits")
    here = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return base.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words")).join(by_doc, here, "left").select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return verdicts(docs, benchmark, **params).drop("text_key")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents without any hit, with their own columns."""
    bad = verdicts(docs, benchmark, **params).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("row_key"))
    return keyed.join(bad, F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.col("row_key") == F.col("bad_key")), "left_anti").select("row.*")
