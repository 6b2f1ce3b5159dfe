"""Quality rules with host-level verdicts, with DataFrame functions only.

Per document: word and symbol counts, repeated lines and repeated three-word windows over the
whole text. Per host (the source column): the share of documents that fail any rule, shrunk by a
beta prior fitted to all hosts, so that a host with few documents isn't judged by their noise.

A base rule rejects a document by itself. The other rules are weak evidence, and the host's verdict
decides what they count for, by the posterior of its failure rate, two deviations to the safe side:

* rejected: most of its documents fail and the rate is clearly above the other hosts'. All go;
* cleared: the rate is clearly below half of the mean. A single weak failure there is more likely
  odd form than junk, and the document stays;
* any other host: a document that fails a weak rule goes.

Defined cases: a null or empty text has no words and fails the base rule; a very long text is measured
whole, inside its row; a rate exactly at a limit is not beyond it; a null source is a host of its own;
repeated rows are judged each by itself; an empty table gives no rows; other columns of the input are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, words


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    A window becomes one long: the high bits a hash of its words, the low bits its place, just
    wide enough for the text. Sorted longs bring windows of one hash together, without any shuffle;
    of those the words themselves are sorted and compared.
    """
    n = F.size(w)
    right = lambda x, bits: F.call_function("shiftright", x, bits)
    left = lambda x, bits: F.call_function("shiftleft", x, bits)

    def beside(values: Column, part) -> Column:
        """The values whose part equals that of a neighbour."""
        same = lambda a, b: F.coalesce(part(a) == part(b), F.lit(False))
        return F.filter(values, lambda x, i: same(x, F.get(values, i + 1)) | same(x, F.get(values, i - 1)))

    bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")
    hashed = lambda b: F.transform(
        F.slice(w, 1, n - 2), lambda x, i: left(right(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), b), b).bitwiseOR(i.cast("long"))
    )
    places = lambda longs, b: F.transform(beside(longs, lambda x: right(x, b)), lambda x: x.bitwiseAND(left(F.lit(1).cast("long"), b) - 1).cast("int"))
    proposed = let(bits, lambda b: let(F.sort_array(hashed(b)), lambda longs: places(longs, b)))
    said = let(proposed, lambda at: F.sort_array(F.transform(at, lambda p: F.struct(F.array_join(F.slice(w, p + 1, F.lit(3)), " ").alias("words"), p.alias("at")))))
    found = let(said, lambda windows: F.transform(beside(windows, lambda x: x["words"]), lambda x: x["at"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(found, lambda p: F.array(p, p + 1, p + 2)))))
    return F.when(n < 4, F.lit(0)).otherwise(covered).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), host, and the counts."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select(F.struct("*").alias("row"))
        .withColumn("w", words(text))
        .withColumn("lines", lines)
        .select(
            "row",
            F.col("row.source").alias("host"),
            F.size("w").cast("long").alias("n_words"),
            F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.size("lines").cast("long").alias("n_lines"),
            repeat_words(F.col("w")).alias("n_repeat_words"),
        )
    )


#: Rules by name. The base rules reject a document by themselves; for the others see the host's verdict.
BASE_RULES = {"short": "n_words < 50", "repetitive": "100 * n_repeat_words > 50 * n_words"}
WEAK_RULES = {"symbols": "2 * n_symbols > n_words", "same_lines": "2 * n_dup_lines > n_lines"}
#: Hosts with a verdict of their own that are broadcast at most, in bytes; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def judged(flagged: DataFrame) -> DataFrame:
    """flagged: (host, base_failed, weak_failed). (host, verdict) for the rejected and the cleared hosts.

    The prior has the mean of all documents and the strength that the spread of the hosts' rates
    implies (method of moments); four numbers come to the driver for it.
    """
    failed = F.col("base_failed") | F.col("weak_failed")
    hosts = materialize(flagged.groupBy("host").agg(F.count("*").alias("docs"), F.count_if(failed).alias("bad")), "quality-hosts")
    rate = F.col("bad") / F.col("docs")
    seen = hosts.agg(F.sum("bad").alias("bad"), F.sum("docs").alias("docs"), F.avg(rate).alias("m1"), F.avg(rate * rate).alias("m2")).first()
    if not seen["docs"]:
        return hosts.select("host", F.lit("").alias("verdict"))
    mean = seen["bad"] / seen["docs"]
    spread = max(seen["m2"] - 2 * mean * seen["m1"] + mean * mean, 1e-9)
    strength = max(mean * (1 - mean) / spread - 1, 1.0)
    limit = min(0.9, max(0.5, mean + 3 * (mean * (1 - mean) / (strength + 1)) ** 0.5))
    known = hosts.withColumn("m", (F.col("bad") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength)))
    known = known.withColumn("sd", F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("docs") + F.lit(strength) + 1)))
    verdict = F.when(F.col("m") - 2 * F.col("sd") > limit, "rejected").when(F.col("m") + 2 * F.col("sd") < mean / 2, "cleared")
    return materialize(known.select("host", verdict.alias("verdict")).filter("verdict IS NOT NULL"), "quality-verdicts")


def with_verdicts(docs: DataFrame, keep_row: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """row, host, counts, base_failed, kept. One pass over the texts; without keep_row only the
    doc_id is carried to the verdict. Few hosts have a verdict of their own; where their measured size
    allows it they are broadcast, so that no text moves."""
    base = F.expr(" OR ".join(f"({r})" for r in BASE_RULES.values()))
    weak = F.expr(" OR ".join(f"({r})" for r in WEAK_RULES.values()))
    df = measured(docs)
    if not keep_row:
        df = df.withColumn("row", F.struct(F.col("row.doc_id").alias("doc_id")))
    flagged = materialize(df.withColumn("base_failed", base).withColumn("weak_failed", weak), "quality")
    hosts = judged(flagged).withColumnRenamed("host", "judged_host")
    held = hosts.agg(F.sum(F.coalesce(F.octet_length("judged_host"), F.lit(0)) + 64)).first()[0] or 0
    joined = flagged.join(F.broadcast(hosts) if held <= broadcast_bytes else hosts.hint("merge"), F.col("host").eqNullSafe(F.col("judged_host")), "left")
    verdict = F.coalesce("verdict", F.lit(""))
    return joined.withColumn("kept", ~F.col("base_failed") & (verdict != "rejected") & (~F.col("weak_failed") | (verdict == "cleared")))


def quality(docs: DataFrame, **params) -> DataFrame:
    """A row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept."""
    return with_verdicts(docs, keep_row=False, **params).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, **params) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return with_verdicts(docs, **params).filter("kept").select("row.*")
