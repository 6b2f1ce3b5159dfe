"""Substring dedup by De Bruijn compaction over word k-mers.

Edges of the graph are all windows of ``width`` consecutive words. Consecutive windows whose
rarest-ordered inner words (the minimizer) are the same occurrence travel as one row, a run, so the
table of edges is a small part of the text. Spark joins then

1. keep the runs whose minimizer occurs again anywhere (the only ones that can be repeated);
2. count equal runs: a run with copies consists of repeated edges only. From their predecessors and
   successors follow the branches of the graph: where a run is always followed by one run, which is
   always preceded by it, the two are one path. Beginnings and ends of texts are branches too, so that
   all edges of a path have the same number of copies;
3. compact the paths by pointer doubling: every run looks up the run its pointer leads to, until all
   point at the head of their path. From here on paths stand for their runs: an occurrence of a head is
   an occurrence of its path, a passage of all its windows, whether it is repeated is decided once per path;
4. single runs beside other runs of their minimizer are the borders of repeated passages: for these
   alone, every window is compared.

Hashes only propose. Every passage and every border window is compared by a 128-bit digest of its words
at its source coordinates. Should a path's passages differ, hashes have collided: then all runs of
the path's minimizers are compared window by window.

Defined cases: a null text has no words; texts shorter than a window keep all words; very long texts are
cut into runs whole; of equally small hashes in a window the first place is its minimizer; repeated rows
are documents of their own, whose windows are repeated; an empty table gives no rows; other columns
are ignored. A removed passage is removed wherever it occurs, the first place included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize
from quillon.llm.tokens import _WORDS, U64, Words, _prefix, chunks, mix


def runs_of(w: Words, width: int, inner: int) -> tuple[np.ndarray, ...]:
    """(text, start, count, anchor, content) of all runs of a chunk; start counts words of the text."""
    n = len(w.hashes)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(U64), none.astype(U64)
    up, down = _WORDS.upto(n + 1)
    sums = _prefix(w.hashes * up[:n])
    inners = mix((sums[inner:] - sums[:-inner]) * down[: n - inner + 1])
    # the least hash of a window, its first place where it has several: both follow from the words alone
    least = (inners & U64(0xFFFFFFFF00000000)) | np.arange(len(inners), dtype=U64)
    span, have = width - inner + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    place = (least & U64(0xFFFFFFFF)).astype(np.int64)
    ends = np.repeat(w.first[1:], np.diff(w.first))
    inside = np.flatnonzero(np.arange(n - width + 1) + width <= ends[: n - width + 1])
    if not len(inside):
        return none, none, none, none.astype(U64), none.astype(U64)
    text = np.searchsorted(w.first, inside, "right") - 1
    new = np.ones(len(inside), bool)
    new[1:] = (place[inside[1:]] != place[inside[:-1]]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    start, text = inside[at], text[at]
    count = np.diff(np.append(at, len(inside)))
    anchor = place[start]
    content = mix((sums[start + count + width - 1] - sums[start]) * down[start] + ((anchor - start) * 4096 + count).astype(U64))
    return text, start - w.first[text], count, mix(inners[anchor]), content


def document_runs(docs: DataFrame, width: int, inner: int) -> DataFrame:
    """doc_id, text_key, n_words, runs: a row per row of docs. text_key tells apart texts of one doc_id."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, edges, cols = [], [0], [[] for _ in range(4)]
            for _, rows, w in chunks(b.column("text"), fold=False):
                sizes.append(np.diff(w.first))
                text, *rest = runs_of(w, width, inner)
                edges.append(edges[-1][-1] + np.searchsorted(text, np.arange(1, rows + 1)) if len(edges) > 1 else np.searchsorted(text, np.arange(1, rows + 1)))
                for c, x in zip(cols, rest, strict=True):
                    c.append(x)
            start, count, anchor, content = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            struct = pa.StructArray.from_arrays(
                [pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], ["start", "n", "anchor", "content"]
            )
            offsets = np.concatenate([[0], *edges[1:]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)), pa.ListArray.from_arrays(pa.array(offsets), struct)],
                ["doc_id", "text_key", "n_words", "runs"],
            )

    return keyed(docs).mapInArrow(run, f"doc_id {id_type}, text_key long, n_words long, runs array<struct<start:int,n:int,anchor:long,content:long>>")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def compared(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """asked (doc_id, text_key, start, n, anchor, known, path): a row per passage of a path, and per window of
    every other asked run: doc_id, text_key, anchor, known, path, start, n, digest. n is 0 where a passage
    goes beyond its text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    lists = asked.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n", "anchor", "known", "path")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda b: hashlib.blake2b(b, digest_size=16).digest()
        for b in batches:
            rows, out = [], [[] for _ in range(6)]
            for i, (t, spans) in enumerate(zip(b.column("text"), b.column("asked"), strict=True)):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
                said = memoryview(b" ".join(words))
                at = np.zeros(len(words) + 1, np.int64)
                np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
                at = at.tolist()
                for s in spans.as_py():
                    start, n, path = s["start"], s["n"], s["path"]
                    fits = start + n + width - 1 <= len(words)
                    if path is None:
                        found = [(p, 1, digest(said[at[p] : at[p + width] - 1])) for p in range(start, start + n)]
                    else:
                        found = [(start, n, digest(said[at[start] : at[start + n + width - 1] - 1]))] if fits else [(start, 0, b"")]
                    for place, size, d in found:
                        rows.append(i)
                        for c, x in zip(out, (s["anchor"], s["known"], path, place, size, d), strict=True):
                            c.append(x)
            rows = pa.array(rows, pa.int64())
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("text_key").take(rows), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", "text_key", "anchor", "known", "path", "start", "n", "digest"])

    own = keyed(docs).withColumnRenamed("doc_id", "own_id").withColumnRenamed("text_key", "own_key")
    here = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key"))
    # rows that repeat are asked for what is repeated anyway, of which seeing one twice changes nothing
    joined = own.join(lists, here).select("doc_id", "text_key", "text", "asked")
    return joined.mapInArrow(run, f"doc_id {id_type}, text_key long, anchor long, known boolean, path long, start int, n int, digest binary")


def linked(kinds: DataFrame) -> DataFrame:
    """kinds: (content, n, copies, prev_lo, prev_hi, next_lo, next_hi). (content, up, n) for each repeated run that only
    continues another one, up: the two are each other's only neighbours."""
    twice = kinds.filter("copies > 1")
    after = twice.filter("next_lo = next_hi AND next_lo <> 0").select(F.col("content").alias("up"), F.col("next_lo").alias("content"))
    before = twice.filter("prev_lo = prev_hi AND prev_lo <> 0").select("content", F.col("prev_lo").alias("up"), "n")
    return before.join(after, ["content", "up"], "left_semi").filter("content <> up")


def compacted(links: DataFrame) -> DataFrame:
    """links (content, up, n): (content, head, n), by pointer doubling. After step k a pointer leads over 2**k
    runs or to its path's head, so the steps are the logarithm of the longest path; only runs whose
    pointer still moves take part in a step."""
    moving, parts = materialize(links.select("content", "up", "n", F.lit(True).alias("moves")), "substring-path"), []
    for _ in range(64):
        every = moving
        for p in parts:
            every = every.union(p)
        ahead = every.select(F.col("content").alias("up"), F.col("up").alias("further"))
        step = moving.join(ahead, "up", "left").select("content", F.coalesce("further", "up").alias("up"), "n", F.col("further").isNotNull().alias("moves"))
        step = materialize(step, "substring-path")
        parts.append(step.filter("NOT moves"))
        moving = step.filter("moves")
        if not moving.limit(1).count():
            break
    # what still moves lies on a ring, which only hashes that collide can make: each of its runs is a path
    out = moving.select("content", F.col("content").alias("head"), "n")
    for p in parts:
        out = out.union(p.select("content", F.col("up").alias("head"), "n"))
    return out


def paths_of(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, members): content of the head, runs, n (windows of the whole path); and content, head of all repeated runs."""
    heads_of = materialize(compacted(linked(kinds)), "substring-members")
    twice = kinds.filter("copies > 1").select("content", "n")
    members = materialize(twice.join(heads_of.select("content", "head"), "content", "left").select("content", F.coalesce("head", "content").alias("head"), "n"), "substring-members")
    return materialize(members.groupBy(F.col("head").alias("content")).agg(F.count("*").alias("runs"), F.sum("n").cast("int").alias("n")), "substring-paths"), members


def repeated_spans(docs: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, spans: for each document with repeated windows, its places of them as array<struct<start, n, path>>:
    n windows from word start on; path names the compacted path, null at borders."""
    each = runs.select("doc_id", "text_key", F.posexplode("runs").alias("i", "r"), "runs")
    each = each.select(
        "doc_id", "text_key", "r.start", "r.n", "r.anchor", "r.content", F.get("runs", F.col("i") - 1)["content"].alias("prev"), F.get("runs", F.col("i") + 1)["content"].alias("next")
    )
    anchors = runs.select(F.explode("runs.anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
    anchors = materialize(anchors, "substring-anchors")  # so that the join's shuffles are plain ones, and a frequent minimizer's rows split
    found = materialize(each.join(anchors, "anchor"), "substring-runs")
    ends = lambda c: (F.min(F.coalesce(c, F.lit(0))).alias(f"{c}_lo"), F.max(F.coalesce(c, F.lit(0))).alias(f"{c}_hi"))
    kinds = found.groupBy("content").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.max("n").alias("n_hi"), *ends("prev"), *ends("next"), F.min(F.struct("doc_id", "text_key", "start", "n", "anchor")).alias("one"))
    kinds = materialize(kinds, "substring-kinds")
    paths, members = paths_of(kinds)
    passages = found.select("doc_id", "text_key", "start", "content").join(paths, "content")
    passages = passages.select("doc_id", "text_key", "start", "n", F.lit(None).cast("long").alias("anchor"), F.lit(False).alias("known"), F.col("content").alias("path"))
    # borders: single runs, and one of each repeated kind of the same minimizer
    single = materialize(kinds.filter("copies = 1").select(F.col("one.anchor").alias("anchor")).distinct(), "substring-single")
    ones = kinds.select("one.*", (F.col("copies") > 1).alias("known"), F.lit(None).cast("long").alias("path")).join(single, "anchor", "left_semi")
    cols = ["doc_id", "text_key", "start", "n", "anchor", "known", "path"]
    seen = materialize(compared(docs, passages.select(*cols).union(ones.select(*cols)), width), "substring-compared")
    said = seen.filter("path IS NOT NULL")
    forms = materialize(said.groupBy("path", "n", "digest").agg(F.count("*").alias("c")), "substring-forms")
    sure = said.join(forms.filter("c > 1 AND n > 0"), ["path", "n", "digest"], "left_semi").select("doc_id", "text_key", "start", "n", "path")
    again = lambda df: df.join(materialize(df.groupBy("anchor", "digest").agg(F.count("*").alias("c")).filter("c > 1"), "substring-again"), ["anchor", "digest"], "left_semi")
    edge = again(seen.filter("path IS NULL")).filter("NOT known").select("doc_id", "text_key", "start", "n", "path")
    out = sure.union(edge)
    differ = forms.groupBy("path").agg(F.count("*").alias("forms"), F.min("n").alias("least")).filter("forms > 1 OR least = 0").select(F.col("path").alias("head"))
    differ = differ.union(members.join(kinds.filter("copies > 1 AND n < n_hi").select("content"), "content", "left_semi").select("head")).distinct()
    if differ.limit(1).count():
        doubtful = found.join(members.join(differ, "head", "left_semi").select("content"), "content", "left_semi").select("anchor").distinct()
        asked = found.join(materialize(doubtful, "substring-doubtful"), "anchor", "left_semi").withColumn("known", F.lit(False)).withColumn("path", F.lit(None).cast("long"))
        out = out.union(again(materialize(compared(docs, asked.select(*cols), width), "substring-compared")).select("doc_id", "text_key", "start", "n", "path"))
    return out.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n", "path")).alias("spans"))


def cut(text: str | None, spans: list[dict], width: int) -> tuple[int, int, str]:
    """Words, removed words and the kept words joined by one space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    change = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        change[s["start"]] += 1
        change[s["start"] + s["n"] + width - 1] -= 1
    gone = np.cumsum(change[:-1]) > 0
    kept = [w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words
    return len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, width: int = 50, inner: int = 8, digest: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed and kept_text, or with digest its SHA-256."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    runs = materialize(document_runs(docs, width, inner), "substring-documents")
    spans = materialize(repeated_spans(docs, runs, width), "substring-spans").withColumnRenamed("doc_id", "of_id").withColumnRenamed("text_key", "of_key")
    name = "kept_sha256" if digest else "kept_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [cut(t.as_py(), s.as_py() or [], width) for t, s in zip(b.column("text"), b.column("spans"), strict=True)]
            texts = [hashlib.sha256(r[2].encode("utf-8", "surrogatepass")).hexdigest() if digest else r[2] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", name])

    here = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    joined = keyed(docs).join(spans, here, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, {name} string")
