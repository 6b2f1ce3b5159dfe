"""Retrieval and answering, batched by query: top-k, graph expansion, ranking, context and guard.

Query tables are small and keyed by ``query_id``; vector and graph tables are large. Models are
injected: an encoder, a scorer and a generator, each a function of lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULT, Settings
from quillon.functions import fixed, text
from quillon.operators import extract
from quillon.operators import graph as g
from quillon.scratch import materialize

Encoder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[str], list[str]], list[float]]
Generator = Callable[[str], str]
#: Queries whose vectors are broadcast at most; beyond, blocks of about QUERY_BLOCK queries each meet every part of the vectors.
QUERY_BATCH, QUERY_BLOCK = 4096, 256
#: Vectors in a pack, and pairs whose distances are summed at once.
VECTOR_PACK, PAIRS = 1024, 16384


def embed(df: DataFrame, column: str, encoder: Callable[[], Encoder], batch_size: int = DEFAULT.embed_batch_size, out: str = "embedding") -> DataFrame:
    """Adds the embedding of a column. encoder makes the model, once per worker; texts of like length
    go together, which keeps padding small."""

    @F.arrow_udf("array<float>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encoder()
        for b in batches:
            # texts stay in Arrow and vectors in four bytes a number: only those of one call are Python objects
            texts = pc.fill_null(b, "")
            order = np.argsort(np.asarray(pc.utf8_length(texts)), kind="stable")
            vectors: list = [None] * len(order)
            for at in range(0, len(order), batch_size):
                part = order[at : at + batch_size]
                for i, v in zip(part, model(texts.take(pa.array(part)).to_pylist()), strict=True):
                    vectors[i] = np.asarray(v, np.float32)
            yield pa.array(vectors, pa.list_(pa.float32()))

    return df.withColumn(out, encoded(F.col(column)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def packed(df: DataFrame, id_column: str, rows: int) -> DataFrame:
    """df (an id, embedding) in rows of at most so many: pack (a number), ids, embeddings."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                one = [pa.array([pack], pa.int64()), *[pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([c])) for c in part.columns]]
                yield pa.RecordBatch.from_arrays(one, ["pack", "ids", "embeddings"])
                pack += 1

    return df.select(id_column, F.col("embedding").cast("array<double>")).mapInArrow(run, f"pack long, ids array<{kind}>, embeddings array<array<double>>")


class _Rows:
    """Vectors of a pack: matrix, norms, unit vectors and kind: 0 has a direction, 1 has none, 2 isn't there or of another length."""

    def __init__(self, ids: pa.Array, embeddings: pa.ListArray, width: int):
        n = np.asarray(pc.fill_null(pc.list_value_length(embeddings), -1))
        self.ids, self.x, self.kind = ids, np.zeros((len(n), width)), np.where(n == width, 0, 2)
        flat = np.asarray(pc.list_flatten(embeddings.filter(pa.array(self.kind == 0))), dtype=float)
        self.x[self.kind == 0] = flat.reshape(-1, width)
        self.kind[(self.kind == 0) & np.isnan(self.x).any(axis=1)] = 2 if embeddings.values.null_count else 1
        self.norm = np.sqrt(in_order(self.x, self.x))
        self.kind[(self.kind == 0) & ~((self.norm > 0) & np.isfinite(self.norm))] = 1
        self.unit = np.where(self.kind[:, None] == 0, self.x, 0) / np.where(self.kind == 0, self.norm, 1)[:, None]


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first product to the last as dot() does: the same doubles to the last bit."""
    return np.add.accumulate(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


class _Best:
    """The first k vectors of each query of a block, of those seen: by distance (NaN and then null last) and vec_id."""

    def __init__(self, queries: _Rows, k: int):
        self.queries, self.k, self.held = queries, k, None
        self.least = np.full(len(queries.ids), -np.inf)  # similarity of the k-th

    def see(self, v: _Rows) -> None:
        q, k = self.queries, self.k
        found = []
        good = np.flatnonzero(v.kind == 0)
        if len(good):
            close = q.unit @ v.unit[good].T
            least = self.least
            if len(good) > k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(close, len(good) - k, axis=1)[:, len(good) - k])
            # a margin far above rounding: products of matrices only propose, sums in order decide
            qi, vi = np.nonzero((close >= (least - 1e-9)[:, None]) & (q.kind == 0)[:, None])
            vi = good[vi]
            parts = [(qi[at : at + PAIRS], vi[at : at + PAIRS]) for at in range(0, len(qi), PAIRS)]
            found += [(a, 1 - in_order(v.x[b], q.x[a]) / (v.norm[b] * q.norm[a]), v.ids.take(pa.array(b)), np.zeros(len(a), bool)) for a, b in parts]
        for of in range(3):  # pairs without a distance: the first of them are enough
            asked, kinds = np.flatnonzero(q.kind == of), np.maximum(v.kind, of)
            if len(asked) and (odd := np.flatnonzero(kinds > 0)).size:
                order = np.asarray(pc.sort_indices(pa.table({"kind": kinds[odd], "id": v.ids.take(pa.array(odd))}), sort_keys=[("kind", "ascending"), ("id", "ascending")]))
                first = np.tile(odd[order[:k]], len(asked))
                found.append((np.repeat(asked, min(k, len(odd))), np.full(len(first), np.nan), v.ids.take(pa.array(first)), kinds[first] == 2))
        if found:
            new = [pa.table({"q": a, "d": pa.array(d, mask=none), "id": i}) for a, d, i, none in found]
            self.keep(pa.concat_tables(new if self.held is None else [self.held, *new]))

    def keep(self, rows: pa.Table) -> None:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("d", "ascending"), ("id", "ascending")])).combine_chunks()
        q = np.asarray(rows["q"])
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        self.held = rows.filter(pa.array(nth < self.k))
        last = nth == self.k - 1
        d = np.asarray(pc.fill_null(rows["d"], np.nan))[last]
        self.least[q[last]] = np.where(np.isnan(d), -np.inf, 1 - d)


def first_of_parts(pairs: DataFrame, k: int) -> DataFrame:
    """pairs of packs (pack, q_ids, q, ids, v): query_id, vec_id, distance of the first k of each query in each task."""
    of = lambda c: pairs.schema[c].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for b in batches:
            for i in range(b.num_rows):
                pack, q_ids, q, ids, v = (c[i] for c in b.columns)
                if pack.as_py() not in best:
                    width = max(pc.max(pc.list_value_length(q.values)).as_py() or 0, 0)
                    best[pack.as_py()] = _Best(_Rows(q_ids.values, q.values, width), k)
                block = best[pack.as_py()]
                block.see(_Rows(ids.values, v.values, block.queries.x.shape[1]))
        for block in best.values():
            if block.held is not None:
                for part in pa.table({"query_id": block.queries.ids.take(block.held["q"]), "vec_id": block.held["id"], "distance": block.held["d"]}).to_batches(10000):
                    yield part

    return pairs.select("pack", "q_ids", "q", "ids", "v").mapInArrow(run, f"query_id {of('q_ids').simpleString()}, vec_id {of('ids').simpleString()}, distance double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact: queries (query_id, embedding), vectors (vec_id, embedding) -> query_id, vec_id, distance, pos. Vectors without
    a direction (distance NaN) and those that aren't there or of another length (null) come last.

    Both sides are packed, some hundred vectors a row, and a pair of packs is one product of matrices: it proposes
    pairs with a margin, their distances are then summed in order. Up to QUERY_BATCH queries lie on every executor and
    each vector is scored where it is. More are dealt into blocks, and each pair of a block and a part of the vectors
    is a task of its own, so that neither the driver nor a task holds all queries. A task holds and gives k rows a query,
    never all scores; the rank limit runs over these before the shuffle again (a window group limit in the plan).
    """
    batch = queries.count()
    many = batch > QUERY_BATCH
    asked = packed(queries.select("query_id", "embedding").repartition(max(-(-batch // QUERY_BLOCK), 1)), "query_id", QUERY_BLOCK).toDF("pack", "q_ids", "q")
    held = packed(vectors, "vec_id", VECTOR_PACK).select("ids", F.col("embeddings").alias("v"))
    # every block of queries reads the packs again
    pairs = materialize(held, "packed-vectors").join(asked.hint("shuffle_replicate_nl")) if many else held.join(F.broadcast(asked))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id"))
    return first_of_parts(pairs, k).withColumn("pos", pos).filter(F.col("pos") <= k).select("query_id", "vec_id", "distance", "pos")


def entry_points(hits: DataFrame, threshold: float, k: int) -> DataFrame:
    """hits (query_id, vec_id, distance) -> query_id, article_id, similarity, pos: the best similarity of
    each article, those at the threshold at least, the first k."""
    best = hits.groupBy("query_id", text.article_of_vector(F.col("vec_id").cast("string")).alias("article_id")).agg(F.max(1 - F.col("distance")).alias("similarity"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "article_id"))
    return best.filter(F.col("similarity") >= threshold).withColumn("pos", pos).filter(F.col("pos") <= k)


def traverse(entries: DataFrame, graph: g.Graph, max_hop: int) -> dict[str, DataFrame]:
    """Bounded breadth-first search from entries (query_id, article_id): nodes (query_id, article_id,
    hop, is_external), edges (query_id, hop, from_id, rel_type, to_article_id, to_term_id, is_external) and
    terms (query_id, term_id). Every edge of a visited node within the hops is kept, back edges too;
    definitions end at their terms; only nodes that the search discovers are external. Each hop is written
    once, for the next one and for all that read its edges."""
    nodes = materialize(entries.select("query_id", "article_id").distinct().withColumn("hop", F.lit(0)).withColumn("is_external", F.lit(False)), "traverse-frontier")
    frontier, edges = nodes, None
    for hop in range(1, max_hop + 1):
        pairs = frontier.select("query_id", F.col("article_id").alias("from_id"))
        step = pairs.join(g.expand(pairs.select("from_id").distinct(), graph), "from_id").select("query_id", F.lit(hop).alias("hop"), "from_id", "rel_type", "to_article_id", "to_term_id", "is_external")
        step = materialize(step, "traverse-edges")
        edges = step if edges is None else edges.union(step)
        found = step.filter("to_article_id IS NOT NULL").groupBy("query_id", F.col("to_article_id").alias("article_id")).agg(F.bool_or("is_external").alias("is_external"))
        frontier = found.join(nodes, ["query_id", "article_id"], "left_anti").select("query_id", "article_id", F.lit(hop).alias("hop"), "is_external")
        frontier = materialize(frontier, "traverse-frontier") if hop < max_hop else frontier
        nodes = nodes.union(frontier)
    if edges is None:
        edges = g.expand(nodes.select(F.col("article_id").alias("from_id")), graph).limit(0).select(F.lit(None).cast(entries.schema["query_id"].dataType).alias("query_id"), F.lit(0).alias("hop"), "*")
    return {"nodes": nodes, "edges": edges, "terms": edges.filter("to_term_id IS NOT NULL").select("query_id", F.col("to_term_id").alias("term_id")).distinct()}


def rank(entries: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries in their order, then cited articles by the first edge to them (hop, from, to): query_id, article_id, pos."""
    order = F.struct(F.lit(0).alias("tier"), F.col("pos").cast("long").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"))
    first = entries.select("query_id", "article_id", order.alias("o"))
    later = edges.filter("rel_type = 'REFERENCES'").select("query_id", F.col("to_article_id").alias("article_id"), F.struct(F.lit(1).alias("tier"), F.col("hop").cast("long").alias("a"), F.col("from_id").alias("b"), F.col("to_article_id").alias("c")).alias("o"))
    best = first.union(later).groupBy("query_id", "article_id").agg(F.min("o").alias("o"))
    ranked = best.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "article_id"))).drop("o")
    return ranked if limit is None else ranked.filter(F.col("pos") <= limit)


def rerank(ranked: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Callable[[], Scorer], k: int) -> DataFrame:
    """ranked (query_id, article_id, pos) by score of (question, text), ties in the old order; articles
    without text, or with an empty one, follow in their old order."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = scorer()
        for q, t in batches:
            yield pd.Series(model(q.tolist(), t.tolist()), dtype=float)

    joined = ranked.join(queries.select("query_id", "question"), "query_id").join(texts.select("article_id", "full_text"), "article_id", "left")
    has = F.coalesce(F.length("full_text") > 0, F.lit(False))
    with_text = joined.filter(has).withColumn("score", scored(F.col("question"), F.col("full_text")))
    both = with_text.unionByName(joined.filter(~has), allowMissingColumns=True)
    new = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").isNull(), F.desc("score"), "pos", "article_id"))
    return both.withColumn("new_pos", new).filter(F.col("new_pos") <= k).select("query_id", "article_id", F.col("new_pos").alias("pos"), "score")


def contexts(ranked: DataFrame, texts: DataFrame, graph: g.Graph) -> DataFrame:
    """What is known of each ranked article: query_id, article_id, pos, kind (full, external, preview,
    missing), content. A text that is there, even an empty one, wins."""
    held = texts.select("article_id", F.col("full_text"), F.lit(True).alias("has_text"))
    info = graph["article"].select("article_id", F.coalesce("is_external", F.lit(False)).alias("external"), "noi_dung_preview", F.lit(True).alias("known"))
    joined = ranked.join(held, "article_id", "left").join(info, "article_id", "left")
    kind = F.when(F.col("has_text"), "full").when(F.col("known").isNull(), "missing").when(F.col("external"), "external").otherwise("preview")
    content = F.when(F.col("has_text"), F.col("full_text")).when(F.col("known") & ~F.col("external"), F.col("noi_dung_preview"))
    return joined.select("query_id", "article_id", "pos", kind.alias("kind"), content.alias("content"))


#: What the model is told before question and context; the caller may give other rules.
RULES = (
    "Chỉ trả lời bằng nội dung của NGỮ CẢNH dưới đây, ngắn gọn, và dẫn Điều cho từng ý. Không dẫn văn bản nào ngoài NGỮ CẢNH. "
    f'Nếu NGỮ CẢNH không đủ, chỉ nói: "{fixed.NOT_FOUND_ANSWER}".\n\n'
)


def prompts(queries: DataFrame, context: DataFrame, rules: str = RULES, lead: str = "CÂU HỎI: ", middle: str = "\n\nNGỮ CẢNH:\n", tail: str = "\n\nTRẢ LỜI:") -> DataFrame:
    """query_id, prompt: rules, question and the context blocks in rank order."""
    head = F.concat(F.lit("[Điều: "), F.col("article_id"), F.lit("]"))
    block = (
        F.when(F.col("kind") == "external", F.concat(head, F.lit(f" {fixed.EXTERNAL_MARK}")))
        .when(F.col("kind") == "preview", F.concat(head, F.lit(f" {fixed.PREVIEW_MARK}\n"), F.coalesce("content", F.lit(""))))
        .otherwise(F.concat(head, F.lit("\n"), F.coalesce("content", F.lit("None"))))
    )
    blocks = context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("context"))
    joined = queries.join(blocks, "query_id", "left")
    return joined.select("query_id", F.concat(F.lit(rules), F.lit(lead), F.col("question"), F.lit(middle), F.coalesce("context", F.lit(fixed.NO_CONTEXT)), F.lit(tail)).alias("prompt"))


def guard(answers: DataFrame, context: DataFrame) -> DataFrame:
    """answers (query_id, answer): adds hallucinated (documents cited but not in the context, sorted) and,
    where there are any, a warning to the answer."""
    held = context.groupBy("query_id").agg(F.collect_set(F.substring_index("article_id", "_dieu-", 1)).alias("docs"))
    joined = answers.join(held, "query_id", "left")
    bad = F.array_sort(F.array_except(extract.cited_documents(F.col("answer")), F.coalesce("docs", F.array().cast("array<string>"))))
    warned = F.concat(F.col("answer"), F.lit(fixed.WARNING_BEFORE), F.array_join("hallucinated", ", "), F.lit(fixed.WARNING_AFTER))
    return joined.withColumn("hallucinated", bad).withColumn("answer", F.when(F.size("hallucinated") > 0, warned).otherwise(F.col("answer"))).drop("docs")


def generate(df: DataFrame, generator: Callable[[], Generator], column: str = "prompt", out: str = "answer") -> DataFrame:
    """Adds a model's reply to a column of prompts; the model is made once per worker."""

    @F.pandas_udf("string")
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = generator()
        for b in batches:
            yield pd.Series([model(p) for p in b], dtype=object)

    return df.withColumn(out, said(F.col(column)))


def retrieve(queries: DataFrame, vectors: DataFrame, graph: g.Graph, texts: DataFrame, *, top_k: int | None = None, threshold: float | None = None, max_hop: int | None = None, limit: int | None = None, overfetch: int | None = None, scorer: Callable[[], Scorer] | None = None, fetch_k: int | None = None, at: str | None = None, settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """queries (query_id, question, embedding) to entries, nodes, edges, ranked and context. With a
    scorer, entries and pool are fetch_k wide and then reranked to limit. at (an ISO date), an option
    that is off by default, keeps entries in force on that day only. What isn't given is as in settings.
    Entries and ranked articles are written once; nothing searches the vectors or the graph twice."""
    given = lambda value, name: getattr(settings, name) if value is None else value
    limit, fetch_k = given(limit, "max_context_articles"), given(fetch_k, "rerank_fetch_k")
    k = fetch_k if scorer else given(top_k, "top_k")
    hits = nearest(queries, vectors, k * given(overfetch, "overfetch"))
    if at:
        dated = graph["document"].filter(F.coalesce(F.col("ngay_hieu_luc") <= at, F.lit(True)) & F.coalesce(F.col("ngay_het_hieu_luc") > at, F.lit(True))).select("doc_id")
        hits = hits.withColumn("doc_id", text.doc_of_article(text.article_of_vector(F.col("vec_id")))).join(dated, "doc_id", "left_semi").drop("doc_id")
    entries = materialize(entry_points(hits, given(threshold, "similarity_threshold"), k), "retrieve-entries")
    walked = traverse(entries, graph, given(max_hop, "max_hop"))
    ranked = rank(entries, walked["edges"], fetch_k if scorer else limit)
    if scorer:
        ranked = rerank(ranked, queries, texts, scorer, limit)
    ranked = materialize(ranked, "retrieve-ranked")
    return {"entries": entries, "ranked": ranked, "context": contexts(ranked, texts, graph), **walked}


def chat(queries: DataFrame, vectors: DataFrame, graph: g.Graph, texts: DataFrame, generator: Callable[[], Generator], rules: str = RULES, **params) -> DataFrame:
    """A row per question: query_id, answer, hallucinated (null where nothing was found), citation_path
    (ranked articles, marked), edges_used (all edges of the search)."""
    r = retrieve(queries, vectors, graph, texts, **params)
    context = materialize(r["context"], "chat-context")
    found = queries.join(r["entries"].select("query_id").distinct(), "query_id", "left_semi")
    said = guard(generate(prompts(found, context, rules), generator), context).select("query_id", "answer", "hallucinated")
    none = queries.join(r["entries"], "query_id", "left_anti").select("query_id", F.lit(fixed.NOT_FOUND_ANSWER).alias("answer"), F.lit(None).cast("array<string>").alias("hallucinated"))
    entry = r["entries"].select("query_id", "article_id", F.lit(True).alias("is_entry"))
    shown = context.join(entry, ["query_id", "article_id"], "left").select("query_id", F.struct("pos", text.cited(F.col("article_id"), F.coalesce("is_entry", F.lit(False)), F.col("kind") == "external").alias("id")).alias("p"))
    path = shown.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["id"]).alias("citation_path"))
    edge = F.struct("hop", "from_id", "rel_type", F.coalesce("to_article_id", "to_term_id").alias("to_id"))
    used = r["edges"].groupBy("query_id").agg(F.array_sort(F.collect_set(edge)).alias("edges_used"))
    return said.union(none).join(path, "query_id", "left").join(used, "query_id", "left")
