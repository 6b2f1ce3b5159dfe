"""The graph as tables: idempotent merges, maintenance and reads.

A graph is a dict of DataFrames (``TABLES``). Writes are batch recomputations: every function takes
the present tables and new rows with a write order ``seq`` and returns new tables. Rows that are
already there count as written before any new one, so a merge is a no-op when it is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from quillon.functions import fixed, text

#: Tables, their columns and keys.
TABLES = {
    "document": ("doc_id string, title string, batch_id string, so_hieu string, loai_vb string, ngay_hieu_luc string, ngay_het_hieu_luc string, trang_thai string, che_do array<string>", ("doc_id",)),
    "chapter": ("chapter_id string, so_chuong int, tieu_de string", ("chapter_id",)),
    "article": ("article_id string, so_dieu int, noi_dung_preview string, is_external boolean", ("article_id",)),
    "clause": ("clause_id string, so_khoan int, noi_dung string", ("clause_id",)),
    "term": ("term_id string, ten_thuat_ngu string, dinh_nghia string", ("term_id",)),
    "belongs_to": ("child_id string, child_kind string, parent_id string, parent_kind string", ("child_id", "child_kind", "parent_id", "parent_kind")),
    "references": ("source_id string, target_id string, raw_text string", ("source_id", "target_id")),
    "defines": ("article_id string, term_id string", ("article_id", "term_id")),
    "uses_term": ("article_id string, term_id string", ("article_id", "term_id")),
    "relation": ("source_id string, target_id string, type string, confidence double, ly_do string", ("source_id", "target_id", "type")),
}
IDENTITY = ("so_hieu", "loai_vb", "ngay_hieu_luc", "ngay_het_hieu_luc", "trang_thai", "che_do")
Graph = dict[str, DataFrame]


def empty(spark: SparkSession) -> Graph:
    return {name: spark.createDataFrame([], schema) for name, (schema, _) in TABLES.items()}


def check_unique(graph: Graph) -> DataFrame:
    """Violations of the uniqueness of document and article ids: table, key, rows. Empty if all is well."""
    out = [graph[t].groupBy(F.col(k).alias("key")).agg(F.count("*").alias("rows")).filter("rows > 1").select(F.lit(t).alias("table"), "key", "rows") for t, k in (("document", "doc_id"), ("article", "article_id"))]
    return out[0].union(out[1])


def run(graph: Graph, sql: str, **params) -> DataFrame:
    """A query over the graph's tables, named in braces, with named parameters: run(graph, "SELECT * FROM {article} WHERE
    so_dieu = :n", n=3). Parameters are values, never parts of the text."""
    spark = next(iter(graph.values())).sparkSession
    return spark.sql(sql, args=params, **{name: df for name, df in graph.items() if f"{{{name}}}" in sql})


def _order(present: bool, seq: Column | None, kind: DataType) -> Column:
    """Old rows come before all new ones, which are in the order of seq."""
    return F.struct(F.lit(not present).alias("new"), (F.lit(None) if seq is None else seq).cast(kind).alias("seq"))


def merge(old: DataFrame, new: DataFrame, key: Sequence[str], first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """old with new (with seq, of any type that has an order) merged in by key. Columns in first keep what was
    written first, those in last take what is written last, null included; columns of neither keep the old value."""
    cols = [c for c in old.columns if c not in key]
    kind = new.schema["seq"].dataType
    before = old.withColumn("seq", _order(True, None, kind))
    both = before.unionByName(new.select(*[c for c in new.columns if c in old.columns], _order(False, F.col("seq"), kind).alias("seq")), allowMissingColumns=True)
    pick = {**dict.fromkeys(first, F.min_by), **dict.fromkeys(last, F.max_by)}
    old_only = lambda c: F.min_by(F.struct(F.when(~F.col("seq.new"), F.col(c)).alias("v")), "seq")["v"].alias(c)
    # values in structs: max_by over a plain column would pass over nothing, but null values must win too
    aggs = [pick[c](F.struct(F.col(c).alias("v")), "seq")["v"].alias(c) if c in pick else old_only(c) for c in cols]
    return (both.groupBy(*key).agg(*aggs) if aggs else both.select(*key).distinct()).select(*old.columns)


def combine(deltas: dict[str, DataFrame]) -> Graph:
    """One graph of many that were written by themselves: tables with batch, their order. What the merges
    do row by row holds between batches too: nodes take what was written last, an identity only where one was
    given, terms and citations what was written first, and a placeholder gives way to a real article."""
    out = {}
    of = lambda cols: F.struct(*cols)
    for table, (_, key) in TABLES.items():
        df = deltas[table]
        cols = [c for c in df.columns if c not in key and c != "batch"]
        if not cols:
            out[table] = df.select(*key).distinct()
            continue
        if table == "document":
            named = F.greatest(*[F.col(c).isNotNull() for c in IDENTITY])
            got = df.groupBy(*key).agg(F.max_by(of(["title", "batch_id"]), "batch").alias("own"), F.max_by(F.when(named, of(IDENTITY)), F.when(named, F.col("batch"))).alias("identity"))
            out[table] = got.select(*key, "own.*", *[F.col(f"identity.{c}").alias(c) for c in IDENTITY]).select(*[c for c in df.columns if c != "batch"])
            continue
        order = F.struct(~F.coalesce("is_external", F.lit(False)), F.col("batch")) if table == "article" else F.col("batch")
        pick = F.min_by if table in ("term", "references") else F.max_by
        out[table] = df.groupBy(*key).agg(pick(of(cols), order).alias("v")).select(*key, "v.*").select(*[c for c in df.columns if c != "batch"])
    return out


def upsert_documents(graph: Graph, docs: DataFrame) -> Graph:
    """docs: doc_id, title, batch_id, seq and, if identities are known, their six columns. With them
    all six are written, null included; without them they stay as they are."""
    given = [c for c in IDENTITY if c in docs.columns]
    if given and len(given) < len(IDENTITY):
        raise ValueError(f"an identity has all of {IDENTITY}")
    return graph | {"document": merge(graph["document"], docs, ["doc_id"], last=["title", "batch_id", *given])}


def upsert_chapters(graph: Graph, chapters: DataFrame) -> Graph:
    """chapters: doc_id, chapter_id, so_chuong, tieu_de, seq. Those of unknown documents are passed over."""
    known = chapters.join(graph["document"].select("doc_id"), "doc_id", "left_semi")
    edges = known.select(F.col("chapter_id").alias("child_id"), F.lit("chapter").alias("child_kind"), F.col("doc_id").alias("parent_id"), F.lit("document").alias("parent_kind"))
    return graph | {"chapter": merge(graph["chapter"], known, ["chapter_id"], last=["so_chuong", "tieu_de"]), "belongs_to": graph["belongs_to"].union(edges).distinct()}


def upsert_articles(graph: Graph, articles: DataFrame) -> Graph:
    """articles: doc_id, chapter_id (null: of the document itself), article_id, so_dieu,
    noi_dung_preview, seq. A placeholder becomes a real article and never goes back."""
    in_chapter = articles.filter("chapter_id IS NOT NULL").join(graph["chapter"].select("chapter_id"), "chapter_id", "left_semi")
    in_doc = articles.filter("chapter_id IS NULL").join(graph["document"].select("doc_id"), "doc_id", "left_semi")
    edge = lambda df, parent, kind: df.select(F.col("article_id").alias("child_id"), F.lit("article").alias("child_kind"), F.col(parent).alias("parent_id"), F.lit(kind).alias("parent_kind"))
    cols = ["article_id", "so_dieu", "noi_dung_preview", "seq"]
    new = in_chapter.select(*cols).union(in_doc.select(*cols)).withColumn("is_external", F.lit(False))
    edges = edge(in_chapter, "chapter_id", "chapter").union(edge(in_doc, "doc_id", "document"))
    return graph | {"article": merge(graph["article"], new, ["article_id"], last=["so_dieu", "noi_dung_preview", "is_external"]), "belongs_to": graph["belongs_to"].union(edges).distinct()}


def upsert_clauses(graph: Graph, clauses: DataFrame) -> Graph:
    """clauses: article_id, clause_id, so_khoan, noi_dung, seq."""
    known = clauses.join(graph["article"].select("article_id"), "article_id", "left_semi")
    edges = known.select(F.col("clause_id").alias("child_id"), F.lit("clause").alias("child_kind"), F.col("article_id").alias("parent_id"), F.lit("article").alias("parent_kind"))
    return graph | {"clause": merge(graph["clause"], known, ["clause_id"], last=["so_khoan", "noi_dung"]), "belongs_to": graph["belongs_to"].union(edges).distinct()}


def upsert_parsed(graph: Graph, documents: DataFrame, chapters: DataFrame, articles: DataFrame, clauses: DataFrame) -> Graph:
    """All of parsed documents at once, parents before children."""
    return upsert_clauses(upsert_articles(upsert_chapters(upsert_documents(graph, documents), chapters), articles), clauses)


def _with_placeholders(article: DataFrame, targets: DataFrame) -> DataFrame:
    missing = targets.select(F.col("target_id").alias("article_id")).distinct().join(article, "article_id", "left_anti")
    return article.unionByName(missing.withColumn("is_external", F.lit(True)), allowMissingColumns=True)


def upsert_references(graph: Graph, refs: DataFrame) -> Graph:
    """refs: source_id, target_id, raw_text, seq. One edge per pair, its first text; sources that aren't
    there are passed over, targets that aren't become placeholders."""
    known = refs.join(graph["article"].select(F.col("article_id").alias("source_id")), "source_id", "left_semi")
    return graph | {"article": _with_placeholders(graph["article"], known), "references": merge(graph["references"], known, ["source_id", "target_id"], first=["raw_text"])}


def upsert_definitions(graph: Graph, rows: DataFrame) -> Graph:
    """rows: article_id, term_id, ten_thuat_ngu, dinh_nghia, seq. Terms keep what defined them first."""
    known = rows.join(graph["article"].select("article_id"), "article_id", "left_semi")
    return graph | {"term": merge(graph["term"], rows, ["term_id"], first=["ten_thuat_ngu", "dinh_nghia"]), "defines": graph["defines"].union(known.select("article_id", "term_id")).distinct()}


def upsert_term_usages(graph: Graph, rows: DataFrame) -> Graph:
    """rows: article_id, term_id. Both ends must be there."""
    known = rows.join(graph["article"].select("article_id"), "article_id", "left_semi").join(graph["term"].select("term_id"), "term_id", "left_semi")
    return graph | {"uses_term": graph["uses_term"].union(known.select("article_id", "term_id")).distinct()}


def upsert_relations(graph: Graph, rows: DataFrame) -> Graph:
    """rows: source_id, target_id, type, confidence, ly_do, seq. Other types than the three fail."""
    ok = F.col("type").isin(*fixed.RELATIONS)
    checked = rows.withColumn("type", F.when(ok, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("not a relation: "), F.coalesce("type", F.lit("null"))))))
    known = checked.join(graph["article"].select(F.col("article_id").alias("source_id")), "source_id", "left_semi")
    return graph | {"article": _with_placeholders(graph["article"], known), "relation": merge(graph["relation"], known, ["source_id", "target_id", "type"], last=["confidence", "ly_do"])}


def upsert_supersedes(graph: Graph, rows: DataFrame) -> Graph:
    """rows: new_id, old_id: a SUPERSEDES edge whose ends are made where missing, as real articles."""
    ends = rows.select(F.explode(F.array("new_id", "old_id")).alias("article_id")).distinct().join(graph["article"], "article_id", "left_anti")
    edges = rows.select(F.col("new_id").alias("source_id"), F.col("old_id").alias("target_id"), F.lit("SUPERSEDES").alias("type"), F.lit(0).alias("seq"))
    return graph | {"article": graph["article"].unionByName(ends, allowMissingColumns=True), "relation": merge(graph["relation"], edges, ["source_id", "target_id", "type"])}


# reads
def real_articles(graph: Graph) -> DataFrame:
    return graph["article"].filter(~F.coalesce("is_external", F.lit(False)))


def documents_with_regime(graph: Graph) -> DataFrame:
    return graph["document"].filter(F.col("che_do").isNotNull())


def listed_documents(graph: Graph) -> DataFrame:
    """(doc_id, so_hieu, trang_thai) of documents with both a regime and a number, by doc_id."""
    return documents_with_regime(graph).filter(F.col("so_hieu").isNotNull()).select("doc_id", "so_hieu", "trang_thai").orderBy("doc_id")


def snapshot(graph: Graph, vectors: DataFrame) -> DataFrame:
    """One row of counts: references, placeholders, documents with a number, real articles, articles with a vector."""
    articles = graph["article"].join(vectors.select("article_id").distinct().withColumn("has_vector", F.lit(True)), "article_id", "left").agg(
        F.count_if(F.coalesce("is_external", F.lit(False))).alias("placeholders"), F.count_if(~F.coalesce("is_external", F.lit(False))).alias("real_articles"), F.count_if(F.col("has_vector")).alias("with_vector")
    )
    refs = graph["references"].agg(F.count("*").alias("references"))
    docs = graph["document"].agg(F.count("so_hieu").alias("documents_with_number"))
    joined = refs.withColumn("one", F.lit(1)).join(articles.withColumn("one", F.lit(1)), "one").join(docs.withColumn("one", F.lit(1)), "one")
    return joined.select("references", "placeholders", "documents_with_number", "real_articles", "with_vector")


def expand(frontier: DataFrame, graph: Graph) -> DataFrame:
    """One hop over citations and definitions: frontier (from_id) -> from_id, rel_type, to_article_id, to_term_id, is_external."""
    cites = frontier.join(graph["references"].withColumnRenamed("source_id", "from_id"), "from_id").join(graph["article"].select(F.col("article_id").alias("target_id"), F.coalesce("is_external", F.lit(False)).alias("is_external")), "target_id", "left")
    defines = frontier.join(graph["defines"].withColumnRenamed("article_id", "from_id"), "from_id")
    return cites.select("from_id", F.lit("REFERENCES").alias("rel_type"), F.col("target_id").alias("to_article_id"), F.lit(None).cast("string").alias("to_term_id"), F.coalesce("is_external", F.lit(False)).alias("is_external")).union(
        defines.select("from_id", F.lit("DEFINES"), F.lit(None).cast("string"), "term_id", F.lit(False))
    )


def articles_by_id(graph: Graph, ids: DataFrame) -> DataFrame:
    """(article_id, is_external, noi_dung_preview) of the ids that are there."""
    return graph["article"].join(ids, "article_id", "left_semi").select("article_id", "is_external", "noi_dung_preview")


# maintenance
def without_references(graph: Graph) -> Graph:
    return graph | {"references": graph["references"].limit(0)}


def orphans(graph: Graph) -> DataFrame:
    """Placeholders that no edge touches."""
    ends = [graph["references"].select("source_id"), graph["references"].select("target_id"), graph["relation"].select("source_id"), graph["relation"].select("target_id"), graph["defines"].select("article_id"), graph["uses_term"].select("article_id"), graph["belongs_to"].select("child_id"), graph["belongs_to"].select("parent_id")]
    touched = ends[0].toDF("article_id")
    for e in ends[1:]:
        touched = touched.union(e.toDF("article_id"))
    return graph["article"].filter(F.coalesce("is_external", F.lit(False))).join(touched, "article_id", "left_anti").select("article_id")


def without_orphans(graph: Graph) -> Graph:
    return graph | {"article": graph["article"].join(orphans(graph), "article_id", "left_anti")}


def stale_documents(graph: Graph, stems: DataFrame) -> DataFrame:
    """Documents of the graph that no file stem names, by id. stems: (stem); stems of other forms are passed over."""
    named = stems.select(text.file_parts(F.col("stem"), strict=False).alias("p")).filter("p IS NOT NULL").select(text.slug(F.col("p.prefix")).alias("doc_id")).distinct()
    return graph["document"].select("doc_id").join(named, "doc_id", "left_anti").orderBy("doc_id")


def subtree(graph: Graph, docs: DataFrame, depth: int = 2) -> DataFrame:
    """(id, kind) of docs (doc_id) and what belongs to them within depth steps. Two steps reach a
    document's chapters, articles and the clauses of its own articles, not those below chapters."""
    level = docs.select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"))
    out = level
    for _ in range(depth):
        level = graph["belongs_to"].join(level.withColumnsRenamed({"id": "parent_id", "kind": "parent_kind"}), ["parent_id", "parent_kind"], "left_semi").select(F.col("child_id").alias("id"), F.col("child_kind").alias("kind"))
        out = out.union(level)
    return out.distinct()


def without_documents(graph: Graph, docs: DataFrame, depth: int = 2) -> Graph:
    """The graph without docs, their subtree and every edge of it."""
    gone = subtree(graph, docs, depth)
    out = dict(graph)
    for kind, table in (("document", "document"), ("chapter", "chapter"), ("article", "article"), ("clause", "clause")):
        key = TABLES[table][1][0]
        out[table] = graph[table].join(gone.filter(F.col("kind") == kind).select(F.col("id").alias(key)), key, "left_anti")
    drop = lambda df, cols: [df := df.join(gone.select(F.col("id").alias(c)), c, "left_anti") for c in cols][-1]
    for table, cols in (("belongs_to", ("child_id", "parent_id")), ("references", ("source_id", "target_id")), ("relation", ("source_id", "target_id")), ("defines", ("article_id",)), ("uses_term", ("article_id",))):
        out[table] = drop(graph[table], cols).select(*graph[table].columns)
    return out


def check_plausible(graph: Graph, stems: DataFrame, most: float = 0.05) -> DataFrame:
    """The stale documents, unless no file names a document or too large a share would be stale."""
    stale = stale_documents(graph, stems)
    total, n = graph["document"].count(), stale.count()
    real = stems.select(text.file_parts(F.col("stem"), strict=False).alias("p")).filter("p IS NOT NULL").limit(1).count()
    if not real:
        raise ValueError("no file names a document; nothing is deleted")
    if total and n / total > most:
        raise ValueError(f"{n} of {total} documents would be stale, more than {most:.0%}; nothing is deleted")
    return stale


def stale_vectors(graph: Graph, vectors: DataFrame) -> DataFrame:
    """Vectors whose article, or whose clause's article, isn't a real one."""
    return vectors.withColumn("parent", text.article_of_vector(F.col("vec_id"))).join(real_articles(graph).select(F.col("article_id").alias("parent")), "parent", "left_anti").drop("parent")


def reconcile_vectors(graph: Graph, vectors: DataFrame) -> DataFrame:
    """The vectors without stale ones; refused where the graph has no real article at all."""
    if not real_articles(graph).limit(1).count():
        raise ValueError("the graph has no real article; no vector is deleted")
    return vectors.join(stale_vectors(graph, vectors).select("vec_id"), "vec_id", "left_anti")


def check_counts(graph: Graph, vectors: DataFrame) -> tuple[int, int]:
    """(real articles with text, vectors), which must be equal after a build; a blank article has no vector."""
    articles, n = real_articles(graph).filter(text.strip(F.coalesce("noi_dung_preview", F.lit(""))) != "").count(), vectors.count()
    if articles != n:
        raise ValueError(f"{articles} real articles but {n} vectors")
    return articles, n


def without_collisions(chunks: DataFrame) -> DataFrame:
    """chunks (article_id, path, text): the first path of each article where all its texts are equal.
    Fails before anything is written where an article has different texts."""
    kinds = chunks.groupBy("article_id").agg(F.count_distinct("text").alias("kinds"), F.min("path").alias("path"), F.min_by("text", "path").alias("text"), F.count("*").alias("files"))
    checked = F.when(F.col("kinds") > 1, F.raise_error(F.concat(F.lit("different texts for "), F.col("article_id")))).otherwise(F.col("path"))
    return kinds.select("article_id", checked.alias("path"), "text", "files")
