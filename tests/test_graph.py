import pytest
from pyspark.sql import functions as F

from quillon.operators import graph as g


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture
def base(spark):
    docs = spark.createDataFrame([("d", "T", "b1", 0)], "doc_id string, title string, batch_id string, seq long")
    graph = g.upsert_documents(g.empty(spark), docs)
    articles = spark.createDataFrame([("d", None, "a1", 1, "p1", 0), ("d", None, "a2", 2, "p2", 1)], "doc_id string, chapter_id string, article_id string, so_dieu int, noi_dung_preview string, seq long")
    return g.upsert_articles(graph, articles)


def refs(spark, *r):
    return spark.createDataFrame([(*x, i) for i, x in enumerate(r)], "source_id string, target_id string, raw_text string, seq long")


def article(spark, *r):
    return spark.createDataFrame([("d", None, *x, i) for i, x in enumerate(r)], "doc_id string, chapter_id string, article_id string, so_dieu int, noi_dung_preview string, seq long")


def test_rerun_changes_nothing(spark, base):
    r = refs(spark, ("a1", "x", "first"), ("a1", "x", "second"), ("gone", "y", ""), ("a1", "a1", "self"))
    once = g.upsert_references(base, r)
    twice = g.upsert_references(once, r)
    for t in ("article", "references"):
        assert rows(once[t], "*") == rows(twice[t], "*")
    assert rows(once["references"], "*") == [("a1", "a1", "self"), ("a1", "x", "first")]
    assert rows(once["article"], "article_id", "is_external") == [("a1", False), ("a2", False), ("x", True)]


def test_placeholder_is_upgraded_in_either_order(spark, base):
    r = refs(spark, ("a1", "a3", "t"))
    one = g.upsert_articles(g.upsert_references(base, r), article(spark, ("a3", 3, "p3")))
    two = g.upsert_references(g.upsert_articles(base, article(spark, ("a3", 3, "p3"))), r)
    assert rows(one["article"], "*") == rows(two["article"], "*")
    assert ("a3", False) in rows(one["article"], "article_id", "is_external")


def test_last_write_wins_and_null_counts(spark, base):
    out = g.upsert_articles(base, article(spark, ("a1", 9, "old"), ("a1", 8, None)))
    assert ("a1", 8, None, False) in rows(out["article"], "*")


def test_identity_writes_all_or_nothing(spark, base):
    full = base["document"].sparkSession.createDataFrame([("d", "T2", "b2", "1/2", "Luật", "2020-01-01", None, "active", ["x"], 0)], "doc_id string, title string, batch_id string, so_hieu string, loai_vb string, ngay_hieu_luc string, ngay_het_hieu_luc string, trang_thai string, che_do array<string>, seq long")
    one = g.upsert_documents(base, full)
    again = g.upsert_documents(one, full.select("doc_id", F.lit("T3").alias("title"), "batch_id", F.lit(1).alias("seq")))
    assert rows(again["document"], "title", "so_hieu", "che_do") == [("T3", "1/2", ["x"])]
    cleared = g.upsert_documents(again, full.withColumn("so_hieu", F.lit(None).cast("string")))
    assert rows(cleared["document"], "title", "so_hieu") == [("T2", None)]
    with pytest.raises(ValueError, match="identity"):
        g.upsert_documents(base, full.drop("che_do"))


def test_children_of_unknown_parents_are_passed_over(spark, base):
    chapters = spark.createDataFrame([("none", "c9", 1, "x", 0), ("d", "c1", 1, "y", 1)], "doc_id string, chapter_id string, so_chuong int, tieu_de string, seq long")
    out = g.upsert_chapters(base, chapters)
    clauses = spark.createDataFrame([("a1", "k1", 1, "x", 0), ("a1", "k1", 1, "y", 1), ("none", "k2", 1, "z", 2)], "article_id string, clause_id string, so_khoan int, noi_dung string, seq long")
    out = g.upsert_clauses(out, clauses)
    assert rows(out["chapter"], "chapter_id") == [("c1",)] and rows(out["clause"], "*") == [("k1", 1, "y")]
    assert ("k1", "clause", "a1", "article") in rows(out["belongs_to"], "*")


def test_terms(spark, base):
    d = spark.createDataFrame([("a1", "t", "T", "one", 0), ("a2", "t", "T'", "two", 1), ("none", "u", "U", "three", 2)], "article_id string, term_id string, ten_thuat_ngu string, dinh_nghia string, seq long")
    out = g.upsert_definitions(base, d)
    assert rows(out["term"], "*") == [("t", "T", "one"), ("u", "U", "three")] and rows(out["defines"], "*") == [("a1", "t"), ("a2", "t")]
    used = spark.createDataFrame([("a1", "t"), ("a1", "none"), ("none", "t"), ("a1", "t")], "article_id string, term_id string")
    assert rows(g.upsert_term_usages(out, used)["uses_term"], "*") == [("a1", "t")]
    assert g.upsert_definitions(base, d.limit(0))["term"].count() == 0


def test_relations(spark, base):
    r = spark.createDataFrame([("a1", "x", "AMENDS", 0.5, "a", 0), ("a1", "x", "AMENDS", 0.7, "b", 1)], "source_id string, target_id string, type string, confidence double, ly_do string, seq long")
    out = g.upsert_relations(base, r)
    assert rows(out["relation"], "*") == [("a1", "x", "AMENDS", 0.7, "b")] and ("x", True) in rows(out["article"], "article_id", "is_external")
    with pytest.raises(Exception, match="not a relation"):
        g.upsert_relations(base, r.withColumn("type", F.lit("LIKES")))["relation"].collect()
    s = g.upsert_supersedes(base, spark.createDataFrame([("new", "old")], "new_id string, old_id string"))
    assert ("new", None) in rows(s["article"], "article_id", "is_external") and rows(g.real_articles(s), "article_id") == [("a1",), ("a2",), ("new",), ("old",)]


def test_maintenance(spark, base):
    graph = g.upsert_references(base, refs(spark, ("a1", "x", "")))
    assert g.orphans(graph).count() == 0
    cut = g.without_references(graph)
    assert rows(g.orphans(cut), "article_id") == [("x",)] and rows(g.without_orphans(cut)["article"], "article_id") == [("a1",), ("a2",)]
    assert rows(g.subtree(graph, spark.createDataFrame([("d",)], "doc_id string")), "id") == [("a1",), ("a2",), ("d",)]
    gone = g.without_documents(graph, spark.createDataFrame([("d",)], "doc_id string"))
    assert rows(gone["article"], "article_id") == [("x",)] and gone["references"].count() == gone["belongs_to"].count() == gone["document"].count() == 0
    vectors = spark.createDataFrame([("a1",), ("a1#khoan-1",), ("x",), ("zz",)], "vec_id string")
    assert rows(g.reconcile_vectors(graph, vectors), "vec_id") == [("a1#khoan-1",), ("a1",)]
    with pytest.raises(ValueError, match="no real article"):
        g.reconcile_vectors(g.empty(spark), vectors)
    with pytest.raises(ValueError, match="2 real articles but 4"):
        g.check_counts(graph, vectors)
    assert g.check_unique(graph).count() == 0 and g.check_unique(graph | {"article": graph["article"].union(graph["article"])}).count() == 3


def test_plausibility(spark, base):
    with pytest.raises(ValueError, match="no file names"):
        g.check_plausible(base, spark.createDataFrame([("readme",)], "stem string"))
    with pytest.raises(ValueError, match="would be stale"):
        g.check_plausible(base, spark.createDataFrame([("1_2020_x_1",)], "stem string"))
    assert g.check_plausible(base, spark.createDataFrame([("d_1",)], "stem string")).count() == 0


def test_collisions(spark):
    df = spark.createDataFrame([("a", "p2", "t"), ("a", "p1", "t"), ("b", "p3", "u")], "article_id string, path string, text string")
    assert rows(g.without_collisions(df), "article_id", "path") == [("a", "p1"), ("b", "p3")]
    with pytest.raises(Exception, match="different texts for a"):
        g.without_collisions(df.union(df.sparkSession.createDataFrame([("a", "p0", "other")], df.schema))).collect()


def test_queries_with_parameters(spark, base):
    got = g.run(base, "SELECT article_id FROM {article} WHERE article_id <> :skip ORDER BY 1", skip="a1' OR '1' = '1")
    assert rows(got, "article_id") == [("a1",), ("a2",)]
    assert g.run(base, "SELECT count(*) AS n FROM {references}").first().n == 0


def test_write_orders_of_any_size(spark):
    old = spark.createDataFrame([("k", "old")], "id string, v string")
    new = spark.createDataFrame([("k", "first", 1, 250_000), ("k", "last", 2, 0), ("k", "mid", 1, 900_000)], "id string, v string, a int, b int").select("id", "v", F.struct("a", "b").alias("seq"))
    assert rows(g.merge(old, new, ["id"], last=["v"]), "v") == [("last",)] and rows(g.merge(old, new, ["id"], first=["v"]), "v") == [("old",)]
    assert rows(g.merge(old.limit(0), new, ["id"], first=["v"]), "v") == [("first",)]


def test_deltas_combine_like_merges_in_their_order(spark, base):
    graphs = [g.upsert_references(base, refs(spark, ("a1", "x", "one"), ("a2", "a1", "two"))), g.empty(spark)]
    later = spark.createDataFrame([("d", None, "x", 9, "now real", 0)], "doc_id string, chapter_id string, article_id string, so_dieu int, noi_dung_preview string, seq long")
    docs = spark.createDataFrame([("d", "renamed", "b2", 0)], "doc_id string, title string, batch_id string, seq long")
    graphs.append(g.upsert_articles(g.upsert_documents(g.empty(spark), docs), later))
    graphs[2] = g.upsert_references(graphs[2], refs(spark, ("x", "a2", "three")))
    deltas = {}
    for i, graph in enumerate(graphs):
        for name, df in graph.items():
            df = df.withColumn("batch", F.lit(i).cast("long"))
            deltas[name] = deltas[name].unionByName(df) if name in deltas else df
    out = g.combine(deltas)
    want = g.upsert_references(g.upsert_articles(g.upsert_documents(graphs[0], docs), later), refs(spark, ("x", "a2", "three")))
    for name in g.TABLES:
        assert out[name].columns == want[name].columns and rows(out[name], "*") == rows(want[name], "*"), name
    assert ("x", False) in rows(out["article"], "article_id", "is_external")
