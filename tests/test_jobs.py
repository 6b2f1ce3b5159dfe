import json

import pytest

from quillon import __main__ as cli
from quillon import config
from quillon.operators import graph as g
from quillon.plans import jobs, migration
from quillon.sources import files
from quillon.streaming import ingest

LAW = "Luật số 1/2020/QH14 có hiệu lực từ ngày 1 tháng 7 năm 2021\nChương I\nCHUNG\nĐiều 1. Phạm vi\n1. Theo Điều 2 và Điều 3 Nghị định 5/2019/NĐ-CP\nĐiều 2. Giải thích từ ngữ\n1. Tiền lương là khoản trả.\nĐiều 3. Sửa\nSửa đổi Điều 9 Luật B số 2/2018/QH13. Trả Tiền lương."


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "luat-1.txt").write_text(LAW, encoding="utf-8")
    (d / "luat-1.tt.txt").write_text("Ngày có hiệu lực\n--\nNgày hết hiệu lực\n02/01/2030", encoding="utf-8")
    (d / "khac.txt").write_text("Điều 1. Một\nx", encoding="utf-8")
    return str(d)


def encoder():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def replier():
    return lambda prompt: json.dumps({"relationship_type": "SUPERSEDES", "confidence": 0.8, "ly_do": "vì"})


def test_build_terms_and_relations(spark, folder, tmp_path):
    docs = files.document_files(spark, folder)
    assert rows(docs, "stem", "sidecar")[0] == ("khac", "")
    listed, missing = files.catalogued(files.catalogue(spark, [{"url": "https://h/luat-1--u", "che_do": ["x"], "ngay_hieu_luc": "2021-01-01"}, {"url": "https://h/none--u"}]), docs)
    assert rows(missing, "stem") == [("none",)]
    graph, vectors = jobs.build_corpus(spark, listed, encoder, str(tmp_path / "graph"), str(tmp_path / "vectors"))
    assert rows(graph["document"], "doc_id", "loai_vb", "ngay_hieu_luc", "ngay_het_hieu_luc", "che_do") == [("1-2020-qh14", None, "2021-01-01", "2030-01-02", ["x"])]
    assert rows(graph["references"], "source_id", "target_id") == [("1-2020-qh14_dieu-1", "1-2020-qh14_dieu-2"), ("1-2020-qh14_dieu-1", "5-2019-nd-cp_dieu-3"), ("1-2020-qh14_dieu-3", "2-2018-qh13_dieu-9")]
    assert vectors.count() == 3 and g.snapshot(graph, vectors.selectExpr("vec_id AS article_id")).first().asDict() == {"references": 3, "placeholders": 2, "documents_with_number": 1, "real_articles": 3, "with_vector": 3}
    _, articles = jobs.ingest_documents(g.empty(spark), listed, "b")
    graph = jobs.link_terms(graph, articles)
    assert rows(graph["defines"], "*") == [("1-2020-qh14_dieu-2", "tien-luong")] and rows(graph["uses_term"], "*") == [("1-2020-qh14_dieu-3", "tien-luong")]
    graph = jobs.link_relations(graph, articles, lambda: replier())
    assert rows(graph["relation"], "*") == [("1-2020-qh14_dieu-3", "2-2018-qh13_dieu-9", "SUPERSEDES", 0.8, "vì")]
    # migration
    same, _, report = jobs.migrate(graph, vectors, spark.createDataFrame([("1_2020_qh14_1",)], "stem string"), articles)
    assert same is graph and {r.at: r.references for r in report.collect()} == {"before": 3, "after": 3}


def test_vectors(spark):
    v = spark.createDataFrame([("a", "d", 1, "old", [1.0])], files.VECTORS)
    new = spark.createDataFrame([("a", "d", 1, "new", [2.0], 1), ("a", "d", 1, "mid", [3.0], 0), ("b", "d", 2, "", [0.0], 2)], files.VECTORS + ", seq long")
    out = files.upsert_vectors(v, new)
    assert rows(out, "vec_id", "document") == [("a", "new"), ("b", "")]
    ids = spark.createDataFrame([("b",), ("z",)], "article_id string")
    assert rows(files.vector_texts(out, ids), "*") == [("b", "")] and rows(files.without_vectors(out, ids.toDF("vec_id")), "vec_id") == [("a",)]


def test_freshness(spark):
    docs = spark.createDataFrame([("a", "12/2022/NĐ-CP"), ("b", "9/2020/QH14")], "doc_id string, so_hieu string")
    live = spark.createDataFrame([("Nghị định 12/2022/NĐ-CP về", "Hết hiệu lực một phần"), ("Nghị định 112/2022/NĐ-CP", "Hết hiệu lực")], "title string, trang_thai string")
    assert rows(jobs.freshness(docs, live), "doc_id", "status", "flagged") == [("a", "partial", True), ("b", "unknown", False)]


def test_fetch_retries_and_tolerates(spark):
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("busy")
        return "body", "side"

    assert files.fetch_with_retry(flaky, "u", pause=0) == ("body", "side")

    def never(url):
        raise files.NotFound(url)

    calls.clear()
    with pytest.raises(files.NotFound):
        files.fetch_with_retry(never, "u", pause=0)

    def by_name(url):
        if "bad" in url:
            raise ValueError("no")
        return f"text of {url}", ""

    got = files.fetch_pages(files.catalogue(spark, [{"url": "h/a--1"}, {"url": "h/bad--2"}]), by_name, pause=0)
    assert rows(got, "stem", "body", "error") == [("a", "text of h/a--1", None), ("bad", None, "ValueError: no")]
    hits = files.search(spark.createDataFrame([("1/2020/QH14",), ("tên",)], "keyword string"), lambda k, n, where: [{"title": f"{k} {where}", "url": "u", "text": "Ngày hiệu lực: 01/02/2021"}] * 9, most=1)
    assert rows(hits, "title", "ngay_hieu_luc") == [("1/2020/QH14 number", "01/02/2021"), ("tên title", "01/02/2021")]


def test_questions(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text(json.dumps({"_note": "x", "questions": [{"question": "a", "gold_article_ids": ["1"]}, {"question": "b", "gold_article_ids": []}]}))
    assert rows(files.questions(spark, str(p)), "at", "question", "gold_article_ids") == [(0, "a", ["1"]), (1, "b", [])]


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_resumable_ingest(spark, tmp_path):
    d, state = tmp_path / "md", str(tmp_path / "state")
    d.mkdir()
    for i in (1, 2, 3):
        write(d, f"5_2020_tt-bxd_{i}.md", f"# Điều {i}. Tên {i}\n\n1. Theo Điều 1")
    write(d, "README.md", "nothing")
    assert [r.stem for r in files.article_files(spark, str(d), 2).collect()] == ["5_2020_tt-bxd_1", "5_2020_tt-bxd_2"]
    ran = []

    def failing(graph, chunks, batch):
        ran.append(batch)
        if len(ran) == 2:
            raise RuntimeError("killed")
        return jobs.ingest_chunks(graph, chunks, batch)

    with pytest.raises(Exception, match="killed"):
        ingest.run_ingest(spark, str(d), state, 2, failing)
    graph = ingest.run_ingest(spark, str(d), state, 2)
    assert rows(graph["article"], "article_id") == [("5-2020-tt-bxd_dieu-1",), ("5-2020-tt-bxd_dieu-2",), ("5-2020-tt-bxd_dieu-3",)]
    assert rows(graph["document"], "title") == [("Thông tư 5/2020/TT-BXD",)] and graph["references"].count() == 3 and graph["clause"].count() == 3
    assert ingest.read_manifest(spark, state)["batch_size"] == 2
    with pytest.raises(ValueError, match="same size"):
        ingest.run_ingest(spark, str(d), state, 3)
    write(d, "5_2020_tt-bxd_4.md", "# Điều 4. Mới")
    assert ingest.run_ingest(spark, str(d), state, 2)["article"].count() == 4
    assert ingest.read_manifest(spark, str(tmp_path / "none")) is None


def test_batches_and_settings(spark, monkeypatch):
    df = spark.range(7)
    assert [r.batch for r in jobs.batches(df, "id", 3).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2]
    monkeypatch.setenv("QUILLON_MAX_HOP", "3")
    monkeypatch.setenv("QUILLON_RERANK_ENABLED", "False")
    s = config.load(spark)
    assert (s.max_hop, s.rerank_enabled, s.similarity_threshold) == (3, False, 0.65)


def test_texts_of_one_title_are_merged_in_file_order(spark, tmp_path):
    d = tmp_path / "same"
    d.mkdir()
    for stem, said in (("b", "hai"), ("a", "một")):
        write(d, f"{stem}.txt", f"# Chung\nChương I\nTên {stem}\nĐiều 1. {said}\n1. khoản {stem}\nĐiều {2 if stem == 'a' else 3}. riêng\nx")
    graph, articles = jobs.ingest_documents(g.empty(spark), files.document_files(spark, str(d)), "b")
    assert rows(graph["article"], "article_id", "noi_dung_preview")[0] == ("chung_dieu-1", "hai\n1. khoản b") and graph["article"].count() == 3
    assert rows(graph["chapter"], "tieu_de") == [("Tên b",)] and rows(graph["clause"], "noi_dung") == [("khoản b",)]
    assert rows(jobs.embed_articles(articles, encoder), "vec_id", "document")[0] == ("chung_dieu-1", "hai\n1. khoản b")


def test_a_blank_article_needs_no_vector(spark, tmp_path):
    d = tmp_path / "blank"
    d.mkdir()
    write(d, "a.txt", "Luật số 1/2020/QH14\nĐiều 1.\n\nĐiều 2. Có\nx")
    graph, vectors = jobs.build_corpus(spark, files.document_files(spark, str(d)), encoder, str(tmp_path / "g"), str(tmp_path / "v"))
    assert graph["article"].count() == 2 and vectors.count() == 1


def test_page_files_are_read_back(spark, tmp_path):
    entries = files.catalogue(spark, [{"url": "h/a--1"}, {"url": "h/bad--2"}, {"url": "h/c"}])
    fetched = files.fetch_pages(entries, lambda url: (f"thân {url}", "Số hiệu") if "bad" not in url else 1 / 0, tries=1, pause=0)
    out = files.write_page_files(fetched, str(tmp_path / "pages"))
    assert [(r.stem, r.error is None) for r in out.orderBy("stem").collect()] == [("a", True), ("bad", False), ("c", True)]
    assert rows(files.document_files(spark, str(tmp_path / "pages")), "stem", "body", "sidecar") == [("a", "thân h/a--1", "Số hiệu"), ("c", "thân h/c", "Số hiệu")]


def test_pages_as_a_data_source(spark):
    spark.dataSource.register(files.fetch_source("own_pages", lambda url: (url.upper(), "s") if "bad" not in url else 1 / 0, tries=1, pause=0))
    got = spark.read.format("own_pages").option("urls", "h/x--1\n\nh/bad\n").load()
    assert sorted((r.stem, r.body, r.error is None) for r in got.collect()) == [("bad", None, False), ("x", "H/X--1", True)]


def corpus(folder, n):
    folder.mkdir()
    for i in range(1, n + 1):
        write(folder, f"5_2020_tt-bxd_{i}.md", f"# Điều {i}. Tên {i}\n\n1. Theo Điều {i % n + 1} và Điều 9 Nghị định 1/2019/NĐ-CP")


def test_ingest_keeps_no_deltas_and_few_snapshots(spark, tmp_path):
    d, state = tmp_path / "md", str(tmp_path / "state")
    corpus(d, 3)
    graph = ingest.run_ingest(spark, str(d), state, 2)
    assert ingest.run_ingest(spark, str(d), str(tmp_path / "trial"), 2, limit=1)["clause"].count() == 1
    files.save_graph(graph, f"{state}/graph")
    files.save_graph(graph, f"{state}/graph")
    assert not (tmp_path / "state" / "delta").exists() and len(list((tmp_path / "state" / "graph").glob("snapshot-*"))) == 2
    graph = files.load_graph(spark, f"{state}/graph")  # older snapshots are gone
    once = jobs.ingest_chunks(g.empty(spark), files.article_files(spark, str(d)).select("stem", "body"), "batch-0")
    for name in ("article", "references", "clause", "belongs_to"):
        assert rows(graph[name], "*") == rows(once[name], "*")


def test_migration_dry_run_apply_and_resume(spark, tmp_path):
    d, state, vectors = tmp_path / "md", str(tmp_path / "state"), str(tmp_path / "vectors")
    corpus(d, 3)
    graph = ingest.run_ingest(spark, str(d), state, 200)
    spark.createDataFrame([("5-2020-tt-bxd_dieu-1",), ("5-2020-tt-bxd_dieu-2#khoan-1",), ("gone_dieu-1",)], "vec_id string").write.parquet(vectors)
    dry = migration.run_migration(spark, str(d), state, vectors)
    assert dry["before"] == dry["after"] and dry["before"]["references"] == 6 and rows(files.load_graph(spark, f"{state}/graph")["references"], "*") == rows(graph["references"], "*")

    def killed(*_):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        migration.run_migration(spark, str(d), state, vectors, apply=True, reingest=killed)
    assert files.load_graph(spark, f"{state}/graph")["references"].count() == 0  # seen to be unfinished
    with pytest.raises(ValueError, match="no checkpoint"):
        migration.run_migration(spark, str(d), state, vectors, resume=True)

    ingest.write_manifest(spark, state, 0, 200)
    out = migration.run_migration(spark, str(d), state, vectors, resume=True)
    assert out["before"]["references"] == 0 and out["after"]["references"] == 6 and out["after"]["real_articles"] == 3
    assert rows(spark.read.parquet(vectors), "vec_id") == [("5-2020-tt-bxd_dieu-1",), ("5-2020-tt-bxd_dieu-2#khoan-1",)]
    for p in d.glob("*.md"):
        p.unlink()
    write(d, "7_2021_tt-bxd_1.md", "# Điều 1. Khác\n\nx")
    with pytest.raises(ValueError, match="would be stale"):
        migration.run_migration(spark, str(d), state, vectors, apply=True)


def test_command_line(spark, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    docs.mkdir()
    write(docs, "luat-1.txt", LAW)
    monkeypatch.setenv("QUILLON_GRAPH_PATH", str(tmp_path / "graph"))
    monkeypatch.setenv("QUILLON_VECTOR_PATH", str(tmp_path / "vectors"))
    assert cli.main(["build", str(docs), "--encoder", "tests.test_jobs:encoder"], spark)["vectors"] == 3
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"questions": [{"question": "a" * 70, "gold_article_ids": ["1-2020-qh14_dieu-1"]}, {"question": "b", "gold_article_ids": []}]}))
    out = cli.main(["evaluate", str(q), "--encoder", "tests.test_jobs:encoder"], spark)
    assert out[0]["n"] == 1 and out[0]["recall10"] == 1.0
    called = []
    monkeypatch.setattr(cli.ingest, "run_ingest", lambda sp, source, state, size, limit=None: called.append((source, state, size, limit)) or {})
    monkeypatch.setattr(cli.migration, "run_migration", lambda sp, source, state, vectors, **k: called.append((source, state, k["apply"], k["resume"])) or {})
    cli.main(["ingest", "d", "--state", "s", "--limit", "3"], spark)
    cli.main(["migrate", "d", "--state", "s", "--resume"], spark)
    assert called == [("d", "s", 200, 3), ("d", "s", False, True)]
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


def test_a_search_is_made_once_for_all_that_read_it(spark, monkeypatch, tmp_path):
    spark.range(300).selectExpr("id AS vec_id", "array(float(cos(id)), float(sin(id))) AS embedding", "cast(id % 10 AS int) AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    from quillon import queries

    for name in ("mean_reciprocal_rank", "ablation"):
        plan = queries.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "Window" not in plan
