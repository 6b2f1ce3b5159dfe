import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import fixed
from quillon.operators import evaluate, retrieve
from quillon.operators import graph as g


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def graph_of(spark, edges, defines=(), external=(), previews=()):
    ids = {x for e in edges for x in e} | {d[0] for d in defines}
    graph = g.empty(spark)
    article = spark.createDataFrame([(i, None, dict(previews).get(i), i in external or None) for i in sorted(ids)], graph["article"].schema)
    return graph | {
        "article": article,
        "references": spark.createDataFrame([(a, b, "") for a, b in edges], graph["references"].schema),
        "defines": spark.createDataFrame(list(defines), graph["defines"].schema),
    }


def entries_of(spark, *ids):
    return spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id long, article_id string, pos int")


def test_nearest_is_exact_and_limited_before_the_shuffle(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 3.0]), ("d", [-1.0, 0.0])], "vec_id string, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.1])], "query_id long, embedding array<float>")
    hits = retrieve.nearest(q, v, 3)
    assert [r.vec_id for r in hits.orderBy("pos").collect()] == ["a", "c", "b"]
    assert "WindowGroupLimit" in hits._jdf.queryExecution().executedPlan().toString()


def test_more_queries_than_a_batch_are_all_answered(spark):
    v = spark.range(40).selectExpr("concat('v', id) AS vec_id", "array(float(cos(id)), float(sin(id))) AS embedding")
    q = spark.range(5000).selectExpr("id AS query_id", "array(float(cos(id / 7)), float(sin(id / 7))) AS embedding")
    hits = retrieve.nearest(q, v, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "WindowGroupLimit" in plan
    halves = [retrieve.nearest(q.filter(f"query_id % 2 = {i}"), v, 3).collect() for i in range(2)]
    got = sorted(map(tuple, hits.collect()))
    assert len(got) == 15000 and got == sorted(tuple(r) for half in halves for r in half)


def test_entry_points_collapse_then_filter_then_cut(spark):
    hits = spark.createDataFrame([(1, "x#khoan-1", 0.1), (1, "x", 0.3), (1, "y", 0.35), (1, "z", 0.36), (1, "w", 0.2)], "query_id long, vec_id string, distance double")
    got = retrieve.entry_points(hits, 0.65, 2).orderBy("pos")
    assert rows(got, "article_id", "pos") == [("x", 1), ("w", 2)]
    assert {r.article_id for r in retrieve.entry_points(hits, 0.65, 9).collect()} == {"x", "w", "y"}
    assert retrieve.entry_points(hits.limit(0), 0.65, 2).collect() == []


def test_cycle_keeps_every_edge_and_visits_once(spark):
    w = retrieve.traverse(entries_of(spark, "a"), graph_of(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("a", "a")], [("b", "t")], {"c"}), 2)
    assert sorted(rows(w["nodes"], "article_id", "hop", "is_external")) == [("a", 0, False), ("b", 1, False), ("c", 2, True)]
    assert sorted(rows(w["edges"].filter("to_article_id IS NOT NULL"), "hop", "from_id", "to_article_id")) == [(1, "a", "a"), (1, "a", "b"), (2, "b", "a"), (2, "b", "c")]
    assert rows(w["terms"], "term_id") == [("t",)]


def test_external_entry_is_not_reported_and_zero_hops(spark):
    graph = graph_of(spark, [("a", "b")], external={"a"})
    assert sorted(rows(retrieve.traverse(entries_of(spark, "a"), graph, 1)["nodes"], "article_id", "is_external")) == [("a", False), ("b", False)]
    w = retrieve.traverse(entries_of(spark, "a"), graph, 0)
    assert w["nodes"].count() == 1 and w["edges"].count() == 0


def test_rank_puts_entries_first(spark):
    entries = entries_of(spark, "e2", "e1")
    w = retrieve.traverse(entries, graph_of(spark, [("e1", "x"), ("e2", "e1"), ("e2", "y"), ("y", "z")], [("e1", "t")]), 2)
    assert [r.article_id for r in retrieve.rank(entries, w["edges"]).orderBy("pos").collect()] == ["e2", "e1", "x", "y", "z"]
    assert [r.article_id for r in retrieve.rank(entries, w["edges"], 3).orderBy("pos").collect()] == ["e2", "e1", "x"]


def scorer():
    return lambda q, t: [float(x.count("!")) for x in t]


def test_rerank(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 4), (1, "e", 5)], "query_id long, article_id string, pos int")
    texts = spark.createDataFrame([("b", "!"), ("c", ""), ("d", "!!"), ("e", "!")], "article_id string, full_text string")
    queries = spark.createDataFrame([(1, "q")], "query_id long, question string")
    assert [r.article_id for r in retrieve.rerank(ranked, queries, texts, lambda: scorer(), 4).orderBy("pos").collect()] == ["d", "b", "e", "a"]


def test_contexts_and_prompt(spark):
    graph = graph_of(spark, [("a", "b"), ("c", "d")], external={"b"}, previews={"c": "xem"})
    ranked = spark.createDataFrame([(1, x, i) for i, x in enumerate("abcz")], "query_id long, article_id string, pos int")
    texts = spark.createDataFrame([("a", "")], "article_id string, full_text string")
    c = retrieve.contexts(ranked, texts, graph)
    assert sorted(rows(c, "article_id", "kind", "content")) == [("a", "full", ""), ("b", "external", None), ("c", "preview", "xem"), ("z", "missing", None)]
    queries = spark.createDataFrame([(1, "gì?"), (2, "khác")], "query_id long, question string")
    p = {r.query_id: r.prompt for r in retrieve.prompts(queries, c, rules="R\n").collect()}
    assert p[1] == f"R\nCÂU HỎI: gì?\n\nNGỮ CẢNH:\n[Điều: a]\n\n\n[Điều: b] {fixed.EXTERNAL_MARK}\n\n[Điều: c] {fixed.PREVIEW_MARK}\nxem\n\n[Điều: z]\nNone\n\nTRẢ LỜI:"
    assert fixed.NO_CONTEXT in p[2]


def test_guard(spark):
    answers = spark.createDataFrame([(1, "Theo 1/2020/NĐ-CP"), (2, "Theo 2/2020/NĐ-CP và 1-2020-nd-cp_dieu-3"), (3, "không dẫn")], "query_id long, answer string")
    context = spark.createDataFrame([(q, "1-2020-nd-cp_dieu-1") for q in (1, 2)], "query_id long, article_id string")
    got = {r.query_id: r for r in retrieve.guard(answers, context).collect()}
    assert got[1].hallucinated == [] and got[1].answer == "Theo 1/2020/NĐ-CP" and got[3].hallucinated == []
    assert got[2].hallucinated == ["2-2020-nd-cp"] and got[2].answer.endswith(f"2-2020-nd-cp{fixed.WARNING_AFTER}")


def speaker():
    return lambda prompt: "Theo 9/2019/QH14" if "nội dung a" in prompt else "?"


def test_chat_end_to_end(spark):
    v = spark.createDataFrame([("a_dieu-1", [1.0, 0.0]), ("b_dieu-1", [0.0, 1.0])], "vec_id string, embedding array<float>")
    graph = graph_of(spark, [("a_dieu-1", "x_dieu-2")], external={"x_dieu-2"})
    texts = spark.createDataFrame([("a_dieu-1", "nội dung a")], "article_id string, full_text string")
    queries = spark.createDataFrame([(1, "hỏi", [1.0, 0.01]), (2, "hỏi", [-1.0, -1.0])], "query_id long, question string, embedding array<float>")
    got = {r.query_id: r for r in retrieve.chat(queries, v, graph, texts, lambda: speaker()).collect()}
    assert got[1].hallucinated == ["9-2019-qh14"] and got[1].citation_path == ["a_dieu-1*", "x_dieu-2 [ngoài corpus]"] and len(got[1].edges_used) == 1
    assert got[2].answer == fixed.NOT_FOUND_ANSWER and got[2].hallucinated is None


def test_documents_out_of_force_can_be_left_out(spark):
    v = spark.createDataFrame([("a_dieu-1", [1.0, 0.0]), ("b_dieu-1", [1.0, 0.1])], "vec_id string, embedding array<float>")
    graph = graph_of(spark, [("a_dieu-1", "b_dieu-1")])
    graph |= {"document": spark.createDataFrame([("a", "2019-01-01", "2020-01-01"), ("b", "2020-01-01", None)], "doc_id string, ngay_hieu_luc string, ngay_het_hieu_luc string")}
    queries = spark.createDataFrame([(1, "q", [1.0, 0.0])], "query_id long, question string, embedding array<float>")
    texts = spark.createDataFrame([], "article_id string, full_text string")
    plain = retrieve.retrieve(queries, v, graph, texts)["entries"]
    dated = retrieve.retrieve(queries, v, graph, texts, at="2021-06-01")["entries"]
    assert sorted(r.article_id for r in plain.collect()) == ["a_dieu-1", "b_dieu-1"] and [r.article_id for r in dated.collect()] == ["b_dieu-1"]


# evaluation
def test_rank_metrics(spark):
    q = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"]), (3, ["c"])], "query_id long, gold array<string>")
    r = spark.createDataFrame([(1, "x", 1), (1, "b", 2), (1, "a", 3), (3, "c", 7)], "query_id long, article_id string, pos int")
    m = evaluate.rank_metrics(q, r)
    assert sorted(rows(m, "query_id", "rank", "hit5", "hit10", "rr")) == [(1, 2, True, True, 0.5), (2, None, False, False, 0.0), (3, 7, False, True, 1 / 7)]
    s = evaluate.summary(m).first()
    assert (s.n, s.recall10) == (3, 2 / 3) and evaluate.summary(m.limit(0)).first().mrr is None
    assert rows(evaluate.misses(m), "query_id") == [(2,)]


def test_question_set(spark):
    one = spark.createDataFrame([(0, "q1", ["a"]), (1, "q2", [])], "at int, question string, gold array<string>")
    two = spark.createDataFrame([(2, "q3", ["x"]), (0, "q1", ["b", "c"]), (1, "q3", ["d", "e"])], "at int, question string, gold array<string>").repartition(3)
    got = evaluate.question_set(one, two)
    assert sorted(rows(got, "question", "gold")) == [("q1", ["a"]), ("q3", ["d", "e"])] and rows(evaluate.multi_hop(got), "question") == [("q3",)]


@pytest.mark.parametrize(
    ("kind", "said", "gold", "ok"),
    [
        ("tf", "ĐÚNG.", "Đúng", True), ("tf", "Không đúng", "sai", True), ("tf", "Sai, tuy có phần đúng", "sai", True), ("tf", "có lẽ", "đúng", False),
        ("mc", "C) vì", "c", True), ("mc", "Đáp án chính xác là B", "B", True), ("mc", "A", "A", True), ("mc", "B là đúng", "B", True), ("mc", "Có A và B", "A", False), ("mc", "chọn: D.", "D", True),
        ("no", "CHƯA TÌM THẤY quy định", None, True), ("no", "Có, Điều 5", None, False),
    ],
)
def test_scorers(spark, kind, said, gold, ok):
    df = spark.createDataFrame([(said, gold)], "a string, g string")
    score = {"tf": evaluate.score_true_false, "mc": evaluate.score_choice, "no": lambda a, _: evaluate.score_refusal(a)}[kind]
    assert df.select(score(df.a, df.g).alias("v")).first().v is ok


def test_free_text(spark):
    df = spark.createDataFrame([("được 06 tháng lương", ["6 THÁNG", "lương"], ["x"], ["y", "x"])], "a string, k array<string>, r array<string>, g array<string>")
    assert tuple(df.select(evaluate.score_free(df.a, df.k, df.r, df.g).alias("v")).first().v) == (True, True)


def test_answers_in_decomposed_letters_are_scored_alike(spark):
    import unicodedata

    for said in ("Không đúng", "Câu này ĐÚNG.", "Ngoài phạm vi của dữ liệu", "Đáp án chính xác là B", "ưỡng ậ ẵ Ệ ỷ ữ"):
        split = unicodedata.normalize("NFD", said)
        df = spark.createDataFrame([(said, split)], "a string, b string")
        got = df.select(*[evaluate.text.answer_form(df[c]).alias(c) for c in "ab"], evaluate.choice(df.b).alias("c"), evaluate.score_refusal(df.b).alias("r")).first()
        assert split != said and got.a == got.b == said.lower() and (got.c == "B") == ("B" in said) and got.r == ("phạm" in said)


def ring(spark):
    v = spark.createDataFrame([("a_dieu-1", [1.0, 0.0]), ("b_dieu-1", [0.9, 0.1]), ("c_dieu-1", [0.0, 1.0])], "vec_id string, embedding array<float>")
    texts = spark.createDataFrame([("a_dieu-1", "nội dung a"), ("c_dieu-1", "nội dung c!!")], "article_id string, full_text string")
    questions = spark.createDataFrame(
        [(1, "hỏi", [1.0, 0.0], "free_text", None, ["Theo"], ["c_dieu-1", "z"]), (2, "hỏi", [0.0, 1.0], "out_of_scope", None, [], [])],
        "query_id long, question string, embedding array<float>, type string, answer string, key_facts array<string>, gold array<string>",
    )
    return questions, v, graph_of(spark, [("a_dieu-1", "c_dieu-1")]), texts


def test_runs_over_an_eval_set(spark):
    from quillon.config import Settings

    questions, v, graph, texts = ring(spark)
    m = evaluate.run_retrieval(questions.filter("query_id = 1"), v, graph, texts).first()
    assert (m["rank"], m.hit5) == (3, True)  # found by the graph alone
    out = evaluate.run_ablation(questions.filter("query_id = 1"), v, graph, texts, lambda: scorer(), Settings(similarity_threshold=0.65))
    assert sorted(rows(out, "config", "subset", "n", "recall5", "mrr")) == sorted((c, s, 1, r, m) for s in ("all", "multi_hop") for c, r, m in (("dense", 0.0, 0.0), ("dense_graph", 1.0, 1 / 3), ("dense_graph_rerank", 1.0, 1.0)))
    scored = {r.query_id: r for r in evaluate.run_qa(questions, v, graph, texts, lambda: speaker(), threshold=0.65).collect()}
    assert scored[1].ranked == ["a_dieu-1", "b_dieu-1", "c_dieu-1"] and scored[1].correct and scored[1].retrieved
    assert not scored[2].correct and scored[2].retrieved is None


def test_settings_are_the_defaults_of_retrieval(spark):
    from quillon.config import Settings

    questions, v, graph, texts = ring(spark)
    ids = lambda **k: [r.article_id for r in retrieve.retrieve(questions.filter("query_id = 1"), v, graph, texts, **k)["ranked"].orderBy("pos").collect()]
    assert ids() == ["a_dieu-1", "b_dieu-1", "c_dieu-1"] and ids(settings=Settings(max_context_articles=2)) == ids(limit=2) == ["a_dieu-1", "b_dieu-1"]
    assert ids(settings=Settings(max_hop=0, similarity_threshold=0.999)) == ["a_dieu-1"]


@pytest.mark.parametrize("batch", [4096, 20])
def test_nearest_gives_the_doubles_and_ties_of_a_plain_comparison(spark, monkeypatch, batch):
    monkeypatch.setattr(retrieve, "QUERY_BATCH", batch)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 8)
    v = spark.range(2500).selectExpr("concat('v', id) AS vec_id", "array(float(id % 3 - 1), float(id % 5 + 0.1), float(id % 7 / 3)) AS embedding").repartition(3)
    q = v.filter("cast(substr(vec_id, 2) AS int) % 50 = 0").selectExpr("cast(substr(vec_id, 2) AS long) AS query_id", "embedding")
    dot = retrieve.dot
    plain = v.crossJoin(q.withColumnRenamed("embedding", "q")).select("query_id", "vec_id", (1 - dot(F.col("embedding"), F.col("q")) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(F.col("q"), F.col("q"))))).alias("distance"))
    want = plain.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).filter("pos <= 40")
    hits = retrieve.nearest(q, v, 40)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") > plan.index("WindowGroupLimit")  # scores never meet a sort, only k rows a query and task do


def test_vectors_without_a_direction_come_last(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("l", [1.0]), ("b", [0.0, 1.0])], "vec_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    got = retrieve.nearest(q, v, 5).orderBy("pos").collect()
    assert [r.vec_id for r in got] == ["a", "b", "z", "l", "n"] and got[2].distance != got[2].distance and got[3].distance is None
    assert retrieve.nearest(q.limit(0), v, 5).count() == 0 == retrieve.nearest(q, v.limit(0), 5).count()


def test_texts_stay_in_arrow_until_they_are_embedded(spark):
    from pyspark.util import PythonEvalType

    df = spark.createDataFrame([(i, None if i == 3 else "é" * (7 - i)) for i in range(7)], "i int, t string").coalesce(1)
    out = retrieve.embed(df, "t", lambda: lambda texts: [[float(len(x)), float(len(texts)), float(x != min(texts, key=len))] for x in texts], batch_size=3)
    # by length: null, 1 and 2 letters, then 3, 5 and 6, then 7
    assert [tuple(r.embedding) for r in out.orderBy("i").collect()] == [(7.0, 1.0, 0.0), (6.0, 3.0, 1.0), (5.0, 3.0, 1.0), (0.0, 3.0, 0.0), (3.0, 3.0, 0.0), (2.0, 3.0, 1.0), (1.0, 3.0, 1.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rstrip().split("ArrowEvalPython")[1].split("\n")[0].endswith(f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}")
