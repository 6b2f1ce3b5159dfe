"""Evaluation: rank metrics, answer scorers, and their aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULT, Settings
from quillon.functions import fixed, text
from quillon.operators import graph as g
from quillon.operators import retrieve
from quillon.scratch import materialize


def rank_metrics(questions: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """questions (query_id, gold array), ranked (query_id, article_id, pos): query_id, rank of the first gold, hit@k, rr."""
    gold = questions.select("query_id", F.explode("gold").alias("article_id")).distinct()
    first = ranked.join(gold, ["query_id", "article_id"], "left_semi").groupBy("query_id").agg(F.min("pos").alias("rank"))
    joined = questions.select("query_id").join(first, "query_id", "left")
    hits = [F.coalesce(F.col("rank") <= k, F.lit(False)).alias(f"hit{k}") for k in ks]
    return joined.select("query_id", "rank", *hits, F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"))


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    """n, mean of each hit and of rr; null means of nothing."""
    hits = [c for c in metrics.columns if c.startswith("hit")]
    return metrics.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.avg(F.col(h).cast("int")).alias(h.replace("hit", "recall")) for h in hits], F.avg("rr").alias("mrr")
    )


def misses(metrics: DataFrame) -> DataFrame:
    """The ids without a hit in the widest."""
    return metrics.filter(~F.col([c for c in metrics.columns if c.startswith("hit")][-1])).select("query_id")


def question_set(*sets: DataFrame) -> DataFrame:
    """Sets of (at, question, gold) in order, at a question's place in its file, as one: questions with a gold, the first
    of each text: query_id, question, gold."""
    parts = [s.select(F.lit(i).alias("of"), "at", "question", "gold") for i, s in enumerate(sets)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    nth = F.row_number().over(Window.partitionBy("question").orderBy("of", "at"))
    return every.filter(F.size("gold") > 0).withColumn("nth", nth).filter("nth = 1").select(F.xxhash64("question").alias("query_id"), "question", "gold")


def multi_hop(questions: DataFrame) -> DataFrame:
    return questions.filter(F.size("gold") >= 2)


def ablation(questions: DataFrame, runs: dict[str, DataFrame]) -> DataFrame:
    """Metrics of several ranked tables over all and multi-hop questions: config, subset, n, recalls, mrr."""
    out = None
    for name, ranked in runs.items():
        m = rank_metrics(questions, ranked).join(questions.select("query_id", (F.size("gold") >= 2).alias("multi")), "query_id").withColumn("config", F.lit(name))
        out = m if out is None else out.union(m)
    subsets = F.when(F.col("multi"), F.array(F.lit("all"), F.lit("multi_hop"))).otherwise(F.array(F.lit("all")))
    return summary(out.withColumn("subset", F.explode(subsets)).drop("multi"), "config", "subset")


def score_true_false(answer: Column, gold: Column) -> Column:
    """A denial beats an affirmation; an answer with neither is wrong."""
    a = text.answer_form(answer)
    no = a.rlike(fixed.SAYS_WRONG)
    said = F.when(no, "sai").when(a.rlike(fixed.SAYS_RIGHT), "đúng").otherwise("?")
    return said == text.answer_form(gold)


def choice(answer: Column) -> Column:
    up = F.upper(text.strip(text.composed(answer)))
    return F.coalesce(*[F.nullif(F.regexp_extract(up, p, 1), F.lit("")) for p in fixed.CHOICES])


def score_choice(answer: Column, gold: Column) -> Column:
    return F.coalesce(choice(answer) == F.upper(gold), F.lit(False))


def score_free(answer: Column, key_facts: Column, ranked: Column, gold: Column) -> Column:
    """struct(facts_ok, cite_ok): all facts said; any gold among the ranked."""
    a = text.answer_form(answer)
    return F.struct(F.forall(key_facts, lambda k: a.contains(text.answer_form(k))).alias("facts_ok"), F.arrays_overlap(ranked, gold).alias("cite_ok"))


def score_refusal(answer: Column) -> Column:
    a = text.answer_form(answer)
    out = F.lit(False)
    for m in fixed.REFUSALS:
        out = out | a.contains(m)
    return out


def score(questions: DataFrame) -> DataFrame:
    """questions (query_id, type, answer_said, answer, key_facts, ranked, gold): adds correct, retrieved."""
    correct = (
        F.when(F.col("type") == "true_false", score_true_false(F.col("answer_said"), F.col("answer")))
        .when(F.col("type") == "multiple_choice", score_choice(F.col("answer_said"), F.col("answer")))
        .when(F.col("type") == "free_text", score_free(F.col("answer_said"), F.col("key_facts"), F.col("ranked"), F.col("gold"))["facts_ok"])
        .otherwise(score_refusal(F.col("answer_said")))
    )
    return questions.withColumn("correct", F.coalesce(correct, F.lit(False))).withColumn("retrieved", F.when(F.size("gold") > 0, F.arrays_overlap("ranked", "gold")))


def accuracy(scored: DataFrame) -> DataFrame:
    """By type and in all (type null): type, n, n_correct, accuracy, retrieval_hit of those in scope, shown."""
    out = scored.rollup("type").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg(F.col("retrieved").cast("int")).alias("retrieval_hit"))
    return out.withColumn("shown", text.share(F.col("n_correct"), F.col("n")))


# runs over an eval set
def run_retrieval(questions: DataFrame, vectors: DataFrame, graph: g.Graph, texts: DataFrame, **params) -> DataFrame:
    """questions (query_id, question, embedding, gold) through the retrieval: rank_metrics of what it ranks."""
    return rank_metrics(questions, retrieve.retrieve(questions, vectors, graph, texts, **params)["ranked"])


def run_ablation(questions: DataFrame, vectors: DataFrame, graph: g.Graph, texts: DataFrame, scorer: Callable[[], retrieve.Scorer], settings: Settings = DEFAULT) -> DataFrame:
    """dense (entries alone), dense_graph (with what they cite) and dense_graph_rerank (a wider pool, reranked) on the same
    entries, over all and multi-hop questions: config, subset, n, recalls, mrr."""
    k, wide = settings.max_context_articles, settings.rerank_fetch_k
    hits = retrieve.nearest(questions, vectors, wide * settings.overfetch)
    entries = materialize(retrieve.entry_points(hits, settings.similarity_threshold, wide), "ablation-entries")
    edges = retrieve.traverse(entries, graph, settings.max_hop)["edges"]
    pool = materialize(retrieve.rank(entries, edges, max(k, wide)), "ablation-pool")
    runs = {
        "dense": entries.filter(F.col("pos") <= k),
        "dense_graph": pool.filter(F.col("pos") <= k),
        "dense_graph_rerank": retrieve.rerank(pool.filter(F.col("pos") <= wide), questions, texts, scorer, k),
    }
    return ablation(questions, runs)


def run_qa(questions: DataFrame, vectors: DataFrame, graph: g.Graph, texts: DataFrame, generator: Callable[[], retrieve.Generator], rules: str = retrieve.RULES, **params) -> DataFrame:
    """questions (query_id, question, embedding, type, answer, key_facts, gold) retrieved, put to the model and scored: their
    columns, answer_said, ranked, correct, retrieved. accuracy() sums it up."""
    r = retrieve.retrieve(questions, vectors, graph, texts, **params)
    said = retrieve.generate(retrieve.prompts(questions, r["context"], rules), generator, out="answer_said").select("query_id", "answer_said")
    ranked = r["ranked"].groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "article_id"))), lambda x: x["article_id"]).alias("ranked"))
    asked = questions.join(materialize(said, "qa-answers"), "query_id").join(ranked, "query_id", "left")
    return score(asked.withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>"))))
