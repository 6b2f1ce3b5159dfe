import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillon.llm import near_dup

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("cls", StringType()), StructField("n_shingles", LongType())])


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(w[i : i + width]) for i in range(len(w) - width + 1)] or ([tuple(w)] if w else []))


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, (_, s) in enumerate(sets):
        n = {}
        for x in s:
            for b in by[x]:
                if b < a:
                    n[b] = n.get(b, 0) + 1
        for b, both in n.items():
            if 100 * both >= percent * (len(s) + len(sets[b][1]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(s), least.get(find(k), None) if s else i, i == (least.get(find(k)) if s else i)) for k, (i, s) in enumerate(sets)), key=repr)


def family(rng, base, copies, edits):
    words = base.split()
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w = w[: rng.randrange(int(len(w) * 0.7), len(w))]
        yield " ".join(w)


def run(spark, docs, **params):
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in docs], SCHEMA)
    return sorted(map(tuple, near_dup.near_duplicates(df, **params).collect()), key=repr)


def test_families_of_edited_copies_match_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for f in range(4):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([40, 120, 200])))
        texts += [base, base, *family(rng, base, 90 if f == 0 else 20, 12)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert run(spark, rows, width=4) == brute(rows, 4, 80)


def test_nulls_short_repeated_and_long_texts(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One Two"), (5, "one  two"), (6, "two one"), (7, long), (8, long + " tail"), (9, "é É"), (10, "É é"), (9, "é É"), (None, "alone here"), (None, "one two")]
    got = run(spark, rows, width=4)
    assert got == brute(rows, 4, 80)


def test_empty_table(spark):
    assert run(spark, [], width=4) == []


def test_driver_documents_match_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    got = sorted(map(tuple, near_dup.near_duplicates(spark.read.parquet(path), width=4).collect()), key=repr)
    assert got == brute(rows, 4, 80)


@pytest.mark.parametrize("percent", [80])
def test_keep_one(spark, percent):
    df = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "A B c d e f", "y"), (3, "other words", None)], "doc_id long, text string, extra string")
    kept = near_dup.keep_one(df, percent=percent)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_keep_one_tells_rows_of_one_id_apart_by_text(spark):
    rows = [(1, "a b c d e f"), (None, "A B c d e f"), (None, "quite other words"), (3, "said twice over"), (3, "said twice over"), (3, "a b c d e f"), (None, "null and twice"), (None, "null and twice")]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, "a b c d e f"), (3, "said twice over"), (None, "null and twice"), (None, "quite other words")]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def test_keep_one_leaves_one_of_each_group_and_all_without_words(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "ONE two three four five six seven eight nine ten eleven twelve"
    c = " ".join(f"w{i}" for i in range(60))
    rows = [(None, a), (None, b), (7, c), (7, c + " tail"), (8, c), (None, None), (None, None), (9, ""), (9, " ")]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    got = sorted(map(tuple, kept.collect()), key=repr)
    assert len(got) == 6 and got.count((None, None)) == 2 and (9, "") in got and (9, " ") in got
    assert sum(r[0] is None and r[1] in (a, b) for r in got) == 1 and sum(r[0] == 7 for r in got) == 1


def test_the_exact_join_misses_no_link(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(6):
        base = " ".join(f"w{rng.randrange(900)}" for _ in range(150))
        texts += [base, *family(rng, base, 12, 14)]
    rows = list(enumerate(texts))
    # one band of many rows proposes next to nothing: only the exact join finds the links
    assert run(spark, rows, width=4, bands=1, rows=40, exact=True) == brute(rows, 4, 80)


def test_a_chain_of_any_length_is_one_component(spark):
    from quillon.llm.components import components

    edges = spark.range(400).selectExpr("id AS a", "id + 1 AS b").union(spark.range(300).selectExpr("5000 AS a", "id + 6000 AS b"))
    got = {r.node: r.label for r in components(edges).collect()}
    assert len(got) == 702 and all(v == (0 if k <= 400 else 5000) for k, v in got.items())


def test_python_works_on_small_parts_of_a_batch(spark, monkeypatch):
    rng = random.Random(8)
    texts = [None, "", "x"] + [" ".join(f"w{rng.randrange(9000)}" for _ in range(rng.choice([3, 400, 1500]))) for _ in range(1500)] + ["long " * 900_000, "é É"]
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    functions, parts, plain, frame = [], [], near_dup.shingle_sets, type(df)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: functions.append(f) or self)
    near_dup.signed(df, 5, 32, 5)
    near_dup.sets_of(df, df.selectExpr("doc_id", "doc_id AS text_key", "text AS cls", "doc_id AS copies"), 5)
    monkeypatch.setattr(near_dup, "shingle_sets", lambda t, width: parts.append((len(t), sum(len((x or "").encode()) for x in t.to_pylist()))) or plain(t, width))
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts))), pa.array([b"c"] * len(texts))], ["doc_id", "text", "text_key", "cls"])
    signed, sets = (pa.Table.from_batches(f(iter([whole.slice(0, 0), whole.slice(1)]))) for f in functions)
    assert len(parts) > 6 and all(rows == 1 or size <= 1 << 21 for rows, size in parts)
    want = [len(s) for s in plain(whole.column("text").slice(1), 5)]
    assert signed.column("doc_id").to_pylist() == list(range(1, len(texts)))
    assert signed.column("n_shingles").to_pylist() == want == [len(s) for s in sets.column("set").to_pylist()]


def test_python_gets_few_rows_at_once(spark, monkeypatch):
    key, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, near_dup.materialize
    before = spark.conf.get(key)
    monkeypatch.setattr(near_dup, "materialize", lambda df, label: seen.setdefault(label, int(spark.conf.get(key))) and plain(df, label))
    assert near_dup.near_duplicates(spark.createDataFrame([(1, "a b"), (2, "A b")], "doc_id long, text string")).count() == 2
    assert seen["near-dup-bands"] <= 1000 and seen["near-dup-sets"] <= 1000 and spark.conf.get(key) == before
