import hashlib
import random
import re

import pytest

from quillon.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, width):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), width)
        for p in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[p : p + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in wins:
                    hit |= set(range(p, p + n))
                    ids |= wins[x]
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_matches_brute_force(spark, broadcast_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "É", "é", "Ab", "aB"]) if rng.random() < 0.3 else f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 40])))) for i in range(25)] + [(98, None), (99, "--"), (None, "Rare Item here"), (3, "again with three")]
    docs = []
    for i in range(60):
        t = [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            if len(w) > 1 and rng.random() < 0.5:
                w = w[rng.randrange(len(w)) :]
            t += [x.upper() for x in w] + [word()]
        docs.append((i, rng.choice([" ", "\n", ", "]).join(t)))
    docs += [(100, None), (101, ""), (102, "?!"), (5, docs[5][1]), (None, "so: RARE item, here"), (103, " ".join(["w1"] * 20_000))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, n_words int")
    bm = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, decontam.decontaminate(df, bm, width=10, broadcast_bytes=broadcast_bytes).collect()), key=repr)
    assert got == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.decontaminate(docs, items).collect()] == [False]
    assert decontam.decontaminate(docs.limit(0), docs.select(docs.doc_id.alias("item_id"), "text")).collect() == []


def test_keep_clean_leaves_columns(spark):
    docs = spark.createDataFrame([(1, "x a b c y", 3), (2, "a b", 4)], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame([(1, "A b C")], "item_id long, text string")
    assert [tuple(r) for r in decontam.keep_clean(docs, items).collect()] == [(2, "a b", 4)]


def test_keep_clean_drops_no_clean_row_of_the_same_id(spark):
    docs = spark.createDataFrame([(None, "x a b c y"), (None, "other"), (2, "a b c"), (2, "fine"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b C")], "item_id long, text string")
    assert sorted(map(tuple, decontam.keep_clean(docs, items).collect()), key=repr) == [(2, "fine"), (None, "other"), (None, None)]


def test_very_long_texts_and_repeated_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = " ".join(f"w{i % 997}" for i in range(9000))
    rows = [(1, f"{long} {item} {long}"), (1, f"{long} {item} {long}"), (1, long), (2, item[:-1])]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    for b in (32 << 20, 0):
        got = sorted(map(tuple, decontam.decontaminate(docs, items, width=10, broadcast_bytes=b).collect()))
        assert got == sorted(brute(rows, [(7, item)], 10))
