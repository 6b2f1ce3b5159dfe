"""run() against a brute-force version of its stages, on the driver's smallest documents."""

import re
from collections import Counter

import pyarrow.parquet as pq

import corpus_pipeline
from quillon.llm import secret_scan

from .test_decontam import words as item_words
from .test_near_dup import brute as components
from .test_rules import brute_kept as brute_verdicts
from .test_rules import brute_targets

SF = "/root/testdata/sf0.001"


def brute_kept(rows):
    """doc_id: (text, source) after the first four stages."""
    rows = [r for r, keep in zip(rows, brute_verdicts([(r["text"], r["source"]) for r in rows]), strict=True) if keep]
    kept = {i for i, _, _, keep in components([(r["doc_id"], r["text"]) for r in rows], 5, 80) if keep}
    rows = [r for r in rows if r["doc_id"] in kept]
    windows = set()
    for t in pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist():
        w = item_words(t)
        n = min(len(w), 10)
        windows |= {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if w else set()
    sizes = {len(x) for x in windows}
    clean = lambda w: not any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))
    rows = [r for r in rows if clean(item_words(r["text"]))]
    return {r["doc_id"]: (secret_scan.redact(r["text"], secret_scan.find_secrets(r["text"])), r["source"]) for r in rows}


def test_run_matches_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = brute_kept(docs)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert 0 < len(got) <= len(want) < len(docs)
    sizes, taken = Counter(), Counter()
    for i, (t, s) in want.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        sizes[s] += n
        if i in got:
            assert got[i].text == t and got[i].source == s and got[i].n_chars == len(t) and 0 < got[i].taken <= 3 * n
            taken[s] += got[i].taken
    assert set(got) <= set(want)
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= 0.5


def test_stages_take_odd_documents(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 5, "x", True), (1, text, "en", "a", 5, "x", True), (2, text.upper(), None, None, None, None, None), (None, None, None, None, None, None, None), (3, text + " password=abcdefgh1", "en", "a", 1, "y", False), (4, "", "en", "b", 0, "z", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, host string, kept boolean"
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, SF)
            assert out.columns == df.columns + ["taken"] * (i == 4)
            df = out
        assert {r.doc_id for r in df.collect()} <= {1}


def test_rows_of_one_id_are_told_apart(spark):
    """The first three stages and the last one keep what is another text, and one of what is the same."""
    base = [f"w{i}" for i in range(80)]
    near = " ".join([*base[:-1], "end"])
    other = " ".join(f"v{i}" for i in range(70))
    leak = pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()[0]
    dirty = other.upper() + " " + leak
    rows = [(1, " ".join(base), "a"), (5, other, "a"), (5, near, "b"), (None, near, "a"), (None, "u " + other[:-3], "a"), (5, other, "a"), (7, dirty, "b")]
    rows += [(9, " ".join(f"t{i}" for i in range(90)), s) for s in ("a", "b")]
    df = spark.createDataFrame([(i, t, "en", s, len(t), 99) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, taken int")
    for name, stage in corpus_pipeline.STAGES[:3]:
        df = corpus_pipeline.materialize(stage(spark, df, SF), name.replace(" ", "-"))
    kept = sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert (1, " ".join(base)) in kept and (5, other) in kept and (7, dirty) not in kept
    assert sum(t == near for _, t in kept) == 0 and [t for _, t in kept].count(other) == 1 and sum(i == 9 for i, _ in kept) == 1
    for _, stage in corpus_pipeline.STAGES[3:]:
        df = stage(spark, df, SF)
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "taken"]
    assert all(0 < r.taken <= 3 * len(r.text.split()) for r in df.collect())
