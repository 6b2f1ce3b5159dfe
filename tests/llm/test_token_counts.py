import re

import pyarrow.parquet as pq
import pytest

from quillon.llm import token_counts as tc


def brute(text):
    """The same by the other library's offsets, in characters, token by token."""
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    if not hasattr(brute, "t"):
        brute.t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
        brute.t.encode_special_tokens = True
    spans = [m.span() for m in re.finditer(r"[^\n]+", text) if re.search(r"[^\x20\x09-\x0D]", m[0])]
    e = brute.t.encode(text, add_special_tokens=False)
    by, between, crossing = [0] * len(spans), 0, 0
    for s, t in e.offsets:
        hold = lambda at: next((i for i, (a, b) in enumerate(spans) if a <= at < b), -1)
        first, last = hold(s), hold(t - 1)
        k = first if first >= 0 else last
        crossing += first != last
        if k < 0:
            between += 1
        else:
            by[k] += 1
    return len(e.ids), by, between, crossing


def test_matches_offsets_of_another_library(spark):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).slice(0, 60).to_pylist()
    for r in rows:
        assert tc.count_text(r["text"], tc.vocabulary_path()) == brute(r["text"])


@pytest.mark.parametrize("text", ["a\n\n\nb", "x \n y", "\n", "one", " \t\nq\n ", "a<|endoftext|>b\n<|endoftext|>", "tail\n", "a \n\n \n b  \n"])
def test_edges_of_lines(text):
    assert tc.count_text(text, tc.vocabulary_path()) == brute(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "Head line\nbody text", 5), (3, "é\n" * 30_000, 5), (3, "same", 5), (3, "same", 5)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_sections): r for r in tc.token_counts(df).collect()}
    assert got[1, 0].n_tokens == got[2, 0].n_tokens == 0
    assert got[None, 2].head_tokens + got[None, 2].body_tokens + got[None, 2].between_tokens == got[None, 2].n_tokens
    long = got[3, 30_000]
    assert sum(long.section_tokens) + long.between_tokens == long.n_tokens
    assert tc.token_counts(df.limit(0)).collect() == []
