import re
import unicodedata
import zlib

import pyarrow.parquet as pq
import zstandard

from quillon.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


def plain(text, contents, piece=4096):
    """The same classifier written plainly: sizes by the one-shot interface, the least one in order."""
    if text is None or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0
    data = re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "replace")
    sizes = []
    for lang, content in contents.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=9)
        n = 0
        for i in range(0, len(data), piece):
            n += len(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data[i : i + piece]))
        sizes.append((n, lang))
    (best, lang), (second, _) = sorted(sizes, key=lambda x: x[0])[:2]
    return lang, 1 - best / second


def test_predictions_match_the_plain_classifier(spark):
    docs = spark.read.parquet(SF)
    contents = langid.fit(docs, ~langid.held_out(docs.doc_id))
    assert list(contents) and all(len(c) <= 449 * 4 * 256 for c in contents.values())
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = pq.read_table(SF, columns=["doc_id", "text"]).to_pylist()
    for r in rows:
        lang, score = plain(r["text"], contents)
        assert (got[r["doc_id"]].lang_pred, got[r["doc_id"]].held_out) == (lang, zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and abs(got[r["doc_id"]].score - score) < 1e-12


def test_the_sample_is_of_whole_texts_of_the_other_folds(spark):
    docs = spark.read.parquet(SF)
    sampled = langid.sample(docs, ~langid.held_out(docs.doc_id), 192, 448, 256).collect()
    texts = {}
    for r in pq.read_table(SF, columns=["doc_id", "text", "lang"]).to_pylist():
        if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            texts.setdefault(r["lang"], []).append(r["text"])
    places = []
    for r in sampled:
        held = [t.find(r.text) for t in texts[r.lang] if r.text in t]
        assert held and r.nth <= 448 and len(r.text) <= 256
        places.append(min(held))
    assert max(places) > 5_000  # no prefix


def test_numerals_are_no_letters():
    c = langid.Classifier({"aa": b"the cat", "bb": b"der hund"})
    assert [c.predict(t)[0] for t in ("\u00b2", "\u00bd \u2462", "\u2167", "12_!", "")] == ["und"] * 5 and c.predict("\u00aa")[0] != "und"


def test_any_number_of_languages(spark):
    rows = [(i * 4, f"word{i % 1100} tale{i % 1100} " * 4, f"l{i % 1100}", None) for i in range(4400)]
    contents = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), langid.F.lit(True))
    assert len(contents) == 1100


def test_held_out_accuracy_on_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = [(r.lang, got[r.doc_id]) for r in docs.select("doc_id", "lang").collect()]
    test = [(lang, p) for lang, p in rows if p.held_out]
    assert 200 < len(test) < 300 and len(got) == 1000
    assert sum(lang == p.lang_pred for lang, p in test) / len(test) > 0.97
    assert all(0 <= p.score <= 1 for _, p in test)


def test_predictions_use_the_text_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(200)
    contents = langid.fit(docs, ~langid.held_out(docs.doc_id))
    plain = langid.predict(docs, contents).select("lang_pred", "score").toPandas()
    other = langid.predict(docs.selectExpr("0L AS doc_id", "text", "'x' AS lang", "'y' AS source"), contents).select("lang_pred", "score").toPandas()
    assert plain.equals(other)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score double"
    train = [(i, "the cat and the dog of the house " * 5, "aa", 0.0) for i in range(40)] + [(i, "der hund und die katze im haus " * 5, "bb", 0.0) for i in range(40, 80)]
    edge = [(None, None, "aa", 0.0), (101, "", "aa", 0.0), (102, "12 !? 3", "bb", 0.0), (103, "the dog", None, 0.0), (103, "the dog", None, 0.0), (104, " ".join(w for i in range(20_000) for w in ("der hund", "die katze", "im haus")[i % 3 : 1 + i % 2 + i % 3]), None, 0.0)]
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(spark.createDataFrame(train + edge, schema)).collect() if r.doc_id is None or r.doc_id > 100), key=repr)
    assert got == sorted([(None, "und"), (101, "und"), (102, "und"), (103, "aa"), (103, "aa"), (104, "bb")], key=repr)
    assert langid.identify(spark.createDataFrame([], schema)).collect() == []
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "words", None, 0.0)], schema)).collect()] == ["und"]


def test_narrow_margins_are_rejected(spark):
    contents = {"aa": b"the cat and the dog", "bb": b"der hund und die katze"}
    docs = spark.createDataFrame([(1, "zq xv")], "doc_id long, text string")
    assert langid.predict(docs, contents, min_margin=0.2).first().lang_pred == "und"
