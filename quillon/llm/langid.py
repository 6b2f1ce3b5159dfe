"""Language ID by compression: a text belongs to the language whose zstandard raw-content dictionary
makes it smallest.

Dictionaries are built from a bounded sample of labelled rows: of each language, about ``sample_docs``
rows in a hash order, whose whole texts are cut into pieces; of these, ``pieces`` in another hash order
make the dictionary, so that every part of a text is as likely to be learned from. Whole texts are
encoded, in pieces that each begin at the dictionary, so that a long text is judged by all its parts and
not by what it repeats of itself.

Defined cases: a null text, and one without any letter (of Unicode's category L), is ``und`` with score 0;
a very long text is encoded whole; languages of equal size are settled in favour of the one with more
labelled rows, then by name; a null lang and a null doc_id teach nothing; a null source changes nothing;
repeated rows are predicted each by itself; without any labelled row every text is ``und``; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize

LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def sample(docs: DataFrame, usable: Column, sample_docs: int, pieces: int, piece_chars: int) -> DataFrame:
    """(lang, text, nth, rows of the language): of each language the first ``pieces`` pieces, in a hash order, of
    the whole texts of about its first sample_docs usable rows by a hash of doc_id.

    The hash range that holds those rows follows from the languages' counts, a row each; a filter applies
    it before anything is sorted or gathered.
    """
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counts = materialize(known.groupBy("lang").agg(F.count("*").alias("rows")), "language-counts")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = known.select("lang", "text", place.alias("key")).join(counts, "lang").filter(F.col("key").cast("double") * F.col("rows") < F.lit(float(4 * sample_docs << 30)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))
    few = few.withColumn("nth", nth).filter(F.col("nth") <= sample_docs)
    cut = F.regexp_extract_all("text", F.lit(rf"(?s)(.{{1,{piece_chars}}})"), F.lit(1))
    each = few.select("lang", "rows", "nth", F.posexplode(cut).alias("at", "text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("nth", "at"), "text"))
    return each.select("lang", "text", "rows", order.alias("nth")).filter(F.col("nth") <= pieces)


def normal(text: str) -> str:
    """Lower-case letters of the text, one space between words: what tells languages apart."""
    return NOT_LETTERS.sub(" ", text.lower())


def fit(docs: DataFrame, usable: Column, sample_docs: int = 192, pieces: int = 448, piece_chars: int = 256) -> dict[str, bytes]:
    """Dictionary content by language, the most frequent language first. What comes to the driver is
    the bounded sample."""
    texts: dict[tuple, list[tuple]] = {}
    for r in sample(docs, usable, sample_docs, pieces, piece_chars).collect():
        texts.setdefault((-r["rows"], r["lang"]), []).append((r["nth"], r["text"]))
    return {lang: " ".join(normal(t) for _, t in sorted(rows)).encode("utf-8", "replace") for (_, lang), rows in sorted(texts.items())}


class Classifier:
    """contents: languages in the order in which ties are settled."""

    def __init__(self, contents: dict[str, bytes], level: int = 9, piece: int = 4096) -> None:
        self.langs, self.piece = list(contents), piece
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = normal(text).encode("utf-8", "replace")
        parts = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the share by which the next best one is larger, 0 to 1."""
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        margin = 1.0 if len(order) == 1 else 1 - sizes[order[0]] / sizes[order[1]]
        return self.langs[order[0]], margin


def predict(docs: DataFrame, contents: dict[str, bytes], min_margin: float = 0.0) -> DataFrame:
    """doc_id, lang_pred, score, narrow for every row. Where the margin is below min_margin the text
    is rejected: lang_pred is ``und``. narrow marks margins that a careful reader would reject."""
    held: list[Classifier] = []

    @F.pandas_udf("lang_pred string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not held:
            held.append(Classifier(contents))
        for texts in batches:
            rows = [held[0].predict(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [lang if s >= min_margin else "und" for lang, s in rows], "score": [s for _, s in rows]})

    out = docs.select("doc_id", judged(F.col("text")).alias("p"))
    return out.select("doc_id", "p.lang_pred", "p.score", (F.col("p.score") < 0.01).alias("narrow"))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, **params) -> DataFrame:
    """A row per row of docs: doc_id, held_out, lang_pred, score, narrow. Learns from the other folds."""
    contents = fit(docs, ~held_out(F.col("doc_id")), **params)
    found = predict(docs, contents)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "narrow")
