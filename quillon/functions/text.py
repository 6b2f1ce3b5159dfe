"""Column functions for identities, strings, dates and formats. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import fixed


def _base_letters() -> tuple[str, str]:
    """Letters that decompose into a base letter and marks, beside their base letters."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x1EFA) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii() and all(unicodedata.category(m) == "Mn" for m in d[1:])]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


MARKED, BARE = _base_letters()


def _compositions() -> tuple[list[str], list[str]]:
    """Sequences of a Vietnamese vowel and marks, in any order and partly composed, beside their single letters; longer ones first."""
    modifiers, tones = ("", "\u0302", "\u0306", "\u031b"), ("", "\u0300", "\u0301", "\u0303", "\u0309", "\u0323")
    out = {}
    for v in "aeiouyAEIOUY":
        for m in modifiers:
            for t in tones:
                whole = unicodedata.normalize("NFC", v + m + t)
                if len(whole) == 1 and m + t:
                    for parts in ((v, m, t), (v, t, m), (unicodedata.normalize("NFC", v + m), t), (unicodedata.normalize("NFC", v + t), m)):
                        if (said := "".join(parts)) != whole:
                            out[said] = whole
    pairs = sorted(out.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    return [k for k, _ in pairs], [v for _, v in pairs]


SPLIT_LETTERS, WHOLE_LETTERS = _compositions()


def composed(c: Column) -> Column:
    """Vietnamese letters as single characters, however they were put together."""
    split, whole = (F.split(F.lit(" ".join(x)), " ") for x in (SPLIT_LETTERS, WHOLE_LETTERS))
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(len(SPLIT_LETTERS) - 1)), c, lambda acc, i: F.replace(acc, F.get(split, i), F.get(whole, i)))
    return F.when(c.rlike(r"\p{Mn}"), steps).otherwise(c)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row: a column that functions of other arrays' elements use would
    be computed again for each of them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fix_eth(c: Column) -> Column:
    """The Icelandic eth that crawls put for the Vietnamese d with stroke."""
    return F.translate(c, "ðÐ", "đĐ")


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits of a name, all else as single dashes between them."""
    # the eth is read as a d with stroke; only what isn't all ASCII can hold letters with marks
    bare = lambda low: F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(F.translate(low, "ðđ" + MARKED, "dd" + BARE), r"\p{Mn}+", ""))
    return F.btrim(F.regexp_replace(let(F.lower(c), bare), "[^a-z0-9]+", "-"), F.lit("-"))


def kind_of_code(code: Column) -> Column:
    """Document kind by the prefix of its code; null where it isn't known."""
    prefix = F.substring_index(slug(code), "-", 1)
    kind = F.lit(None).cast("string")
    for key, name in fixed.KIND_OF_CODE.items():
        kind = F.when(prefix == key, F.lit(name)).otherwise(kind)
    return kind


def identity(number: Column, year: Column, code: Column) -> Column:
    """struct(doc_id, so_hieu, loai_vb, title) of a document's number, year and code; leading zeros stay."""
    so_hieu = F.concat(number, F.lit("/"), year, F.lit("/"), F.upper(fix_eth(code)))
    kind = kind_of_code(code)
    return F.struct(
        slug(F.concat(number, F.lit("_"), year, F.lit("_"), code)).alias("doc_id"),
        so_hieu.alias("so_hieu"),
        kind.alias("loai_vb"),
        F.coalesce(F.concat(kind, F.lit(" "), so_hieu), so_hieu).alias("title"),
    )


PREFIX = r"^(\d+)_(\d{4})_(.+)$"


def identity_of_prefix(prefix: Column) -> Column:
    """identity() of a file prefix number_year_code, null for any other."""
    part = lambda i: F.regexp_extract(prefix, PREFIX, i)
    return F.when(prefix.rlike(PREFIX), identity(part(1), part(2), part(3)))


FILE_STEM = r"^(.+)_(\d+)$"


def file_parts(stem: Column, strict: bool = True) -> Column:
    """struct(prefix, so_dieu) of a file stem prefix_article. Others raise, or are null if not strict."""
    out = F.struct(F.regexp_extract(stem, FILE_STEM, 1).alias("prefix"), F.regexp_extract(stem, FILE_STEM, 2).cast("int").alias("so_dieu"))
    if not strict:
        return F.when(stem.rlike(FILE_STEM), out)
    return F.when(stem.rlike(FILE_STEM), out).otherwise(F.raise_error(F.concat(F.lit("not <prefix>_<article>: "), stem)))


ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman(c: Column) -> Column:
    """Value of a Roman numeral; a digit before a larger one counts negative, whatever it is."""
    table = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    values = F.transform(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), lambda x: table[x])
    step = lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["last"], -v).otherwise(v)).alias("sum"), v.alias("last"))
    return F.aggregate(F.reverse(values), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step, lambda acc: acc["sum"])


def chapter_number(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).otherwise(roman(c))


def plain_number(c: Column) -> Column:
    """An integer without leading zeros; null if it is none."""
    return c.try_cast("int")


def article_id(doc: Column, number: Column) -> Column:
    return F.concat(doc, F.lit("_dieu-"), number.cast("string"))


def clause_id(article: Column, number: Column) -> Column:
    return F.concat(article, F.lit("_khoan-"), number.cast("string"))


def chapter_id(doc: Column, number: Column) -> Column:
    return F.concat(doc, F.lit("_chuong-"), number.cast("string"))


def clause_vector_id(article: Column, number: Column) -> Column:
    return F.concat(article, F.lit("#khoan-"), number.cast("string"))


def doc_of_article(article: Column) -> Column:
    """What is before the last _dieu-."""
    return F.regexp_replace(article, r"_dieu-(?:(?!_dieu-).)*$", "")


def article_of_vector(vector: Column) -> Column:
    return F.substring_index(vector, "#", 1)


def title_and_body(text: Column) -> Column:
    """struct(title, body): a first line "# title" is the title; else the whole text is the body."""
    head = F.substring_index(text, "\n", 1)
    titled = F.coalesce(text.startswith("# "), F.lit(False))
    rest = F.when(F.locate("\n", text) > 0, F.substring(text, F.length(head) + 2, F.length(text))).otherwise(F.lit(""))
    return F.struct(F.when(titled, strip(F.substring(head, 3, F.length(head)))).otherwise(F.lit("")).alias("title"), F.when(titled, rest).otherwise(F.coalesce(text, F.lit(""))).alias("body"))


#: What the pattern (?U)\\s matches.
WHITE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; no pattern, which would try every character of the text."""
    return F.btrim(c, F.lit(WHITE))


def full_text(heading: Column, lines: Column) -> Column:
    """The article's heading and its stripped body, the empty one left out."""
    body = strip(F.array_join(lines, "\n"))
    return strip(F.array_join(F.filter(F.array(heading, body), lambda x: x != ""), "\n"))


def preview(text: Column) -> Column:
    return F.left(text, F.lit(fixed.PREVIEW_CHARS))


def iso_date(text: Column) -> Column:
    """The first "ngày D tháng M năm Y", else the first D/M/Y, as YYYY-MM-DD; no check of the calendar."""
    two = lambda x: F.lpad(x, 2, "0")
    joined = lambda d: F.concat(F.get(d, F.lit(2)), F.lit("-"), two(F.get(d, F.lit(1))), F.lit("-"), two(F.get(d, F.lit(0))))
    # a date has three numbers and no other digits: each pattern is matched once
    read = lambda m: F.when(m != "", let(F.regexp_extract_all(m, F.lit(r"(?U)(\d+)"), F.lit(1)), joined))
    found = lambda t: F.coalesce(let(F.regexp_extract(t, fixed.LONG_DATE, 0), read), F.when(t.contains("/"), let(F.regexp_extract(t, fixed.SLASH_DATE, 0), read)))
    return let(text, found)


def labelled_date(text: Column, label: str, labels: tuple[str, ...] = fixed.LABELS, window: int = fixed.LABEL_WINDOW) -> Column:
    """The date between a label and the next known label, within the window."""
    # a label that begins in the window ends the date there, wherever it ends itself
    reach = window + max(map(len, labels))
    before = lambda rest: F.left(rest, F.least(F.lit(window), *[F.nullif(F.locate(other, rest), F.lit(0)) - 1 for other in labels if other != label]))
    dated = lambda at: F.when(at > 0, iso_date(let(F.substring(text, at + len(label), F.lit(reach)), before)))
    return let(F.locate(label, text), dated)


def effective_date(body: Column, sidecar: Column) -> Column:
    """The labelled date of the metadata page, else the date in the window after the first "hiệu lực" of the text."""
    after = F.regexp_extract(body, rf"(?s){fixed.EFFECT}(.{{0,{fixed.LABEL_WINDOW}}})", 1)
    return F.coalesce(labelled_date(sidecar, fixed.EFFECTIVE_LABEL), iso_date(after))


def expiry_date(sidecar: Column) -> Column:
    return labelled_date(sidecar, fixed.EXPIRY_LABEL)


def so_hieu_parts(body: Column, sidecar: Column) -> Column:
    """struct(so, nam, ma_hieu) from the metadata page, else from the text; empty strings if there is none."""
    part = lambda i: F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), fixed.SO_HIEU, i), F.lit("")) for t in (sidecar, body)], F.lit(""))
    return F.struct(part(1).alias("so"), part(2).alias("nam"), part(3).alias("ma_hieu"))


def override(given: Column, parsed: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), parsed)


def looks_like_so_hieu(keyword: Column) -> Column:
    return strip(keyword).rlike(fixed.SO_HIEU_ALONE)


def status(live: Column) -> Column:
    """current, partial, expired or unknown."""
    low = F.lower(live)
    return (
        F.when(low.contains("một phần"), "partial").when(low.contains("hết hiệu lực"), "expired").when(low.contains("còn hiệu lực"), "current").otherwise("unknown")
    )


def names_so_hieu(title: Column, so_hieu: Column) -> Column:
    """Whether the title has exactly this number, not as the end of another."""
    return F.regexp_like(F.coalesce(title, F.lit("")), F.concat(F.lit(r"(?<![\d/])\Q"), so_hieu, F.lit(r"\E")))


def answer_form(answer: Column) -> Column:
    """An answer for comparison: letters composed, trimmed, lower case, numbers without leading zeros."""
    return F.regexp_replace(F.lower(strip(composed(answer))), r"(?U)\b0+(\d)", "$1")


RELATION_FIELDS = "relationship_type string, confidence string, ly_do string"


def relation_reply(reply: Column) -> Column:
    """struct(relationship_type, confidence, ly_do) of a model's reply, from its first { to its last };
    null where it isn't JSON or a field is missing or of another type. A confidence of true is 1."""
    body = F.substring(reply, F.locate("{", reply), F.length(reply) - F.locate("}", F.reverse(reply)) - F.locate("{", reply) + 2)

    def read(parsed: Column) -> Column:
        field = lambda name, kind: F.try_variant_get(parsed, f"$.{name}", kind)
        type_of = lambda name: F.schema_of_variant(field(name, "variant"))

        def of(kind: Column) -> Column:
            number = let(type_of("confidence"), lambda t: F.when(t == "BOOLEAN", field("confidence", "boolean").cast("double")).when(t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), field("confidence", "double")))
            said = lambda n: F.when(n.isNotNull() & (type_of("ly_do") == "STRING"), F.struct(kind.alias("relationship_type"), n.alias("confidence"), field("ly_do", "string").alias("ly_do")))
            return F.when(kind.isin(*fixed.RELATIONS, "NONE"), let(number, said))

        return let(field("relationship_type", "string"), of)

    # the reply is parsed once, not once for every field
    return F.when((F.locate("{", reply) > 0) & (F.locate("}", reply) > 0), let(F.try_parse_json(body), read))


def share(hits: Column, total: Column) -> Column:
    """"x% (k/n)", or n/a of nothing."""
    return F.when(total > 0, F.format_string("%.1f%% (%d/%d)", F.lit(100.0) * hits / total, hits.cast("long"), total.cast("long"))).otherwise(F.lit("n/a"))


def cited(article: Column, is_entry: Column, is_external: Column) -> Column:
    """An id as it is shown: * marks an entry, a note what is outside the corpus."""
    return F.concat(article, F.when(is_entry, "*").otherwise(""), F.when(F.coalesce(is_external, F.lit(False)), fixed.OUTSIDE_MARK).otherwise(""))


def strip_chrome(body: Column, marker: str = fixed.TAB_BAR) -> Column:
    """What follows the last tab bar; the whole text where there is none."""
    return F.element_at(F.split(body, rf"\Q{marker}\E"), -1)


def is_not_found(body: Column) -> Column:
    low = F.lower(body)
    found = F.lit(False)
    for m in fixed.NOT_FOUND:
        found = found | low.contains(m)
    return (F.length(body) < fixed.NOT_FOUND_BELOW) & found


def url_slug(url: Column) -> Column:
    """The last part of a url's path before its first --, at most 100 characters."""
    last = F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)
    return F.left(F.substring_index(last, "--", 1), F.lit(100))


def hit_metadata(item: Column) -> Column:
    """struct(trang_thai, ngay_ban_hanh, ngay_hieu_luc) of a search hit's text, null where absent."""
    get = lambda p: F.nullif(F.regexp_extract(item, p, 1), F.lit(""))
    return F.struct(
        strip(get(fixed.HIT_STATUS)).alias("trang_thai"),
        get(fixed.HIT_ISSUED).alias("ngay_ban_hanh"),
        get(fixed.HIT_EFFECTIVE).alias("ngay_hieu_luc"),
    )
