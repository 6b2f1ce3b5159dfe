import pytest
from pyspark.sql import functions as F

from quillon.functions import text


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


L = F.lit


@pytest.mark.parametrize(
    ("name", "want"),
    [("Luật Bảo hiểm xã hội", "luat-bao-hiem-xa-hoi"), ("  --Nghị ĐỊNH số 5/2020  ", "nghi-dinh-so-5-2020"), ("102_2017_nð-cp", "102-2017-nd-cp"), ("Điều kiện ưu đãi", "dieu-kien-uu-dai"), ("", ""), ("日本", "")],
)
def test_slug(spark, name, want):
    assert value(spark, text.slug(L(name))) == want


def test_identities(spark):
    got = value(spark, text.identity(L("05"), L("2017"), L("nð-cp")))
    assert got.asDict() == {"doc_id": "05-2017-nd-cp", "so_hieu": "05/2017/NĐ-CP", "loai_vb": "Nghị định", "title": "Nghị định 05/2017/NĐ-CP"}
    assert value(spark, text.identity(L("41"), L("2024"), L("QH15"))).title == "41/2024/QH15"
    assert value(spark, text.identity_of_prefix(L("19_2016_tt-bxd"))).loai_vb == "Thông tư"
    assert value(spark, text.identity_of_prefix(L("21-lct_hdnn8"))) is None
    assert value(spark, text.kind_of_code(L("TTLT-BYT-BTC"))) == "Thông tư liên tịch" and value(spark, text.kind_of_code(L(""))) is None


def test_file_stems(spark):
    assert tuple(value(spark, text.file_parts(L("05_2017_tt-btnmt_12")))) == ("05_2017_tt-btnmt", 12)
    assert value(spark, text.file_parts(L("readme"), strict=False)) is None
    with pytest.raises(Exception, match="not <prefix>_<article>"):
        value(spark, text.file_parts(L("readme")))


@pytest.mark.parametrize(("numeral", "n"), [("IV", 4), ("XIX", 19), ("MCMXCIV", 1994), ("IIX", 10), ("x", 10)])
def test_roman(spark, numeral, n):
    assert value(spark, text.roman(L(numeral))) == n


def test_numbers_and_ids(spark):
    assert value(spark, text.chapter_number(L("07"))) == 7 and value(spark, text.chapter_number(L("VII"))) == 7
    assert value(spark, text.plain_number(L("05"))) == 5
    assert value(spark, text.article_id(L("d"), L(3))) == "d_dieu-3" and value(spark, text.clause_id(L("d_dieu-3"), L(1))) == "d_dieu-3_khoan-1"
    assert value(spark, text.doc_of_article(L("a_dieu-1_dieu-2"))) == "a_dieu-1"
    assert value(spark, text.article_of_vector(L("a_dieu-1#khoan-2"))) == "a_dieu-1"


def test_title_and_body(spark):
    assert tuple(value(spark, text.title_and_body(L("# Tên \nthân\nbài")))) == ("Tên", "thân\nbài")
    assert tuple(value(spark, text.title_and_body(L("# Tên")))) == ("Tên", "")
    assert tuple(value(spark, text.title_and_body(L("#Tên\nx")))) == ("", "#Tên\nx")
    assert tuple(value(spark, text.title_and_body(L(None).cast("string")))) == ("", "")
    assert value(spark, text.full_text(L("Phạm vi"), F.array(L(""), L(" a"), L("b "), L("")))) == "Phạm vi\na\nb"


@pytest.mark.parametrize(
    ("said", "want"),
    [("từ ngày 1 tháng 7 năm 2025", "2025-07-01"), ("NGÀY 01 THÁNG 12 NĂM 2020 và 3/4/2019", "2020-12-01"), ("3/4/2019 ngày 5 tháng 6 năm 2020", "2020-06-05"), ("hết 31/2/2021", "2021-02-31"), ("--", None), (None, None)],
)
def test_dates(spark, said, want):
    assert value(spark, text.iso_date(L(said).cast("string"))) == want


def test_labelled_dates(spark):
    page = "Số hiệu\n41/2024\nNgày có hiệu lực\n--\nNgày hết hiệu lực\n01/02/2030\nCơ quan ban hành\nQuốc hội"
    assert value(spark, text.labelled_date(L(page), "Ngày có hiệu lực")) is None
    assert value(spark, text.expiry_date(L(page))) == "2030-02-01"
    body = "Luật này có hiệu lực thi hành từ ngày 01 tháng 7 năm 2025."
    assert value(spark, text.effective_date(L(body), L(page))) == "2025-07-01"
    assert value(spark, text.effective_date(L("không nói"), L(""))) is None
    assert value(spark, text.override(L(""), L("2020-01-01"))) == "2020-01-01" and value(spark, text.override(L("2019-01-01"), L("x"))) == "2019-01-01"


def test_so_hieu(spark):
    assert tuple(value(spark, text.so_hieu_parts(L("Luật số 41/2024/QH15 ngày"), L("Số hiệu: 9/2020/X")))) == ("41", "2024", "QH15")
    assert tuple(value(spark, text.so_hieu_parts(L(""), L(None).cast("string")))) == ("", "", "")
    assert value(spark, text.looks_like_so_hieu(L(" 12/2022/NĐ-CP "))) and not value(spark, text.looks_like_so_hieu(L("12/22/NĐ")))
    assert not value(spark, text.names_so_hieu(L("NĐ 112/2022/NĐ-CP"), L("12/2022/NĐ-CP"))) and value(spark, text.names_so_hieu(L("số 12/2022/NĐ-CP"), L("12/2022/NĐ-CP")))


@pytest.mark.parametrize(("live", "want"), [("Hết hiệu lực một phần", "partial"), ("Hết hiệu lực toàn bộ", "expired"), ("CÒN HIỆU LỰC", "current"), ("khác", "unknown"), (None, "unknown")])
def test_status(spark, live, want):
    assert value(spark, text.status(L(live).cast("string"))) == want


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('```json\n{"relationship_type": "AMENDS", "confidence": 0.9, "ly_do": "vì"}\n```', ("AMENDS", 0.9, "vì")),
        ('{"relationship_type": "NONE", "confidence": 1, "ly_do": ""}', ("NONE", 1.0, "")),
        ('{"relationship_type": "NONE", "confidence": true, "ly_do": ""}', ("NONE", 1.0, "")),
        ('{"relationship_type": "OTHER", "confidence": 1, "ly_do": ""}', None),
        ('{"relationship_type": "NONE", "confidence": "1", "ly_do": ""}', None),
        ('{"relationship_type": "NONE", "confidence": 1, "ly_do": 3}', None),
        ('{"relationship_type": "NONE", "confidence": 1}', None),
        ("no json", None),
        ("} {", None),
        ("{broken", None),
    ],
)
def test_relation_reply(spark, reply, want):
    got = value(spark, text.relation_reply(L(reply)))
    assert (tuple(got) if got else None) == want


def test_small_formats(spark):
    assert value(spark, text.answer_form(L(" Là 06 THÁNG, 2006 ngày "))) == "là 6 tháng, 2006 ngày"
    assert value(spark, text.share(L(2), L(3))) == "66.7% (2/3)" and value(spark, text.share(L(0), L(0))) == "n/a"
    assert value(spark, text.cited(L("a"), L(True), L(None).cast("boolean"))) == "a*" and value(spark, text.cited(L("a"), L(False), L(True))) == "a [ngoài corpus]"
    assert value(spark, text.strip_chrome(L("x<TAB>y<TAB>z"), "<TAB>")) == "z" and value(spark, text.strip_chrome(L("plain"), "<TAB>")) == "plain"
    assert value(spark, text.is_not_found(L("Văn bản KHÔNG TỒN TẠI"))) and not value(spark, text.is_not_found(L("x" * 7000 + "không tồn tại")))
    assert value(spark, text.url_slug(L("https://h/a/luat-so-1--uuid--x/"))) == "luat-so-1"
    got = value(spark, text.hit_metadata(L("PDF Trạng thái: Hết hiệu lực một phần Ngày ban hành: 14/12/2020 Ngày hiệu lực: 01/02/2021")))
    assert tuple(got) == ("Hết hiệu lực một phần", "14/12/2020", "01/02/2021") and tuple(value(spark, text.hit_metadata(L("x")))) == (None, None, None)


def test_a_reply_is_parsed_once(spark):
    df = spark.createDataFrame([('x {"relationship_type": "AMENDS", "confidence": true, "ly_do": "a } b"} y',), ("} {",), ("{",), (None,), ('{"relationship_type": "AMENDS", "confidence": "1", "ly_do": ""}',)], "r string")
    read = df.select(text.relation_reply(F.col("r")).alias("r"))
    assert read._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson") == 1
    assert [r.r and tuple(r.r) for r in read.collect()] == [("AMENDS", 1.0, "a } b"), None, None, None, None]


def test_a_labelled_date_is_looked_for_once(spark):
    said = ["Ngày có hiệu lực\n1/2/2020", "Ngày có hiệu lực " + "x" * 55 + "Người ký 1/2/2020", "Ngày có hiệu lực --\nNgày hết hiệu lực: 02/01/2030", "Ngày có hiệu lực ngày 3 tháng 12 năm 2021, 1/2/2020", "1/2/2020", None]
    df = spark.createDataFrame([(x,) for x in said], "s string")
    read = df.select(text.labelled_date(F.col("s"), "Ngày có hiệu lực").alias("d"))
    assert [r.d for r in read.collect()] == ["2020-02-01", None, None, "2021-12-03", None, None]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("th[áa]ng") == 1
