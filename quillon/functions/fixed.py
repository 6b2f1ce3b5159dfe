"""Words, patterns and formats of Vietnamese legal documents that results depend on.

Fixed values throughout this file; everything else in the package derives from them.
"""

# fixed values: document kinds as they are written in citations, longer names before their prefixes
KINDS = ("Bộ luật", "Luật", "Pháp lệnh", "Nghị định", "Nghị quyết", "Quyết định", "Thông tư liên tịch", "Thông tư", "Chỉ thị")

# fixed values: prefix of a document code -> kind
KIND_OF_CODE = {
    "tt": "Thông tư",
    "nd": "Nghị định",
    "ttlt": "Thông tư liên tịch",
    "qd": "Quyết định",
    "ct": "Chỉ thị",
    "nq": "Nghị quyết",
    "pl": "Pháp lệnh",
}

# fixed values: names of laws that are cited without number or year -> document id
ALIASES = {
    "luật bảo hiểm xã hội": "41-2024-qh15",
    "bộ luật lao động": "45-2019-qh14",
    "luật việc làm": "74-2025-qh15",
    "luật an toàn, vệ sinh lao động": "84-2015-qh13",
    "luật an toàn vệ sinh lao động": "84-2015-qh13",
    "luật bảo hiểm y tế": "25-2008-qh12",
}
ALIAS_WINDOW = 60

# fixed values: headings; Java patterns, on stripped lines but for the clause
CHAPTER = r"^Chương(?U)\s+([IVXLCDM]+|\d+)$"
ARTICLE = r"(?d)^Điều(?U)\s+(\d+)\.\s*(.*)$"
CLAUSE = r"(?d)^((?U)\d+)\.(?U)\s+(.*)$"
APPENDIX = r"(?iu)^phụ lục(?U)\s+([IVXLCDM]+|\d+)\s*$"
PREVIEW_CHARS = 200

# fixed values: relation triggers, in order of precedence
TRIGGERS = (
    ("AMENDS", "sửa đổi|bổ sung"),
    ("SUPERSEDES", "thay thế"),
    ("CONFLICTS_WITH", "bãi bỏ|hết hiệu lực|trái với|mâu thuẫn với"),
)
RELATIONS = ("AMENDS", "SUPERSEDES", "CONFLICTS_WITH")

# fixed values: definitions
LIST_TRIGGER = "được hiểu như sau|giải thích từ ngữ"

# fixed values: labels of the metadata page
EFFECTIVE_LABEL = "Ngày có hiệu lực"
EXPIRY_LABEL = "Ngày hết hiệu lực"
LABELS = (
    "Số hiệu",
    "Loại văn bản",
    "Ngày ký xác thực",
    "Ngày có hiệu lực",
    "Ngày hết hiệu lực",
    "Cơ quan ban hành",
    "Người ký",
    "Ngành",
    "Lĩnh vực",
)
LABEL_WINDOW = 60
TAB_BAR = "Nội dung\nThuộc tính\nLược đồ\nVăn bản gốc\nTải về"
NOT_FOUND = ("không tồn tại", "not found", "không có nội dung")
NOT_FOUND_BELOW = 6000

# fixed values: answers that refuse
REFUSALS = (
    "chưa tìm thấy",
    "không có",
    "không tìm thấy",
    "ngoài phạm vi",
    "không thuộc",
    "không liên quan",
    "không đủ căn cứ",
    "không thể trả lời",
    "không có thông tin",
    "không có dữ liệu",
)

# fixed values: marks in a prompt, and the warning after an answer
EXTERNAL_MARK = "[Điều luật này KHÔNG có trong dữ liệu đã ingest - không có nội dung, không được suy đoán hay bịa nội dung của Điều này]"
PREVIEW_MARK = "[preview rút gọn, chưa có embedding đầy đủ]"
NO_CONTEXT = "(không có ngữ cảnh)"
OUTSIDE_MARK = " [ngoài corpus]"
NOT_FOUND_ANSWER = "Chưa tìm thấy quy định cụ thể trong dữ liệu"
WARNING_BEFORE = "\n\n⚠️ **Cảnh báo**: Câu trả lời viện dẫn văn bản KHÔNG có trong dữ liệu đang cung cấp ("
WARNING_AFTER = "). Vui lòng kiểm chứng lại với nguồn chính thức tại vbpl.vn trước khi áp dụng."

# fixed values: dates and numbers in texts; Java patterns, as all below
LONG_DATE = r"(?iu)ng[àa]y(?U)\s+(\d{1,2})\s+th[áa]ng\s+(\d{1,2})\s+n[ăa]m\s+(\d{4})"
SLASH_DATE = r"(\d{1,2})/(\d{1,2})/(\d{4})"
EFFECT = r"(?iu)hi[ệe]u(?U)\s+l[ựu]c"
SO_HIEU = r"[Ss][ốôo](?U)\s+(\d+)/(\d{4})/((?-U)[A-Za-zĐđ0-9\-]+)"
SO_HIEU_ALONE = r"^\d+/\d{4}/[A-Za-z0-9Đđ-]+$"

# fixed values: what a search hit says of a document
HIT_STATUS = r"(?Ud)Trạng thái:\s*(.+?)\s*Ngày ban hành:"
HIT_ISSUED = r"(?U)Ngày ban hành:\s*(\d{2}/\d{2}/\d{4})"
HIT_EFFECTIVE = r"(?U)Ngày hiệu lực:\s*(\d{2}/\d{2}/\d{4})"

# fixed values: citations
_KIND = "|".join(KINDS)
_NUMBERED = rf"(?:{_KIND})(?:\s+[^\d,.;]{{1,80}}?)?\s*(?:số\s+)?(\d+)\s*/\s*(\d{{4}})\s*/\s*([\w\-]+)"
_NAMED = rf"(?:{_KIND})\s+[^\d,.;]+?\d{{4}}"
#: Groups: whole, article number, document name, its number, year and code.
CITATION = rf"(?U)((?:khoản\s+\d+\s+)?Điều\s+(\d+)(?:\s+(?:của\s+)?({_NUMBERED}|{_NAMED}))?)"
SO_HIEU_CITED = r"(?U)\b((?-U)[0-9]{1,4})/([0-9]{4})/([A-Za-zĐđ][A-Za-zĐđ0-9\-]*)(?U)\b"
ARTICLE_CITED = r"(?U)\b([0-9]{1,4}-[0-9]{4}-[a-zđ0-9\-]+_dieu-[0-9]+)\b"

# fixed values: sentences and definitions
SENTENCE_END = r"(?U)(?<=[.;])\s+|\n+"
QUOTED_VERB = "được hiểu là"
QUOTED = r'(?U)[“"]([^”"]+)[”"]\s*được hiểu là\s+((?d).+?)(?=[.;\n]| và [^.;\n]*?được hiểu là|$)'
ITEM = r"(?s)(?:^|\n)[ \t]*(?U)\d{1,3}\.[ \t]+(.+?)(?=\n[ \t]*\d{1,3}\.[ \t]|\z)"

# fixed values: what answers say; forms in which they name their choice, in order, of which the first that matches decides
SAYS_WRONG = r"(?U)\bsai\b|\bkhông đúng\b"
SAYS_RIGHT = r"(?U)\bđúng\b"
CHOICES = (
    r"(?U)^\s*([ABCD])\s*[\)\.:\-]",
    r"(?U)(?:ĐÁP\s*ÁN|CHỌN|CÂU\s*TR[ẢA]\s*L[ỜO]I)(?:\s+\S+){0,3}?\s*(?:LÀ|:)\s*([ABCD])\b",
    r"(?U)^\s*([ABCD])\s*$",
    r"(?U)^\s*([ABCD])\b",
)
