"""Secret scans: an Aho-Corasick pass over each whole text finds keywords, regular expressions are
tried only where a keyword begins, and formats that embed a checksum are validated by it.

Spans count code points, end exclusive. Kinds, in order:

* assign, access, hex: the base kinds, leftmost and non-overlapping per kind;
* github: ``gh?_`` tokens whose last six characters are the CRC-32 of the rest in base 62;
* npm: ``npm_`` tokens with the same checksum;
* card: 13 to 19 digits after a card keyword that pass the Luhn check;
* jwt: three base64url parts whose first decodes to a JSON header with an algorithm;
* pem: private key blocks, header to footer, encrypted ones too, whose data is base64; of PGP blocks the
  CRC-24 at their end must be right.

Defined cases: a null and an empty text have no spans; very long texts are scanned whole, in time that
grows with their length only; spans of several kinds may overlap, and those that begin together are
ordered by kind; repeated rows are scanned each by itself; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm", "card", "jwt", "pem")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc62(body: str) -> str:
    """CRC-32 as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def checksummed(m: re.Match) -> bool:
    return crc62(m[1][:-6]) == m[1][-6:]


def jwt_header(m: re.Match) -> bool:
    part = m[0].split(".")[0]
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


def card_number(m: re.Match) -> bool:
    digits = re.sub(r"[^0-9]", "", m[1])
    return 13 <= len(digits) <= 19 and luhn(digits)


def crc24(data: bytes) -> int:
    """The checksum of OpenPGP's armour."""
    crc = 0xB704CE
    for x in data:
        crc ^= x << 16
        for _ in range(8):
            crc = (crc << 1) ^ (0x1864CFB if crc & 0x800000 else 0)
    return crc & 0xFFFFFF


def key_block(m: re.Match) -> bool:
    """Whether the data of a key block, its header lines left out, is base64, with a right checksum if it has one."""
    lines = [x.strip() for x in m["body"].splitlines()]
    data = [x for x in lines if x and ":" not in x]
    check = data.pop() if data and re.fullmatch(r"=[A-Za-z0-9+/]{4}", data[-1]) else None
    joined = "".join(x for line in data for x in line.split())
    if not joined or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", joined):
        return False
    if check is None:
        return True
    try:
        return crc24(base64.b64decode(joined, validate=True)) == int.from_bytes(base64.b64decode(check[1:]))
    except binascii.Error:
        return False


#: kind: (keywords in lower case, pattern tried at a keyword, what a match must pass)
ANCHORED = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
        lambda m: len(m[1]) >= 8,
    ),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), checksummed),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), checksummed),
    "card": (("card", "visa", "mastercard"), re.compile(r"(?i:mastercard|card|visa)[\x20#:=]{0,4}(?:no\.?|number)?[\x20#:=]{0,4}([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])", re.ASCII), card_number),
    "jwt": (("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{10,}+"), jwt_header),
    "pem": (("-----begin ",), re.compile(r"-----BEGIN (?P<kind>(?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?)-----(?P<body>(?:[^-]++|-(?!----))*+)-----END (?P=kind)-----"), key_block),
}
#: Where a kind's match fails at a start, it fails at every later one up to the end of this.
FAILS_UPTO = {"jwt": re.compile(r"eyJ[A-Za-z0-9_-]*+")}
#: A run of hex digits needs no keyword; only runs of the full length are ever matched.
HEX = re.compile(r"[0-9a-f]{32,}")


@cache
def automaton() -> ahocorasick.Automaton:
    kinds: dict[str, list[str]] = {}
    for kind, (keywords, _, _) in ANCHORED.items():
        for k in keywords:
            kinds.setdefault(k, []).append(kind)
    a = ahocorasick.Automaton()
    for k, of in kinds.items():
        a.add_word(k, (len(k), tuple(of)))
    a.make_automaton()
    return a


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed.

    Same as a left-to-right search of each pattern: every match begins at a keyword, and a match
    that fails its check still covers its characters.
    """
    # bytes.lower changes ASCII letters only, so places stay as they are
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    starts: dict[str, list[int]] = {}
    for end, (n, kinds) in automaton().iter(low):
        for kind in kinds:
            starts.setdefault(kind, []).append(end - n + 1)
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, places in starts.items():
        _, pattern, passes = ANCHORED[kind]
        skip, upto = FAILS_UPTO.get(kind), 0
        for at in sorted(places):
            if at < upto:
                continue
            if m := pattern.match(text, at):
                upto = m.end()
                if passes(m):
                    spans.append((m.start(), m.end(), kind))
            elif skip and (m := skip.match(text, at)):
                upto = m.end()
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[{kind}]") -> str:
    """Every span replaced by its kind; spans that overlap become one."""
    out, upto, n = [], 0, len(spans)
    i = 0
    while i < n:
        start, end, kind = spans[i]
        while i + 1 < n and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[upto:start], mark.format(kind=kind)]
        upto, i = end, i + 1
    return "".join([*out, text[upto:]])


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                spans = find_secrets(t) if t else []
                base = [s for s in spans if s[2] in KINDS[:3]]
                counts = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                rows.append((*counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = F.pandas_udf(scanned, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return docs.select("doc_id", found(F.col("text")).alias("found")).select("doc_id", "found.*")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by its kind and n_chars, where there is such a
    column, set to the new length. Texts without secrets stay as they are, null stays null."""

    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redact(t, find_secrets(t)) if t else t for t in texts], dtype=object)

    out = docs.withColumn("text", F.pandas_udf(redacted, "string")(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
