"""URL filters, secret scans, quality rules and mixing against brute force."""

import base64
import hashlib
import json
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from quillon.llm import mixing, quality, secret_scan, urls

WORD = r"[^\x20\x09-\x0D]+"


# secrets
def brute_base(text):
    kinds = {
        "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
        "access": (r"AKIA[A-Z0-9]+", 16, 0),
        "hex": (r"[0-9a-f]+", 32, 0),
    }
    out = []
    for k, (kind, (rx, least, group)) in enumerate(kinds.items()):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(rx, text) if len(m[group]) >= least]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out)]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(2)
    bits = ["password", "PassWord", "passwd", "api_key", "APIKEY", "secret", "ſecret", "toKen", "=", ":", " ", "  ", '"', "'", "AKIA", "akia", "ABCDEFGH12345678", "0123456789abcdef" * 2, "abc", "é", "\n", "İ", "x" * 8, "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(800)]
    texts += [r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (None, "token=abcdefgh", "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        want = brute_base(t)
        n = Counter(s.split(":")[0] for s in want)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in secret_scan.KINDS[:3]] == want
    assert got[-1].spans == "" and got[None].spans == "assign:0:14"


def test_checksums_decide():
    body = "aB3" * 10
    good = f"ghp_{body}{secret_scan.crc62(body)}"
    assert [s[2] for s in secret_scan.find_secrets(f"x {good}.")] == ["github"]
    assert secret_scan.find_secrets(f"x {good[:-1]}{'0' if good[-1] != '0' else '1'}.") == []
    assert [s[2] for s in secret_scan.find_secrets("card number: 4111 1111 1111 1111.")] == ["card"]
    assert secret_scan.find_secrets("card number: 4111 1111 1111 1112.") == []
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    assert [s[2] for s in secret_scan.find_secrets(f"{head}.eyJzdWIiOjF9.abcdefghijk")] == ["jwt"]
    assert secret_scan.find_secrets("eyJxxxxxxxx.eyJzdWIiOjF9.abcdefghijk") == []
    pem = "-----BEGIN RSA PRIVATE KEY-----\nQUJD\n-----END RSA PRIVATE KEY-----"
    assert secret_scan.redact(f"a {pem} b", secret_scan.find_secrets(f"a {pem} b")) == "a [pem] b"


def test_key_blocks_of_all_forms():
    import os

    body = base64.b64encode(os.urandom(300)).decode()
    enc = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123ABCD-9\n\n{body[:64]}\n{body[64:]}\n-----END RSA PRIVATE KEY-----"
    crc = base64.b64encode(secret_scan.crc24(base64.b64decode(body)).to_bytes(3)).decode()
    pgp = f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v2\n\n{body}\n={crc}\n-----END PGP PRIVATE KEY BLOCK-----"
    assert secret_scan.crc24(b"123456789") == 0x21CF02
    for block in (enc, pgp, enc.replace("RSA ", "")):
        assert [s for s in secret_scan.find_secrets(f"x {block} y") if s[2] == "pem"] == [(2, 2 + len(block), "pem")]
    for other in (pgp.replace(f"={crc}", "=AAAA"), enc.replace(body[:64], "not base64!"), enc.replace("END RSA", "END DSA"), "-----BEGIN PRIVATE KEY----------END PRIVATE KEY-----"):
        assert not [s for s in secret_scan.find_secrets(other) if s[2] == "pem"]


@pytest.mark.parametrize("piece", ["eyJ", "eyJaaaaaa", "eyJaaaaaa.", "-----BEGIN RSA PRIVATE KEY-----\n-", "-----BEGIN ", "password ", "token='", "secret=", "card 4 1 ", "AKIA", "abcdef0123", "ghp_", " ", "eyJ" + "W" * 9])
def test_hostile_texts_take_linear_time(piece):
    import time

    start = time.perf_counter()
    secret_scan.find_secrets(piece * (1_000_000 // len(piece)))
    deep = base64.urlsafe_b64encode(b'{"a":' * 200_000).decode()
    secret_scan.find_secrets(f"{deep}.aaaaaa.bbbbbbbbbbbb")
    assert time.perf_counter() - start < 4


def test_a_run_that_fails_hides_no_later_token():
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    good = f"{head}.eyJzdWIiOjF9.abcdefghijk"
    for before in ("eyJaaa ", "EYJaaaaaaa", "eyJaaaaaaaaa,", "eyJaaaaaaaaa.b "):
        assert [s[2] for s in secret_scan.find_secrets(before + good)] == ["jwt"]


def test_no_documents_no_secrets(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, "token=abcdefgh", "x"), (2, "token=abcdefgh", "x")], "doc_id long, text string, n_hex string")
    assert sorted((r.doc_id, r.spans, r.n_hex) for r in secret_scan.scan(df).collect()) == [(1, "", 0), (2, "assign:0:14", 0), (2, "assign:0:14", 0)]
    assert secret_scan.scan(df.limit(0)).collect() == [] and secret_scan.redact_documents(df.limit(0)).columns == df.columns


def test_redaction_sets_the_length(spark):
    df = spark.createDataFrame([(1, "my password=abcdefgh1 é", 23, "k"), (2, None, 0, "k"), (3, "clean", 5, "k")], "doc_id long, text string, n_chars long, spans string")
    assert [(r.text, r.n_chars) for r in secret_scan.redact_documents(df).collect()] == [("my [assign] é", 13), (None, None), ("clean", 5)]


# urls
def test_url_rules_and_terms(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme porn": ("", "", None, "block"), "http://A.Example.com/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        "https://b.com/en/9": ("b.com", "/en/9", "com/en/", "block"), "http://example.net/de/81#t": ("example.net", "/de/81", "example.net/de/8", "block"), "http://x.net/de/": ("x.net", "/de/", "net/de/", "allow"),
        "http://notexample.org/es": ("notexample.org", "/es", None, "allow"), "http://com/en/1": ("com", "/en/1", "com/en/", "block"), "http://x.org?/es/": ("x.org", "", None, "allow"),
        "http://h.fr/free-xxx-pics": ("h.fr", "/free-xxx-pics", None, "block"), "http://h.fr/essex": ("h.fr", "/essex", None, "allow"), "http://h.fr/casino": ("h.fr", "/casino", None, "allow"),
        "http://h.fr/casino/poker": ("h.fr", "/casino/poker", None, "block"), "http://h.fr/casino/casino": ("h.fr", "/casino/casino", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, 3) for i, u in enumerate(cases)], "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_hosts_of_each_kind_are_blocked_by_the_terms(spark):
    bad = ["http://m.casino-win.example.fr/en/4033.html", "https://free-bets.example.fr/en/5462#top", "http://cheap-pills.example.fr/de/1?page=2&ref=x", "https://blog.adult-x.example.fr/fr/9689/", "http://www.spam-farm.example.fr/en/7", "https://m.ads-track.example.fr/es/3?utm_source=feed"]
    good = ["http://farm.example.fr/en/1?ref=x", "https://x.example.fr/free/status", "http://win.example.fr/windows?ref=x", "https://post.example.fr/track?tracking=3", "http://sussex.example.fr/betsy/downloads", "https://bank.example.fr/loans/loan"]
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert [got[i] for i in range(len(got))] == [(None, "block")] * len(bad) + [(None, "allow")] * len(good)


def test_escapes_vocabularies_and_odd_urls(spark):
    cases = [(1, "http://h.fr/%70orn", "block"), (2, "http://h.fr/a%2Fcas%69no%20poker", "block"), (3, "http://h.fr/ess%65x", "allow"), (4, "http://h.fr/%ff%zz%", "allow"), (5, "", "allow"), (None, None, "allow"), (6, "http://h.fr/" + "a/" * 500_000 + "porn", "block"), (7, "x", "allow"), (7, "x", "allow")]
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u, _ in cases], "page_id long, url string, verdict string, n_soft int")
    assert sorted(((r.page_id, r.verdict) for r in urls.filter_urls(df).collect()), key=repr) == sorted(((i, v) for i, _, v in cases), key=repr)
    assert urls.filter_urls(df.limit(0)).collect() == []
    own = urls.load_vocabulary(spark.createDataFrame([(" Bad ", None), ("odd", 1.5), ("even", 0.5), ("", 1.0)], "term string, weight double"))
    assert own == {"strict": ("bad",), "soft": {"even": 0.5, "odd": 1.5}}
    pages = spark.createDataFrame([(1, "http://h.fr/bad"), (2, "http://h.fr/odd/even"), (3, "http://h.fr/odd"), (4, "http://h.fr/porn")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in urls.filter_urls(pages, **own).collect()) == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow")]
    assert {r.verdict for r in urls.filter_urls(pages, strict=(), soft={}).collect()} == {"allow"}


# quality
def brute_quality(t):
    w = re.findall(WORD, t or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "a", "a a", "a a a", "a a a a", "é\u00a0b #*", "x\r\nx\r\n", " ".join(["w"] * 5000), " ".join(f"u{i % 29_990}" for i in range(30_000)), "same row", "same row"]
    texts += [rng.choice(["\n", " "]).join(rng.choice("abcdef") for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).slice(0, 200).to_pylist()]
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else f"s{i % 5}", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    for r in quality.quality(df).collect():
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality.quality(df.limit(0)).collect() == []


def brute_kept(rows):
    """The verdict on (text, source) rows, from plain numbers: each document's failures, then its host's."""
    fails = []
    for t, _ in rows:
        n, _, symbols, dup, rep = brute_quality(t)
        lines = sum(bool(re.search(WORD, x)) for x in (t or "").split("\n"))
        fails.append((n < 50 or 100 * rep > 50 * n, 2 * symbols > n or 2 * dup > lines))
    docs, bad = Counter(s for _, s in rows), Counter(s for (_, s), f in zip(rows, fails, strict=True) if any(f))
    mean, rates = sum(bad.values()) / len(rows), [bad[s] / docs[s] for s in docs]
    spread = sum((r - mean) ** 2 for r in rates) / len(rates)
    strength = max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1)
    limit = min(0.9, max(0.5, mean + 3 * (mean * (1 - mean) / (strength + 1)) ** 0.5))
    out = []
    for (_, s), (base, weak) in zip(rows, fails, strict=True):
        m = (bad[s] + mean * strength) / (docs[s] + strength)
        sd = (m * (1 - m) / (docs[s] + strength + 1)) ** 0.5
        out.append(not base and not m - 2 * sd > limit and (not weak or m + 2 * sd < mean / 2))
    return out


@pytest.mark.parametrize("broadcast_bytes", [quality.BROADCAST_BYTES, -1])
def test_hosts_decide_what_weak_failures_count_for(spark, broadcast_bytes):
    good, odd = " ".join(f"w{i}" for i in range(60)), " ".join(["###"] * 3 + [f"w{i}#" for i in range(60)])
    rows = [(i, good, f"host{i % 10}") for i in range(400)] + [(1000 + i, "short", "spam") for i in range(60)] + [(1100 + i, odd, f"host{i}") for i in range(2)]
    rows += [(2000, good, "spam"), (2001, good, "new"), (2002, "short", "small"), (2003, odd, "small")]
    rows += [(3000 + i, good, None) for i in range(2000)] + [(6000, odd, None)] + [(7000 + i, odd if i % 5 == 0 else good, "mid") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality(df, broadcast_bytes=broadcast_bytes).collect()}
    assert [kept[i] for i, _, _ in rows] == brute_kept([r[1:] for r in rows])
    assert all(kept[i] for i in range(400)) and not kept[2000] and kept[2001] and not kept[2002]  # a host of junk takes its good document along
    assert kept[6000] and not kept[2003] and not kept[7000] and kept[7001]  # a weak failure stays in a clean host only
    good_rows = quality.keep_good(df, broadcast_bytes=broadcast_bytes)
    assert good_rows.columns == df.columns and sorted(r.doc_id for r in good_rows.collect()) == sorted(i for i in kept if kept[i])


def test_weak_failures_act_on_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = {r.doc_id: r for r in quality.quality(docs).collect()}
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    gone = [i for i, r in rows.items() if not r.base_failed and not r.kept]
    assert len(gone) > 100 and all(quality_of.get(i, 0) == 0 for i in gone)


# mixing
def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: share.get(s, cap * sizes[s]) for s in order}
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_takes(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s in [None, "é", "z", "a", "A", "b", "empty"]:
        for _ in range(rng.choice([1, 3, 40, 200])):
            rows.append((rng.choice([len(rows), None]), " ".join("w" * rng.randrange(1, 4) for _ in range(0 if s == "empty" else rng.randrange(30))) or rng.choice([None, ""]), s))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(WORD, t or ""))
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(df).collect()] == [0] and mixing.mix(df.limit(0)).collect() == []
    assert mixing.mix_documents(df).columns == ["doc_id", "text", "source", "taken"]


def test_mixed_documents_are_told_apart_by_text_and_source(spark):
    rows = [(1, "w " * 40, "a"), (1, "w " * 2, "b"), (1, "w " * 40, "b"), (None, "x " * 9, "a"), (None, "y " * 7, "a"), (None, None, None), (2, "z " * 30_000, "a"), (3, "tie tie", "b"), (3, "tie tie", "b")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, taken int")
    got = mixing.mix_documents(df)
    assert got.columns == ["doc_id", "text", "source", "taken"]
    said = {(r.doc_id, r.text, r.source): r.taken for r in mixing.taken_rows(df).join(df.select("doc_id", "text", "source").distinct(), ["doc_id", "source"]).selectExpr("doc_id", "text", "source", "taken", "size").collect() if len(r.text.split()) == r.size and r.text != "tie tie"}
    out = got.collect()
    for r in out:
        assert 0 < r.taken <= 3 * len(r.text.split())
        if r.doc_id is not None and r.text != "tie tie":
            assert said[r.doc_id, r.text, r.source] == r.taken
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1.5 for s, t in brute_targets(sizes).items())


def test_many_sources_have_the_targets_of_brute_force(spark):
    rng = random.Random(8)
    sizes = {f"host{i:04d}": rng.choice([0, 1, 2, 5, 400, 3000]) for i in range(700)} | {None: 11}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "src string, source_size long").selectExpr("coalesce(src, '') AS src", "src IS NULL AS src_null", "source_size")
    got = {None if r.src_null else r.src: r.target for r in mixing.source_targets(mixing.placed_sources(df, (5, 2, 1), 3), 1.0).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
