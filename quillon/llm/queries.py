"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontam, html_extract, langid, mixing, near_dup, quality, secret_scan, substring, token_counts, urls
from quillon.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"), width=35, digest=True)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_quality, op3_near_dup, op4_secrets, op5_decontam, op6_substring, op7_urls, op8_main_text, op9_language, op10_token_counts)}


OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM sized GROUP BY source),
s2 AS (SELECT *, CAST(CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS room FROM s1),
s3 AS (SELECT *, room / weight AS full_at FROM s2),
s4 AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
              coalesce(sum(room) OVER (ORDER BY full_at, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
              sum(weight) OVER (ORDER BY full_at, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
              row_number() OVER (ORDER BY full_at, rn) AS nth FROM s3),
s5 AS (SELECT *, (total - used) / open_weight AS level FROM s4),
f AS (SELECT nth AS first_nth, level AS first_level FROM s5 WHERE level <= full_at ORDER BY nth LIMIT 1),
s6 AS (SELECT source, source_size,
              CASE WHEN nth >= coalesce((SELECT first_nth FROM f), nth + 1) THEN least(room, (SELECT first_level FROM f) * weight) ELSE room END AS target FROM s5),
s7 AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), source_size * 3) AS budget FROM s6),
s8 AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM s7),
d AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM sized)
SELECT d.doc_id, d.size, s8.source_size, s8.target,
       CAST(s8.epochs * d.size + greatest(0, least(d.size, s8.budget - s8.epochs * s8.source_size - d.start)) AS BIGINT) AS taken, d.source
FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source
"""

OP2 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM t),
g AS (SELECT a.rid, a.i, a.word AS x, b.word AS y, c.word AS z FROM w a JOIN w b ON b.rid = a.rid AND b.i = a.i + 1 JOIN w c ON c.rid = a.rid AND c.i = a.i + 2),
gg AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM gg, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
wc AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
ll AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM ll WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT t.doc_id, t.source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(lc.n, 0) AS n_dup_lines,
             coalesce(n_lines, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM t LEFT JOIN wc USING (rid) LEFT JOIN lc USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
c AS (SELECT *, (2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines) AS weak_failed FROM b),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS docs, CAST(count(*) FILTER (WHERE base_failed OR weak_failed) AS DOUBLE) AS bad FROM c GROUP BY source),
p AS (SELECT sum(bad) / sum(docs) AS mean, avg(bad / docs) AS m1, avg((bad / docs) * (bad / docs)) AS m2 FROM h),
q AS (SELECT mean, greatest(mean * (1 - mean) / greatest(m2 - 2 * mean * m1 + mean * mean, 1e-9) - 1, 1.0) AS strength FROM p),
l AS (SELECT *, least(0.9, greatest(0.5, mean + 3 * sqrt(mean * (1 - mean) / (strength + 1)))) AS reject_above FROM q),
m2 AS (SELECT source, mean, reject_above, (bad + mean * strength) / (docs + strength) AS m, docs + strength + 1 AS n FROM h, l),
v AS (SELECT source, m - 2 * sqrt(m * (1 - m) / n) > reject_above AS rejected, m + 2 * sqrt(m * (1 - m) / n) < mean / 2 AS cleared FROM m2)
SELECT c.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       (NOT base_failed AND NOT v.rejected AND (NOT weak_failed OR v.cleared)) AS kept
FROM c JOIN v ON c.source IS NOT DISTINCT FROM v.source
"""

OP3 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN length(w) = 0 THEN [] WHEN length(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, length(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS shingles FROM d),
x AS (SELECT rid, length(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (SELECT a.rid AS a, b.rid AS b, a.n + b.n AS n, count(*) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (n - shared)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(rid, r) AS (SELECT rid, rid FROM s UNION SELECT reach.rid, sides.b FROM reach JOIN sides ON sides.a = reach.r),
least AS (SELECT reach.rid, min(s.doc_id) AS component_id FROM reach JOIN s ON s.rid = reach.r GROUP BY reach.rid)
SELECT s.doc_id, CAST(length(shingles) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least ON least.rid = s.rid
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(length(w), 10) AS n FROM b WHERE length(w) > 0),
bs AS (SELECT item, w, n, unnest(range(1, length(w) - n + 2)) AS s FROM bl),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM bs),
sizes AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT rid, n, w, unnest(range(1, length(w) - n + 2)) AS s FROM d, sizes WHERE length(w) >= n),
dw AS (SELECT rid, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM dp),
h AS (SELECT rid, s, dw.n, item FROM dw JOIN bw ON bw.win = dw.win AND bw.n = dw.n),
hp AS (SELECT DISTINCT rid, s, n FROM h),
hw AS (SELECT rid, unnest(range(s, s + n)) AS p FROM hp),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hw GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(length(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.rid = d.rid LEFT JOIN its ON its.rid = d.rid
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, length(w) - 33)) AS s FROM d WHERE length(w) >= 35),
x AS (SELECT rid, s, array_to_string(list_slice(w, s, s + 34), ' ') AS said FROM p),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY said) AS n FROM x) WHERE n > 1),
g AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS i FROM r),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT words.rid, string_agg(word, ' ' ORDER BY words.i) AS kept, count(*) AS n FROM words LEFT JOIN g ON g.rid = words.rid AND g.i = words.i WHERE g.i IS NULL GROUP BY words.rid)
SELECT d.doc_id, CAST(length(w) AS BIGINT) AS n_words, CAST(length(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.rid = d.rid
"""

OP7 = r"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1) AS raw, coalesce(rest, '') AS rest FROM a),
c AS (SELECT page_id, url_decode(url) AS url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM b),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
      FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
terms(term, weight) AS (VALUES {terms}),
t AS (SELECT page_id, count(*) FILTER (WHERE weight IS NULL) AS n_strict, count(*) FILTER (WHERE weight IS NOT NULL) AS n_soft, sum(weight) AS w
      FROM c JOIN terms ON CASE WHEN contains(lower(url), term) THEN regexp_matches(lower(url), '(^|[^\pL\pN])' || term || '($|[^\pL\pN])') END GROUP BY page_id)
SELECT c.page_id, host, path, rule,
       coalesce(f.verdict, CASE WHEN coalesce(n_strict, 0) > 0 OR (coalesce(n_soft, 0) > 1 AND w >= 2) THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(coalesce(n_strict, 0) AS BIGINT) AS n_strict, CAST(coalesce(n_soft, 0) AS BIGINT) AS n_soft
FROM c LEFT JOIN f ON f.page_id = c.page_id LEFT JOIN t ON t.page_id = c.page_id
"""


def oracle_sql() -> dict[str, str]:
    terms = [*((t, "NULL") for t in urls.STRICT), *((t, w) for t, w in urls.SOFT.items())]
    op7 = OP7.replace("{terms}", ", ".join(f"('{t}', CAST({w} AS DOUBLE))" for t, w in terms))
    return {"op1_mixing": OP1, "op2_quality": OP2, "op3_near_dup": OP3, "op5_decontam": OP5, "op6_substring": OP6, "op7_urls": op7}
