"""URL filters: host rules first, then a weighted vocabulary found by one Aho-Corasick automaton.

A strict term rejects a url by itself; soft terms reject it when the weights of the distinct ones
reach a sum, which any two of the default vocabulary do. Terms are sought in the url as it reads with its
percent escapes decoded. A term only counts between boundaries: no letter or digit may touch it, so that
a place name that holds a term inside a longer word is left alone.

The vocabulary is a parameter; ``load_vocabulary`` reads one from a table. Rules fit the url as it is.

Defined cases: a null or empty url, or one without ``://``, has an empty host and path and fits no rule;
its text is still searched for terms. A very long url is searched whole. Of rules that fit, the longest
wins; no two of one length may differ. Escapes that aren't UTF-8 read as U+FFFD. Repeated rows are
judged each by itself; a null page_id stays; an empty table gives no rows; other columns, also of the
output's names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains, on paths that start with its path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Also compounds whose parts alone say nothing, like an x.
STRICT = (
    "porn", "porno", "pornography", "xxx", "hentai", "camgirls", "sexcam", "sexcams", "milf", "bdsm", "onlinecasino", "warez", "keygen",
    "pornhub", "sexchat", "livesex", "sexshop", "camsex", "camgirl", "gangbang", "blowjob", "creampie", "upskirt", "x-rated", "xrated", "adult-x", "x-adult",
    "casinoonline", "casino-online", "online-casino", "freespins", "free-spins", "sportsbetting", "buyviagra", "buy-viagra", "buycialis", "buy-cialis", "keygens", "serialz", "crackz",
)
#: One hit says little, so two distinct ones at the default soft_sum reject. Inflections that plain urls put side by side (track, tracking) are left out.
SOFT = dict.fromkeys(
    (
        # gambling
        "casino", "casinos", "poker", "bet", "bets", "betting", "bookmaker", "jackpot", "jackpots", "slot", "slots", "roulette", "blackjack", "baccarat", "bingo", "lotto", "gambling", "gamble", "wager", "sportsbook", "win", "bonus",
        # adult
        "adult", "sex", "sexy", "nude", "nudes", "naked", "escort", "escorts", "erotic", "erotica", "fetish", "webcam", "webcams", "hookup", "hookups", "dating", "milfs", "busty", "horny", "nsfw",
        # pills
        "viagra", "cialis", "levitra", "xanax", "tramadol", "phentermine", "ambien", "valium", "pill", "pills", "meds", "pharma", "rx", "steroids", "weightloss",
        # spam
        "spam", "spammer", "farm", "linkfarm", "backlinks", "clickbait", "payday", "loans", "replica", "replicas", "cheap", "cheapest", "free", "prizes", "giveaway", "getrich", "forex",
        # advertising
        "ads", "adserver", "adclick", "popads", "popunder", "banners", "doubleclick", "track", "clicktrack", "affiliate",
        # piracy
        "torrent", "torrents", "cracked", "crack", "serials", "nulled", "download",
    ),
    1.0,
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case in ASCII) and path, both empty for null and where ``://`` is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def automaton(strict: Sequence[str], soft: dict[str, float]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term, weight in (*soft.items(), *((t, None) for t in strict)):
        a.add_word(term, (term, weight))
    if len(a):
        a.make_automaton()
    return a


def term_hits(url: str, a: ahocorasick.Automaton) -> tuple[int, list[str], float]:
    """Distinct strict terms, distinct soft terms and the sum of their weights."""
    low, strict, soft = unquote(url).lower(), set(), {}
    for end, (term, weight) in a.iter(low) if len(a) else ():
        start = end - len(term) + 1
        if (start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
            continue
        if weight is None:
            strict.add(term)
        else:
            soft[term] = weight
    return len(strict), sorted(soft), sum(soft.values())


def load_vocabulary(terms: DataFrame) -> dict:
    """Parameters strict and soft of filter_urls from a table (term, weight), where a strict term's weight is null.
    The vocabulary goes to every worker as a whole, so it comes to the driver."""
    rows = terms.select(F.lower(F.trim("term")).alias("term"), F.col("weight").cast("double").alias("weight")).filter("term <> ''").collect()
    strict = sorted({r["term"] for r in rows if r["weight"] is None})
    return {"strict": tuple(strict), "soft": {r["term"]: r["weight"] for r in sorted(rows, key=lambda r: (r["term"], r["weight"] or 0)) if r["weight"] is not None and r["term"] not in strict}}


def score_urls(urls: Column, strict: Sequence[str] = STRICT, soft: dict[str, float] | None = None) -> Column:
    soft = SOFT if soft is None else soft
    held: list[ahocorasick.Automaton] = []

    @F.pandas_udf("strict int, soft int, weight double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not held:
            held.append(automaton(strict, soft))
        for urls in batches:
            rows = [term_hits(u or "", held[0]) for u in urls]
            yield pd.DataFrame({"strict": [r[0] for r in rows], "soft": [len(r[1]) for r in rows], "weight": [r[2] for r in rows]})

    return scored(urls)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, soft_sum: float = 2.0, **vocabulary) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, n_strict, n_soft. Needs page_id and url."""
    host, path = url_parts(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"), score_urls(F.col("url"), **vocabulary).alias("terms"))
    judged = parted.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    # several distinct soft terms, heavy enough together
    bad = (F.col("terms.strict") > 0) | ((F.col("terms.soft") > 1) & (F.col("terms.weight") >= soft_sum))
    verdict = F.coalesce(F.col("found.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"),
        F.col("terms.strict").cast("long").alias("n_strict"), F.col("terms.soft").cast("long").alias("n_soft"),
    )
