"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the hierarchy.

A page is parsed into nodes: its block elements, the inline elements that carry a name (class, id or
role), and a node of its own for every run of loose text between blocks. Each gets features of its
subtree (text, link and tag density), its attributes' words, its depth and its siblings; boosted trees
give it the log-odds of main text. The decoder then chooses the best set of nodes in which whatever is
kept has all its ancestors kept and whatever is dropped has its whole subtree dropped, so that no article
survives inside a dropped block and no advert inside a kept one is forced along with it.

The tables hold no labels for pages, so the trees are fitted to generated pages whose main text is
known (``page_maker``), a bounded number of them, with a fixed seed.

Defined cases: null and empty html have an empty text; broken markup is read as far as it goes, in time
that grows with the page's length only; a very long page is read whole; between choices of equal worth
a node is dropped; repeated rows are read each by itself; an empty table gives no rows; other columns,
also of the output's names, are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.boosting import Trees, fit_trees

#: A comment, a declaration or a tag. Outside of quotes a tag ends at the next < at the latest.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+|[^<>]*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Decimal character references, whose digits may be any number.
DECIMAL = re.compile(r"&#0*([0-9]+);?")
#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style noscript template title iframe object canvas audio video textarea select button datalist desc metadata annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body article main section div aside nav header footer form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog center".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose loose text is a node of its own.
CONTAINERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption summary".split()) | {""}
#: An opening tag that ends an open one of these, up to the first of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
GOOD = frozenset("article articlebody content post entry story main body text page prose blog news read".split())
BAD = frozenset(
    "nav navbar navigation menu header footer foot sidebar side aside ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay share sharing social related recommended comment comments commentlist reply replies respond disqus discussion breadcrumb breadcrumbs widget newsletter subscribe signup login search form pagination pager tags toolbar copyright legal disclaimer masthead topbar bottom".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("bad", "chars", "children", "controls", "depth", "good", "links", "marks", "own", "parent", "start", "sub", "sub_links", "sub_tags", "tag", "words")

    def __init__(self, tag: str, parent: int, depth: int, start: int, good: int, bad: int) -> None:
        self.tag, self.parent, self.depth, self.start, self.good, self.bad = tag, parent, depth, start, good, bad
        self.children: list[int] = []
        self.own = self.links = self.words = self.marks = self.controls = 0
        self.chars = self.sub = self.sub_links = self.sub_tags = 0


def attribute_words(attributes: str) -> tuple[int, int]:
    good = bad = 0
    for m in ATTRIBUTE.finditer(attributes):
        for w in WORD.findall(m[1] or m[2] or m[3] or ""):
            w = w.lower()
            good += w in GOOD
            bad += w in BAD
    return good, bad


def unescaped(text: str) -> str:
    """Character references decoded; numbers beyond all characters are U+FFFD, however long."""
    if "&" not in text:
        return text
    return html.unescape(DECIMAL.sub(lambda m: f"&#{m[1]};" if len(m[1]) < 8 else "&#1114112;", text))


class Open:
    """The open nodes of a page, and where each tag and each block is open, so that no tag searches them."""

    def __init__(self, nodes: list[Node]) -> None:
        self.nodes, self.stack, self.at, self.blocks = nodes, [0], {}, [0]

    def push(self, i: int) -> None:
        tag = self.nodes[i].tag
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag[0] not in "#~":
            self.blocks.append(len(self.stack))
        self.stack.append(i)

    def cut(self, level: int) -> None:
        """Closes the nodes from level on."""
        while len(self.stack) > level:
            tag = self.nodes[self.stack.pop()].tag
            self.at[tag].pop()
            if tag[0] not in "#~":
                self.blocks.pop()

    def to_block(self) -> None:
        """Closes loose text and inline elements above the innermost block."""
        self.cut(self.blocks[-1] + 1)

    def level(self, tags) -> int:
        """The level of the innermost open node of tags; 0 if there is none."""
        return max((held[-1] for t in tags if (held := self.at.get(t))), default=0)


def parse(page: str) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """Nodes in page order (0 is the root) and pieces of text: (node, line, text). Pieces of one line
    touch; a block's edge or a line break begins another line. Loose text is a node named #, a named
    inline element one named by ~ and its tag."""
    nodes, pieces = [Node("", -1, 0, 0, 0, 0)], []
    held = Open(nodes)
    stack = held.stack
    pos, line, links, seen, skipped = 0, 0, 0, 0, {}

    def add(tag: str, good: int = 0, bad: int = 0) -> None:
        nodes.append(Node(tag, stack[-1], len(stack), seen, good, bad))
        nodes[stack[-1]].children.append(len(nodes) - 1)

    def loose() -> None:
        if nodes[stack[-1]].tag in CONTAINERS:
            add("#")
            held.push(len(nodes) - 1)

    def say(text: str) -> None:
        nonlocal seen
        if text:
            text = unescaped(text)
            n = len(text.strip())
            if n:
                loose()
                node = nodes[stack[-1]]
                node.own += n
                node.links += n if links else 0
                node.words += text.count(" ") + 1
                node.marks += text.count(".") + text.count(",") + text.count("!") + text.count("?")
                seen += n
            pieces.append((stack[-1], line, text))

    end_of_tags = max(page.rfind(">"), page.rfind("<!--")) + 1
    while pos < end_of_tags and (m := TOKEN.search(page, pos)):
        say(page[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1]
        if tag in SKIPPED:
            if closing:
                continue
            if tag in ("button", "select", "textarea"):
                nodes[stack[-1]].controls += 1
            if not m[3].endswith("/"):
                ends = skipped.setdefault(tag, re.compile(rf"</{tag}\b[^<>]*>?", re.IGNORECASE))
                end = ends.search(page, pos)
                pos = end.end() if end else len(page)
        elif tag in ("br", "hr"):
            line += 1
        elif tag == "input":
            nodes[stack[-1]].controls += 1
        elif tag in BLOCKS:
            line += 1
            if closing:
                if k := held.level((tag,)):
                    held.cut(k)
                else:
                    held.to_block()
                continue
            links = 0
            held.to_block()
            if nodes[stack[-1]].tag == "p":  # no block stands in a paragraph
                held.cut(len(stack) - 1)
            if tag in ENDS and (k := held.level(ENDS[tag][0])) > held.level(ENDS[tag][1]):
                held.cut(k)
            add(tag, *attribute_words(m[3])) if m[3] else add(tag)
            if not m[3].endswith("/"):
                held.push(len(nodes) - 1)
        elif tag not in VOID:
            if tag == "a":
                links = 0 if closing else 1
            if closing:
                # an inline element ends inside its block only
                k = held.level((f"~{tag}",))
                if k > held.blocks[-1]:
                    held.cut(k)
            else:
                nodes[stack[-1]].sub_tags += tag != "a"
                if m[3] and not m[3].endswith("/") and ATTRIBUTE.search(m[3]):
                    loose()
                    add(f"~{tag}", *attribute_words(m[3]))
                    held.push(len(nodes) - 1)
    say(page[pos:])
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        x.sub += x.own
        x.sub_links += x.links
        if x.parent >= 0:
            up = nodes[x.parent]
            up.sub += x.sub
            up.sub_links += x.sub_links
            up.sub_tags += x.sub_tags + 1
            up.controls += x.controls
    return nodes, pieces


def features(nodes: list[Node]) -> list[list[float]]:
    """A row per node."""
    total, rows, above = max(nodes[0].sub, 1), [], []
    for x in nodes:
        # of the ancestors: articles, blocks that are none by their tag, words of their attributes
        a = above[x.parent] if x.parent >= 0 else (0, 0, 0, 0)
        own = (x.tag in ("article", "main"), x.tag in ("nav", "footer", "aside", "form", "header"), x.good, x.bad)
        above.append(tuple(p + q for p, q in zip(a, own, strict=True)))
        sib = nodes[x.parent].children if x.parent >= 0 else [0]
        around = nodes[x.parent].sub if x.parent >= 0 else total
        rows.append([
            x.tag == "p", x.tag in HEADINGS, x.tag in ("ul", "ol", "li", "dl", "dt", "dd"), x.tag in ("div", "section", "body", "html", ""), *own, *a,
            math.log1p(x.own), math.log1p(x.sub), x.sub / total, x.sub_links / max(x.sub, 1), math.log1p(x.sub / (x.sub_tags + 1)), x.depth,
            x.tag == "#", x.tag[:1] == "~", len(sib), x.sub / max(around, 1), math.log1p(around / len(sib)), x.marks / max(x.words, 1), x.controls, x.start / total, a[0] > 0 or own[0], a[1] > 0 or own[1],
        ])
    return rows


def decode(nodes: list[Node], logits: np.ndarray, spread: float = 0.5) -> list[bool]:
    """The kept nodes: the best consistent choice. A node's own text counts fully for its log-odds, the
    text below it at ``spread``; a dropped node takes its subtree along."""
    value = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        own = 0.0 if i == 0 else float(logits[i]) * (x.own + spread * (x.sub - x.own))
        value[i] = own + sum(v for c in x.children if (v := value[c]) > 0)
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and value[i] > 0
    return kept


def text_of(pieces: list[tuple[int, int, str]], kept: list[bool]) -> str:
    """Kept pieces in page order; any white space, and every edge of a line, is one space."""
    out, last = [], None
    for node, line, text in pieces:
        if kept[node]:
            out.append(text if line == last else f" {text}")
            last = line
    return " ".join("".join(out).split())


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    parsed = [parse(p) if p else None for p in pages]
    rows = [r for x in parsed if x for r in features(x[0])]
    logits = trees.logits(np.array(rows, float)) if rows else np.zeros(0)
    out, at = [], 0
    for x in parsed:
        if not x:
            out.append("")
            continue
        n = len(x[0])
        out.append(text_of(x[1], decode(x[0], logits[at : at + n])))
        at += n
    return out


@cache
def trained(pages: int = 600, seed: int = 7) -> Trees:
    """Trees fitted to ``pages`` generated pages."""
    from quillon.llm.page_maker import labelled_pages

    x, y, weight = [], [], []
    for page, is_main in labelled_pages(pages, seed):
        nodes, pieces = parse(page)
        main = [0] * len(nodes)
        for node, _, text in pieces:
            if is_main(text):
                main[node] += len(text.strip())
        for i in range(len(nodes) - 1, 0, -1):
            main[nodes[i].parent] += main[i]
        for i, row in enumerate(features(nodes)):
            if i and nodes[i].sub:
                x.append(row)
                y.append(main[i] > 0)  # a block is kept if any main text is in it
                weight.append(1 + math.log1p(nodes[i].sub))
    return fit_trees(np.array(x, float), np.array(y, float), np.array(weight))


def main_text(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """A row per row of pages: page_id, url, text, n_chars."""
    trees = trees or trained()

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts: list[str] = []
            for at in range(0, len(b), 128):
                texts += extract([p if isinstance(p, str) else None for p in b.iloc[at : at + 128]], trees)
            yield pd.Series(texts, dtype=object)

    out = pages.select("page_id", "url", extracted(F.col("html")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
