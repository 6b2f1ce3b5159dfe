"""Generated web pages with known main text, to fit and test the extraction.

Every word of the main text carries a mark that no other word has, so labels need no second parse
of the page. Layouts vary in tags, attribute words (often meaningless ones), order and depth.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

MARK = "⁠"  # word joiner: no letter, no white space
SYLLABLES = ("an en on un re the er ing ly st ou ha wh le que ment tion der die sch ung keit ue os as do mi ra".split(), "ka ki ku ma mi mo ta te to na ne no ra ri ro sa se so".split())


class Maker:
    def __init__(self, rng: random.Random) -> None:
        self.r, self.syllables = rng, rng.choice(SYLLABLES)

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randrange(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randrange(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice("...!?") for _ in range(self.r.randrange(lo, hi)))

    def main(self, text: str) -> str:
        inline = self.r.random()
        marked = [MARK + w for w in text.split()]
        if inline < 0.2 and len(marked) > 4:
            k = self.r.randrange(len(marked) - 2)
            tag = self.r.choice(["b", "em", "a href='/x'", "span", "code", f"span class='{self.word()}'", f"a class='{self.word()}-link' href='/x'", f"em id='{self.word()}'"])
            marked[k] = f"<{tag}>{marked[k]}</{tag.split()[0]}>"
        return " ".join(marked)

    def attrs(self, words: list[str]) -> str:
        if self.r.random() < 0.45:
            return self.r.choice(["", f' class="{self.word()}-{self.r.randrange(99)}"'])
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(words)}{self.r.choice(["", "", "-box", "_inner", "-1", " wide"])}"'

    def paragraph(self) -> str:
        """Main text, now and then with a named inline advert or note in it."""
        text = self.main(self.sentences(1, 7))
        if self.r.random() < 0.12:
            tag = self.r.choice(["span", "span", "a href='/b'", "em", "ins"])
            inline = f"<{tag} {self.r.choice(['class', 'class', 'id'])}='{self.r.choice(['ad', 'ads', 'advert', 'sponsored', 'promo', 'share', 'newsletter'])}{self.r.choice(['', '', '-1', '-inline', '_x'])}'>{self.words(2, 7)}</{tag.split()[0]}>"
            text = self.r.choice([f"{text} {inline}", f"{inline} {text}", f"{text} {inline} {self.main(self.sentences(1, 3))}"])
        return text

    def stray(self) -> str:
        """Loose text outside of any block: links, a slogan, a credit."""
        k = self.r.random()
        links = self.r.choice([" ", " | ", " &middot; "]).join(f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randrange(1, 6)))
        return links if k < 0.5 else self.words(1, 6).capitalize() if k < 0.8 else f"{links} {self.words(1, 5)}"

    def links(self, n: int, lo: int = 1, hi: int = 4) -> str:
        items = [f'<a href="/{self.word()}">{self.words(lo, hi)}</a>' for _ in range(n)]
        return self.r.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    def block(self, tags: list[str], words: list[str], body: str) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.attrs(words)}>{body}</{tag}>"

    def menu(self) -> str:
        return self.block(["nav", "nav", "div", "header"], ["nav", "menu", "topbar", "navbar"], self.links(self.r.randrange(3, 12)))

    def header(self) -> str:
        return self.block(["header", "header", "div"], ["header", "masthead", "banner"], f"<div>{self.words(1, 4)}</div><p>{self.words(2, 8)}</p>" + (self.links(4) if self.r.random() < 0.5 else ""))

    def footer(self) -> str:
        return self.block(["footer", "footer", "div"], ["footer", "copyright", "legal"], f"&copy; {self.word()} &middot; {self.sentences(1, 3)}" + (self.links(5) if self.r.random() < 0.5 else ""))

    def advert(self) -> str:
        return self.block(["div", "div", "aside", "p"], ["ad", "ads", "advert", "sponsor", "promo"], self.r.choice([self.sentences(1, 4), f"<a href='/b'>{self.words(3, 9)}</a>", f"<p>{self.sentences(1, 3)}</p>"]))

    def notice(self) -> str:
        return self.block(["div", "div", "section", "aside"], ["cookie", "consent", "notice", "alert", "popup", "newsletter"], f"<p>{self.sentences(1, 3)}</p>" + self.r.choice(["", "<button>OK</button>", f"<a href='/p'>{self.word()}</a>"]))

    def sidebar(self) -> str:
        body = f"<h3>{self.words(1, 3)}</h3>" + self.links(self.r.randrange(3, 9), 3, 9)
        return self.block(["aside", "aside", "div"], ["sidebar", "related", "widget", "recommended"], body + (f"<p>{self.sentences(1, 2)}</p>" if self.r.random() < 0.3 else ""))

    def form(self) -> str:
        return f"<form{self.attrs(['search', 'login', 'subscribe', 'respond'])}><label>{self.words(1, 4)}</label><p>{self.words(2, 9)}</p><input name=q><button>{self.word()}</button></form>"

    def comments(self) -> str:
        one = lambda: self.block(["div", "li", "article"], ["comment", "reply"], f"<div>{self.words(1, 3)}</div><p>{self.sentences(1, 5)}</p>")
        return f"<{(t := self.r.choice(['section', 'div', 'div']))} {self.r.choice(['id', 'class'])}=\"{self.r.choice(['comments', 'comment-list', 'discussion', 'replies', 'disqus_thread'])}\"><h3>{self.words(1, 3)}</h3>{''.join(one() for _ in range(self.r.randrange(1, 6)))}</{t}>"

    def article(self) -> str:
        r, parts = self.r, [f"<h1>{self.main(self.words(3, 12))}</h1>"] if self.r.random() < 0.85 else []
        short = r.random() < 0.25  # a line or two in all
        if short:
            parts = parts and [f"<h1>{self.main(self.words(1, 4))}</h1>"]
        for _ in range(1 if short else r.randrange(1, 12)):
            k = r.random()
            if short:
                parts.append(f"<p>{self.main(self.words(1, 6))}</p>")
                continue
            if k < 0.7:
                parts.append(f"<p>{self.paragraph()}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif k < 0.78:
                parts.append(f"<h2>{self.main(self.words(1, 7))}</h2>")
            elif k < 0.86:
                parts.append(f"<ul>{''.join(f'<li>{self.main(self.words(2, 14))}</li>' for _ in range(r.randrange(2, 6)))}</ul>")
            elif k < 0.9:
                parts.append(f"<blockquote><p>{self.main(self.sentences(1, 3))}</p></blockquote>")
            elif k < 0.94:
                parts.append(f"<table>{''.join(f'<tr><td>{self.main(self.words(1, 4))}</td><td>{self.main(self.words(1, 4))}</td></tr>' for _ in range(3))}</table>")
            elif k < 0.97:
                parts.append(f"<p><b>{self.main(self.sentences(1, 2))}<br>{self.main(self.sentences(1, 2))}")
            else:
                parts.append(self.advert())
        body = "".join(parts)
        if r.random() < 0.3:
            body = f"<div{self.attrs(['content', 'entry', 'text'])}>{body}</div>"
        elif r.random() < 0.1:  # no paragraphs, only line breaks
            body = "<br><br>".join(self.main(self.sentences(2, 7)) for _ in range(r.randrange(1, 6)))
        return self.block(["article", "article", "main", "div", "section"], ["content", "article", "post", "entry", "story"], body)

    def page(self) -> str:
        r = self.r
        before = [f() for f in (self.header, self.menu, self.advert, self.notice, self.form) if r.random() < 0.55]
        after = [f() for f in (self.sidebar, self.comments, self.form, self.advert, self.notice, self.sidebar) if r.random() < 0.45]
        r.shuffle(before)
        r.shuffle(after)
        loose = [self.stray() if r.random() < 0.25 else "" for _ in range(4)]
        before.insert(r.randrange(len(before) + 1), loose[0])
        after.insert(r.randrange(len(after) + 1), loose[1])
        middle = "".join([*before, loose[2] and f"{loose[2]}\n", self.article(), loose[3], *after])
        if r.random() < 0.4:
            middle = f"<div{self.attrs(['page', 'wrapper', 'container'])}>{middle}</div>"
        if r.random() < 0.8:
            middle += self.footer()
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{middle}</body></html>"


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, Callable[[str], bool]]]:
    """n pages, and what tells whether a piece of a page's text is main text. The words that mark it
    are part of the page's text in fitting; they change neither tags nor links nor punctuation."""
    rng = random.Random(seed)
    for _ in range(n):
        yield Maker(rng).page(), lambda piece: MARK in piece
