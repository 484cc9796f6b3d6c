"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A leaf block is a maximal stretch of text without a block-level tag inside. Its features are the tags, classes, ids and roles of
its ancestors, its own tag, its length, sentences, share of link text, last character and place, and lengths and link shares of its
neighbours. The field has two labels (article, other); it is trained on labelled pages that `labelled_pages` makes from a fixed
seed (PAGES of them: layouts with menus, headers, footers, side bars, notices, adverts, forms and comments before, after and inside
the article; half of them name nothing, name things in other words, by roles or by opaque names, or are laid out by divisions or
tables alone), by Adam on the exact likelihood (forward-backward), and a page is decoded by Viterbi.

Scripts, styles, comments and other text that is never shown are dropped by the parser; character references are decoded.
White space inside a block becomes one space, blocks are joined by one space in page order. Null and empty pages give an
empty text. Pages are read whole; repeated rows are read each by itself. A page without any article block gives "".
"""
from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

PAGES = 900  # labelled pages
SIZE = 1 << 13  # hashed features
# fixed values: tags that begin a new block, that never show text, and that hold nothing
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td
textarea tfoot th thead title tr ul video""".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas head title datalist".split())
IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template".split())  # anything else ends the head
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCK - frozenset("button caption label legend option select summary textarea title td th tr tbody thead tfoot".split())
LEAVES_SVG = BLOCK - frozenset("title desc".split()) | frozenset("b big br center code em font i img s small span strong sub sup tt u".split())  # ends svg and math
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table select html body div article section main aside nav form".split())
_TOKEN = re.compile("[a-z]+")
_SENTENCE = re.compile(r"[.!?…](?:\s|$)")


class Block:
    __slots__ = ("text", "link", "around", "tag")

    def __init__(self, text: str, link: int, around: list[str], tag: str) -> None:
        self.text, self.link, self.around, self.tag = text, link, around, tag


class _Leaves(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, list[str]]] = []
        self.count: dict[str, int] = {}  # of what the open elements are called
        self.hidden = self.links = 0
        self.parts: list[str] = []
        self.link_chars = 0

    def _push(self, tag: str, names: list[str]) -> None:
        self.open.append((tag, names))
        for n in names:
            self.count[n] = self.count.get(n, 0) + 1
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def _pop(self) -> str:
        tag, names = self.open.pop()
        for n in names:
            self.count[n] -= 1
            if not self.count[n]:
                del self.count[n]
        self.hidden -= tag in HIDDEN
        self.links -= tag == "a"
        return tag

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag = next((t for t, _ in reversed(self.open) if t in BLOCK), "")
                self.blocks.append(Block(text, self.link_chars, list(self.count), tag))
            self.parts, self.link_chars = [], 0

    def _close(self, tags: set[str], scope: frozenset[str]) -> None:
        """Ends the innermost open element of these tags, unless an element of `scope` stands in between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in scope:
                return

    def _end_head(self) -> None:
        """Both </head> and <body> may be left out: what can't stand in a head ends it, unless inside one of its elements."""
        if self.open and self.open[-1][0] == "head":
            self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in LEAVES_SVG and (self.count.get("t=svg") or self.count.get("t=math")) and not self.count.get("t=foreignobject"):
            self._close({"svg", "math"}, frozenset())
        if tag in BLOCK:
            self.flush()
            if tag in ENDS_P and self.count.get("t=p"):
                self._close({"p"}, _SCOPE)
            if tag in SAME:
                self._close(SAME[tag], _SCOPE - SAME[tag])
            if tag == "body":
                self._close({"head"}, frozenset())
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        names = [f"t={tag}"]
        for k, v in attrs:
            if k in ("class", "id", "role", "itemprop") and v:
                names += [f"c={w}" for w in dict.fromkeys(_TOKEN.findall(v.lower()))]
        self._push(tag, names)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "iframe", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.count.get(f"t={tag}"):
            self._close({tag}, frozenset())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """As in browsers, a comment up to the next '>', whatever the keyword; inside svg and math CDATA up to ']]>'."""
        if self.rawdata.startswith("<![CDATA[", i) and (self.count.get("t=svg") or self.count.get("t=math")):
            end = self.rawdata.find("]]>", i)
            return end + 3 if end >= 0 else -1
        return self.parse_bogus_comment(i, report)

    def handle_data(self, data: str) -> None:
        if self.hidden and data.strip():
            self._end_head()
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)


def leaf_blocks(page: str) -> list[Block]:
    p = _Leaves()
    p.feed(page)
    if p.rawdata.startswith("<!--"):  # a comment that never ends
        p.rawdata = ""
    p.close()
    p.flush()
    return p.blocks


def features(blocks: list[Block]) -> list[np.ndarray]:
    """Hashed features of each block of one page."""
    words = [min(6, (b.text.count(" ") + 1).bit_length()) for b in blocks]
    link = [min(4, 4 * b.link // max(1, len(b.text))) for b in blocks]
    out = []
    for k, b in enumerate(blocks):
        n, a = words[k], link[k]
        ends = b.text[-1] in ".!?…\"”»"
        sentences = min(3, len(_SENTENCE.findall(b.text)))
        near = [(words[j], link[j]) if 0 <= j < len(blocks) else (0, 9) for j in (k - 1, k + 1)]
        names = ["bias", f"l={b.tag}", f"n={n}", f"a={a}", f"e={ends}", f"s={sentences}", f"first={k == 0}", f"last={k == len(blocks) - 1}", f"o={b.text[0] in '©|»›'}", *b.around]
        names += [f"l={b.tag} n={n}", f"n={n} e={ends} a={a}", f"s={sentences} a={a > 1}"]
        names += [f"{side}n={x}" for side, (x, _) in zip("pq", near)] + [f"{side}a={y} a={a}" for side, (_, y) in zip("pq", near)]
        out.append(np.fromiter(dict.fromkeys(zlib.crc32(x.encode()) % SIZE for x in names), dtype=np.int64))
    return out


class Field:
    """Two labels (0 other, 1 article): weights of features per label, of label pairs, and of the first label."""

    def __init__(self) -> None:
        self.w = {"unary": np.zeros((SIZE, 2)), "pair": np.zeros((2, 2)), "first": np.zeros(2)}

    def scores(self, x: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w["unary"][f].sum(axis=0) for f in x])

    def viterbi(self, x: list[np.ndarray]) -> np.ndarray:
        u, pair = self.scores(x).tolist(), self.w["pair"].tolist()
        a, b = u[0][0] + self.w["first"][0], u[0][1] + self.w["first"][1]
        back = []
        for p, q in u[1:]:
            from0, from1 = (a + pair[0][0], b + pair[1][0]), (a + pair[0][1], b + pair[1][1])
            back.append((from0[1] > from0[0], from1[1] > from1[0]))
            a, b = max(from0) + p, max(from1) + q
        y = [int(b > a)]
        for step in reversed(back):
            y.append(int(step[y[-1]]))
        return np.array(y[::-1])

    def _gradient(self, x: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the negative log likelihood of one page."""
        u, pair, n = self.scores(x), self.w["pair"], len(x)
        f, b = np.empty((n, 2)), np.zeros((n, 2))
        f[0] = u[0] + self.w["first"]
        for k in range(1, n):
            f[k] = np.logaddexp(f[k - 1][0] + pair[0], f[k - 1][1] + pair[1]) + u[k]
        for k in range(n - 2, -1, -1):
            t = u[k + 1] + b[k + 1]
            b[k] = np.logaddexp(pair[:, 0] + t[0], pair[:, 1] + t[1])
        z = np.logaddexp(*f[-1])
        node = np.exp(f + b - z)
        node[np.arange(n), y] -= 1
        g = {"unary": np.zeros_like(self.w["unary"]), "pair": np.zeros((2, 2)), "first": node[0]}
        for k, features_ in enumerate(x):
            g["unary"][features_] += node[k]
        if n > 1:
            g["pair"] = np.exp(f[:-1, :, None] + pair[None] + (u + b)[1:, None, :] - z).sum(axis=0)
            np.add.at(g["pair"], (y[:-1], y[1:]), -1)
        return g

    def train(self, pages: list[tuple[list[np.ndarray], np.ndarray]], epochs: int = 3, rate: float = 0.05, ridge: float = 1e-4, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // 10)):
                t += 1
                all_ = [self._gradient(*pages[i]) for i in part]
                for k in self.w:
                    g = sum(a[k] for a in all_) / len(part) + ridge * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


# --- labelled pages ---------------------------------------------------------------------------------------------------

MARK = "\ue000"  # begins each article block of a labelled page


def labelled_pages(n: int = PAGES, seed: int = 17) -> Iterator[str]:
    """Pages whose article blocks begin with MARK."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    maybe = lambda p: rng.random() < p
    word = lambda: "".join(pick("an", "th", "ti", "on", "re", "sh", "er", "ing", "ou", "ent", "é", "de", "lo", "ß", "ó", "ver") for _ in range(rng.integers(1, 5)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    line = lambda a, b: words(a, b).capitalize() + pick(".", ".", ".", "!", "?", "", ",")
    prose = lambda: " ".join(line(1, 18) for _ in range(rng.integers(1, 6)))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def box(names: tuple, tags: tuple = ("div", "section", "aside", "div")) -> tuple[str, str]:
        tag = pick(*tags)
        return f'<{tag} {pick("class", "class", "id")}="{pick(*names)}">', f"</{tag}>"

    def other() -> str:
        kind = rng.integers(13)
        if kind == 0:
            a, b = pick(("<nav>", "</nav>"), box(("menu", "nav", "navbar", "main-menu", "topnav")))
            return a + links(rng.integers(3, 9)) + b
        if kind == 1:
            a, b = box(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-box", "banner"))
            return a + pick(line(2, 14), prose(), f"<p>{line(3, 12)}</p>") + b
        if kind == 2:
            a, b = pick(("<aside>", "</aside>"), box(("sidebar", "related", "side", "widget", "see-also")))
            return a + pick(f"<h3>{words(1, 4)}</h3>", "") + pick(links(rng.integers(2, 6)), f"<p>{prose()}</p>") + b
        if kind == 3:
            a, b = box(("cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "notification", "popup", "modal", "banner"))
            return a + f"<p>{prose()}</p>" + pick(f"<button>{words(1, 3)}</button>", "") + b
        if kind == 4:
            fields = "".join(f"<label>{words(1, 3)} <input name='{word()}'></label>" for _ in range(rng.integers(1, 4)))
            return f"<form action='/{word()}'><p>{line(2, 10)}</p>{fields}<button>{words(1, 2)}</button></form>"
        if kind in (5, 6):
            a, b = box(("comments", "comment-list", "reader-comments", "disqus", "responses", "discussion"), ("section", "div", "ol"))
            each = lambda: pick(f'<div class="comment"><b>{word()}</b><p>{prose()}</p></div>', f'<article class="comment"><p>{prose()}</p></article>',
                                f'<li class="comment"><p>{prose()}</p></li>', f"<p>{prose()}</p>")
            return a + pick(f"<h2>{words(1, 3)}</h2>", "") + "".join(each() for _ in range(rng.integers(1, 5))) + b
        if kind == 7:
            a, b = box(("share", "social", "newsletter", "subscribe", "signup", "tags", "breadcrumb", "breadcrumbs", "author-bio", "pagination"))
            return a + pick(links(3), f"<p>{line(2, 12)}</p>", f"<p>{prose()}</p>") + b
        if kind == 8:
            return f"<footer>&copy; {words(1, 4)} &middot; {line(1, 12)}" + pick("", links(3), f"<p>{prose()}</p>") + "</footer>"
        if kind == 9:
            return f"<header><h1>{words(1, 4)}</h1>" + pick("", f"<p>{line(2, 10)}</p>", links(4)) + "</header>"
        if kind == 10:
            a, b = box(("footer", "site-footer", "header", "site-header", "masthead", "copyright", "legal", "disclaimer"))
            return a + pick(f"<p>{prose()}</p>", line(2, 14)) + b
        if kind == 11:
            return f"<script>var t='<p>{words(2, 6)}</p>';</script><style>p{{margin:0}}</style><!-- {words(1, 4)} -->"
        return f"<ul>{''.join(f'<li><a href=#>{word()}</a></li>' for _ in range(4))}</ul>"

    # what is made of a page's names: kept, other words, roles, opaque names, no names
    groups = {
        "menu": ("menu nav navbar main-menu topnav breadcrumb breadcrumbs share social tags pagination", "navigation topbar links linklist toolbar subnav menubar crumbs", "navigation"),
        "main": ("content post entry-content article-body story main-content post-body text", "main maincontent primary page body article center wrap copy entry col-main document", "main"),
        "foot": ("footer site-footer copyright legal disclaimer", "bottom foot colophon credits imprint subfooter", "contentinfo"),
        "head": ("header site-header masthead", "top banner brand logo title-bar hero", "banner"),
        "side": ("sidebar related side widget see-also", "rail right left secondary extra aside col-side", "complementary"),
    }
    group_of = {old: g for g, (names, _, _) in groups.items() for old in names.split()} | {"nav": "menu", "article": "main", "footer": "foot", "aside": "side"}
    shells = ("nav", "article", "main", "footer", "header", "aside", "section")

    def renamed(page: str) -> str:
        """The page with its telling names and tags replaced."""
        way = pick("words", "words", "roles", "opaque", "none")
        opaque: dict[str, str] = {}

        def call(group: str | None) -> str:
            if way == "words" and group:
                return f' {pick("id", "id", "class")}="{pick(*groups[group][1].split())}"'
            if way == "roles" and group:
                return f' role="{groups[group][2]}"'
            if way == "opaque" or (way == "words" and maybe(0.3)):
                name = opaque.setdefault(group or "", "".join(pick(*"abcdefghjkmnpqrstvwxyz") for _ in range(rng.integers(1, 7))) + pick("", "-1", "_x", "9"))
                return f' class="{name}"'
            return ""

        page = re.sub(r' (?:class|id)="([^"]*)"', lambda m: call(group_of.get(m[1])), page)
        for tag in shells:
            g = "main" if tag in ("article", "main") else group_of.get(tag) or ("head" if tag == "header" else None)
            page = re.sub(rf"<{tag}>", lambda m: f"<div{call(g)}>", re.sub(rf"</{tag}>", "</div>", re.sub(rf"<{tag} ", "<div ", page)))
        return page

    def plain_other() -> str:
        """Parts that can be told without names: links, short lines, forms, footers."""
        kind = rng.integers(8)
        if kind <= 1:
            a, b = pick(("<nav>", "</nav>"), box(tuple(groups["menu"][0].split()), ("div", "ul", "div")))
            return a + pick(links(rng.integers(2, 9)), " ".join(f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.integers(2, 7))),
                            " | ".join(f'<a href="/{word()}">{words(1, 2)}</a>' for _ in range(rng.integers(3, 7)))) + b
        if kind == 2:
            a, b = pick(("<footer>", "</footer>"), box(tuple(groups["foot"][0].split()), ("div",)))
            return a + pick("&copy; ", "Copyright ", "") + words(1, 5) + pick("", " 20" + str(rng.integers(10, 30)), links(3)) + b
        if kind == 3:
            a, b = pick(("<header>", "</header>"), box(tuple(groups["head"][0].split()), ("div",)))
            return a + pick(f"<a href='/'>{words(1, 3)}</a>", f"<h1><a href='/'>{words(1, 3)}</a></h1>", words(1, 3), links(4)) + b
        if kind == 4:
            a, b = pick(("<aside>", "</aside>"), box(tuple(groups["side"][0].split()), ("div",)))
            return a + pick(f"<h3>{words(1, 3)}</h3>", "") + links(rng.integers(2, 7)) + b
        if kind == 5:
            return f"<form action='/{word()}'><label>{words(1, 3)} <input name='{word()}'></label><button>{words(1, 2)}</button></form>"
        if kind == 6:
            return f"<div><a href='/{word()}'>{words(1, 4)}</a></div>"
        return f"<script>var t='<p>{words(2, 6)}</p>';</script><style>p{{margin:0}}</style><!-- {words(1, 4)} -->"

    for _ in range(n):
        def keep(text: str) -> str:
            return MARK + html.escape(text, quote=False)

        def part(deep: float) -> str:
            kind = rng.integers(9)
            if kind <= 4:
                text = keep(pick(prose(), prose(), line(1, 3), words(1, 2)))
                return pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<div><p>{text}</p></div>")
            if kind == 5:
                h = pick("h2", "h3")
                return f"<{h}>{keep(words(1, 7))}</{h}>"
            if kind == 6:
                tag = pick("ul", "ol")
                return f"<{tag}>" + "".join(f"<li>{keep(line(1, 12))}</li>" for _ in range(rng.integers(2, 5))) + f"</{tag}>"
            if kind == 7:
                return pick(f"<blockquote>{keep(prose())}</blockquote>", f"<pre>{keep(words(2, 12))}</pre>", f"<table><tr><td>{keep(words(1, 4))}</td><td>{keep(words(1, 4))}</td></tr></table>",
                            f"<p>{keep(words(1, 5))} <a href='/x'>{html.escape(words(1, 3))}</a></p>")
            return other() if maybe(deep) else f"<p>{keep(prose())}</p>"

        if maybe(0.5):  # a page without telling names, or laid out by a table
            sentences = lambda: " ".join(words(5, 18).capitalize() + pick(".", ".", ".", "!", "?") for _ in range(rng.integers(1, 6)))
            text = "".join(pick(f"<p>{keep(sentences())}</p>", f"<p>{keep(sentences())}", f"<p>{keep(sentences())}</p>", f"<p>{keep(sentences())} <a href='/x'>{words(1, 3)}</a></p>" + f"<p>{keep(sentences())}</p>",
                                f"<h2>{keep(words(2, 7))}</h2><p>{keep(sentences())}</p>", f"<div>{keep(sentences())}</div>",
                                "<ul>" + "".join(f"<li>{keep(words(4, 12).capitalize() + '.')}</li>" for _ in range(rng.integers(2, 5))) + f"</ul><p>{keep(sentences())}</p>")
                           for _ in range(rng.integers(1, 9)))
            title = pick(f"<h1>{keep(words(2, 9))}</h1>", "")
            some = lambda a, b: "".join(plain_other() for _ in range(rng.integers(a, b)))
            if maybe(0.2):
                left, right = pick((some(1, 3), ""), (some(1, 3), some(0, 2)), ("", some(1, 3)))
                body = "<table>" + pick("", f"<tr><td>{some(1, 2)}</td></tr>") + f"<tr><td>{left}</td><td>{title}{text}</td><td>{right}</td></tr></table>" + some(0, 2)
            else:
                a, b = pick(("<article>", "</article>"), ("<main>", "</main>"), box(tuple(groups["main"][0].split()), ("div",)), ("<div>", "</div>"), ("", ""))
                body = pick("", "<div>") + some(0, 4) + a + title + text + b + some(0, 4)
            yield f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title></head><body>{renamed(body)}" + pick("</body></html>", "")
            continue
        before = "".join(other() for _ in range(rng.integers(0, 4)))
        a, b = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
                    box(("content", "post", "entry-content", "article-body", "story", "main-content", "post-body", "text"), ("div", "section", "div")))
        body = a + pick(f"<h1>{keep(words(2, 10))}</h1>", f"<h1>{keep(line(2, 10))}</h1>", "") + "".join(part(0.7) for _ in range(rng.integers(1, 12)))
        body += (other() if maybe(0.25) else "") + b
        after = "".join(other() for _ in range(rng.integers(0, 4)))
        page = f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title></head><body>{before}{body}{after}" + pick("</body></html>", "")
        yield page


def labelled_blocks(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a labelled page without the marks, and their labels."""
    blocks = leaf_blocks(page)
    labels = np.array([b.text.startswith(MARK) for b in blocks], dtype=int)
    for b in blocks:
        b.text = b.text.removeprefix(MARK)
    return blocks, labels


@functools.lru_cache(maxsize=1)
def trained() -> Field:
    field, pages = Field(), []
    for page in labelled_pages():
        blocks, labels = labelled_blocks(page)
        if blocks:
            pages.append((features(blocks), labels))
    field.train(pages)
    return field


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    return " ".join(b.text for b, y in zip(blocks, field.viterbi(features(blocks))) if y)


def extract(pages: DataFrame, html_column: str = "html", text: str = "text") -> DataFrame:
    """All rows with their columns but the html, and `text` in place of a column of that name."""
    keep = [c for c in pages.columns if c not in (html_column, text)]
    rows = pages.select(F.struct(*keep).alias("row") if keep else F.lit(None).alias("row"), F.col(html_column).cast("string").alias("html"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                found = [main_text(x.as_py() or "", field) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.string())], ["row", "text"])

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col("row")[c].alias(c) for c in keep), F.col("text").alias(text))
