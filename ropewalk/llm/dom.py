"""Pages as flat trees: elements and runs of inline text, in page order.

A forgiving reader of HTML: unclosed, misnested and cut tags are closed the way browsers do for paragraphs, list items,
table parts and headings; raw text (scripts, styles, titles), comments and form controls give no text. An inline run is a
node of its own and is one block of the page's text: character references are decoded, white space becomes one space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
MUTE = frozenset("select button datalist template svg canvas audio video object".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt
ruby s samp small span strike strong sub sup time tt u var math picture map""".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
WALLS = frozenset("html table td th caption marquee object template".split())  # end tags do not reach beyond
TABLE = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
#: start tag: (open elements it ends, elements it does not look beyond)
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "td": (frozenset(["td", "th"]), frozenset("tr table".split())),
    "th": (frozenset(["td", "th"]), frozenset("tr table".split())),
    "tr": (frozenset("tr caption colgroup".split()), frozenset(["table"])),
    **{t: (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"]))
       for t in ("thead", "tbody", "tfoot")},
}
NAMED = ("class", "id", "role", "itemprop", "itemtype", "aria-label", "rel", "property")

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)?+(?:\s*+(=)\s*+)?+")
BARE = re.compile(r"[^\s>]*+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in (*RAW, *MUTE)}
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Page:
    """Nodes in page order; ``end[i]`` is the node after the subtree of i. Text is "" for elements."""

    tags: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)   # characters of a run inside links
    strong: list[int] = field(default_factory=list)   # characters of a run inside emphasis
    extras: list[list[int]] = field(default_factory=list)  # images, controls, links of a node itself


def attribute_tokens(name: str, value: str) -> list[str]:
    return [f"@{w.lower()}" for w in CAMEL.findall(value)[:24] if len(w) > 1 or name == "role"]


class _Reader:
    def __init__(self, html: str):
        self.html = html
        self.page = Page()
        self.open: list[tuple[str, int]] = []  # tag and node (-1 for an inline element)
        self.inline_tokens: list[tuple[str, ...]] = []  # of the inline elements of this run
        self.pieces: list[str] = []
        self.links = self.emphasis = self.linked = self.strong = 0
        self.unclosed: set[str] = set()  # quotes that do not occur further on
        self.node("#page", ())

    def node(self, tag: str, tokens: tuple[str, ...], text: str = "") -> int:
        p, i, over = self.page, len(self.page.tags), self.top
        p.tags.append(tag)
        p.parent.append(over)
        p.end.append(i + 1)
        p.tokens.append(tokens)
        p.text.append(text)
        p.linked.append(0)
        p.strong.append(0)
        p.extras.append([0, 0, 0])
        return i

    @property
    def top(self) -> int:
        return next((n for _, n in reversed(self.open) if n >= 0), 0 if self.page.tags else -1)

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces.clear()
        if text:
            tokens = tuple(t for some in self.inline_tokens for t in some)
            i = self.node("#text", tokens, text)
            self.page.linked[i], self.page.strong[i] = min(self.linked, len(text)), min(self.strong, len(text))
        self.inline_tokens.clear()
        self.linked = self.strong = 0

    def say(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        if self.open and self.open[-1][0] == "head" and text.strip():
            self.pop(len(self.open) - 1)
        self.pieces.append(text)
        if self.links:
            self.linked += len(text)
        if self.emphasis:
            self.strong += len(text)

    def pop(self, to: int) -> None:
        """Close the open elements from place ``to`` on."""
        if any(n >= 0 for _, n in self.open[to:]):
            self.flush()
        while len(self.open) > to:
            self.close(*self.open.pop())

    def close(self, tag: str, node: int) -> None:
        if node >= 0:
            self.page.end[node] = len(self.page.tags)
        elif tag == "a":
            self.links -= 1
        elif tag in ("b", "strong", "em", "i"):
            self.emphasis -= 1

    def find(self, tags: frozenset[str], walls: frozenset[str]) -> int:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                return i
            if self.open[i][0] in walls:
                return -1
        return -1

    def start(self, tag: str, tokens: tuple[str, ...], hidden: bool) -> None:
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.pop(len(self.open) - 1)
        if tag in ("html", "body") and any(t == tag for t, _ in self.open):
            return
        if tag in CLOSES_P:
            at = self.find(frozenset(["p"]), WALLS)
            if at >= 0:
                self.pop(at)
        if tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.pop(len(self.open) - 1)
        if tag in ENDS:
            at = self.find(*ENDS[tag])
            if at >= 0:
                self.pop(at)
        if tag == "a":  # links do not nest
            at = self.find(frozenset(["a"]), WALLS)
            if at >= 0:
                self.close(*self.open.pop(at))
        if tag == "br":
            self.pieces.append(" ")
        elif tag == "hr":
            self.flush()
        elif tag == "img" or tag == "input":
            self.page.extras[self.top][tag == "input"] += 1
        if tag in VOID:
            return
        if tag in INLINE:
            self.open.append((tag, -1))
            if tag == "a":
                self.links += 1
                self.page.extras[self.top][2] += 1
            elif tag in ("b", "strong", "em", "i"):
                self.emphasis += 1
            if tokens or hidden:
                self.inline_tokens.append(tokens + (("@hidden",) if hidden else ()))
        else:
            self.flush()
            self.open.append((tag, self.node(tag, tokens + (("@hidden",) if hidden else ()))))

    def stop(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if tag == "br":
            self.pieces.append(" ")
            return
        walls = frozenset(["html", "table"]) if tag in TABLE else WALLS
        at = self.find(HEADINGS if tag in HEADINGS else frozenset([tag]), walls - {tag})
        if at < 0:
            if tag == "p":  # stands for an empty paragraph
                self.flush()
            return
        if tag in INLINE:  # blocks opened inside stay open
            self.close(*self.open.pop(at))
        else:
            self.pop(at)

    def attributes(self, at: int) -> tuple[int, tuple[str, ...], bool]:
        """Tokens of the attributes from ``at`` on, and the place after the tag (-1 if the page ends in it)."""
        html, tokens, hidden = self.html, [], False
        while True:
            m = ATTRIBUTE.match(html, at)
            at = m.end()
            name, value = (m[1] or "").lower(), ""
            if at >= len(html):
                return -1, (), False
            if m[2]:
                quote = html[at]
                stop = -1
                if quote in "\"'" and quote not in self.unclosed:
                    stop = html.find(quote, at + 1)
                    if stop < 0:
                        self.unclosed.add(quote)
                if stop >= 0:
                    value, at = html[at + 1:stop], stop + 1
                else:
                    b = BARE.match(html, at)
                    value, at = b[0], b.end()
            if name in NAMED:
                tokens += attribute_tokens(name, value)
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                    name == "style" and "display:none" in value.replace(" ", "").lower()):
                hidden = True
            if at < len(html) and html[at] == ">":
                return at + 1, tuple(tokens), hidden
            if not name and not m[2]:  # a stray mark
                at += 1

    def read(self) -> Page:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.say(html[at:])
                break
            if lt > at:
                self.say(html[at:lt])
            c = html[lt + 1:lt + 2]
            if c == "!" and html.startswith("<!--", lt):
                if html.startswith((">", "->"), lt + 4):
                    at = html.find(">", lt) + 1
                    continue
                stop = html.find("-->", lt + 4)
                at = n if stop < 0 else stop + 3
            elif c in ("!", "?") or (c == "/" and not html[lt + 2:lt + 3].isalpha()):
                if c == "/" and lt + 2 >= n:
                    self.say("</")
                    break
                stop = html.find(">", lt)
                at = n if stop < 0 else stop + 1
            elif c == "/":
                m = NAME.match(html, lt + 2)
                if not m:
                    at = lt + 2
                    continue
                stop = html.find(">", m.end())
                at = n if stop < 0 else stop + 1
                if stop >= 0:
                    self.stop(m[0].lower())
            elif m := NAME.match(html, lt + 1):
                tag = m[0].lower()
                at, tokens, hidden = self.attributes(m.end())
                if at < 0:
                    break
                if tag == "svg" and html[at - 2] == "/":
                    continue
                if tag in RAW or tag in MUTE:
                    if tag not in IN_HEAD and self.open and self.open[-1][0] == "head":
                        self.pop(len(self.open) - 1)
                    self.page.extras[self.top][1] += tag in ("textarea", "select", "button")
                    stop = RAW_END[tag].search(html, at)
                    if stop is None:
                        at = n if tag in RAW else at
                        continue
                    close = html.find(">", stop.end())
                    at = n if close < 0 else close + 1
                else:
                    self.start(tag, tokens, hidden)
            else:
                self.say("<")
                at = lt + 1
        self.pop(0)
        self.flush()
        self.page.end[0] = len(self.page.tags)
        return self.page


def parse(html: str | None) -> Page:
    return _Reader(html or "").read()
