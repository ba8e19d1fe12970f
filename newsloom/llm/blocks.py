"""Leaf blocks of a web page: runs of text between block-level tags, with the elements that they stand in.

A page is read once from left to right, as a browser reads it: unclosed paragraphs, list items and cells end where
the next one begins, an end tag closes what it finds open, scripts and styles end at their own end tag, and a tag or a
comment that never ends takes the rest of the page. The work is linear in the page, whatever stands in it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

# Fixed values of HTML: elements that begin and end a block, that never have content, whose content is never shown, whose content holds no tags.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html"
    " legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("canvas datalist head iframe math noscript object script select style svg template textarea title video audio".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: An element ends an open one of its kind, unless one of these containers was opened in between.
SIBLINGS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "tr": ("tr", ("table",)), "tbody": ("tbody thead tfoot", ("table",)), "tfoot": ("tbody thead tfoot", ("table",)),
}

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+|["'])*+)(>|\Z)""")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)|'([^']*)|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ends = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW | UNSEEN}


@dataclass(slots=True)
class Element:
    """An open element: its features that no element around it has, its own features, and, filled in by the model, the score of all around it."""

    tag: str
    up: Element | None
    fresh: list[str]
    own: list[str]
    score: float | None = None


@dataclass(slots=True)
class Block:
    text: str
    at: Element
    link_chars: int
    after_title: bool


@dataclass(slots=True)
class _Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[Element] = field(default_factory=list)
    active: Counter = field(default_factory=Counter)
    open: Counter = field(default_factory=Counter)
    runs: list[str] = field(default_factory=list)
    link_chars: int = 0
    link: bool = False
    titled: bool = False

    def text(self, run: str) -> None:
        run = entities.unescape(run) if "&" in run else run
        self.runs.append(run)
        if self.link:
            self.link_chars += len(run)

    def flush(self) -> None:
        if self.runs:
            if text := " ".join("".join(self.runs).split()):
                self.blocks.append(Block(text, self.stack[-1], self.link_chars, self.titled))
            self.runs, self.link_chars = [], 0

    def push(self, tag: str, attributes: str) -> None:
        own = ["t:" + tag]
        for names in NAMES.findall(attributes) if attributes else ():
            for w in WORD.findall("".join(names)):
                w = w.lower()
                own += ["c:" + w, "s:" + w[:4]]
        own = list(dict.fromkeys(own))
        fresh = [f for f in own if not self.active[f]]
        self.active.update(own)
        self.open[tag] += 1
        self.stack.append(Element(tag, self.stack[-1] if self.stack else None, fresh, own))

    def pop(self) -> str:
        e = self.stack.pop()
        self.active.subtract(e.own)
        self.open[e.tag] -= 1
        self.titled |= e.tag == "h1"
        return e.tag

    def begin(self, tag: str, attributes: str) -> None:
        self.flush()
        if self.stack[-1].tag == "p":
            self.pop()
        kinds, walls = SIBLINGS.get(tag, ("", ()))
        for e in reversed(self.stack) if kinds else ():
            if e.tag in walls or e.up is None:
                break
            if e.tag in kinds.split():
                while self.stack[-1] is not e:
                    self.pop()
                self.pop()
                break
        self.push(tag, attributes)

    def end(self, tag: str) -> None:
        self.flush()
        if self.open[tag] and not (tag == "html" or tag == "body"):
            while self.pop() != tag:
                pass


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page that hold text, in page order; none for null. White space inside a block is one space, character references are decoded."""
    page, pos, html, endless = _Page(), 0, html or "", set()
    page.push("html", "")
    while (i := html.find("<", pos)) >= 0:
        if i > pos:
            page.text(html[pos:i])
        c = html[i + 1 : i + 2]
        if html.startswith("<!--", i):
            j = html.find("-->", i + 2)
            pos = len(html) if j < 0 else j + 3
            continue
        m = TAG.match(html, i)
        if not m:
            if c in ("!", "?", "/") and c:
                j = html.find(">", i)
                pos = len(html) if j < 0 else j + 1
            else:
                page.text("<")
                pos = i + 1
            continue
        pos, tag = m.end(), m[1].lower()
        if not m[3]:
            break
        if c == "/":
            if tag in BLOCK:
                page.end(tag)
            elif tag == "a":
                page.link = False
            elif tag == "br":
                page.text(" ")
        elif tag in BLOCK:
            if tag not in ("html", "body"):
                page.begin(tag, m[2])
        elif tag in UNSEEN or tag in RAW:
            if tag not in endless and (not m[2].endswith("/") or tag in RAW):
                e = _ends[tag].search(html, pos)
                if e or tag in RAW:
                    j = html.find(">", e.end()) if e else -1
                    pos = len(html) if j < 0 else j + 1
                else:  # never ended: what follows is part of the page
                    endless.add(tag)
        elif tag == "a":
            page.link = True
        elif tag == "br":
            page.text(" ")
        elif tag == "hr":
            page.flush()
    else:
        page.text(html[pos:])
    page.flush()
    return page.blocks
