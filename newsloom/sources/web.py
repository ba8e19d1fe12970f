"""Feeds, sitemaps, robots files and pages, from columns of fetched text.

Parsing one document is a small helper from the standard library; Spark deals out the documents and works on the
items. Malformed documents give no items.
"""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: bytes of a sitemap at most; a larger one gives no items.
LARGEST_SITEMAP = 25_000_000


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _root(xml: str | None):
    """The root element; none for what is no XML, or declares a document type or entities before it."""
    if not xml:
        return None
    first = re.search(r"<[A-Za-z_]", xml)
    if not first or re.search(r"<!(?:DOCTYPE|ENTITY)", xml[: first.start()], re.IGNORECASE):
        return None
    try:
        return ElementTree.fromstring(xml.strip())
    except ElementTree.ParseError:
        return None


def _time(s: str | None) -> datetime | None:
    """A date of a feed or sitemap, UTC if it names no zone."""
    if not s or not s.strip():
        return None
    for parse in (lambda x: datetime.fromisoformat(x.replace("Z", "+00:00")), parsedate_to_datetime):
        try:
            d = parse(s.strip())
            return (d if d.tzinfo else d.replace(tzinfo=UTC)).astimezone(UTC)
        except (ValueError, TypeError):
            continue
    return None


def feed_items(xml: str | None) -> list[dict]:
    """Items with a title and a link; the time of an update stands in for a missing one."""
    root, out = _root(xml), []
    for node in root.iter() if root is not None else ():
        if _local(node.tag) not in ("item", "entry"):
            continue
        kids: dict[str, list] = {}
        for k in node:
            kids.setdefault(_local(k.tag), []).append(k)
        said = lambda *names: next((t for n in names for k in kids.get(n, []) if (t := "".join(k.itertext()).strip())), None)  # noqa: B023, E731
        link = said("link") or next((k.get("href") for k in kids.get("link", []) if k.get("rel", "alternate") == "alternate" and k.get("href")), None)
        image = next((k.get("url") for n in ("content", "thumbnail", "enclosure") for k in kids.get(n, []) if k.get("url") and (n != "enclosure" or k.get("type", "image").startswith("image"))), None)
        if said("title") and link:
            out.append({"title": said("title"), "link": link, "summary": (said("description", "summary") or "")[:1000], "author": said("author", "creator"), "published": _time(said("pubDate", "published", "date")) or _time(said("updated")), "image": image})
    return out


ITEM = pa.struct([("title", pa.string()), ("link", pa.string()), ("summary", pa.string()), ("author", pa.string()), ("published", pa.timestamp("us", "UTC")), ("image", pa.string())])
ITEM_DDL = "array<struct<title:string,link:string,summary:string,author:string,published:timestamp,image:string>>"


def sitemap_entries(xml: str | None) -> list[dict]:
    """Locations and times, of pages or of further sitemaps."""
    root = None if not xml or len(xml) > LARGEST_SITEMAP or len(xml.encode()) > LARGEST_SITEMAP else _root(xml)
    if root is None or _local(root.tag) not in ("urlset", "sitemapindex"):
        return []
    kind, out = ("page" if _local(root.tag) == "urlset" else "sitemap"), []
    for node in root:
        kids = {_local(k.tag): (k.text or "").strip() for k in node}
        if kids.get("loc"):
            out.append({"kind": kind, "loc": kids["loc"], "lastmod": _time(kids.get("lastmod"))})
    return out


ENTRY = pa.struct([("kind", pa.string()), ("loc", pa.string()), ("lastmod", pa.timestamp("us", "UTC"))])


class Page(HTMLParser):
    """Title, meta data, paragraphs, links, images and linked data of a page."""

    TEXT, SKIP = {"p", "h1", "h2", "h3", "h4", "li"}, {"script", "style", "noscript", "nav", "footer", "aside", "form"}

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.blocks, self.links, self.images, self.data = "", {}, [], [], [], []
        self.open: list[str] = []
        self.held: list[str] | None = None
        self.script: list[str] | None = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault(a.get("property") or a.get("name") or "", a.get("content", ""))
        elif tag == "img":
            self.images.append((a.get("data-src") or a.get("src", ""), a.get("alt", "")))
        elif tag not in ("br", "hr", "input", "link"):
            self.open.append(tag)
            if tag == "a" and a.get("href"):
                self.links.append(a["href"])
            if tag in self.TEXT and not self.SKIP & set(self.open):
                self.held = []
            if tag == "script" and "ld+json" in a.get("type", ""):
                self.script = []

    def handle_endtag(self, tag):
        if tag in self.TEXT and self.held is not None:
            self.blocks.append((tag, " ".join("".join(self.held).split())))
            self.held = None
        if tag == "script" and self.script is not None:
            self.data.append("".join(self.script))
            self.script = None
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif self.held is not None:
            self.held.append(data)
        if self.open and self.open[-1] == "title":
            self.title += data

    def clean_text(self, least: int = 20) -> str:
        return "\n\n".join(t for _, t in self.blocks if len(t) >= least)


def _article_of(data: list[str], least: int = 200) -> dict | None:
    """The linked-data article with the longest body."""
    best = None
    for raw in data:
        try:
            todo = [json.loads(raw)]
        except ValueError:
            continue
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo += x
            elif isinstance(x, dict):
                todo += [v for k, v in x.items() if k == "@graph"]
                kinds = x.get("@type")
                body = x.get("articleBody")
                if isinstance(body, str) and len(body) >= least and any("Article" in str(k) for k in (kinds if isinstance(kinds, list) else [kinds])) and (best is None or len(body) > len(best["articleBody"])):
                    best = x
    return best


def extract(html: str | None, url: str | None = None) -> dict:
    """The best of the tiers: linked data if confident, then the paragraphs, then meta data."""
    page = Page(html or "")
    tiers = []
    if found := _article_of(page.data):
        score = min(0.95, 0.80 * bool(found.get("headline")) * 0.4375 + 0.45 + 0.10 * bool(found.get("datePublished")) + 0.05 * bool(found.get("author")) + 0.05 * bool(found.get("image")))
        tiers.append(("jsonld", round(score, 4), found.get("headline") or page.title, found["articleBody"]))
    h1 = next((t for tag, t in page.blocks if tag == "h1" and t), "")
    title = page.meta.get("og:title") or page.meta.get("twitter:title") or h1 or page.title.strip()
    text = page.clean_text()
    if text:
        tiers.append(("density", round(min(0.9, 0.30 * bool(title) + 0.40 * (len(text) >= 200) + 0.05 * bool(page.images)), 4), title, text))
    tiers.append(("meta", round(min(0.7, 0.25 * bool(title) + 0.30 * (len(text) >= 200)), 4), title, text or page.meta.get("description", "")))
    good = [t for t in tiers if t[1] >= 0.5]
    tier, confidence, title, text = good[0] if good else max(tiers, key=lambda t: (t[1], len(t[3])))
    image = next((urljoin(url or "", s) for s, _ in page.images if s), None)
    return {"tier": tier, "confidence": confidence, "title": title, "text": text, "image": image, "paragraphs": sum(tag == "p" for tag, _ in page.blocks)}


PAGE = pa.struct([("tier", pa.string()), ("confidence", pa.float64()), ("title", pa.string()), ("text", pa.string()), ("image", pa.string()), ("paragraphs", pa.int64())])
PAGE_DDL = "struct<tier:string,confidence:double,title:string,text:string,image:string,paragraphs:bigint>"


def parse_feed(xml: Column) -> Column:
    return F.arrow_udf(lambda x: pa.array([feed_items(s) for s in x.to_pylist()], pa.list_(ITEM)), ITEM_DDL)(xml)


def parse_sitemap(xml: Column) -> Column:
    return F.arrow_udf(lambda x: pa.array([sitemap_entries(s) for s in x.to_pylist()], pa.list_(ENTRY)), "array<struct<kind:string,loc:string,lastmod:timestamp>>")(xml)


def extract_page(html: Column, url: Column) -> Column:
    return F.arrow_udf(lambda h, u: pa.array([extract(a, b) for a, b in zip(h.to_pylist(), u.to_pylist(), strict=True)], PAGE), PAGE_DDL)(html, url)


def allowed(robots: Column, agent: Column, url: Column) -> Column:
    """Whether a robots text lets an agent fetch a URL; no text allows all."""

    def run(r: pa.Array, a: pa.Array, u: pa.Array) -> pa.Array:
        known: dict[str, RobotFileParser] = {}
        out = []
        for text, who, where in zip(r.to_pylist(), a.to_pylist(), u.to_pylist(), strict=True):
            if text not in known:
                known[text] = RobotFileParser()
                known[text].parse((text or "").splitlines())
            out.append(known[text].can_fetch(who or "*", where or ""))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")(robots, agent, url)


def listing_cards(pages: DataFrame, most: int = 50) -> DataFrame:
    """Links of a category page, absolute, in order, each once: (page_id, position, link)."""

    def links(h: pa.Array, u: pa.Array) -> pa.Array:
        out = []
        for html, url in zip(h.to_pylist(), u.to_pylist(), strict=True):
            out.append(list(dict.fromkeys(urljoin(url or "", x) for x in Page(html or "").links if not x.startswith(("#", "javascript:"))))[:most])
        return pa.array(out, pa.list_(pa.string()))

    return pages.select("page_id", F.posexplode(F.arrow_udf(links, "array<string>")("html", "url")).alias("position", "link"))
