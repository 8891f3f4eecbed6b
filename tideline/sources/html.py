"""Text and links of HTML pages, with the standard library's parser inside Arrow batches."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROPPED = {"script", "style", "nav", "footer"}
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


#: An ampersand, with the reference that it begins if that one ends in a semicolon.
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


#: Titles and contexts of one page, in characters: nested anchors that are never closed hold each other's text over and over.
MOST_LINK_CHARS = 64 << 20


class _Element:
    """An open element: its tag, the number of strings before it, the anchor that it is, and the anchors whose parent it is."""

    __slots__ = ("anchor", "anchors", "before", "tag")

    def __init__(self, tag: str, before: int, anchor: dict | None):
        self.tag, self.before, self.anchor, self.anchors = tag, before, anchor, []


class _Reader(HTMLParser):
    """Collects the stripped strings of a page, and for each anchor its own strings and those of its parent element.

    The open elements are a stack with an index from tags to their places in it, so that an end tag finds its start at once and every
    element is closed once: the work follows the length of the page, however many elements stay open.
    """

    def __init__(self, dropped: set[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.silent = dropped, 0  # dropped elements that are open
        self.strings: list[str] = []
        self.open: list[_Element] = []
        self.places: dict[str, list[int]] = {}
        self.anchors: list[dict] = []
        self.top: list[dict] = []  # anchors without a parent element

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        anchor = None
        if tag == "a" and not self.silent and (href := dict(attrs).get("href")) is not None:
            parent = self.open[-1] if self.open else None
            anchor = {"href": href, "from": len(self.strings), "to": None, "parent_from": parent.before if parent else 0, "parent_to": None}
            self.anchors.append(anchor)
            (parent.anchors if parent else self.top).append(anchor)
        self.silent += tag in self.dropped
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(_Element(tag, len(self.strings), anchor))

    def handle_endtag(self, tag):
        if self.places.get(tag):
            self._close(self.places[tag][-1])

    def _close(self, depth: int) -> None:
        """Close all elements from this place on."""
        now = len(self.strings)
        while len(self.open) > depth:
            element = self.open.pop()
            self.places[element.tag].pop()
            self.silent -= element.tag in self.dropped
            if element.anchor:
                element.anchor["to"] = now
            for a in element.anchors:
                a["parent_to"] = now

    def handle_data(self, data):
        if not self.silent and (s := data.strip()):
            self.strings.append(s)

    def finish(self) -> None:
        self.close()
        self._close(0)
        for a in self.top:
            a["parent_to"] = len(self.strings)


def _read(html: str | None, dropped: set[str]) -> _Reader:
    reader = _Reader(dropped)
    reader.feed(html or "")
    reader.finish()
    return reader


def closed_only(html: str | None) -> str:
    """The page, in which ampersands that don't begin a reference with its semicolon stand for themselves: a parser would also read
    ``&amp`` that a cut has left without one."""
    known = lambda name: name and (name[0] == "#" or name in html5)
    return _REFERENCE.sub(lambda m: m[0] if known(m[1]) else "&amp;" + m[0][1:], html or "")


def page_text(html: str | None, max_chars: int = 12_000, *, open_references: bool = True) -> str:
    """The page's strings, stripped and joined by one space, without scripts, styles, navigation and footers; "" if it can't be read.

    References without their semicolon are read as HTML has it, or with ``open_references=False`` stay as they are written.
    """
    try:
        return " ".join(_read(html if open_references else closed_only(html), DROPPED).strings)[:max_chars]
    except Exception:  # noqa: BLE001  a page that can't be read has no text
        return ""


def page_links(html: str | None, base: str | None) -> list[tuple[str, str, str]]:
    """(absolute url, title, context) of each anchor with a target; the context is the text of the anchor's parent element."""
    reader = _read(html, {"script", "style"})
    ends = [0, *accumulate(len(s) + 1 for s in reader.strings)]
    size = sum(ends[a["to"]] - ends[a["from"]] + ends[a["parent_to"]] - ends[a["parent_from"]] for a in reader.anchors)
    if size > MOST_LINK_CHARS:
        raise ValueError(f"links with over {MOST_LINK_CHARS} characters of text")
    out = []
    for a in reader.anchors:
        context = " ".join(reader.strings[a["parent_from"] : a["parent_to"]])
        try:
            url = urljoin(base or "", a["href"])
        except ValueError:
            url = a["href"]
        out.append((url, " ".join(reader.strings[a["from"] : a["to"]]) or context, context))
    return out


def links_or_fault(html: str | None, base: str | None) -> dict:
    """The links of a page, or why it can't be read; one page never fails the others."""
    try:
        return {"links": [dict(zip(("url", "title", "context"), x)) for x in page_links(html, base)], "fault": None}
    except Exception as error:  # noqa: BLE001  whatever the parser raises is the page's fault
        return {"links": None, "fault": f"{type(error).__name__}: {str(error) or 'no reason given'}".splitlines()[0]}


def with_text(pages: DataFrame, html: str = "html", out: str = "text", max_chars: int = 12_000, *, open_references: bool = True) -> DataFrame:
    @F.pandas_udf("string")
    def texts(col: pd.Series) -> pd.Series:
        return col.map(lambda h: page_text(h, max_chars, open_references=open_references))

    return pages.withColumn(out, texts(F.col(html)))


def read(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` -> (page_url, links array<struct<url,title,context>>, fault), a row a page: either its links or why it can't be read."""

    @F.pandas_udf("links array<struct<url:string,title:string,context:string>>, fault string")
    def parsed(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([links_or_fault(x, y) for x, y in zip(h, u)], columns=["links", "fault"])

    return pages.select(F.col(url).alias("page_url"), parsed(F.col(html), F.col(url)).alias("p")).select("page_url", "p.links", "p.fault")


def links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` -> (page_url, url, title, context), a row an anchor; pages that can't be read have none, see ``faults``."""
    found = read(pages, html, url).select("page_url", F.explode("links").alias("a"))
    return found.select("page_url", "a.url", "a.title", "a.context")


def faults(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Violations (rule, entity, detail) of pages whose links can't be read."""
    found = read(pages, html, url).where(F.col("fault").isNotNull())
    return found.select(F.lit("unreadable_page").alias("rule"), F.col("page_url").alias("entity"), F.col("fault").alias("detail"))
