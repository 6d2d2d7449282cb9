"""Pages as columns: one pass of Python's own HTML parser over Arrow batches; every later rule is a Column expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SHAPE = (
    "url string, page_title string, raw_title string, tags array<struct<text: string, href: string>>, lines array<string>, links array<string>, iframes array<string>, "
    "vimeo_ids array<string>, images array<struct<at: int, raw: string, src: string, original: boolean>>, parts array<struct<kind: string, key: string, first: int, last: int>>"
)


@dataclass(frozen=True)
class PageLayout:
    """Class names of a page's parts. slideshow: start of the ids of projects' slideshows; thumb, active: class names of the
    project that is shown, whose id is that of its slideshow after 'item_'. containers: selectors ('.class' or a tag) of
    where images are if there is no such slideshow."""

    title: str = "project_title"
    tags: str = "tags"
    content: str = "project_content"
    slideshow: str = "slideshow_container"
    thumb: str = "project_thumb"
    active: str = "active"
    containers: tuple[str, ...] = (".project_content", ".slide_content", ".content_inner", "article", "main")


class _Page(HTMLParser):
    def __init__(self, url: str, layout: PageLayout, join: Callable[[str, str], str]):
        super().__init__(convert_charrefs=True)
        self.url, self.layout, self.join = url, layout, join
        self.shown = re.compile(f"{re.escape(layout.thumb)}.*{re.escape(layout.active)}")
        self.open: list[tuple[str, str, list[dict]]] = []  # tag, part of the layout, and what ends with it
        self.at, self.parts = 0, []  # start tags so far; elements of interest by the first and last start tag within
        self.page_title: list[str] = []
        self.raw_title: list[str] = []
        self.tags: list[list[str]] = []
        self.content: list[str] = []
        self.links: list[str] = []
        self.iframes: list[str] = []
        self.vimeo: list[str] = []
        self.images: list[tuple[int, str, str, bool]] = []
        self.seen: set[str] = set()  # kinds of parts so far

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are not asked for."""
        return j

    def within(self, part: str) -> bool:
        return any(p == part for _, p, _ in self.open)

    def marked(self, tag: str, names: list[str], id_: str) -> list[dict]:
        """The shown project's thumb, slideshows, and the first element of each selector."""
        layout, found = self.layout, []
        if names and self.shown.search(" ".join(names)):
            found.append(("thumb", id_))
        if id_ and f"{layout.slideshow}_" in id_:
            found.append(("slides", id_))
        found += [(s, "") for s in layout.containers if (s[1:] in names if s[0] == "." else s == tag) and s not in self.seen]
        self.seen.update(kind for kind, _ in found)
        return [{"kind": kind, "key": key, "first": self.at, "last": self.at} for kind, key in found]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        names, own = a.get("class", "").split(), ""
        self.at += 1
        ends = self.marked(tag, names, a.get("id", ""))
        self.parts += ends
        if tag == "div" and self.layout.title in names and not self.raw_title:
            own = "title"
        elif tag == "span" and self.layout.tags in names:
            own = "tags"
        elif self.layout.content in names:
            own = "content"
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
            if self.within("tags"):
                self.tags.append(["", a["href"]])
                own = "tag"
        if tag == "iframe" and a.get("src"):
            self.iframes.append(a["src"])
        if a.get("data-vimeo-id"):
            self.vimeo.append(a["data-vimeo-id"])
        if tag == "img":
            src = a.get("src_o") or a.get("data-src") or a.get("src") or ""
            if src:
                self.images.append((self.at, src, self.join(self.url, src), bool(a.get("src_o"))))
        if tag not in VOID:
            self.open.append((tag, own, ends))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.shut(i)
                break

    def shut(self, i: int) -> None:
        """Ends the open elements from the i-th on."""
        for _, _, ends in self.open[i:]:
            for part in ends:
                part["last"] = self.at
        del self.open[i:]

    def handle_data(self, data: str) -> None:
        inner = self.open[-1][0] if self.open else ""
        if inner == "title":
            self.page_title.append(data)
        if self.within("title"):
            self.raw_title.append(data)
        if self.within("tag") and self.tags:
            self.tags[-1][0] += data
        if self.within("content") and inner not in ("script", "style"):
            self.content.append(data)

    def row(self) -> tuple:
        self.shut(0)
        lines = [x.strip() for x in "\n".join(self.content).split("\n")]
        return (
            self.url, "".join(self.page_title).strip(), "".join(self.raw_title).strip(), [{"text": t.strip(), "href": h} for t, h in self.tags],
            [x for x in lines if x], self.links, self.iframes, self.vimeo, [{"at": i, "raw": r, "src": s, "original": o} for i, r, s, o in self.images], self.parts,
        )


def parse_page(url: str, html: str, layout: PageLayout, join: Callable[[str, str], str] = urljoin) -> tuple:
    page = _Page(url or "", layout, join)
    page.feed(html or "")
    page.close()
    return page.row()


def parse_pages(pages: DataFrame, layout: PageLayout | None = None) -> DataFrame:
    """One row for each page (url, html): its titles, tags, content lines, links, iframes, video ids, images and the
    parts that images can be in. at, first and last number the page's start tags: an image is in a part if its number is
    above first and not above last."""
    layout = layout or PageLayout()
    text = pa.string()
    types = [text, text, text, pa.list_(pa.struct([("text", text), ("href", text)])), *[pa.list_(text)] * 4, pa.list_(pa.struct([("at", pa.int32()), ("raw", text), ("src", text), ("original", pa.bool_())]))]
    types.append(pa.list_(pa.struct([("kind", text), ("key", text), ("first", pa.int32()), ("last", pa.int32())])))
    names = [re.split(r"\s", x.strip())[0] for x in re.split(r",(?![^<]*>)", SHAPE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lru_cache(1 << 12)(urljoin)  # made by the task: a cache of a module does not travel with its functions
        for batch in batches:
            rows = [parse_page(u, h, layout, join) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return pages.select(F.col("url"), F.col("html")).mapInArrow(run, SHAPE)


def absolute(url: str, link: str) -> str:
    return urljoin(url, link)
