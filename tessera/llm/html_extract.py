"""Main text of web pages by a tree-structured graphical model.

The blocks of a page form a tree. Each has features (tag, words of class and id, link density, length, punctuation) whose
likelihoods under "main text" and "other" come from labelled pages, and each parent-child pair a potential. Messages go
up the tree and down again (sum-product), which gives every block its exact marginal; blocks at one half or more are
the text. Scripts, styles and the like have no blocks at all.

Labels are binary, so a message is one log-odds value, and a page of n blocks takes O(n).
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_text
from tessera.llm.html_training import labelled_pages

# HTML's elements by how they are parsed and laid out.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video title textarea select option".split())
TEXT_ONLY = frozenset("script style textarea title iframe noscript".split())
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
SCOPED = frozenset("template object svg math select".split())  # closed by their own end tag or an outer block's only
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html ins label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BREAKS = frozenset("br hr img input".split())
CLOSES_P = BLOCK - {"button", "ins", "label"}
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

OPEN = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|[!?])")
PLAIN, SPACE = re.compile(r"[^>=]*"), re.compile(r"\s*")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LABEL = re.compile(r'data-label="([01])"')
PART = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    attrs: str
    texts: list = field(default_factory=list)  # (place among all texts, text)
    chars: int = 0
    linked: int = 0
    stops: int = 0


def parse(source: str) -> list[Node]:
    """Blocks in page order, parents first; a root without a tag is the first. Texts are runs between blocks' borders."""
    nodes = [Node("", -1, "")]
    stack: list[tuple[str, int]] = [("", 0)]  # open elements and the block each one is in
    run: list[str] = []
    linked, in_link, place, at, skip, in_head = 0, 0, 0, 0, "", False
    ended: set[str] = set()  # quotes and end tags that do not come any more
    opened = Counter({"": 1})  # the stack's elements by name
    inner, outer = Counter(), Counter()  # elements open within the skipped one; inline elements open outside of it

    def cut(i: int) -> None:
        for tag, _ in stack[i:]:
            opened[tag] -= 1
        del stack[i:]

    def flush() -> None:
        nonlocal run, linked, place
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            if text:
                node = nodes[stack[-1][1]]
                node.texts.append((place, text))
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.stops += text.count(". ") + text.count("? ") + text.count("! ") + text.count("\u3002") + (text[-1] in ".?!")
                place += 1
            run, linked = [], 0

    def parent_ends(name: str, closing: bool) -> bool:
        """The tag closes, itself or by implication, an element around the skipped one."""
        loose = skip not in SCOPED
        if closing:
            return name == "head" or (name in BLOCK and opened[name] > 0) or (loose and outer[name] > 0)
        if name == "body":
            return skip != "template"
        if not loose:
            return False
        if name in CLOSES_P and stack[-1][0] == "p" and not any(inner[x] > 0 for x in BLOCK):
            return True
        return name in SAME_KIND and not any(inner[x] > 0 for x in SAME_KIND[name] | SCOPE[name]) and _same_kind(stack, name) > 0

    while token := _next(source, at, ended):
        begin, end, closing, name, attrs = token
        if not skip and begin > at:
            in_head = in_head and source[at:begin].isspace()
            if not in_head:
                run.append(source[at:begin])
                if in_link:
                    linked += begin - at
        at = end
        if not name:
            continue
        if skip:
            if closing and inner[name] > 0:
                inner[name] -= 1
                continue
            if closing and name == skip:
                skip = ""
                continue
            if not closing and name in TEXT_ONLY and not attrs.endswith("/"):
                if skip not in ("svg", "math") or (name not in ended and _find_end(source, name, at) >= 0):
                    at = _after(source, name, at)
                else:
                    ended.add(name)
                continue
            if not parent_ends(name, closing):
                if name == skip == "option":
                    inner.clear()
                elif not closing and name not in VOID and not attrs.endswith("/"):
                    inner[name] += 1
                continue
            skip = ""
        if name == "head":
            in_head = not closing
            continue
        if in_head:
            if closing:
                in_head = name not in ("body", "html", "br")
            elif name == "noframes":
                at = _after(source, name, at)
                continue
            else:
                in_head = name in HEAD
        if closing:
            if outer[name] > 0:
                outer[name] -= 1
            if name == "a":
                in_link = 0
            elif name in BLOCK and opened[name] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        flush()
                        cut(i)
                        break
            continue
        if name in RAW:
            run.append(" ")
            if attrs.endswith("/"):
                continue
            if name in TEXT_ONLY:
                at = _after(source, name, at)
            else:
                skip = name
                inner.clear()
            continue
        if name == "a":
            in_link = 1
        elif name in BREAKS:
            run.append(" ")
        if name not in BLOCK:
            if name not in VOID:
                outer[name] += 1
            continue
        flush()
        if name in CLOSES_P and stack[-1][0] == "p":
            cut(len(stack) - 1)
        if name in SAME_KIND:
            i = _same_kind(stack, name)
            if i:
                cut(i)
                if name in ("tr",) and stack[-1][0] == "tr":
                    cut(len(stack) - 1)
        nodes.append(Node(name, stack[-1][1], attrs))
        stack.append((name, len(nodes) - 1))
        opened[name] += 1
    if not skip and at < len(source):
        run.append(source[at:])
    flush()
    return nodes


def _next(source: str, at: int, ended: set[str]) -> tuple[int, int, bool, str, str] | None:
    """The next tag, comment or declaration: begin, end, whether it closes, its name ('' for no tag) and attributes.

    Quotes count after '=' only, and only if they are closed at all; a tag without an end takes what is left of the page.
    Every character is looked at a bounded number of times: ended remembers searches that found nothing.
    """
    m = OPEN.search(source, at)
    if m is None:
        return None
    if m[3] is None:
        mark = "-->" if m[1] else ">"
        end = source.find(mark, m.end())
        return m.start(), len(source) if end < 0 else end + len(mark), False, "", ""
    place = m.end()
    while True:
        place = PLAIN.match(source, place).end()
        if place == len(source):
            return m.start(), place, False, "", ""
        if source[place] == ">":
            return m.start(), place + 1, m[2] == "/", m[3].lower(), source[m.end() : place]
        place = SPACE.match(source, place + 1).end()
        quote = source[place : place + 1]
        if quote in ("'", '"') and quote not in ended:
            close = source.find(quote, place + 1)
            if close < 0:
                ended.add(quote)
            else:
                place = close + 1


def _same_kind(stack: list[tuple[str, int]], name: str) -> int:
    """The place of the open element that a start tag of this name closes, or 0."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in SAME_KIND[name]:
            return i
        if stack[i][0] in SCOPE[name]:
            break
    return 0


def _after(source: str, name: str, at: int) -> int:
    """The place after the end tag of an element whose content is text only."""
    end = _find_end(source, name, at)
    close = source.find(">", end) if end >= 0 else -1
    return len(source) if close < 0 else close + 1


def _find_end(source: str, name: str, at: int) -> int:
    m = re.compile(f"</{name}", re.I).search(source, at)
    return m.start() if m else -1


#: Kinds of tags: blocks of one kind share length features, and pairs of kinds share a parent-child potential.
KINDS = {
    "text": "p pre blockquote figcaption summary", "item": "li dt dd", "cell": "td th", "list": "ul ol dl menu", "row": "tr table tbody thead tfoot caption",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup", "main": "article main body html", "box": "div section center details figure",
}
KIND = {tag: kind for kind, tags in KINDS.items() for tag in tags.split()} | {"": "box"}


def kind(tag: str) -> str:
    return KIND.get(tag, "other")


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of each block's features: its tag, words of its names, and by kind its length, share of links and sentences,
    of its own texts and of its whole subtree."""
    chars, linked, stops = [n.chars for n in nodes], [n.linked for n in nodes], [n.stops for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
    out = []
    for i, n in enumerate(nodes):
        own = ["t:" + n.tag]
        if n.attrs and "=" in n.attrs:
            for m in NAMES.finditer(n.attrs):
                own += ["n:" + x for x in PART.findall((m[1] or m[2] or m[3] or "").lower())]
        k = kind(n.tag)
        own.append(f"s:{k}:{_size(chars[i])}:{_share(linked[i], chars[i])}:{min(stops[i], 2)}")
        if n.chars != chars[i]:
            own.append(f"o:{k}:{_size(n.chars)}:{_share(n.linked, n.chars)}")
        out.append(own)
    return out


def _size(c: int) -> int:
    return 0 if c == 0 else 1 if c < 25 else 2 if c < 100 else 3 if c < 400 else 4


def _share(linked: int, chars: int) -> int:
    share = linked / chars if chars else 0.0
    return 0 if share == 0 else 1 if share < 0.34 else 2 if share < 0.67 else 3


Potential = tuple[tuple[float, float], tuple[float, float]]


@dataclass(frozen=True)
class Model:
    """odds: log-odds that a feature gives to main text. pairs: P(child label | parent label) by the kinds of parent and
    child, as ((other-other, other-text), (text-other, text-text)). prior: log-odds of the root."""

    odds: dict[str, float]
    pairs: dict[tuple[str, str], Potential]
    prior: float

    def pair(self, nodes: list[Node], i: int) -> Potential:
        child = kind(nodes[i].tag)
        return self.pairs.get((kind(nodes[nodes[i].parent].tag), child)) or self.pairs["", child]


def train(pages: Iterator[str], smooth: float = 1.0, rounds: int = 8, step: float = 0.1) -> Model:
    """From pages whose blocks carry data-label. A block without one has its parent's.

    Potentials are counted. Features start from their counted odds, shrunk as they overlap, and then follow the gradient of
    the labels' likelihood (label less marginal, for each block that has a feature) for some rounds over the pages.
    """
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    count, links, read = Counter(), Counter(), []
    for page in pages:
        nodes = parse(page)
        labels = []
        for n in nodes:
            m = LABEL.search(n.attrs)
            labels.append(int(m[1]) if m else labels[n.parent] if n.parent >= 0 else 1)
        own = features(nodes)
        read.append((nodes, own, labels))
        for n, names, y in zip(nodes, own, labels, strict=True):
            seen[y].update(names)
            count[y] += 1
            if n.parent >= 0:
                for parent in (kind(nodes[n.parent].tag), ""):
                    links[parent, kind(n.tag), labels[n.parent], y] += 1
    names = set(seen[0]) | set(seen[1])
    odds = {f: 0.5 * (math.log((seen[1][f] + smooth) / (count[1] + 2 * smooth)) - math.log((seen[0][f] + smooth) / (count[0] + 2 * smooth))) for f in names}
    kinds = [*KINDS, "other"]
    pairs = {}
    for parent in ("", *kinds):
        for child in kinds:
            n = [[links[parent, child, p, y] for y in (0, 1)] for p in (0, 1)]
            if parent == "" or sum(map(sum, n)) >= 50:
                pairs[parent, child] = tuple(tuple((x + smooth) / (sum(row) + 2 * smooth) for x in row) for row in n)
    model = Model(odds, pairs, 0.0)
    for _ in range(rounds):
        for nodes, own, labels in read:
            for names, p, y in zip(own, marginals(nodes, model, own), labels, strict=True):
                slope = step * (y - p)
                if abs(slope) > 0.001:
                    for f in names:
                        odds[f] += slope
    return model


def marginals(nodes: list[Node], model: Model, own: list[list[str]] | None = None) -> list[float]:
    """Each block's probability of being main text, by sum-product up and down the tree. own: the nodes' features."""
    odds = model.odds
    up = [sum(odds.get(f, 0.0) for f in names) for names in own or features(nodes)]
    up[0] += model.prior
    n = len(nodes)
    message, pair = [0.0] * n, [model.pair(nodes, i) for i in range(n)]
    exp, log = math.exp, math.log
    for i in range(n - 1, 0, -1):
        (t00, t01), (t10, t11) = pair[i]
        e = exp(max(-60.0, min(60.0, up[i])))
        message[i] = log((t10 + t11 * e) / (t00 + t01 * e))
        up[nodes[i].parent] += message[i]
    for i in range(1, n):
        (t00, t01), (t10, t11) = pair[i]
        e = exp(max(-60.0, min(60.0, up[nodes[i].parent] - message[i])))
        up[i] += log((t01 + t11 * e) / (t00 + t10 * e))
    return [1.0 / (1.0 + exp(-max(-60.0, min(60.0, x)))) for x in up]


def main_text(source: str, model: Model, least: float = 0.5) -> str:
    nodes = parse(source)
    kept = [x for n, p in zip(nodes, marginals(nodes, model), strict=True) if p >= least for x in n.texts]
    return "\n".join(text for _, text in sorted(kept))


@lru_cache(4)
def default_model(pages: int = 800, seed: int = 3) -> Model:
    """Trained on so many labelled pages, which are made by rules: a bounded number, the same in every run."""
    return train(labelled_pages(pages, seed))


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    A null page is empty and has no text; a very long one is parsed whole, in time that grows with its length. Rows are independent of each other; repeated ones give equal rows. Other
    columns are ignored; an empty table gives an empty one.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), doc_text("html").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
