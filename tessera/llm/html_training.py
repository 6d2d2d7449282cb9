"""Labelled pages to train the extractor on: made by rules, the same for the same seed.

Every element that is laid out as a block has a label of its own in the attribute data-label (1: main text). The pages
mix layouts, so that no single tag or class name tells the label.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SYLLABLES = ("ka", "lo", "mi", "ten", "ra", "su", "ve", "dor", "an", "pel", "qui", "zo", "ber", "ist", "um", "fal")
CONTENT_NAMES = ("content", "post-body", "entry-content", "story", "article-text", "main-content", "page-content", "text")
NAV_NAMES = ("menu", "nav", "navigation", "top-menu", "breadcrumb", "tabs", "site-nav")
AD_NAMES = ("ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot")
SIDE_NAMES = ("sidebar", "widget", "related", "side", "trending", "aside")
NOTICE_NAMES = ("cookie-notice", "consent", "notice", "alert", "message-bar", "popup")
COMMENT_NAMES = ("comments", "comment", "comment-list", "reader-comments", "replies", "discussion")
FOOT_NAMES = ("footer", "site-footer", "bottom", "copyright", "legal")
HEAD_NAMES = ("header", "site-header", "masthead", "logo", "top")


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.nameless = 0.0  # how many of a page's names say nothing
        self.boxed = False  # paragraphs are plain boxes

    def words(self, low: int, high: int) -> list[str]:
        return ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 3))) for _ in range(self.r.randint(low, high))]

    def sentence(self) -> str:
        w = self.words(4, 16)
        return " ".join(w).capitalize() + self.r.choice(".....?!")

    def prose(self, low: int, high: int) -> str:
        parts = [self.sentence() for _ in range(self.r.randint(low, high) * self.r.choice((1, 1, 1, 4)))]
        if self.r.random() < 0.12:  # verse, lists of names, texts without points
            parts = [x[:-1] + self.r.choice((",", "", "")) for x in parts]
        if self.r.random() < 0.15:
            parts[0] = f'<a href="/{self.words(1, 1)[0]}">{parts[0]}</a>'
        if self.r.random() < 0.2:
            parts[-1] = f"<b>{parts[-1]}</b>"
        return " ".join(parts)

    def made_up(self) -> str:
        """A name that says nothing, as style tools write them."""
        letters = "".join(self.r.choices("abcdefghijklmnopqrstuvwxyz", k=self.r.randint(1, 6)))
        return letters + self.r.choice(("", "-", "_")) + str(self.r.randrange(1000))

    def tag(self, name: str, label: int, inner: str, names: tuple[str, ...] = (), likely: float = 0.75) -> str:
        attr, x = "", self.r.random()
        if names and x < likely * (1 - self.nameless):
            attr = f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names)}"'
        elif names and x < likely or self.r.random() < 0.3 * self.nameless:
            attr = f' class="{self.made_up()}"' if self.r.random() < 0.6 else ""
        return f'<{name} data-label="{label}"{attr}>{inner}</{name}>'

    def links(self, low: int, high: int) -> str:
        items = "".join(self.tag("li", 0, f'<a href="/{w}">{w}</a>') for w in self.words(low, high))
        return self.tag("ul", 0, items)

    def nav(self) -> str:
        inner = self.links(3, 9) if self.r.random() < 0.8 else " | ".join(f'<a href="/{w}">{w}</a>' for w in self.words(3, 8))
        return self.tag(self.r.choice(("nav", "nav", "div", "ul" if "<li" not in inner else "div")), 0, inner, NAV_NAMES)

    def tags(self) -> str:
        """A line of links below an article."""
        inner = ", ".join(f'<a href="/{w}">{w}</a>' for w in self.words(2, 5))
        return self.tag("div", 0, self.tag("p", 0, inner), ("tags", "meta", "more"), 0.5) if self.r.random() < 0.5 else self.tag(self.r.choice(("p", "div")), 0, inner)

    def ad(self) -> str:
        text = self.prose(1, 3) if self.r.random() < 0.7 else f'<a href="http://x.example">{self.sentence()}</a>'
        return self.tag(self.r.choice(("div", "div", "aside", "p", "ins")), 0, text, AD_NAMES, 0.95)

    def side(self) -> str:
        inner = self.tag("h3", 0, " ".join(self.words(1, 3)).title()) + self.links(2, 6)
        if self.r.random() < 0.3:
            inner += self.tag("p", 0, self.sentence())
        return self.tag(self.r.choice(("aside", "div")), 0, inner, SIDE_NAMES, 0.85)

    def notice(self) -> str:
        inner = self.tag("p", 0, self.prose(1, 2)) if self.r.random() < 0.5 else self.prose(1, 2)
        return self.tag(self.r.choice(("div", "section")), 0, inner + "<button>OK</button>", NOTICE_NAMES, 0.95)

    def form(self) -> str:
        inner = f'<label>{" ".join(self.words(1, 3))}</label><input name="q"><button>{self.words(1, 1)[0]}</button>'
        if self.r.random() < 0.4:
            inner = self.tag("p", 0, self.sentence()) + inner
        return self.tag("form", 0, inner, ("search", "newsletter", "subscribe", "login"), 0.6)

    def comments(self) -> str:
        each = "".join(self.tag(self.r.choice(("div", "li")), 0, self.tag("p", 0, self.prose(1, 4)), COMMENT_NAMES, 0.7) for _ in range(self.r.randint(1, 5)))
        return self.tag(self.r.choice(("section", "div", "div")), 0, self.tag("h3", 0, self.words(1, 1)[0].title()) + each, COMMENT_NAMES, 0.95)

    def foot(self) -> str:
        inner = self.r.choice(("&copy; ", "&copy; ", "Copyright ", "")) + " &middot; ".join(" ".join(self.words(1, 3)) for _ in range(self.r.randint(1, 3)))
        if self.r.random() < 0.3:
            inner = self.tag("p", 0, inner)
        return self.tag(self.r.choice(("footer", "footer", "div")), 0, inner, FOOT_NAMES, 0.8)

    def head(self) -> str:
        inner = self.tag(self.r.choice(("p", "div", "h2")), 0, " ".join(self.words(1, 3)).title())
        return self.tag(self.r.choice(("header", "div")), 0, inner + (self.nav() if self.r.random() < 0.5 else ""), HEAD_NAMES, 0.8)

    def short(self) -> str:
        """A few words, with or without a point."""
        text = " ".join(self.words(1, 6))
        if self.r.random() < 0.1:
            return f"{self.r.randrange(1, 24)}:{self.r.randrange(10, 60)}"
        if self.r.random() < 0.3:
            text = f"{self.r.randrange(1, 500)} {text}"
        return text.capitalize() + "." if self.r.random() < 0.4 else text

    def items(self) -> str:
        """A list: of sentences, or of short things."""
        brief = self.r.random() < 0.65
        if self.r.random() < 0.15:
            pairs = "".join(self.tag("dt", 1, self.short()) + self.tag("dd", 1, self.short() if brief else self.prose(1, 2)) for _ in range(self.r.randint(1, 5)))
            return self.tag("dl", 1, pairs)
        inside = (lambda: self.tag("p", 1, self.prose(1, 2))) if self.r.random() < 0.1 else self.short if brief else (lambda: self.prose(1, 2))
        return self.tag(self.r.choice(("ul", "ol")), 1, "".join(self.tag("li", 1, inside()) for _ in range(self.r.randint(2, 9))))

    def paragraph(self) -> str:
        name = "div" if self.boxed else "p"
        text = self.short() if self.r.random() < 0.1 else self.prose(1, 6)
        return self.tag(name, 1, text, CONTENT_NAMES if self.boxed else (), 0.1)

    def heading(self) -> str:
        text = " ".join(self.words(1, 7)).capitalize() + self.r.choice(("", "", "", "?"))
        return self.tag(self.r.choice(("h2", "h3", "h4")), 1, text)

    def block(self) -> str:
        x = self.r.random()
        if x < 0.57:
            return self.paragraph()
        if x < 0.69:
            return self.heading()
        if x < 0.81:
            return self.items()
        if x < 0.85:
            return self.tag("blockquote", 1, self.tag("p", 1, self.prose(1, 3)) if self.r.random() < 0.5 else self.prose(1, 3))
        if x < 0.88:
            return self.tag("pre", 1, self.sentence() if self.r.random() < 0.5 else self.short())
        if x < 0.94:
            cells = self.r.randint(2, 4)
            row = lambda kind: self.tag("tr", 1, "".join(self.tag(kind, 1, self.short()) for _ in range(cells)))
            return self.tag("table", 1, row(self.r.choice(("th", "td"))) + "".join(row("td") for _ in range(self.r.randint(1, 4))))
        if x < 0.97:
            return self.tag("figure", 1, self.tag("figcaption", 1, self.sentence()))
        return self.tag("div", 1, self.prose(1, 4))

    def article(self) -> list[str]:
        """An article's blocks; now and then nothing but questions, one list or bare text."""
        r, x = self.r, self.r.random()
        parts = [self.tag("h1", 1, " ".join(self.words(1, 9)).capitalize())] if r.random() < 0.75 else []
        if parts and r.random() < 0.15:
            parts = [self.tag("header", 1, parts[0])]
        if x < 0.07:
            return parts + [y for _ in range(r.randint(2, 6)) for y in (self.heading(), self.tag("p", 1, self.short() if r.random() < 0.5 else self.sentence()))]
        if x < 0.14:
            return parts + ([self.heading()] if r.random() < 0.5 else []) + [self.items()]
        if x < 0.2:
            return parts + ["<br><br>".join(self.prose(1, 4) for _ in range(r.randint(1, 5)))]
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            parts.append(self.block())
            if r.random() < 0.06:
                parts.append(r.choice((self.ad, self.side, self.form))())
        return parts

    def layout_table(self, body: str) -> str:
        """An old page: a table with menus in cells beside the text's."""
        r = self.r
        menu = r.choice((lambda: "<br>".join(f'<a href="/{w}">{w}</a>' for w in self.words(2, 8)), lambda: self.links(2, 7), lambda: " | ".join(f'<a href="/{w}">{w}</a>' for w in self.words(2, 6))))()
        cells = [self.tag("td", 0, menu), self.tag("td", 1, body)]
        rows = [self.tag("tr", 1, "".join(cells if r.random() < 0.7 else cells[::-1]))]
        if r.random() < 0.4:
            rows.insert(0, self.tag("tr", 0, self.tag("td", 0, "" if r.random() < 0.4 else " ".join(self.words(1, 3)).title())))
        return self.tag("table", 1, "".join(rows))

    def page(self) -> str:
        r = self.r
        self.nameless, self.boxed = r.choice((0.0, 0.0, 0.1, 1.0)), r.random() < 0.25
        parts = self.article() if r.random() < 0.97 else []
        if parts and r.random() < 0.15:
            parts.append(self.comments())
        if parts and r.random() < 0.15:
            parts.append(self.tags())
        if not parts:
            body = ""
        elif r.random() < 0.12:
            body = self.layout_table("".join(parts))
        elif r.random() < 0.1:
            body = "".join(parts)
        else:
            outer = r.choice(("article", "article", "main", "div", "div", "section"))
            body = self.tag(outer, 1, "".join(parts), CONTENT_NAMES, 0.7 if outer in ("div", "section") else 0.3)
        if body and r.random() < 0.25:
            body = self.tag(r.choice(("div", "main", "center")), 1, body, ("wrapper", "container", "page", "main", "row"), 0.8)
        # Without names only links tell what is around the text.
        others = (self.head, self.nav, self.ad, self.notice, self.form) if self.nameless < 1 else (self.nav, self.nav, self.form)
        before = [f() for f in others if r.random() < 0.5]
        after = [f() for f in ((self.comments, self.side, self.ad, self.form, self.notice) if self.nameless < 1 else (self.tags, self.nav)) if r.random() < 0.35]
        r.shuffle(before)
        whole = f'{"".join(before)}{body}{"".join(after)}{self.foot() if r.random() < 0.8 and self.nameless < 1 else ""}'
        if r.random() < 0.2:
            whole = self.tag("div", 1, whole, ("wrapper", "container", "page", "site"), 0.8)
        return f'<html><body data-label="1">{whole}</body></html>'


def labelled_pages(n: int, seed: int) -> Iterator[str]:
    maker = PageMaker(seed)
    for _ in range(n):
        yield maker.page()
