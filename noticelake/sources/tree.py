"""One captured page as a tree of its elements: where its content begins, what its text is, which rows and cards hold its links.

A small helper of the page reader, run once a page inside an Arrow batch. It only takes pages apart; what titles, dates and labels mean is decided by column expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

from ..functions import patterns as P

#: Elements without an end; kinds of sources whose whole body is the notice; roots of such pages where there is no body.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PLATFORMS = ("dacon", "aifactory", "campuspick")
_APP_ROOTS = ("#__nuxt", "#__next", "#app")
#: Where the content of a page is, the first that a page has; `.` is a class, `#` an id, `$` the end of an id beside the class `content`.
_CONTENT = [
    ".contest-detail", ".contest-view", ".contest_view", ".competition-content", ".mb-view-content", ".mb-board-view-content", "#mb_content", ".mb-content", "$_content", ".artclViewBody",
    ".view-content", ".view-content-box", ".artclView", "article", "main", "#container",
]
#: Parts of the content that say nothing about the notice.
_DROPPED_TAGS = {"script", "style", "nav", "header", "footer", "aside", "input", "button", "select", "textarea", "del", "s", "template", "noscript"}
_DROPPED_CLASSES = {"comments", "comment-list", "related", "recommend", "recommendations", "mb-prev-next", "mb-neighbor", "sidebar", "breadcrumbs", "breadcrumb", "post-navigation", "pagination"}
_DROPPED_LIKE = re.compile(r"related|recommend|suggest|breadcrumb|pagination|login-modal", re.I)
_SILENT = {"script", "style", "template", "noscript"}
#: Where the subject of a notice is, the first usable one; headings inside these parts are of the site.
_SUBJECTS = [".artclViewTitle", ".view-title", ".mb-view-title", ".mb-board-view-title", ".mb-subject", "#mb_subject", "@headline", ".contest-title"]
_OF_THE_SITE, _OF_OTHERS = {"nav", "header", "footer", "aside"}, re.compile(r"related|recommend|comment", re.I)
#: Titles of cards, by class; lines of a card that are no title.
_CARD_WORDS, _CARD_PARTS, _CARD_LIKE = {"title", "subject"}, ("card-title", "contest-title"), ("title", "subject")
_CARD_STATE = re.compile(r"접수중|진행중|종료|마감|D[-−]\d+|관심\s*\d+")
#: Labels that stand behind their date in a row of two cells, and pictures whose authored text states a period.
_AFTER_DATE, _PICTURED = re.compile(r"접수|신청|마감|결과|발표|시작|종료|심사"), re.compile(r"접수|신청|모집|응모")
_OTHER_MILESTONES = re.compile(r"(?:^|\n)\s*대회\s*주요\s*일정\s*(?:\n|$)")
_DATE = re.compile(P.FULL_DATE)
_SPACED = [(word[0], word, re.compile(r"(?<![가-힣])" + r"[ \t]*".join(word) + r"(?![가-힣])")) for word in P.FIELD_WORDS]
_INVISIBLE = dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF)) | {0xA0: " "}


def normal(text: str) -> str:
    """`functions.text.normalize` on one string."""
    text = text.translate(_INVISIBLE)
    for first, word, pattern in _SPACED:
        if first in text:
            text = pattern.sub(word, text)
    text = re.sub(r"오\s+([전후])", r"오\1", text)
    return re.sub(r"['’‘`]\s*(\d{2})(?=\s*[.년/-]\s*\d)", r"20\1", text)


class Node:
    """An element with what it holds, elements and text."""

    __slots__ = ("tag", "attrs", "inside", "parent", "classes")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.inside = tag, attrs, parent, []
        self.classes = attrs["class"].split() if attrs.get("class") else ()

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def below(self) -> Iterator[Node]:
        """The elements inside, in the order of the page."""
        stack = [x for x in reversed(self.inside) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.inside) if isinstance(x, Node))

    def strings(self, dropped: bool = False, turned: bool = False) -> list[str]:
        """The pieces of text inside, stripped; without parts that say nothing (`dropped`), with rows and pictures read as text (`turned`)."""
        out, stack = [], list(reversed(self.inside))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if plain := x.strip():
                    out.append(plain)
            elif x.tag in _SILENT or (dropped and x.is_noise()):
                continue
            elif turned and (line := x.turned()):
                out.append(line)
            else:
                stack.extend(reversed(x.inside))
        return out

    def line(self) -> str:
        return " ".join(self.strings())

    def is_noise(self) -> bool:
        a = self.attrs
        if self.tag in _DROPPED_TAGS or a.get("role") == "navigation" or "hidden" in a or a.get("aria-hidden") == "true":
            return True
        return any(c in _DROPPED_CLASSES or _DROPPED_LIKE.search(c) for c in self.classes)

    def turned(self) -> str:
        """A row whose date stands before its label as `label: date`; a picture's authored text where it states a period."""
        if self.tag == "img":
            alt = self.attrs.get("alt") or ""
            return alt if _PICTURED.search(alt) and _DATE.search(alt) else ""
        if self.tag not in ("tr", "li"):
            return ""
        cells = [x for x in self.inside if isinstance(x, Node) and x.tag in ("th", "td", "span")]
        if len(cells) != 2:
            return ""
        day, label = (normal(" ".join(c.strings(dropped=True))) for c in cells)
        fits = _DATE.search(day) and not _DATE.search(label) and len(label) < 40 and _AFTER_DATE.search(label)
        return f"{label}: {day}" if fits else ""


class Page(HTMLParser):
    """The tree of one page, with its elements by tag, class and id in the order of the page."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.found: dict[str, list[Node]] = defaultdict(list)
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        names = [tag, *("." + c for c in node.classes)]
        if node.attrs.get("id"):
            names.append("#" + node.attrs["id"])
            if node.attrs["id"].endswith("_content") and "content" in node.classes:
                names.append("$_content")
        if node.attrs.get("itemprop") == "headline":
            names.append("@headline")
        for name in names:
            self.found[name].append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        before = self.at
        self.handle_starttag(tag, attrs)
        self.at = before

    def handle_endtag(self, tag):
        for node in (self.at, *self.at.above()):
            if node.tag == tag:
                self.at = node.parent or self.root
                return

    def handle_data(self, data):
        self.at.inside.append(data)

    def first(self, names: list[str] | tuple[str, ...]) -> Node | None:
        return next((self.found[name][0] for name in names if name in self.found), None)

    def content(self, kind: str | None) -> Node | None:
        """Where the notice is: the whole body on platforms, else the first content part; without a kind the body stands in for a missing one."""
        body = self.first(("body",))
        if kind in PLATFORMS:
            return body or self.first(_APP_ROOTS) or self.root
        return self.first(_CONTENT) or ((body or self.root) if kind is None else None)

    def titles(self) -> list[tuple[str, str]]:
        """Possible titles, best first, each with what it must show: nothing, a topical word, or a word of contests."""
        out = [(node.line(), "any") for name in _SUBJECTS for node in self.found.get(name, ())]
        for row in self.found.get("tr", ()):
            cells = [x for x in row.inside if isinstance(x, Node) and x.tag in ("th", "td")]
            if len(cells) >= 2 and "".join(cells[0].strings()) == "제목":
                out.append((cells[1].line(), "any"))
        headings = {id(n): n for name in ("h1", "h2", "h3") for n in self.found.get(name, ())}
        for node in (n for n in self.root.below() if id(n) in headings):
            if not any(x.tag in _OF_THE_SITE or any(_OF_OTHERS.search(c) for c in x.classes) for x in node.above()):
                out.append((node.line(), "any" if node.tag == "h1" else "topical"))
        out += [(n.attrs.get("content", ""), "any") for n in self.found.get("meta", ()) if n.attrs.get("property") == "og:title"][:1]
        return out + [(n.line(), "contest") for n in self.found.get("title", ())[:1]]

    def text(self, kind: str | None) -> str:
        """The normalised text of the content, a line for every piece of text."""
        content = self.content(kind)
        if content is None:
            return ""
        text = normal("\n".join(content.strings(dropped=True, turned=True)))
        return _OTHER_MILESTONES.split(text, maxsplit=1)[0] if kind == "dacon" else text

    def metas(self) -> list[str]:
        """The descriptions of the page's head."""
        wanted = {"og:description": None, "description": None}
        for n in self.found.get("meta", ()):
            for name in (n.attrs.get("property"), n.attrs.get("name")):
                if name in wanted and wanted[name] is None:
                    wanted[name] = n.attrs.get("content", "")
        return [x for x in wanted.values() if x]

    def scripts(self) -> list[str]:
        """Embedded JSON."""
        return ["".join(x for x in n.inside if isinstance(x, str)) for n in self.found.get("script", ()) if "json" in n.attrs.get("type", "")]

    def marks(self, names: set[str]) -> list[dict[str, str]]:
        """Attributes of elements that have one of the names and are not recommended elsewhere."""
        own = lambda n: not any(re.search(r"recommend|related", c, re.I) for x in n.above() for c in x.classes)
        return [n.attrs for n in self.root.below() if not names.isdisjoint(n.attrs) and own(n)]

    def links(self) -> list[tuple[Node, str]]:
        return [(a, a.attrs["href"]) for a in self.found.get("a", ()) if a.attrs.get("href")]


def card_titles(a: Node) -> tuple[list[str], str]:
    """What may be the title of a link's card, best first, and what is left if none of it is a real title."""
    inside = list(a.below())
    plain = {t: n for n in reversed(inside) for t in ("heading" if n.tag in ("h1", "h2", "h3", "h4") else n.tag,)}
    exact = next((n for n in inside if not _CARD_WORDS.isdisjoint(n.classes) or any(p in n.attrs.get("class", "") for p in _CARD_PARTS)), None)
    like = next((n for n in inside if any(p in n.attrs.get("class", "") for p in _CARD_LIKE)), None)
    named = [n.line() for n in (exact, plain.get("heading"), like, plain.get("strong")) if n is not None]
    lines = [x.strip() for piece in a.strings() for x in piece.splitlines() if len(x.strip()) >= 4]
    first = next((x for x in lines if not _CARD_STATE.fullmatch(x)), None)
    return [x for x in named if len(x) >= 4], first or a.line()


def row_of(a: Node) -> Node:
    """The table row around a link, else its list item, else the link itself."""
    above = list(a.above())
    return next((x for x in above if x.tag == "tr"), None) or next((x for x in above if x.tag == "li"), None) or a
