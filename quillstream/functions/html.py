"""Readable text of HTML by its structure. A tree walk has no built-in function, so this runs as a pandas UDF.

The tree comes from the standard library's tolerant parser: elements left open end with their parent. Repairs that
other parsers make to broken markup may differ.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BOILERPLATE

VOID = {"area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements never read, elements that indent, and what ids and classes of page furniture contain.
UNREAD = {"script", "style", "noscript", "iframe", "object", "embed", "applet", "meta", "frameset", "frame", "noframes", "param", "canvas", "svg", "video", "audio", "source", "track", "form", "input", "button", "select", "option", "textarea", "aside"}
UNWRITTEN = {"style", "onclick", "onmouseover", "align", "bgcolor", "class", "id"}
INDENTS = {"div", "p", "section", "article", "li", "blockquote", "table", "tr", "td"}
FURNITURE = ("nav", "footer", "header", "menu", "sidebar")
DEEPEST = 5
#: What ids and classes of a page's other parts contain.
TERMS = {"header": ("header", "heading", "top-bar"), "footer": ("footer", "bottom", "copyright"), "nav": ("nav", "menu", "navigation"), "aside": ("sidebar", "side", "aside")}
#: A start tag of one of these ends an open paragraph.
ENDS_P = {"p", "div", "section", "article", "ul", "ol", "dl", "table", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "nav", "main", "pre", "hr", "address", "figure"}
BLOCKS = ENDS_P | {"li", "tr", "td", "th", "dt", "dd", "tbody", "thead", "tfoot", "body", "html", "head"}
PARTS = ["main_content", "header_content", "footer_content", "navigation_content", "sidebar_content"]


def _strings(*names: str) -> T.StructType:
    """A type that can be given before there is a session."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def says(self, *words: str) -> bool:
        named = (self.attrs.get("id") or "").lower() + " " + (self.attrs.get("class") or "").lower()
        return any(w in named for w in words)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)
        self.skipping = 0
        #: How many elements of each name are open, so that an end tag without a start costs nothing.
        self.open: Counter[str] = Counter()
        #: The paragraph that is open here, with only inline elements inside.
        self.paragraph: Node | None = None

    def leave(self, node: Node) -> None:
        """Close an open element and all that is open inside it."""
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.paragraph = None if self.at is self.paragraph else self.paragraph
            self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipping:
            self.skipping += tag in UNREAD and tag not in VOID
            return
        if tag in UNREAD:
            self.skipping = int(tag not in VOID)
            return
        if tag == "li" and self.at.tag == "li":
            self.leave(self.at)
        if tag in ENDS_P and self.paragraph is not None:
            self.leave(self.paragraph)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1
            self.paragraph = node if tag == "p" else None if tag in BLOCKS else self.paragraph

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            self.skipping -= tag in UNREAD and tag not in VOID
            return
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self.leave(node)
        if tag in BLOCKS:
            self.paragraph = None

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.at.children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _main(root: Node) -> Node:
    blocks = [n for n in root.walk() if n.tag in ("main", "article", "div", "section")]
    for attribute in ("id", "class"):
        for n in blocks:
            if re.search("content|main", n.attrs.get(attribute, ""), re.IGNORECASE):
                return n
    return next((n for n in root.walk() if n.tag == "body"), root)


def _parts(root: Node, tag: str) -> list[Node]:
    """The elements of one of the page's other parts: by tag (all menus, the first header or footer), then by id, then by class."""
    own = [n for n in root.walk() if n.tag == tag]
    out = own if tag == "nav" else own[:1] if tag != "aside" else []
    for attribute in ("id", "class"):
        for term in TERMS[tag]:
            out = out + [n for n in root.walk() if term in n.attrs.get(attribute, "").lower()]
    return list({id(n): n for n in out}.values())


def _text(node: Node) -> str:
    return " ".join(_raw(node).split())


def _raw(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo += reversed(n.children)
    return "".join(out)


def lines(node: Node, base: str, is_main: bool, read: dict[int, int] | None = None) -> list[str]:
    """Lines of text, indented by a space for each level; links carry their address, headings and links end the walk below them.

    ``read`` has the least indent at which elements have been read before. Where ``node`` is among them, its lines at the
    deepest indent are known already, as they are the same from above, and the walk ends there.
    """
    out: list[str] = []
    again = read is not None and id(node) in read
    todo: list[tuple[Node | str, int]] = [(node, 0)]
    while todo:
        n, indent = todo.pop()
        indent = min(indent, DEEPEST)
        if again and indent == DEEPEST:
            continue
        if read is not None and not isinstance(n, str):
            read[id(n)] = min(indent, read.get(id(n), indent))
        if isinstance(n, str):
            if len(text := " ".join(n.split())) >= 3:
                out.append(" " * indent + text)
            continue
        if n.tag == "a" and n.attrs.get("href"):
            href, text = n.attrs["href"], _text(n)
            if len(text) >= 3 and not re.match("javascript:|#", href):
                if base and not href.startswith(("http://", "https://", "mailto:", "tel:")):
                    try:
                        href = urljoin(base, href)
                    except ValueError:
                        href = ""
                out.append(" " * indent + text + (f" [URL: {href}]" if href else ""))
            continue
        if re.fullmatch("h[1-6]", n.tag):
            if text := _text(n):
                out.append(" " * min(int(n.tag[1]) - 1, 2) + text)
            continue
        if is_main and (n.tag in ("nav", "footer", "header") or n.says(*FURNITURE)):
            continue
        below = indent + 1 if n.tag in INDENTS else indent
        todo += [(c, below) for c in reversed(n.children)]
    return out


def lines_of_all(nodes: list[Node], base: str) -> list[str]:
    """Lines of elements that may be inside each other, without most of those that would come again from inside."""
    read: dict[int, int] = {}
    return [x for n in nodes if read.get(id(n)) != 0 for x in lines(n, base, False, read)]


def useful(found: list[str], longer_than: int = 1) -> list[str]:
    kept = [x for x in found if len(x.strip()) > longer_than and not any(b in x.lower() for b in BOILERPLATE)]
    return list(dict.fromkeys(kept))


def structured(html: str | None, base: str = "") -> dict[str, str | None]:
    """Text of the page's five parts; a main part of under five lines is read again from the body."""
    if not html or not html.strip():
        return dict.fromkeys(PARTS)
    root = tree(html)
    main, body = _main(root), next((n for n in root.walk() if n.tag == "body"), root)
    found = lines(main, base, True)
    if len(found) < 5 and body is not main:
        found = lines(body, base, True)
    parts = [found, *(lines_of_all(_parts(root, tag), base) for tag in TERMS)]
    return {k: "\n".join(kept) if (kept := useful(p)) else None for k, p in zip(PARTS, parts, strict=True)}


def readable(html: str | None, base: str = "") -> str | None:
    """The main part, else the others, one after the other. NULL for what can't be read."""
    try:
        s = structured(html, base)
    except (AssertionError, ValueError):  # markup that the parser gives up on
        return None
    rest = (s["header_content"], s["navigation_content"], s["sidebar_content"], s["footer_content"])
    return s["main_content"] or "\n\n".join(x for x in rest if x) or None


def cleaned(node: Node) -> str:
    """An element written anew: only what can be read, without styling attributes."""
    out: list[str] = []
    todo: list[Node | str | tuple[str]] = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif isinstance(n, str):
            out.append(n.strip())
        elif n.tag not in UNREAD:
            out.append(f"<{n.tag}" + "".join(f' {k}="{v}"' for k, v in n.attrs.items() if k not in UNWRITTEN) + ">")
            todo += [(f"</{n.tag}>",), *reversed(n.children)]
    return "".join(out)


def query_of(html: str | None, asked: str | None = None) -> str | None:
    """What a page is about: what was asked; else its title, first heading, keywords and description, or a first long paragraph."""
    if asked or not html:
        return asked or None
    named = dict(reversed([(m["name"], m["content"]) for m in _metas(html) if m.get("name") and m.get("content")]))
    root = tree(html)
    first = {tag: next((n for n in root.walk() if n.tag == tag), None) for tag in ("title", "h1")}
    found = [_raw(n) for n in first.values() if n is not None] + [named[k] for k in ("keywords", "description") if k in named]
    if not any(k in named for k in ("keywords", "description")):
        found += [t[:150] for t in (_raw(n) for n in root.walk() if n.tag == "p") if len(t) > 150][:1]
    return " ".join(filter(None, found)) or None


def _metas(html: str) -> list[dict[str, str]]:
    class Metas(HTMLParser):
        found: list[dict[str, str]]

        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag == "meta":
                self.found.append({k: v or "" for k, v in attrs})

    reader = Metas()
    reader.found = []
    reader.feed(html)
    reader.close()
    return reader.found


@F.pandas_udf(T.StringType())
def page_query(html: pd.Series) -> pd.Series:
    return html.map(query_of).astype(object)


@F.pandas_udf(T.StringType())
def cleaned_body(html: pd.Series) -> pd.Series:
    """The body written anew; NULL without a page."""
    return html.map(lambda h: cleaned(next((n for n in tree(h).walk() if n.tag == "body"), tree(h))) if h else None).astype(object)


def closed(html: Column) -> Column:
    """Markup in which only references that a semicolon ends are ones, as XML and plain replacement have it.

    HTML also reads a few old names without it (``&amp`` cut off at the end of a title is ``&``); here these stay as they are.
    """
    return F.regexp_replace(html, r"&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][0-9A-Za-z]*);)", "&amp;")


@F.pandas_udf(_strings(*PARTS))
def structured_text(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([structured(h, b or "") for h, b in zip(html, base, strict=True)], columns=PARTS, dtype=object)


@F.pandas_udf(T.StringType())
def readable_text(html: pd.Series) -> pd.Series:
    return html.map(readable).astype(object)


@F.pandas_udf(_strings("primary", "fallback"))
def _first_readable(primary: pd.Series, fallback: pd.Series) -> pd.DataFrame:
    rows = []
    for p, f in zip(primary, fallback, strict=True):
        text = readable(p)
        rows.append((text, readable(f) if text is None else None))
    return pd.DataFrame(rows, columns=["primary", "fallback"], dtype=object)


def first_readable(primary: Column, fallback: Column) -> Column:
    """Both texts, the second only where the first is empty: what isn't needed isn't parsed."""
    return _first_readable(primary, fallback)


@F.pandas_udf(_strings("website_url", "sector", "industry"))
def profile_of(html: pd.Series) -> pd.DataFrame:
    """Website, sector and industry of a company's profile page."""

    def one(page: str | None) -> tuple:
        if not page:
            return None, None, None
        site, named, term = None, {}, None
        for n in tree(page).walk():
            if n.tag == "dt":
                term = next((k for k in ("sector", "industry") if k in _text(n).lower()), None)
            elif n.tag == "a":
                if "business-url" in n.attrs.get("data-ylk", "") and site is None:
                    href = n.attrs.get("href", "")
                    site = href if href.startswith("http") else _text(n) or None
                elif term:
                    named.setdefault(term, _text(n) or None)
                    term = None
        return site, named.get("sector"), named.get("industry")

    return pd.DataFrame([one(h) for h in html], columns=["website_url", "sector", "industry"], dtype=object)


def _spaced(node: Node) -> str:
    """The pieces of text below an element, each trimmed, with a space between them."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n.strip())
        else:
            todo += reversed(n.children)
    return " ".join(filter(None, out))


def _article(page: str) -> str | None:
    root = tree(page)
    boxes = [n for n in root.walk() if n.tag == "div"]
    wrapped = [next((n for n in boxes if c in n.attrs.get("class", "").split()), None) for c in ("atoms-wrapper", "read-more-wrapper")]
    if any(w is not None for w in wrapped):
        return " ".join(filter(None, (_spaced(w) for w in wrapped if w is not None))) or None
    for m in re.finditer(r"""<script[^>]*\bid=["']caas-art-[^>]*>(.*?)</script>""", page, re.DOTALL | re.IGNORECASE):
        try:
            content = json.loads(m[1]).get("content")
        except (ValueError, AttributeError):
            continue
        if isinstance(content, str) and content.strip():
            return _spaced(tree(content)) or None
    return _spaced(root) or None


@F.pandas_udf(T.StringType())
def article_text(page: pd.Series) -> pd.Series:
    """The text of a news article: its body's wrappers, else the embedded content, else the whole page's text."""
    return page.map(lambda p: _article(p) if p else None).astype(object)


def _consent(page: str) -> str | None:
    if not re.search(r"""id=["']?consent-page\b""", page) or "originalDoneUrl" not in page:
        return None

    class Inputs(HTMLParser):
        found: str | None = None

        def handle_starttag(self, tag: str, attrs: list) -> None:
            own = dict(attrs)
            if tag == "input" and own.get("name") == "originalDoneUrl" and self.found is None:
                self.found = own.get("value")

    reader = Inputs()
    reader.feed(page)
    reader.close()
    return unescape(reader.found) if reader.found else None  # addresses are escaped once more inside the form


@F.pandas_udf(T.StringType())
def consent_target(page: pd.Series) -> pd.Series:
    """The address that a page asking for consent stands for; NULL for all other pages."""
    return page.map(lambda p: _consent(p) if p else None).astype(object)
