"""Main text of HTML pages: site templates are found by what recurs on a host, and taken out.

Each page is parsed once, on the executors, to its blocks of text. Every box (div, section, list, table and the like) is
hashed with all below it, and boxes of links by their shape alone, since a menu may link elsewhere on each page; Spark
counts on how many different pages of its host a hash occurs, and text in a box that recurs on ``LEAST_PAGES`` of them or
more is deleted, however large the host is. Pages with the same content count as one, so that copies of a page don't
make a template of it. What the page itself says is used too: menus, headers, footers, sidebars, forms, scripts and
styles by element, role, class or id, where a class or id names what an element is, not what it has or lacks. The article
(or main) element is the page's own content: it is no template itself, nothing around it is left out for its name, and a
list or table inside it is no template either, but a box without such a claim, like one of links inside the article, is.
Paragraphs are no boxes, since plain sentences recur as well.

Reading takes time in proportion to the page's length, whatever is left open in it: tags are scanned forwards only, end
tags look up whether their element is open, and a block knows its box, a box the one around it.

Edge cases: null and empty pages give the empty text; markup that is badly nested is read as far as it goes, open
elements end with the page, and a tag that never ends takes the rest of the page with it; pages of any length and
depth are read whole; repeated rows give one output row each; a box on exactly ``LEAST_PAGES`` pages is a template; a
page with a null or odd URL belongs to the host of the empty name; pages without an article are read from the body; a
table without rows gives none; columns of any name can be kept.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, saved, table
from .urls import host_of

#: A box is a template's if it occurs on so many different pages of the host.
LEAST_PAGES = 5

#: What may begin markup; what ends a tag, or hides its end.
OPENS, ENDS = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])"), re.compile("[\"'>]")
NAME = re.compile(r"[^\s/>]+")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext template".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first closes an open element of the second, as long as none of the third is open inside.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"body", "caption", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Not content, by element; by role; by what a class or id names.
OUT_TAGS = frozenset("aside button canvas dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
COMMENTS = frozenset("comment comments disqus replies respond responses".split())
OUT_NAMES = COMMENTS | frozenset(
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer sidebar"
    " notice notices notification cookie cookies consent gdpr banner popup modal"
    " ad ads adslot advert adverts advertisement advertisements promo promotion promoted sponsor sponsored"
    " newsletter signup login subscribe".split()
)
#: A name that begins so says what a page has or lacks; one that ends so names a part of what stands before.
SAYS = frozenset("has have with without no not non is was hide show enable disable".split())
PARTS = frozenset("area bar block body box card container content group holder inner item items link links list outer panel row section slot strip text unit widget widgets wrap wrapper zone".split())
#: Ids of headings, paragraphs and phrases are places to link to; classes of headings say how they look.
CONTAINERS = frozenset("article aside dd div dl dt fieldset figure li main ol section table td tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES, WORDS = re.compile(r"\S+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Boxes are counted by their subtrees; inside the article, only those of the second kind.
BOXES = frozenset("article aside div dl fieldset figure footer form header main menu nav ol section table ul".split())
BARE = frozenset("aside div fieldset footer form header menu nav section".split())
#: The groups of CLOSES and the paragraph, each with what closes in it and what it can't close beyond.
GROUPS = [({"p"}, {"table", "td", "th", "caption", "button", "object"}), *dict.fromkeys((frozenset(a), frozenset(b)) for a, b in CLOSES.values())]
GROUP_OF = {tag: GROUPS.index((frozenset(a), frozenset(b))) for tag, (a, b) in CLOSES.items()}
SCOPED = frozenset().union(*(a | b for a, b in GROUPS))


@dataclass(slots=True)
class Element:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)
    #: For each of GROUPS the depth of the element that it would close from here, if any.
    scope: tuple = (None,) * len(GROUPS)


class Scanner:
    """Goes through a page's markup once, from its beginning to its end."""

    def __init__(self, html: str) -> None:
        self.html = html
        self._none: dict[str, bool] = {}

    def find(self, what: str, at: int) -> int:
        """Where a character is next; that there is none is remembered, as nothing is asked for further back."""
        if self._none.get(what):
            return -1
        if (found := self.html.find(what, at)) < 0:
            self._none[what] = True
        return found

    def end_of_tag(self, at: int) -> int:
        """Where the tag that is open at ``at`` ends: at a ``>`` outside quotes; a quote that isn't closed hides nothing."""
        while m := ENDS.search(self.html, at):
            if m[0] == ">":
                return m.start()
            closing = self.find(m[0], m.end())
            at = closing + 1 if closing >= 0 else m.end()
        return -1

    def end_of_raw(self, tag: str, at: int) -> tuple[int, int]:
        """Where the text of an element without markup inside ends, and where its end tag does."""
        n = len(self.html)
        if self._none.get("</" + tag) or not (m := re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(self.html, at)):
            self._none["</" + tag] = True
            return n, n
        end = self.find(">", m.end())
        return m.start(), end + 1 if end >= 0 else n


def parse(html: str) -> Element:
    """A tree of elements and strings (character references not yet decoded)."""
    root = Element("#page")
    stack, open_ = [root], Counter()
    scanner = Scanner(html)

    def close(depth: int) -> None:
        open_.subtract(x.tag for x in stack[depth:])
        del stack[depth:]

    def close_in(group: int) -> None:
        if (depth := stack[-1].scope[group]) is not None:
            close(depth)

    at = 0
    while m := OPENS.search(html, at):
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        if m[0] == "<!--":
            end = html.find("-->", m.end())
            at = end + 3 if end >= 0 else len(html)
            continue
        if m[0] in ("<!", "<?"):
            end = scanner.find(">", m.end())
            at = end + 1 if end >= 0 else len(html)
            continue
        name = NAME.match(html, m.end() - 1)
        end = scanner.end_of_tag(name.end())
        tag, at = name[0].lower(), end + 1 if end >= 0 else len(html)
        if end < 0:
            break
        if m[0][1] == "/":
            if open_[tag] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in ENDS_P:
            close_in(0)
        if tag in GROUP_OF:
            close_in(GROUP_OF[tag])
        node = Element(tag, html[name.end() : end])
        stack[-1].children.append(node)
        if tag in RAW:
            end, after = scanner.end_of_raw(tag, at)
            node.children.append(html[at:end])
            at = after
        elif tag not in VOID:
            outer = stack[-1].scope
            node.scope = tuple(len(stack) if tag in a else None if tag in b else x for (a, b), x in zip(GROUPS, outer, strict=True)) if tag in SCOPED else outer
            stack.append(node)
            open_[tag] += 1
    if at < len(html):
        stack[-1].children.append(html[at:])
    return root


def _named(value: str) -> str | None:
    """What a class or id names that isn't content: the last word of one of its names, less words for parts of it."""
    for name in NAMES.findall(value):
        words = [w.lower() for w in WORDS.findall(name)]
        while len(words) > 1 and words[-1] in PARTS:
            words.pop()
        if words and words[-1] in OUT_NAMES and words[0] not in SAYS:
            return words[-1]
    return None


def _out(node: Element) -> str | None:
    """How an element says that it isn't content: as an element, as one that isn't shown, or by a name; None if it doesn't."""
    if node.tag in OUT_TAGS:
        return "form" if node.tag == "form" else "element"
    if not node.attributes or node.tag in ("html", "body"):
        return None
    found = None
    for m in ATTRIBUTE.finditer(node.attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            return "element"
        if name == "role" and value.strip().lower() in OUT_ROLES:
            found = found or "role"
        if (name == "class" and node.tag not in HEADINGS) or (name == "id" and node.tag in CONTAINERS):
            found = found or _named(value)
    return found


def _is_main(node: Element) -> bool:
    return node.tag == "main" or bool(node.attributes and re.search(r"""role\s*=\s*["']?main\b""", node.attributes))


def _left_out(order: list[Element], outer: dict[int, Element], plain: dict[int, int]) -> set[int]:
    """Elements that aren't content. ``order``: all elements, each before those inside; ``plain``: letters outside links.

    A name is no reason to leave out what is around the page's article, the largest that there is; nor, on a page that has
    none, what holds most of its text. So a wrapper may be called what it likes, and a form may hold the page. Comments
    are the exception: they may outweigh the article, but don't hold the page's first heading.
    """
    says = {id(n): how for n in order if (how := _out(n))}
    inside_out: set[int] = set()
    articles: list[Element] = []
    for n in order:  # articles that neither say that they are no content nor are in an element that can't be
        around = id(outer[id(n)]) if id(n) in outer else None
        if says.get(id(n)) == "element" or around in inside_out:
            inside_out.add(id(n))
        elif (n.tag == "article" or _is_main(n)) and id(n) not in says:
            articles.append(n)
    kept: set[int] = set()
    if articles:
        at = outer.get(id(max(articles, key=lambda n: (plain[id(n)], n.tag == "article"))))
        while at is not None:
            kept.add(id(at))
            at = outer.get(id(at))
    else:
        kept = {id(n) for n in order if 2 * plain[id(n)] > plain[id(order[0])]}
    if any(how in COMMENTS for how in says.values()):
        heading = next((n for n in order if n.tag == "h1"), None)
        titled: set[int] = set()
        while heading is not None:
            titled.add(id(heading))
            heading = outer.get(id(heading))
        kept = {k for k in kept if says.get(k) not in COMMENTS or k in titled}
    return {k for k, how in says.items() if how == "element" or k not in kept}


def _articles(root: Element, left_out: set[int]) -> list[Element]:
    """The outermost article elements that are content, else main elements, else body, else the page."""

    def outermost(wanted) -> list[Element]:
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if wanted(node):
                found.append(node)
                continue
            todo += [c for c in reversed(node.children) if isinstance(c, Element) and id(c) not in left_out]
        return found

    return outermost(lambda n: n.tag == "article") or outermost(_is_main) or outermost(lambda n: n.tag == "body") or [root]


def _digested(order: list[Element]) -> tuple[dict[int, int], dict[int, int]]:
    """For each element the letters below it that are outside links, and the hash to count it by: of all below it.

    An element whose text is in links, for the most part and in two at least, is counted by its shape: elements only, and of
    neighbours of one shape the first. So menus are one template, whatever they link to on a page.
    """
    digests, shapes, plain, linked, links, counted = {}, {}, {}, {}, {}, {}
    for node in reversed(order):  # from the leaves up, without recursion: markup may be nested very deeply
        h, shape = xxhash.xxh64(node.tag.encode()), xxhash.xxh64(node.tag.encode())
        own = in_links = n_links = last = 0
        for c in node.children:
            if isinstance(c, Element):
                h.update(digests[id(c)].to_bytes(8, "little"))
                if shapes[id(c)] != last:
                    last = shapes[id(c)]
                    shape.update(last.to_bytes(8, "little"))
                own, in_links, n_links = own + plain[id(c)], in_links + linked[id(c)], n_links + links[id(c)]
            else:
                text = b" ".join(c.encode(errors="replace").split())
                h.update(text)
                own += 0 if node.tag in RAW else len(text)
        if node.tag == "a":
            own, in_links, n_links = 0, own + in_links, 1
        k = id(node)
        digests[k], shapes[k], plain[k], linked[k], links[k] = h.intdigest(), shape.intdigest(), own, in_links, n_links
        counted[k] = shapes[k] if n_links >= 2 and in_links > own else digests[k]
    return plain, counted


def blocks(html: str | None) -> tuple[list[tuple[str, int]], list[tuple[int, int]]]:
    """The page's blocks of content, each with its box; all boxes of the page: hash and the box around. -1 is none."""
    root = parse(html or "")
    out: list[tuple[str, int]] = []
    boxes: list[tuple[int, int]] = []
    pending: list[str] = []
    order, todo, outer = [], [root], {}
    while todo:
        node = todo.pop()
        order.append(node)
        below = [c for c in node.children if isinstance(c, Element)]
        outer |= {id(c): node for c in below}
        todo += reversed(below)
    plain, counted = _digested(order)
    left_out = _left_out(order, outer, plain)
    own = {id(a): a.tag in ("article", "main") for a in _articles(root, left_out)}

    def flush(box: int) -> None:
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            if text:
                out.append((text, box))

    # Entries: a string, an element to enter, or the box that a block leaves; with whether text counts, and the box around.
    steps: list = [(root, False, False, -1)]
    while steps:
        item = steps.pop()
        if isinstance(item, str):
            pending.append(item)
            continue
        if isinstance(item, int):
            flush(item)
            continue
        node, inside, in_article, box = item
        if inside and node.tag in ("br", "wbr", "hr"):
            pending.append(" " if node.tag == "br" else "")
            if node.tag == "hr":
                flush(box)
            continue
        block = node.tag in BLOCK
        if block:
            flush(box)
        if id(node) in own:
            inside, in_article = True, own[id(node)]
        elif id(node) in left_out:
            inside = False
        # The article is no template, nor what is around it: these are entered by no block of their own.
        if id(node) not in own and node.tag in (BARE if in_article else BOXES):
            boxes.append((_signed(counted[id(node)]), box))
            box = len(boxes) - 1
        if block:
            steps.append(box)
        for c in reversed(node.children):
            if isinstance(c, Element):
                steps.append((c, inside, in_article, box))
            elif inside:
                steps.append(c)
    flush(-1)
    return out, boxes


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _holding(blocks: list[tuple[str, int]], boxes: list[tuple[int, int]]) -> list[bool]:
    """Of each box, whether a block of content is in it, directly or in a box inside."""
    out = [False] * len(boxes)
    for _, box in blocks:
        while box >= 0 and not out[box]:
            out[box] = True
            box = boxes[box][1]
    return out


def page_blocks(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``keep`` (a struct), content (a hash of the blocks' texts), blocks (text, box) and boxes (hash, outer box, whether it holds a block)."""

    def work(pages: pa.Array) -> dict:
        found = [blocks(h) for h in pages.to_pylist()]
        contents = [_signed(xxhash.xxh64_intdigest("\n".join(t for t, _ in b).encode(errors="replace"))) for b, _ in found]
        return {
            "content": pa.array(contents, pa.int64()),
            "blocks": pa.array([[{"text": t, "box": k} for t, k in b] for b, _ in found], pa.list_(pa.struct([("text", pa.string()), ("box", pa.int32())]))),
            "boxes": pa.array([[{"hash": h, "outer": k, "holds": y} for (h, k), y in zip(x, _holding(b, x), strict=True)] for b, x in found], pa.list_(pa.struct([("hash", pa.int64()), ("outer", pa.int32()), ("holds", pa.bool_())]))),
        }

    return boxed(pages, html, keep, lambda: work, "content bigint, blocks array<struct<text:string,box:int>>, boxes array<struct<hash:bigint,outer:int,holds:boolean>>")


def templates(parsed: DataFrame) -> DataFrame:
    """Host and hash of every box that recurs on different pages of the host.

    Pairs and counts are reduced within partitions before each shuffle, so a host with a third of all pages costs no more.
    """
    there = parsed.select("keep.host", "content", F.explode(F.array_distinct("boxes.hash")).alias("hash")).distinct()
    return there.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "hash")


def _remaining(blocks: list[dict], boxes: list[dict], gone: list[int] | None) -> str:
    if not gone:
        return "\n".join(b["text"] for b in blocks)
    out, dead = set(gone), []
    for x in boxes:  # a box comes after the one around it
        dead.append(x["hash"] in out or (x["outer"] >= 0 and dead[x["outer"]]))
    return "\n".join(b["text"] for b in blocks if b["box"] < 0 or not dead[b["box"]])


def main_text(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url") -> DataFrame:
    """``keep``, text and n_chars for each row of ``pages``."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    rows = pages.select(kept, F.col(f"`{html}`").alias("html"), host_of(F.col(f"`{url}`")).alias("host"), F.monotonically_increasing_id().alias("row"))
    parsed = saved(page_blocks(rows, ["kept", "host", "row"]), "html-blocks")
    recurring = saved(templates(parsed), "html-templates")
    # Only boxes that hold content can take any with them.
    holding = F.transform(F.filter("boxes", lambda x: x["holds"]), lambda x: x["hash"])
    boxes = parsed.select("keep.row", "keep.host", F.explode(F.array_distinct(holding)).alias("hash"))
    gone = boxes.join(recurring, ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("gone"))  # at most a page's own boxes
    gone = saved(gone, "html-gone")  # its size is then known before texts would be shuffled to meet it
    joined = parsed.join(gone, F.col("keep.row") == F.col("row"), "left").select(F.struct("blocks", "boxes", "gone").alias("page"), "keep.kept")

    def work(pages: pa.Array) -> dict:
        text = [_remaining(p["blocks"], p["boxes"], p["gone"]) for p in pages.to_pylist()]
        return {"text": pa.array(text, pa.string()), "n_chars": pa.array(list(map(len, text)), pa.int64())}

    return boxed(joined, "page", ["kept"], lambda: work, "text string, n_chars bigint").select("keep.kept.*", "text", "n_chars")


def page_texts(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
