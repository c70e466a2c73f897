"""Feeds and list pages to items. Each reader takes rows with a payload and gives one row for each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, links, text

LINK = "struct<_href:string,_rel:string>"
CATEGORY = "struct<_term:string,_scheme:string>"
ATOM = f"entry array<struct<id:string,title:string,link:array<{LINK}>,published:string,updated:string,summary:string>>"
DUBLIN_CORE = (
    f"entry array<struct<id:string,title:string,link:array<{LINK}>,published:string,updated:string,content:string,category:array<{CATEGORY}>,"
    "modified:string,identifier:string,language:string,publisher:string,contributor:string,subject:array<string>,keyword:array<string>>>"
)
RSS = "channel struct<item:array<struct<guid:string,title:string,link:string,pubDate:string,description:string>>>"


def _plain(xml: Column) -> Column:
    """XML without namespace declarations and prefixes, and without what attributes would make of plain text elements."""
    xml = F.regexp_replace(xml, r"""\sxmlns(:\w+)?=("[^"]*"|'[^']*')""", "")
    xml = F.regexp_replace(xml, r"<(/?)\w+:(\w+)", "<$1$2")
    return F.regexp_replace(xml, r"<(id|guid|title|published|updated|summary|content|description|modified|identifier|language|publisher|contributor|subject|keyword)\s[^>]*?(/?)>", "<$1$2>")


def _given(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def _link(links: Column) -> Column:
    """The link that is marked as alternate, else the first."""
    alternate = F.filter(links, lambda x: x["_rel"] == "alternate")
    return _given(F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"]))


def _complete(items: DataFrame) -> DataFrame:
    return items.where("id is not null and title is not null and url is not null")


def atom(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """id, title, url, timestamp (published, else updated), summary; entries without the first three are skipped."""
    e = F.col("e")
    rows = payloads.select(F.explode(F.from_xml(_plain(F.col(column)), ATOM)["entry"]).alias("e"))
    return _complete(rows.select(_given(e["id"]).alias("id"), _given(e["title"]).alias("title"), _link(e["link"]).alias("url"), dates.iso_to_utc(F.coalesce(_given(e["published"]), _given(e["updated"]))).alias("timestamp"), _given(e["summary"]).alias("summary")))


def atom_dublin_core(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Atom with the publisher's data: repeated elements as arrays without blanks, NULL where nothing is left."""
    e = F.col("e")

    def several(x: Column) -> Column:
        kept = F.filter(F.transform(x, lambda v: F.trim(v)), lambda v: v != "")
        return F.when(F.size(kept) > 0, kept)

    rows = payloads.select(F.explode(F.from_xml(_plain(F.col(column)), DUBLIN_CORE)["entry"]).alias("e"))
    categories = F.transform(e["category"], lambda c: F.struct(c["_term"].alias("term"), c["_scheme"].alias("scheme")))
    return _complete(
        rows.select(
            _given(e["id"]).alias("id"), _given(e["title"]).alias("title"), _link(e["link"]).alias("url"),
            dates.iso_to_utc(F.coalesce(_given(e["published"]), _given(e["updated"]))).alias("timestamp"),
            dates.iso_to_utc(_given(e["updated"])).alias("updated_utc"), _given(e["modified"]).alias("modified_utc"),
            *[_given(e[c]).alias(c) for c in ("identifier", "language", "publisher", "contributor")],
            several(e["subject"]).alias("subjects"), several(e["keyword"]).alias("keywords"),
            F.when(F.size(categories) > 0, categories).alias("categories"), _given(e["content"]).alias("content_html"),
        )
    )


def rss(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """As atom; the id is the guid, else the link, and dates are those of mail."""
    e = F.col("e")
    rows = payloads.select(F.explode(F.from_xml(_plain(F.col(column)), RSS)["channel"]["item"]).alias("e"))
    link = _given(e["link"])
    return _complete(rows.select(F.coalesce(_given(e["guid"]), link).alias("id"), _given(e["title"]).alias("title"), link.alias("url"), dates.rfc822_to_utc(e["pubDate"]).alias("timestamp"), _given(e["description"]).alias("summary")))


def html_list(pages: DataFrame, scope: str, item: str, fields: dict[str, str], column: str = "html", keep: list[str] = ()) -> DataFrame:
    """Items of a list page: the scope's match, in it every match of the item, in that the first match of each field.

    Patterns have one group each. Tags are stripped from fields; a field that isn't there is NULL.
    """
    page = F.regexp_extract(F.col(column), scope, 1)
    rows = pages.select(*keep, F.explode(F.regexp_extract_all(page, F.lit(item), F.lit(1))).alias("__item"))
    return rows.select(*keep, *[F.nullif(text.strip_tags(F.regexp_extract("__item", p, 1)), F.lit("")).alias(name) for name, p in fields.items()])


#: The sites whose lists these are, to which their links are relative.
NEWS_SITE, RELEASE_SITE = "https://www.businesswire.com", "https://www.prnewswire.com"


def news_list(pages: DataFrame, column: str = "html", base: str = NEWS_SITE) -> DataFrame:
    """A list of <li> items with a link, a heading, a snippet and a time. Links are made absolute, and are ids."""
    fields = {"url": r'(?is)<a[^>]+href="([^"]+)"', "title": r"(?is)<h2[^>]*>(.*?)</h2>", "summary": r'(?is)<div[^>]*class="[^"]*snippet[^"]*"[^>]*>(.*?)</div>', "time": r'(?is)<time[^>]+datetime="([^"]+)"'}
    rows = html_list(pages, r'(?is)<ul[^>]*class="[^"]*news-items[^"]*"[^>]*>(.*?)</ul>', r"(?is)<li[^>]*>(.*?)</li>", fields, column)
    url = links.absolute(F.lit(base), F.trim("url"))
    return _complete(rows.select(url.alias("id"), "title", url.alias("url"), dates.iso_to_utc(F.col("time")).alias("timestamp"), "summary"))


def release_cards(pages: DataFrame, column: str = "html", base: str = RELEASE_SITE) -> DataFrame:
    """Cards that are links, with the Eastern time inside the heading, from which it is removed. Links are made absolute."""
    card = r'(?is)(<a[^>]*class="[^"]*consolidatelink[^"]*"[^>]*>.*?</a>)'
    rows = pages.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(card), F.lit(1))).alias("c"))
    c = F.col("c")
    heading = F.regexp_extract(c, r"(?is)<h3[^>]*>(.*?)</h3>", 1)
    when = text.strip_tags(F.regexp_extract(heading, r"(?is)<small[^>]*>(.*?)</small>", 1))
    title = F.nullif(text.strip_tags(F.regexp_replace(heading, r"(?is)<small[^>]*>.*?</small>", " ")), F.lit(""))
    url = links.absolute(F.lit(base), F.nullif(F.trim(F.regexp_extract(c, r'(?is)href="([^"]+)"', 1)), F.lit("")))
    summary = F.nullif(text.strip_tags(F.regexp_extract(c, r"(?is)<p[^>]*>(.*?)</p>", 1)), F.lit(""))
    return _complete(rows.select(url.alias("id"), title.alias("title"), url.alias("url"), dates.wire_time_to_utc(when).alias("timestamp"), summary.alias("summary")))
