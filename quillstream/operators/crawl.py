"""Links of pages: extraction, filtering by strategy and words, the set of each key, and crawls from page to page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import domains, links, text

HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def hrefs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), text.common_entities)


def page_links(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] = (), strategy: str = "all", keywords: list[str] = ()) -> DataFrame:
    """``keep``, page (its address) and link: absolute links, relevant, by strategy and words; each once for a page."""
    rows = pages.select(*keep, F.col(url).alias("page"), F.explode(F.array_distinct(hrefs(F.col(html)))).alias("href")).where(~links.is_irrelevant(F.col("href")))
    rows = rows.withColumn("link", links.absolute(F.col("page"), F.col("href"))).where("link is not null")
    return rows.where(links.follows(strategy, F.col("page"), F.col("link")) & links.has_keyword(F.col("link"), list(keywords))).select(*keep, "page", "link").distinct()


def links_of(found: DataFrame, key: str, link: str = "link", limit: int | None = None) -> DataFrame:
    """Sorted distinct links of each key and their number. ``limit`` is exact: so many, not one more."""
    urls = F.array_sort(F.collect_set(link))
    rows = found.groupBy(key).agg(urls.alias("urls"))
    rows = rows.withColumn("urls", F.slice("urls", 1, limit)) if limit is not None else rows
    return rows.withColumn("n", F.size("urls"))


def likeliest_release_page(urls: Column) -> Column:
    """A stand-in for a model that picks a page of press releases: the shortest that says so, else none."""
    telling = F.filter(urls, lambda u: F.lower(u).rlike("press|news|investor|release"))
    return F.get(F.array_sort(F.transform(telling, lambda u: F.struct(F.length(u).alias("n"), u.alias("u")))), F.lit(0))["u"]


def write_url_lists(found: DataFrame, key: str, path: str, link: str = "link") -> None:
    """A folder for each key with its sorted links as text, one to a line."""
    found.select(key, link).distinct().repartition(key).sortWithinPartitions(key, link).write.partitionBy(key).mode("overwrite").text(path)


def same_domain(rows: DataFrame, a: str, b: str, rules: DataFrame) -> DataFrame:
    """Rows whose two URLs have the same label of a registrable domain, by the table of public suffixes.

    Only the label is compared, so example.com and example.co.uk are the same; a URL without one is no other's.
    """
    named = rows.withColumns({"__a": links.host(F.col(a)), "__b": links.host(F.col(b))})
    named = domains.with_domains(domains.with_domains(named, "__a", rules, "__a_"), "__b", rules, "__b_")
    return named.where("__a_label = __b_label").select(*rows.columns)


class Crawl:
    """A breadth-first crawl. Each level of its frontier is a folder, written once; what is there is not visited again.

    ``visit`` gives the pages (url, html) of a frontier: by a join with pages that are stored, or by asking. ``resolve``
    says where links (page, link) lead, as url; without it a link is its own. A crawl whose driver has died goes on after
    the last level that was written.
    """

    def __init__(
        self, folder: str, visit: Callable[[DataFrame], DataFrame], strategy: str = "all", keywords: list[str] = (), per_host: int | None = None, rules: DataFrame | None = None, resolve: Callable[[DataFrame], DataFrame] | None = None
    ) -> None:
        self.folder, self.visit, self.strategy, self.keywords, self.per_host, self.rules, self.resolve = folder.rstrip("/"), visit, strategy, list(keywords), per_host, rules, resolve

    def _level(self, spark: SparkSession, n: int) -> DataFrame:
        return spark.read.schema("url string, parent string").parquet(f"{self.folder}/{n}").withColumn("depth", F.lit(n))

    def _written(self, spark: SparkSession, n: int) -> bool:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS")
        return done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done)

    def _admitted(self, new: DataFrame, visited: DataFrame | None) -> DataFrame:
        """New URLs as far as their hosts have room, in the order of URLs. Hosts count in all levels together."""
        if self.per_host is None:
            return new
        host = F.coalesce(links.host(F.col("url")), F.lit(""))
        ranked = new.withColumn("host", host).withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("url"))).where(F.col("n") <= self.per_host)
        if visited is None:
            return ranked.select("url", "parent")
        used = visited.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("used"))
        return ranked.join(used, "host", "left").where(F.col("n") + F.coalesce("used", F.lit(0)) <= self.per_host).select("url", "parent")

    def _found(self, level: DataFrame) -> DataFrame:
        """url and parent of all that a level's pages link to, each URL once, with its smallest parent."""
        pages = self.visit(level.select("url"))
        by_rules = self.strategy == "same-domain" and self.rules is not None
        found = page_links(pages, strategy="all" if by_rules else self.strategy, keywords=self.keywords)
        found = same_domain(found, "page", "link", self.rules) if by_rules else found
        found = self.resolve(found) if self.resolve else found.withColumn("url", F.col("link"))
        return found.where("url is not null").groupBy("url").agg(F.min("page").alias("parent"))

    def run(self, seeds: DataFrame, depth: int) -> DataFrame:
        """url, parent and depth of all that is visited, the seeds (a column url) at depth 0."""
        spark = seeds.sparkSession
        visited, n = None, 0
        while n <= depth:
            if not self._written(spark, n):
                if n == 0:
                    new = seeds.select("url").where("url is not null").distinct().withColumn("parent", F.lit(None).cast("string"))
                else:
                    new = self._found(self._level(spark, n - 1)).join(visited.select("url"), "url", "left_anti")
                self._admitted(new, visited).write.mode("overwrite").parquet(f"{self.folder}/{n}")
            level = self._level(spark, n)
            visited = level if visited is None else visited.unionByName(level)
            if level.isEmpty():
                break
            n += 1
        return visited
