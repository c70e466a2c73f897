"""URL filtering: a blocked Bloom filter of listed canonical URLs passes possible hits, an exact hash join settles them.

Two lists are looked up, each through its own filter and join. The list of URLs holds canonical URLs: scheme and fragment
go; the host is lower-cased, without user, default port and final dot; of the path, escapes of unreserved characters
are decoded, others upper-cased, dot segments resolved and slashes at the end cut; parameters that only track a visit
go, the rest are sorted. A page whose URL is listed is blocked, unless it is the page that the list names as the one to
keep. The list of rules holds hosts and beginnings of paths with a verdict, which stands above the other list: a
rule fits its host and all subdomains, and a URL has a key for each number of labels that a rule's host has and each
length that a rule's path has. The longest rule that fits wins (of equally long ones that with the longer host, then ``block``).

A filter drops nearly all keys inside the scan, and only the rest are joined. It has a bounded size: beyond some million
listed keys it lets more through, and the join, by a shuffle then, has more to do.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is on no list; a path is
empty where the URL has none, and then fits only rules with an empty path; escapes that are cut off stay as they are;
URLs of any length are read whole; repeated rows give one output row each; empty lists give every URL the default;
columns of any name can be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import BlockedBloom
from .common import ascii_lower, saved, table

#: The rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Up to so many entries are broadcast (a few MB); longer lists are joined by a shuffle that Spark may split.
MAX_BROADCAST = 20_000
#: Parameters that say how a visitor came, not which page is asked for.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column, counts: list[int]) -> Column:
    """The last labels of a host, for each of these numbers of labels that it has."""
    has = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    if not counts:
        return F.array().cast("array<string>")
    return F.transform(F.filter(F.lit(counts), lambda k: k <= has), lambda k: F.call_function("substring_index", host, F.lit("."), -k))


def _unescaped(text: Column) -> Column:
    """Escapes of unreserved characters decoded, all others in upper case."""

    def one(part: Column) -> Column:
        code, rest = F.substring(part, 1, 2), F.substring(part, F.lit(3), F.length(part))
        char = F.chr(F.conv(code, 16, 10).cast("bigint"))
        whole = F.when(char.rlike("^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(code), rest))
        return F.when(part.rlike("^[0-9A-Fa-f]{2}"), whole).otherwise(F.concat(F.lit("%"), part))

    parts = F.split(text, "%", -1)
    return F.when(text.contains("%"), F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")).otherwise(text)


def canonical(url: Column) -> Column:
    """What URLs of one page have in common; null where there is no ``://``."""
    scheme = ascii_lower(F.regexp_extract(url, r"^([^:/?#]*)://", 1))
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^.*@", ""), r"\.+(?=:|$)", "")
    port = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    segments = F.split(_unescaped(path_of(url)), "/", -1)
    start = F.array().cast("array<string>")
    stack = F.aggregate(segments, start, lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))))
    path = F.regexp_replace(F.array_join(stack, "/"), "/+$", "")
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    asked = F.array_sort(F.filter(F.split(_unescaped(query), "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(url.contains("://"), F.concat(port, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")))


def repeated(pages: DataFrame, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """A list (url, keeper): canonical URLs that several rows have, and the smallest id among these."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), canonical(F.col(f"`{url}`")).alias("url")).where("url is not null")
    return rows.groupBy("url").agg(F.min("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("url", "keeper")


def judge(pages: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = "allow", listed: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """``keep``, host, path, rule (host and path of the rule, else null) and verdict for each row of ``pages``.

    ``rules``: host, path, verdict; of a rule given twice ``block`` counts. ``listed``: url (canonical) and keeper (the id
    of a page that isn't blocked, or null).
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep")  # whatever the names, they clash with none here
    address = F.col(f"`{url}`")
    rows = pages.select(kept, F.monotonically_increasing_id().alias("row"), host_of(address).alias("host"), path_of(address).alias("path"), *([] if listed is None else [canonical(address).alias("canonical"), F.col(f"`{id_col}`").alias("id")]))
    on_list = F.lit(False)
    if listed is not None:
        entries = saved(listed.where("url is not null").select("url", "keeper").distinct(), "urls-listed")
        n = entries.count()
        bloom = BlockedBloom(entries.select(F.xxhash64("url").alias("h")), "h", n)
        # Rows that can't be listed get a key of their own each, so that they don't meet under null.
        may = F.coalesce(bloom.may_hold(F.xxhash64("canonical")), F.lit(False)) & F.col("canonical").isNotNull()
        rows = rows.withColumn("key", F.when(may, F.col("canonical")).otherwise(F.concat(F.lit("\0"), F.col("row").cast("string"))))
        rows = rows.join(F.broadcast(entries) if n <= MAX_BROADCAST else entries, F.col("key") == F.col("url"), "left")
        on_list = F.col("url").isNotNull() & ~F.coalesce(F.col("keeper") == F.col("id"), F.lit(False))
    rows = rows.select("keep", "row", "host", "path", on_list.alias("listed"))
    known = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = saved(known.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", F.concat("host", "path").alias("rule")), "urls-rules")
    n = known.count()
    bloom = BlockedBloom(known.select(F.xxhash64("rule").alias("h")), "h", n, inside=True)
    lengths = sorted(r[0] for r in known.select(F.length("rule_path")).distinct().collect())  # no longer than a URL can be
    counts = sorted(r[0] for r in known.select((F.size(F.split("rule_host", r"\.", -1))).alias("n")).distinct().collect())  # no more than a host has labels
    path = F.col("path")
    sizes = F.filter(F.lit(lengths), lambda x: x <= F.length(path)) if lengths else F.array().cast("array<int>")

    def fits(suffix: Column) -> Column:
        keys = F.transform(sizes, lambda x: F.struct(suffix.alias("host"), F.substring(path, F.lit(1), x).alias("path")))
        return F.filter(keys, lambda k: bloom.may_hold(F.xxhash64(F.concat(k["host"], k["path"]))))

    keys = F.when(F.col("host") != "", F.flatten(F.transform(_suffixes(F.col("host"), counts), fits)))
    possible = rows.select("*", F.explode_outer(keys).alias("key"))
    met = possible.join(F.broadcast(known) if n <= MAX_BROADCAST else known, (F.col("key.host") == F.col("rule_host")) & (F.col("key.path") == F.col("rule_path")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), "verdict", "rule"))).alias("best")
    # Everything else is the same in all rows of a page, so any of them will do; a listed page may have met several entries.
    out = met.groupBy("row").agg(best, F.min("listed").alias("listed"), *[F.first(c).alias(c) for c in ("keep", "host", "path")])
    verdict = F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise(default))
    return out.select("keep.*", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under the rules; where none fits, a page is blocked if an earlier one has the same canonical URL."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, rules_frame(spark), ["page_id"], listed=repeated(pages))


#: Canonical URLs as far as SQL goes: paths with dot segments or escapes are compared as they are (tests cover these).
SQL = r"""
WITH p AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS asked
  FROM pages),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^.*@', ''), '[.]+$', '') || regexp_replace(path, '/+$', '')
                 || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical
  FROM p),
l AS (SELECT canonical, min(page_id) AS keeper FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1),
r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT c.*, keeper, (SELECT max({'n': length(r.h || r.p), 'rule': r.h || r.p, 'verdict': r.verdict}) FROM r
               WHERE (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)) AS best
  FROM c LEFT JOIN l USING (canonical))
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN keeper <> page_id THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""
