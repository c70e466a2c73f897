"""Public suffixes by the published cases, and crawls against a plain one."""

from __future__ import annotations

import pytest

from quillstream.functions import domains
from quillstream.operators import crawl

#: Published cases of the suffix list, hosts with their registrable domains.
CASES = {
    "COM": None, "example.COM": "example.com", "WwW.example.COM": "example.com", "example": None, "b.example.example": "example.example",
    "biz": None, "domain.biz": "domain.biz", "a.b.domain.biz": "domain.biz", "b.example.com": "example.com", "test.ac": "test.ac",
    "mm": None, "c.mm": None, "b.c.mm": "b.c.mm", "a.b.c.mm": "b.c.mm", "jp": None, "test.jp": "test.jp", "ac.jp": None, "test.ac.jp": "test.ac.jp",
    "kyoto.jp": None, "test.kyoto.jp": "test.kyoto.jp", "ide.kyoto.jp": None, "a.b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp",
    "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "ck": None, "test.ck": None, "b.test.ck": "b.test.ck",
    "www.ck": "www.ck", "www.www.ck": "www.ck", "us": None, "test.k12.ak.us": "test.k12.ak.us", "www.test.k12.ak.us": "test.k12.ak.us",
    "食狮.com.cn": "食狮.com.cn", "食狮.公司.cn": "食狮.公司.cn", "公司.cn": None, "www.xn--85x722f.xn--55qx5d.cn": "xn--85x722f.xn--55qx5d.cn",
}


def test_published_cases(spark):
    hosts = spark.createDataFrame([(h,) for h in [*CASES, None, "", ".com", "a..com", "10.0.0.1", "example.com."]], "host string")
    got = {r["host"]: r for r in domains.with_domains(hosts, "host", domains.published(spark)).collect()}
    assert {h: got[h]["domain"] for h in CASES} == CASES
    assert all(got[h]["suffix"] is None for h in (None, "", ".com", "a..com", "10.0.0.1"))
    assert got["example.com."]["domain"] == "example.com" and got["www.city.kobe.jp"]["label"] == "city" and got["example"]["suffix"] == "example"


def test_rules_of_lists():
    lines = ["// a comment", "", "com  // what follows is no rule", "*.Ck", "!www.ck", "公司.cn", "// ===BEGIN PRIVATE DOMAINS===", "blogspot.com"]
    assert set(domains.parsed(lines)) == {("com", 1, False), ("ck", 2, False), ("www.ck", 1, True), ("公司.cn", 2, False), ("xn--55qx5d.cn", 2, False)}
    assert ("blogspot.com", 2, False) in domains.parsed(lines, private=True)


def test_same_domain_by_rules(spark):
    rows = [("http://a.example.co.uk/x", "https://example.com/"), ("http://a.co.uk", "http://b.co.uk"), ("http://co.uk", "http://co.uk"), ("http://x.city.kobe.jp", "http://city.kobe.jp"), (None, None)]
    df = spark.createDataFrame(rows, "page string, link string")
    assert {r["link"] for r in crawl.same_domain(df, "page", "link", domains.published(spark)).collect()} == {"https://example.com/", "http://city.kobe.jp"}


SITE = {
    "http://a.com/": ["/1", "/2", "http://b.com/", "#x", "javascript:y"], "http://a.com/1": ["/", "/2", "3"], "http://a.com/2": ["/4", "http://www.a.com/5"],
    "http://a.com/3": ["/6"], "http://a.com/4": ["/1"], "http://www.a.com/5": ["http://a.com/7"], "http://a.com/6": ["/8"], "http://b.com/": ["/9", "http://a.com/1"], "http://b.com/9": [],
}


@pytest.fixture
def site(spark):
    rows = [(u, "".join(f'<a href="{x}">x</a>' for x in hrefs)) for u, hrefs in SITE.items()]
    return spark.createDataFrame(rows, "url string, html string")


def plain(follows, depth, per_host=None):
    from urllib.parse import urljoin, urlsplit

    host = lambda u: urlsplit(u).hostname
    level, seen, used = ["http://a.com/"], {}, {}
    for n in range(depth + 1):
        admitted = []
        for u in sorted(level):
            if per_host is None or used.get(host(u), 0) < per_host:
                used[host(u)] = used.get(host(u), 0) + 1
                seen[u] = n
                admitted.append(u)
        found = {urljoin(u, x) for u in admitted for x in SITE.get(u, []) if not x.startswith(("#", "javascript:")) and follows(host(u), host(urljoin(u, x)))}
        level = [u for u in found if u not in seen]
    return seen


@pytest.mark.parametrize(("strategy", "per_host"), [("all", None), ("same-hostname", None), ("same-domain", None), ("all", 3)])
def test_crawl_against_a_plain_one(spark, site, tmp_path, strategy, per_host):
    follows = {"all": lambda a, b: True, "same-hostname": lambda a, b: a == b, "same-domain": lambda a, b: a.removeprefix("www.") == b.removeprefix("www.")}[strategy]
    visit = lambda frontier: frontier.join(site, "url")
    seeds = spark.createDataFrame([("http://a.com/",), ("http://a.com/",), (None,)], "url string")
    got = crawl.Crawl(f"{tmp_path}/c", visit, strategy, per_host=per_host, rules=domains.published(spark)).run(seeds, 3)
    assert {r["url"]: r["depth"] for r in got.collect()} == plain(follows, 3, per_host)
    assert got.count() == len(plain(follows, 3, per_host))


def test_a_crawl_goes_on_after_its_last_level(spark, site, tmp_path):
    asked: list = []

    def visit(frontier):
        asked.append(sorted(r["url"] for r in frontier.collect()))
        if len(asked) == 2:
            raise RuntimeError("the driver dies")
        return frontier.join(site, "url")

    seeds = spark.createDataFrame([("http://a.com/",)], "url string")
    with pytest.raises(RuntimeError):
        crawl.Crawl(f"{tmp_path}/c", visit).run(seeds, 3)
    got = crawl.Crawl(f"{tmp_path}/c", visit).run(seeds, 3)
    assert asked[0] == ["http://a.com/"] and asked[1] == asked[2]  # the first level is not visited again
    assert {r["url"]: r["depth"] for r in got.collect()} == plain(lambda a, b: True, 3)
    assert crawl.Crawl(f"{tmp_path}/none", lambda f: f.join(site, "url")).run(seeds.limit(0), 3).count() == 0
