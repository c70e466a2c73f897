"""Edge cases of parsers, stores, predicates and streams that the driver's tables don't have."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstream.functions import dates, html, links, text, validate
from quillstream.operators import crawl, dedup, filings, judge, predicates, store, ticks
from quillstream.sources import feeds, payloads
from quillstream.streaming import dataflow, state


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


UTC = dt.datetime


@pytest.mark.parametrize(
    ("f", "raw", "want"),
    [
        (dates.iso_to_utc, "2025-08-15T17:04:00Z", UTC(2025, 8, 15, 17, 4)),
        (dates.iso_to_utc, "2025-08-15T17:04:00+02:00", UTC(2025, 8, 15, 15, 4)),
        (dates.iso_to_utc, "soon", None),
        (dates.rfc822_to_utc, "Fri, 15 Aug 2025 17:04:00 GMT", UTC(2025, 8, 15, 17, 4)),
        (dates.rfc822_to_utc, "15 Aug 2025 17:04:00 -0400", UTC(2025, 8, 15, 21, 4)),
        (dates.rfc822_to_utc, "yesterday", None),
        (dates.wire_time_to_utc, "Aug 15, 2025, 17:04 ET", UTC(2025, 8, 15, 21, 4)),
        (dates.wire_time_to_utc, "Jan 15, 2025, 17:04 ET", UTC(2025, 1, 15, 22, 4)),
        (dates.wire_time_to_utc, "", None),
        (dates.acceptance_to_utc, "<ACCEPTANCE-DATETIME>20251102013000", UTC(2025, 11, 2, 5, 30)),
        (dates.acceptance_to_utc, "none", None),
        (dates.millis_or_iso_to_utc, "1755277440000", UTC(2025, 8, 15, 17, 4)),
    ],
)
def test_times(spark, f, raw, want):
    assert one(spark, f(F.lit(raw)).cast("timestamp_ntz")) == want


@pytest.mark.parametrize(("raw", "want"), [("ab.c-1", "AB.C-1"), ("a$b", "AB"), ("elevenchars", None), ("$$$", None), ("", None), (None, None)])
def test_tickers(spark, raw, want):
    assert one(spark, validate.ticker(F.lit(raw).cast("string"))) == want


def test_numbers_and_names(spark):
    assert one(spark, validate.numeric(F.lit("1e13"))) is None
    assert one(spark, validate.numeric(F.lit("nan"))) is None
    assert one(spark, validate.numeric(F.lit("-5.5"))) == -5.5
    assert one(spark, validate.company_name(F.lit("  A \t"))) == "A"
    assert one(spark, validate.company_name(F.lit("n" * 201))) is None
    assert one(spark, F.isnan(validate.surprise(F.lit(1.0), F.lit(float("nan"))))) is True
    assert one(spark, validate.unset_to_null(F.lit(2147483647), "int")) is None


def test_text(spark):
    assert one(spark, text.strip_tags(F.lit("<p>a &amp;lt; b</p>  <i>c</i>"))) == "a &lt; b c"
    assert one(spark, text.strip_tags(F.lit("<p>&eacute;&copy;</p>"), text.decoded)) == "é©"
    assert one(spark, text.useful_lines(F.lit("a long line\nAll Rights Reserved\n a long line \nx\nother line"))) == "a long line\nother line"
    assert one(spark, text.tidy(F.lit(" a \n\n\n\n b\t c "))) == "a\n\nb c"
    assert one(spark, text.tidy(F.lit("  "))) is None
    assert one(spark, text.html_to_lines(F.lit("<p>a</p><div> b<br>c</div><p></p>"))) == "a\nb\nc"
    assert one(spark, text.useful_tokens(F.lit("The ▲▲▲ earnings of ccp ↑12 it rose"))) == ["earnings", "rose"]
    assert one(spark, text.strip_tags(F.lit("Caf&eacute; &#8217;s &copy;"))) == "Café ’s ©"
    assert one(spark, text.html_to_lines(F.lit("foo<b>bar</b><br>x &hellip;"))) == "foobar\nx …"


def test_links(spark):
    page = F.lit("https://www.a.com/x/y")
    follow = lambda s, u: one(spark, links.follows(s, page, F.lit(u)))
    assert follow("same-domain", "http://ir.a.org/") is True
    assert follow("same-hostname", "http://a.com/") is False
    assert follow("same-origin", "https://www.a.com:443/z") is True
    assert follow("same-origin", "http://www.a.com/z") is False
    assert follow("same-domain", "mailto:x@a.com") is False
    assert follow("odd", "https://www.a.com/") is False
    assert one(spark, links.domain_label(F.lit("https://x.example.co.uk/"))) == "example"
    assert one(spark, links.has_keyword(F.lit("https://a.com/Press"), ["press"])) is True
    assert one(spark, links.has_keyword(F.lit("https://a.com/"), [])) is True
    df = spark.createDataFrame([("https://a.com/d/p", '<a href="../q?x">1</a><a href="#t">2</a><a href="javascript:v()">3</a><A HREF=\'//b.com/\'>4</A><a class="k" href="http://a.com/z">5</a><a href="../q?x">6</a>')], "url string, html string")
    got = sorted(r["link"] for r in crawl.page_links(df).collect())
    assert got == ["http://a.com/z", "https://a.com/q?x", "https://b.com/"]
    assert crawl.links_of(crawl.page_links(df), "page", limit=2).first()["n"] == 2
    assert one(spark, crawl.likeliest_release_page(F.array(F.lit("http://a/long-news"), F.lit("http://a/press"), F.lit("b")))) == "http://a/press"


FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/">
<entry><id>1</id><title type="html">One</title><link rel="self" href="http://s"/><link rel="alternate" href="http://a"/><published>2025-08-15T17:04:00Z</published>
<updated>2025-08-16T00:00:00Z</updated><dc:subject>x</dc:subject><dc:subject> </dc:subject><dc:subject>y</dc:subject><dc:language>en</dc:language><category term="t" scheme="s"/></entry>
<entry><id> </id><title>Blank id</title><link href="http://b"/></entry><entry><id>3</id><title>No link</title></entry>
<entry><id>4</id><title>Four</title><link href="http://d"/><updated>bad</updated></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([(FEED,), ("not xml",)], "payload string")
    got = {r["id"]: r for r in feeds.atom(df).collect()}
    assert set(got) == {"1", "4"}
    assert got["1"]["url"] == "http://a"
    assert got["4"]["timestamp"] is None
    dc = {r["id"]: r for r in feeds.atom_dublin_core(df).collect()}
    assert dc["1"]["subjects"] == ["x", "y"]
    assert dc["1"]["language"] == "en"
    assert dc["1"]["categories"][0]["term"] == "t"
    assert dc["4"]["subjects"] is None
    rss = '<rss><channel><item><title>T</title><link>http://l</link><pubDate>Fri, 15 Aug 2025 17:04:00 GMT</pubDate><description>d</description></item><item><guid isPermaLink="false">g</guid><title>U</title><link>http://m</link></item></channel></rss>'
    got = {r["id"]: r for r in feeds.rss(spark.createDataFrame([(rss,)], "payload string")).collect()}
    assert set(got) == {"http://l", "g"}


def test_lists(spark):
    rel = '<ul class="bw-news-items"><li class="bw-news-item"><a href="/news/1"><h2>T</h2></a></li></ul>'
    assert feeds.news_list(spark.createDataFrame([(rel,)], "html string")).first()["url"] == "https://www.businesswire.com/news/1"
    a = '<ul class="bw-news-items"><li class="i"><a href="http://u"><h2>A &amp; B</h2></a><div class="bw-news-item-snippet">S</div><time datetime="2025-08-15T17:04:00Z">t</time></li><li>none</li></ul>'
    got = feeds.news_list(spark.createDataFrame([(a,)], "html string")).collect()
    assert [(r["title"], r["summary"]) for r in got] == [("A & B", "S")]
    b = '<a class="newsreleaseconsolidatelink x" href="/n/1"><h3><small>Aug 15, 2025, 17:04 ET</small> Title </h3><p class="remove-outline">P</p></a>'
    row = feeds.release_cards(spark.createDataFrame([(b,)], "html string")).first()
    assert (row["title"], row["url"], row["summary"]) == ("Title", "https://www.prnewswire.com/n/1", "P")
    assert row["timestamp"] is not None


def test_payloads(spark):
    p = '{"quoteSummary":{"result":[{"assetProfile":{"website":"http://w","sector":"S"}}]}}'
    assert one(spark, payloads.profile(F.lit(p))).asDict() == {"website_url": "http://w", "sector": "S", "industry": None}
    assert one(spark, payloads.saved_page(F.lit('{"body":"b"}'))) is None
    s = '{"data":{"tickerStream":{"stream":[{"content":{"title":"a"}},{"content":{"title":"b","clickThroughUrl":{"url":"http://b"}}}]}}}'
    df = spark.createDataFrame([("x", s)], "ticker string, payload string")
    assert [r["title"] for r in payloads.press_releases(df).collect()] == ["b"]
    assert payloads.latest_press_release(df).count() == 0
    assert payloads.days([df.select("ticker"), df.select("payload")]).columns == ["ticker", "payload"]


def submission(item, *documents):
    return f"<ACCEPTANCE-DATETIME>20250309023000\n{item}\n" + "".join(f"<DOCUMENT>\n<TYPE>{t}\n<TEXT>{b}</TEXT>\n</DOCUMENT>" for t, b in documents)


#: items, tiers, highest, exhibit, contract, fallback of each shape.
FILINGS = [
    ("Item 5.02", [("8-K", "<p>An officer left.</p>")], ["5.02"], {"5.02": 1}, 1, None, False, True),
    ("Item 2.02 Item 9.01", [("8-K", "<p>b</p>"), ("EX-99.1", "<p>Our results.</p>")], ["2.02", "9.01"], {"2.02": 1}, 1, "EX-99.1", False, False),
    ("Item 1.01 Item 1.02 Item 9.01", [("8-K", "<p>Agreement.</p>"), ("EX-10.1", "x")], ["1.01", "1.02", "9.01"], {"1.01": 1, "1.02": 2}, 1, None, True, True),
    ("", [("8-K", "b"), ("EX-99.1", "<p>Text.</p>"), ("EX-2.1", "c")], [], {}, None, "EX-99.1", True, False),
    ("Item 5.02 Item 404 item 7.01", [("8-K", "b"), ("EX-99.2", "second"), ("EX-99.1", "<p>first</p>")], ["5.02", "404", "7.01"], {"5.02": 1}, 1, "EX-99.1", False, False),
    ("Item 3.02 Item 5.07", [("8-K", "<p>b</p>"), ("EX-99.01", "odd name")], ["3.02", "5.07"], {}, None, None, False, False),
]


def test_filings(spark):
    df = spark.createDataFrame([(i, submission(f[0], *f[1])) for i, f in enumerate(FILINGS)], "n int, submission string")
    for r in filings.analyse(df).collect():
        _, _, items, tiers, highest, exhibit, contract, fallback = FILINGS[r["n"]]
        assert (r["items"], r["items_tier_map"], r["highest_item_tier"], r["primary_exhibit_type"]) == (items, tiers, highest, exhibit), r["n"]
        assert (r["has_material_contract_exhibit"], r["fallback_used"]) == (contract, fallback), r["n"]
    assert one(spark, filings.exhibit_99(F.lit(submission("", ("EX-10.1", "no"), ("EX 99.2", "second"), ("EX-99.01", "odd"))))) == "odd"
    assert one(spark, filings.submission_url(F.lit('<a href="/Archives/1.txt">'))) == "https://www.sec.gov/Archives/1.txt"


def test_readable_html():
    page = "<html><body><header>Top of page</header><nav>Menu here</nav><div id='content'><h1>Head line</h1><p>First text</p><p>Second text with <a href='/x'>a link</a></p><ul><li>item one</li><li>item two</li></ul><script>no</script></div><footer>Foot notes</footer></body></html>"
    s = html.structured(page, "http://a.com/d/")
    assert s["main_content"].splitlines() == ["Head line", "  First text", "  Second text with", "  a link [URL: http://a.com/x]", "  item one", "  item two"]
    assert s["footer_content"] == "Foot notes"
    assert html.readable("") is None
    assert html.readable(None) is None
    assert "open" in html.readable("<div><p>left open")


def test_profiles_and_articles(spark):
    page = "<a data-ylk='slk:business-url' href='http://w.com'>w</a><dl><dt>Sector:</dt><dd><a>Tech</a></dd><dt>Industry</dt><dd><a>Chips</a></dd></dl>"
    assert tuple(one(spark, html.profile_of(F.lit(page)))) == ("http://w.com", "Tech", "Chips")
    assert one(spark, html.article_text(F.lit("<div class='atoms-wrapper'><p>Body text</p></div><p>other</p>"))) == "Body text"
    assert one(spark, html.article_text(F.lit("<p>Only this</p>"))) == "Only this"


def test_predicates(spark):
    df = spark.range(10)
    chain = [("id", True, 8, False), ("id", False, 1, True), ("id", True, 1, True)]
    assert [r[0] for r in df.where(predicates.conditions(chain)).collect()] == [1, 8, 9]
    assert df.where(predicates.conditions([])).count() == 10
    assert df.where(predicates.optional([("id", "eq", None), ("id", "in", [])])).count() == 10
    assert df.where(predicates.tree({"operator": "or", "operands": [{"operator": "btwn", "operands": ["id", [2, 3]]}, {"operator": "eq", "operands": ["id", 7]}]})).count() == 3


def test_store(spark):
    firms = spark.createDataFrame([("A", "1", "Firm", None, None)], "ticker string, cik string, company_name string, sector string, industry string")
    places = spark.createDataFrame([(3, "NYSE")], "id bigint, name string")
    bridge = spark.createDataFrame([("A", 3)], "company_ticker string, exchange_id bigint")
    new = spark.createDataFrame([("a", "9", "Other", None, None, "nasdaq", 1), ("b", "2", "B", None, None, "nyse", 2), ("c", "3", None, None, None, None, 3)], "ticker string, cik string, company_name string, sector string, industry string, exchange string, seq int")
    f, p, b = store.add_company_and_exchange(firms, places, bridge, new, "seq")
    assert sorted((r["ticker"], r["company_name"]) for r in f.collect()) == [("A", "Firm"), ("B", "B")]
    assert sorted(map(tuple, p.collect())) == [(3, "NYSE"), (4, "NASDAQ")]
    profile = {r["ticker"]: r["exchanges"] for r in store.company_profile(f, b, p).collect()}
    assert profile == {"A": "NASDAQ, NYSE", "B": "NYSE"}
    changed = store.coalesce_update(firms, spark.createDataFrame([("A", "Tech", None)], "ticker string, sector string, industry string"), ["ticker"], ["sector", "industry"]).first()
    assert (changed["sector"], changed["industry"]) == ("Tech", None)


def test_changes_and_caches(spark):
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate("AABAAC")], "key string, v string, seq int")
    assert [r["seq"] for r in dedup.changes(df, "key", F.col("v"), "seq").orderBy("seq").collect()] == [0, 2, 3, 5]
    last = spark.createDataFrame([("k", "A")], "key string, v string")
    assert dedup.changed_since(df, last, "key", "v").count() == 2
    assert sorted(r["v"] for r in dedup.most_recent(df, "v", 2, "seq").collect()) == ["A", "C"]


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 4, "a"), (3, 10, "b")], "id int, t int, k string")
    right = spark.createDataFrame([(7, 5, "a"), (8, 10, "a"), (9, 11, "a")], "id int, t int, k string")
    assert sorted(map(tuple, ticks.as_of(left, right, "k", "t", "id", ["id"]).select("id", "asof_id").collect())) == [(1, 8), (2, None), (3, None)]


def test_judge(spark):
    df = spark.createDataFrame([("t", "Record quarter: profit and growth"), ("t", None), ("t", "weather")], "ticker string, text_content string")
    assert [r["judgement_score"] for r in judge.judged(df).collect()] == [3]

    def scorer(x):
        if "weather" in x:
            raise ValueError(x)
        return True, "so", 5

    assert judge.judged(df, scorer=judge.by_function(scorer)).count() == 1


def stream(spark, tmp_path, schema, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(rows, tmp_path, name="out"):
    rows.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(str(tmp_path / name))


def test_stream_changes_over_batches(spark, tmp_path):
    rows = stream(spark, tmp_path, "k string, v string, seq long", [("a", "x", 1), ("a", "x", 2)], [("a", "x", 3), ("a", "y", 4), ("b", "x", 5)])
    assert sorted(r["seq"] for r in run(state.changes(rows, "k", "v", "seq"), tmp_path).collect()) == [1, 4, 5]


def test_bounded_cache_forgets(spark, tmp_path):
    rows = stream(spark, tmp_path, "g string, id string, seq long", [("g", i, n) for n, i in enumerate("abcda")])
    assert [r["id"] for r in run(state.unseen_bounded(rows, "g", "id", "seq", 3), tmp_path).orderBy("seq").collect()] == list("abcda")


def test_router(spark, tmp_path):
    router = dataflow.Router(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="channel"):
        router.produce(None, spark.range(1))
    router.produce("a", stream(spark, tmp_path, "id long", [(1,), (2,)]))
    router.route("a", "b")(lambda df: df.where("id > 1"))
    got: list = []
    router.sink("a", "all", dataflow.parquet_sink(str(tmp_path / "all")))
    router.sink("b", "some", lambda batch, n: got.extend(batch.collect()))
    assert router.node_count == 4
    router.start(availableNow=True)
    assert router.wait(60)
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2
    assert [r["id"] for r in got] == [2]
    router.route("b", "a")(lambda df: df)
    with pytest.raises(ValueError, match="feed each other"):
        router.channel("a")
    with pytest.raises(KeyError):
        router.channel("nothing")


def test_polled_source_reads_once_for_each_state(spark, tmp_path):
    from quillstream.streaming import polling

    def fetch(seen):
        return {"etag": "v1", "last_modified": "now"}, [("a", 1), ("b", 2)]

    polling.register(spark, "polled_test", "id string, n int", fetch)
    q = spark.readStream.format("polled_test").load().writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        q.processAllAvailable()
        assert sorted(r["id"] for r in spark.table("polled").collect()) == ["a", "b"]
    finally:
        q.stop()


def test_stream_bars_close_with_the_watermark(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1, 10, 0)
    rows = [("s", t0, 2.0, 1.0), ("s", t0 + dt.timedelta(seconds=20), 4.0, 3.0), ("s", t0 + dt.timedelta(minutes=1), 5.0, 1.0)]
    late = [("s", t0 + dt.timedelta(minutes=30), 1.0, 1.0)]
    df = stream(spark, tmp_path, "k string, t timestamp, p double, q double", rows, late)
    got = {r["open"]: r for r in run(state.bars(df, "k", "t", "1 minute", "p", "q"), tmp_path).collect()}
    assert got[2.0]["vwap"] == 3.5
    assert got[2.0]["high"] == 4.0
    assert got[5.0]["trades"] == 1


def test_followed_by_in_a_stream(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    a = stream(spark, tmp_path / "a", "k string, t timestamp, n int", [("x", t0, 1)])
    b = stream(spark, tmp_path / "b", "k string, t timestamp, n int", [("x", t0 + dt.timedelta(hours=23), 2), ("x", t0 + dt.timedelta(hours=25), 3), ("y", t0, 4)])
    got = run(state.followed_by(a, b, "k", "t", "24 HOURS", "25 hours").select("l_n", "r_n"), tmp_path)
    assert [tuple(r) for r in got.collect()] == [(1, 2)]


def test_odd_times_and_names(spark):
    assert one(spark, dates.millis_or_iso_to_utc(F.lit("9223372036854775807"))) is None
    assert one(spark, dates.acceptance_to_utc(F.lit("<Acceptance-Datetime> 20250309023000"))) is not None
    odd = '{"fields":["Ticker",null,"ticker","cik","name"],"data":[["a","x","b",1,"N"],["short"]]}'
    assert [tuple(r) for r in payloads.company_seed(spark.createDataFrame([(odd,)], "payload string")).collect()] == [("B", "1", "N", None)]
    values = spark.createDataFrame([(1, None, "x", 1), (1, "t", "y", 2)], "a int, tag string, v string, n int")
    assert ticks.account_summary(values, "a", "tag", "v", "n").first()["summary"] == {"t": "y"}


def test_structured_text_as_lines(spark):
    page = (
        "<html><head><title>Title</title><meta name='keywords' content='k1, k2'></head><body><nav><a href='/m'>Menu here</a></nav><div id='main'>Begin"
        "<h1 class='header'>Head</h1><section><p>Deep <b>bold</b><a class='menu' href='x?y=1'>Link</a><p>More<ul><li>one thing</ul></section><div class='sidebar'>no</div>"
        "<p>Copyright nobody</p></div><div class='top-bar'>Bar</div><footer>Foot</footer></body></html>"
    )
    got = html.structured(page, "http://a.com/p/")
    assert got["main_content"].split("\n") == [" Begin", "Head", "   Deep", "   bold", "   Link [URL: http://a.com/p/x?y=1]", "   More", "   one thing"]
    assert got["navigation_content"].split("\n")[0] == "Menu here [URL: http://a.com/m]"
    assert (got["header_content"], got["footer_content"], got["sidebar_content"]) == ("Head\n Bar", "Foot", None)  # two letters are no line
    assert html.query_of(page) == "Title Head k1, k2"
    assert html.query_of("<body><h1>H</h1><p>short<p>" + "w" * 200) == "H " + "w" * 150
    assert html.query_of(page, "asked") == "asked"
    assert html.cleaned(html.tree("<div class='x' lang='en'> a <script>s</script><b style='c'>b</b></div>").children[0]) == '<div lang="en">a<b>b</b></div>'


def test_polled_source_replays_after_a_restart(spark, tmp_path):
    from quillstream.streaming import polling

    state = tmp_path / "asked"

    def fetch(offset):
        n = int(offset["etag"] or 0) + 1
        first = not state.exists()
        state.write_text("x")
        # The service gives its first row only to the first who asks.
        return ({"etag": str(n), "last_modified": ""}, [(n, "only once" if first else "later")]) if n <= 2 else (offset, [])

    polling.register(spark, "once", "n int, what string", fetch)
    failing, got = [True], []

    def write(batch, _):
        if failing[0]:
            raise RuntimeError("the sink is down")
        got.extend(r["what"] for r in batch.collect())

    def run():
        q = spark.readStream.format("once").load().writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/c").start()
        try:
            q.processAllAvailable()
        except Exception:  # noqa: BLE001  the first run is meant to fail
            pass
        q.stop()

    run()
    failing[0] = False
    run()
    assert got == ["only once", "later"]


def test_pollers_and_files(spark, tmp_path):
    from quillstream.sources import pollers

    (tmp_path / "a.xml").write_text('<feed><entry><id>1</id><title>T</title><link href="http://x/1"/></entry><entry><id>2</id><title>U</title><link href="http://x/2"/></entry><entry><id>2</id><title>U</title><link href="http://x/2"/></entry></feed>')
    poller = pollers.FilePoller("Wire", f"{tmp_path}/a.xml", feeds.atom)
    seen = spark.createDataFrame([("1",)], "id string")
    got = poller.poll(spark, seen).collect()
    assert [(r["source"], r["item"]["id"], r["item"]["article_text"]) for r in got] == [("Wire", "2", None)]
    assert {r["item"]["id"] for r in poller.poll(spark).collect()} == {"1", "2"}
    pages = spark.createDataFrame([("k1", "<p>a\nb"), ("k2", None)], "id string, body string")
    pollers.write_pages(pages, "id", "body", f"{tmp_path}/pages")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/pages").select("value").collect()] == ["<p>a", "b"]
    quotes = spark.createDataFrame([("A", 1.0, 2.0), ("B", 0.0, 2.0), ("C", None, 2.0)], "symbol string, bid double, ask double")
    assert [r["midpoint"] for r in pollers.with_midpoint(quotes).orderBy("symbol").collect()] == [1.5, None, None]


def test_market_data_subscriptions(spark, tmp_path):
    from quillstream.sources import pollers

    rows = spark.createDataFrame([("A", 1.0, 10.0, 1), ("A", 2.0, 5.0, 2), ("B", 9.0, 1.0, 3)], "symbol string, price double, size double, seq long")
    rows.selectExpr("symbol", "price", "size", "timestamp_seconds(1000 + seq) as ts", "seq").write.parquet(f"{tmp_path}/trades")

    class Files(pollers.MarketData):
        def trades(self, spark, stream=False):
            return (spark.readStream if stream else spark.read).schema(pollers.TRADE).parquet(f"{tmp_path}/trades")

        def quotes(self, spark, stream=False):
            raise NotImplementedError

    data, got = Files(), []
    assert data.latest_trade(spark, "A").first()["price"] == 2.0
    assert data.bars(spark, "A", "1 hour").first()["volume"] == 15.0
    data.subscribe(spark, "trades", ["A"], lambda batch, _: got.extend(r["price"] for r in batch.collect()), availableNow=True)
    assert data.subscribed() == [("trades", "A")]
    data._queries["trades", "A"].awaitTermination()
    data.unsubscribe("trades", ["A"])
    assert sorted(got) == [1.0, 2.0] and data.subscribed() == []


def test_store_counts_times_and_companies(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", dt.datetime(2020, 1, 1)), (2, "b", dt.datetime(2020, 1, 1))], "k int, v string, updated_at timestamp")
    new = spark.createDataFrame([(2, "c", None, 1), (2, "d", None, 2), (3, "e", None, 1), (None, "x", None, 1)], "k int, v string, updated_at timestamp, seq int")
    got = {r["k"]: (r["v"], r["updated_at"].year > 2020) for r in store.upsert(base, new, ["k"], "seq", touched="updated_at").collect()}
    assert got == {1: ("a", False), 2: ("d", True), 3: ("e", True)}
    rows, counters = store.save_counters(new, F.col("k").isNotNull())
    rows.where("k is not null").write.parquet(f"{tmp_path}/saved")
    assert counters.get == {"total": 4, "saved": 3, "skipped": 1}
    reports = spark.createDataFrame([("ab", dt.datetime(2025, 1, 1), "Firm", 1), ("cd", None, "No time", 2), ("ef", dt.datetime(2025, 1, 1), " ", 3)], "company_ticker string, report_datetime timestamp, company_name string, seq int")
    firms = spark.createDataFrame([("XY", "Old")], "ticker string, company_name string")
    assert sorted(map(tuple, store.ensure_companies(firms, reports, "seq").collect())) == [("AB", "Firm"), ("XY", "Old")]


def test_failures_of_a_scorer_are_told(spark):
    def scorer(text):
        if "bad" in text:
            raise ValueError("no")
        return True, "r", 1

    df = spark.createDataFrame([("good",), ("bad",), (None,)], "t string")
    got = df.select("t", judge.by_function_or_error(scorer)(F.col("t")).alias("j")).collect()
    assert [(r["j"]["judgement_score"], r["j"]["error"]) for r in got] == [(1, None), (None, "ValueError: no"), (None, None)]
    assert one(spark, validate.percent(F.lit(1), F.lit(4))) == 25.0
    assert 1.0 <= one(spark, validate.jittered(F.lit(1.0))) <= 1.1


def test_bounded_cache_of_the_stream_evicts(spark, sf_dir):
    from quillstream.plans import streams

    def bounded(most):
        rows = state.unseen_bounded(streams._stream(spark, sf_dir), "event_type", "user_id", "event_id", most)
        return sorted(tuple(r) for r in streams._to_end(rows, spark).collect())

    streams._rocksdb(spark)
    got = bounded(3)
    held, want = {}, []
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect():
        own = held.setdefault(r["event_type"], {})
        if r["user_id"] not in own:
            want.append((r["event_type"], str(r["user_id"]), r["event_id"]))
            own[r["user_id"]] = True
            if len(own) > 3:
                del own[next(iter(own))]
    assert got == sorted(want)
    assert len(got) > len({(e, u) for e, u, _ in got})  # what was evicted came again


@pytest.mark.parametrize("unit", ["<i>a few</b>", '<div class="nav">some text', '<span class="menu">some text', '<div class="sidebar"><span id="nav">some text', "<p><b>some text", "<li>some text</ul>"])
def test_pages_are_read_in_time_in_proportion_to_their_length(unit):
    import time

    def seconds(n):
        began = time.perf_counter()
        html.structured(unit * n)
        return time.perf_counter() - began

    seconds(1_000)
    small, large = min(seconds(4_000) for _ in range(3)), min(seconds(32_000) for _ in range(2))
    assert large < 24 * small  # eight times the length


def test_parts_inside_parts_give_their_lines_at_each_indent_once():
    page = "<body><div id='main'><p>Story of the day</p></div>" + "".join(f"<div class='nav'><p>level {i}</p>" for i in range(8)) + "</body>"
    got = html.structured(page)["navigation_content"].split("\n")
    assert len(got) == len(set(got))
    assert [x for x in got if x.endswith("level 7")] == ["     level 7", "    level 7", "   level 7", "  level 7"]
    assert got[:3] == ["  level 0", "   level 1", "    level 2"]


def test_a_paragraph_ends_with_what_it_is_in():
    root = html.tree("<span><p>a</span><div>b</div>")
    assert [n.tag for n in root.children] == ["span", "div"]


@pytest.mark.parametrize("bucket", [60, 3_600, 10**9])
def test_changes_over_spans_of_time_are_those_of_one_pass(spark, bucket):
    import random

    rng = random.Random(bucket)
    rows = [(rng.choice(["a", "b", None]), dt.datetime(2025, 1, 1) + dt.timedelta(seconds=30 * rng.randint(0, 60)), n, rng.choice(["x", "y", None])) for n in range(300)]
    last, want = {}, []
    for k, at, n, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or last[k] != v:
            want.append(n)
        last[k] = v
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, "k string, t timestamp, n int, v string").withColumn("t", F.col("t").cast(kind))
        got = dedup.changes(df, "k", F.col("v"), "t", "n", bucket_seconds=bucket)
        assert got.columns == df.columns
        assert sorted(r["n"] for r in got.collect()) == sorted(want)
    assert sorted(r["n"] for r in dedup.changes(df, "k", F.col("v"), "n").collect()) == sorted(n for k, _, n, v in rows if next((x[3] for x in reversed(rows[:n]) if x[0] == k), "none") != v)


def test_page_structure_reads_references_as_its_sql(spark, tmp_path):
    from against import oracle, spark_rows

    from quillstream import catalog

    cut = ["one &amp; and&amp", "one &lt", "one&quo", "one &amp;&am", "one &copy", "&amp;amp; one", "one &"]
    page = "<html><head><title>x</title></head><body><nav><ul><li><a href=\"/a?b=1&copy=2&amp;c=3\">one &amp; two</a></li></ul></nav><article><h1>{0}</h1><p>{0}</p><p>one &amp; two</p></article><footer>&copy; {0}</footer></body></html>"
    rows = [(i, "https://a.com/en/1", page.format(c)) for i, c in enumerate(cut)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    got, want = spark_rows(catalog.QUERIES["q55_page_structure"](spark, str(tmp_path))), oracle(catalog.ORACLES["q55_page_structure"], str(tmp_path))
    assert got == want
    assert html.structured(page.format(cut[0]))["main_content"].split("\n")[0] == "one & and&"  # as HTML has it
