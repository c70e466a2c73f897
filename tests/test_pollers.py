"""Pollers whose services fail, and subscriptions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstream.functions import html
from quillstream.sources import feeds, pollers

FEED = "<feed>" + "".join(f'<entry><id>{i}</id><title>T{i}</title><link href="http://x/{i}"/></entry>' for i in range(6)) + "</feed>"
SUBMISSION = "<ACCEPTANCE-DATETIME>20250815170400\nItem 2.02 Results\n<DOCUMENT><TYPE>EX-99.1\n<TEXT><div id='main'>" + "".join(f"<p>Paragraph {i} of the release</p>" for i in range(6)) + "</div></TEXT></DOCUMENT>"


def service():
    """Index pages name submissions; some can't be reached, some name none, some are empty. A function of its own, as tasks don't know this module."""
    text = SUBMISSION

    def ask(url):
        if url == "http://x/1":
            raise OSError("not reached")
        if url.startswith("http://x/"):
            return "<p>no link</p>" if url.endswith("2") else f'<a href="http://s/{url[-1]}.txt">text</a>'
        if url == "http://s/3.txt":
            raise ValueError("cut off")
        return "" if url == "http://s/4.txt" else text

    return ask


@pytest.mark.parametrize("streamed", [False, True])
def test_items_stay_when_their_filings_fail(spark, tmp_path, streamed):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text(FEED)
    poller = pollers.FilingPoller("SEC", f"{tmp_path}/in", feeds.atom, service())
    if streamed:
        poller.fetch = lambda s: s.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(f"{tmp_path}/in").select(F.col("content").cast("string").alias("payload"))
        rows = poller.stream(spark)
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(rows.schema).parquet(f"{tmp_path}/out").collect()
    else:
        got = poller.poll(spark).collect()
    items = {r["item"]["id"]: r["item"] for r in got}
    assert set(items) == set("012345")
    assert [items[i]["title"] for i in "12"] == ["T1", "T2"]
    errors = {i: items[i]["article_error"] for i in sorted(items)}
    assert errors == {"0": None, "1": "OSError: not reached", "2": "no submission is named", "3": "ValueError: cut off", "4": "the submission is empty", "5": None}
    for i in "1234":
        assert items[i]["article_text"] is None and items[i]["items"] is None
    for i in "05":
        assert items[i]["article_text"].startswith("Paragraph 0") and items[i]["items"] == ["2.02"] and items[i]["highest_item_tier"] == 1


def test_extraction_can_be_left_out(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FEED)
    got = pollers.FilingPoller("SEC", f"{tmp_path}/a.xml", feeds.atom, lambda u: 1 / 0, skip_extraction=True).poll(spark).collect()
    assert len(got) == 6 and all(r["item"]["article_text"] is None for r in got)


def test_consent_pages_are_left_for_the_page_they_stand_for(spark, tmp_path):
    consent = '<div id="consent-page"><form><input type="hidden" name="originalDoneUrl" value="http://n/real?a=1&amp;amp;b=2"></form></div>'
    seen = tmp_path / "seen"

    def ask(url):
        with seen.open("a") as f:
            f.write(url + "\n")
        return {"http://n/1": consent, "http://n/real?a=1&b=2": "<div class='x atoms-wrapper'><p>Real</p><p>text</p></div><div class='read-more-wrapper'>and more</div>", "http://n/2": "<p>Plain <b>page</b></p>", "http://n/3": consent.replace("real?a=1", "gone?a=1")}[url]

    df = spark.createDataFrame([(f"http://n/{i}",) for i in (1, 2, 3)] + [(None,)], "url string")
    got = {r["url"]: (r["article_text"], r["article_error"]) for r in pollers.release_texts(df, ask).collect()}
    assert got["http://n/1"] == ("Real text and more", None) and got["http://n/2"] == ("Plain page", None) and got[None] == (None, None)
    assert got["http://n/3"][0] is None and got["http://n/3"][1].startswith("KeyError")
    assert len(seen.read_text().split()) == 5  # each page once


def test_profiles_are_asked_for_twice(spark, tmp_path):
    seen = tmp_path / "seen"

    def ask(url):
        with seen.open("a") as f:
            f.write(url + "\n")
        if url.endswith("/B") or (url.endswith("/A") and seen.read_text().split().count(url) == 1):
            raise OSError("once, or always")
        return "<a data-ylk='business-url' href='http://w.com'>w</a><dl><dt>Sector</dt><dd><a>Tech</a></dd></dl>" if url.startswith("http://page") else '{"quoteSummary":{"result":[{"assetProfile":{"website":"http://w.com","sector":"Tech","industry":"Chips"}}]}}'

    df = spark.createDataFrame([("A",), ("B",)], "ticker string")
    for kind, want in ((True, "http://json/"), (False, "http://page/")):
        got = {r["ticker"]: r for r in pollers.asked_profiles(df, ask, F.concat(F.lit(want), "ticker"), from_json=kind).collect()}
        assert (got["A"]["website_url"], got["A"]["sector"]) == ("http://w.com", "Tech")
        assert tuple(got["B"])[1:] == (None, None, None)
    assert sorted(seen.read_text().split()) == sorted(2 * ["http://json/A", "http://json/B", "http://page/A", "http://page/B"])


def test_attempts_and_articles(spark):
    df = spark.createDataFrame([("u",)], "url string")
    assert tuple(pollers.asked(df, lambda u: 1 / 0, "url", "page", attempts=2).first()) == ("u", None, "ZeroDivisionError: division by zero")
    embedded = """<script type="application/json" id="caas-art-1">{"content": "<p>From</p><p>JSON</p>"}</script><p>page</p>"""
    assert html._article(embedded) == "From JSON"
    assert html._article(embedded.replace("{", "[", 1)) == "page"
    assert html._consent("<p>originalDoneUrl</p>") is None


def test_symbols_share_a_query_and_leave_it_one_by_one(spark, tmp_path):
    spark.createDataFrame([("A", 1.0, 10.0, 1), ("B", 2.0, 5.0, 2), ("C", 9.0, 1.0, 3)], "symbol string, price double, size double, seq long").selectExpr("symbol", "price", "size", "timestamp_seconds(seq) as ts", "seq").write.parquet(f"{tmp_path}/t")

    class Files(pollers.MarketData):
        def trades(self, spark, stream=False):
            return spark.readStream.schema(pollers.TRADE).parquet(f"{tmp_path}/t")

        def quotes(self, spark, stream=False):
            raise NotImplementedError

    data, got = Files(), []
    data.subscribe(spark, "trades", ["A", "B"], lambda batch, _: got.extend(r["symbol"] for r in batch.collect()))
    one = data._queries["trades", "A"]
    assert data._queries["trades", "B"] is one
    one.processAllAvailable()
    assert sorted(got) == ["A", "B"]
    data.unsubscribe("trades", ["A"])
    assert one.isActive and data.subscribed() == [("trades", "B")]
    spark.createDataFrame([("A", 1.0, 10.0, 9), ("B", 2.0, 5.0, 9)], "symbol string, price double, size double, seq long").selectExpr("symbol", "price", "size", "timestamp_seconds(seq) as ts", "seq").write.mode("append").parquet(f"{tmp_path}/t")
    one.processAllAvailable()
    assert sorted(got) == ["A", "B", "B"]
    data.unsubscribe("trades", ["B"])
    assert not one.isActive and data.subscribed() == []
