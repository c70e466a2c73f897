"""JSON payloads of services to rows; fields that are missing on the way are NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, validate

ARTICLES = "data struct<articles:array<struct<id:string,title:string,releaseurl:string,body:string,adate:string,company:string,topics:array<string>>>>"
STREAM = (
    "data struct<tickerStream:struct<stream:array<struct<content:struct<title:string,canonicalUrl:struct<url:string>,"
    "clickThroughUrl:struct<url:string>,pubDate:string,displayTime:string>>>>>"
)
CALENDAR = "finance struct<result:array<struct<documents:array<struct<columns:array<struct<id:string>>,rows:array<array<string>>>>>>>"
#: The calendar's own names to ours.
CALENDAR_NAMES = {
    "ticker": "ticker", "companyshortname": "company_name", "eventname": "event_name", "startdatetime": "earnings_call_time", "startdatetimetype": "time_type",
    "epsestimate": "eps_estimate", "epsactual": "eps_actual", "epssurprisepct": "eps_surprise_percent", "intradaymarketcap": "market_cap",
}


def by_name(names: Column, values: Column) -> Column:
    """A map of names to values: nameless values go, and of a repeated name the last value counts."""
    pairs = F.zip_with(names, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    named = F.filter(pairs, lambda p: p["k"].isNotNull())
    later = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(later)


def articles(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Articles with an id, a title and an address; tags of the body are stripped."""
    a = F.col("a")
    rows = payloads.select(F.explode(F.from_json(column, ARTICLES)["data"]["articles"]).alias("a"))
    return rows.select(a["id"].alias("id"), a["title"].alias("title"), a["releaseurl"].alias("url"), dates.iso_to_utc(a["adate"]).alias("timestamp"), text.strip_tags(a["body"]).alias("article_text"), a["company"].alias("company"), a["topics"].alias("topics")).where("id <> '' and title <> '' and url <> ''")


def press_releases(payloads: DataFrame, column: str = "payload", ticker: str = "ticker", limit: int = 250) -> DataFrame:
    """The first ``limit`` entries of each stream, then those with an address, in the service's order."""
    c = F.col("c.content")
    rows = payloads.select(F.upper(F.col(ticker)).alias("ticker"), F.posexplode(F.slice(F.from_json(column, STREAM)["data"]["tickerStream"]["stream"], 1, limit)).alias("place", "c"))
    url = F.coalesce(c["canonicalUrl"]["url"], c["clickThroughUrl"]["url"])
    return rows.select("ticker", "place", c["title"].alias("title"), url.alias("url"), c["pubDate"].alias("pub_date"), c["displayTime"].alias("display_time")).where("url is not null")


def latest_press_release(payloads: DataFrame, column: str = "payload", ticker: str = "ticker") -> DataFrame:
    """The first entry of each stream: services give the newest first."""
    return press_releases(payloads, column, ticker, 1).drop("place")


def earnings_calendar(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Calendar rows, whose columns the payload itself names, as typed events; missing numbers are NaN, as in flight."""
    d = F.col("d")
    documents = payloads.select(F.explode(F.flatten(F.from_json(column, CALENDAR)["finance"]["result"]["documents"])).alias("d"))
    rows = documents.select(F.explode(d["rows"]).alias("r"), F.transform(d["columns"], lambda c: c["id"]).alias("names"))
    m = by_name(F.col("names"), F.slice(F.col("r"), 1, F.size("names")))
    got = {new: F.element_at("m", F.lit(old)) for old, new in CALENDAR_NAMES.items()}
    numbers = {c: validate.number_or_nan(got[c]) for c in ("eps_estimate", "eps_actual", "eps_surprise_percent", "market_cap")}
    rows = rows.where(F.size("r") >= F.size("names")).withColumn("m", m)
    out = rows.select(*[got[c].alias(c) for c in ("ticker", "company_name", "event_name", "time_type")], dates.millis_or_iso_to_utc(got["earnings_call_time"]).alias("earnings_call_time"), *[x.alias(c) for c, x in numbers.items()])
    return out.withColumn("eps_surprise", validate.surprise(F.col("eps_actual"), F.col("eps_estimate")))


def profile(payload: Column) -> Column:
    base = "$.quoteSummary.result[0].assetProfile."
    return F.struct(F.get_json_object(payload, base + "website").alias("website_url"), F.get_json_object(payload, base + "sector").alias("sector"), F.get_json_object(payload, base + "industry").alias("industry"))


def records(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``{"fields": [...], "data": [[...], ...]}`` as maps with lower-case keys."""
    p = F.from_json(column, "fields array<string>, data array<array<string>>")
    rows = payloads.select(p.alias("p")).select("p.fields", F.explode("p.data").alias("row"))
    return rows.where(F.size("row") == F.size("fields")).select(by_name(F.transform("fields", lambda x: F.lower(x)), F.col("row")).alias("record"))


def company_seed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """ticker, cik, company_name and exchange of a seed file; rows that lack one of the first three are skipped."""
    get = lambda *names: F.coalesce(*[F.nullif(F.trim(F.element_at("record", F.lit(n))), F.lit("")) for n in names])
    return records(payloads, column).select(F.upper(get("ticker")).alias("ticker"), get("cik", "cik_str").alias("cik"), get("name", "title", "company_name").alias("company_name"), get("exchange").alias("exchange")).dropna(subset=["ticker", "cik", "company_name"])


def saved_page(payload: Column) -> Column:
    """body and url of a stored page; NULL unless both are there."""
    p = F.from_json(payload, "body string, url string")
    return F.when(p["body"].isNotNull() & p["url"].isNotNull(), p)


def days(frames: list[DataFrame]) -> DataFrame:
    """One table of several days' frames; columns that a day lacks are NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
