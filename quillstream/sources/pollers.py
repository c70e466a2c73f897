"""What pollers and market data services have in common, as classes to fill in, and sources and sinks of whole files.

A poller says how its payloads are read, how they become items and how an item's article is read; the chain from
payloads to enveloped new items is the same for all. Services themselves are reached through files or Python data
sources (``streaming.polling``); how often and how much is the trigger's and the source's matter.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import html
from ..operators import dedup, filings, judge, ticks
from ..streaming import state
from . import payloads

TRADE = "symbol string, price double, size double, ts timestamp, seq long"
QUOTE = "symbol string, bid double, ask double, bid_size double, ask_size double, ts timestamp, seq long"


class Poller(ABC):
    """A named source of items (id, title, url, timestamp)."""

    name: str

    @abstractmethod
    def fetch(self, spark: SparkSession) -> DataFrame:
        """Payloads: rows of a file, a stream or a table."""

    @abstractmethod
    def parse(self, fetched: DataFrame) -> DataFrame:
        """Items of payloads."""

    def article(self, items: DataFrame) -> DataFrame:
        """Items with ``article_text``; without an override there is none. An item that can't be read on stays, as it was."""
        return items if "article_text" in items.columns else items.withColumn("article_text", F.lit(None).cast("string"))

    def stream(self, spark: SparkSession, key: str = "id") -> DataFrame:
        """As ``poll``, of a ``fetch`` that gives a stream: an id that has passed is known from then on."""
        return judge.envelope(self.article(state.first_seen(self.parse(self.fetch(spark)), key)), self.name)

    def poll(self, spark: SparkSession, seen: DataFrame | None = None) -> DataFrame:
        """New items in their envelope: fetched, parsed, each id once and none that was seen, then their articles."""
        items = self.parse(self.fetch(spark))
        fresh = dedup.unseen(items, "id", F.asc_nulls_last("timestamp"), "url", seen=seen)
        return judge.envelope(self.article(fresh), self.name)


class FilePoller(Poller):
    """A poller over files of payloads, a payload a file."""

    def __init__(self, name: str, path: str, parse: Callable[[DataFrame], DataFrame]) -> None:
        self.name, self.path, self._parse = name, path, parse

    def fetch(self, spark: SparkSession) -> DataFrame:
        return whole_files(spark, self.path).withColumnRenamed("content", "payload")

    def parse(self, fetched: DataFrame) -> DataFrame:
        return self._parse(fetched)


class FilingPoller(FilePoller):
    """A poller whose items are filings: an item's index page names the submission, which is read and analysed.

    ``ask`` gets an address and returns its text. Where it fails, or a submission can't be made out, the item stays as the
    feed has it, with NULLs beside it and ``article_error`` saying why; no item holds up another.
    """

    ADDED = ("items", "items_tier_map", "highest_item_tier", "primary_exhibit_type", "exhibits_found", "has_material_contract_exhibit", "fallback_used", "acceptance_datetime_utc")

    def __init__(self, name: str, path: str, parse: Callable[[DataFrame], DataFrame], ask: Callable[[str], str | None], at_most: int = 5, skip_extraction: bool = False) -> None:
        super().__init__(name, path, parse)
        self.ask, self.at_most, self.skip_extraction = ask, at_most, skip_extraction

    def article(self, items: DataFrame) -> DataFrame:
        if self.skip_extraction:
            return super().article(items)
        pages = asked(items, self.ask, "url", "__index", self.at_most).withColumnRenamed("error", "__index_error")
        texts = asked(pages.withColumn("__submission_url", filings.submission_url(F.col("__index"))), self.ask, "__submission_url", "submission", self.at_most)
        found = filings.analyse(texts)
        got = F.col("submission").isNotNull()
        why = F.coalesce("__index_error", "error", F.when(~got, F.when(F.col("__submission_url").isNull(), "no submission is named").otherwise("the submission is empty")))
        added = [F.when(got, F.col(c)).alias(c) for c in self.ADDED]
        return found.select(*items.columns, *added, F.when(got, F.coalesce("primary_text", "fallback_text")).alias("article_text"), why.alias("article_error"))


def asked(rows: DataFrame, ask: Callable[[str], str | None], url: str, into: str, at_most: int = 5, attempts: int = 1) -> DataFrame:
    """``rows`` with what ``ask`` returns for an address, and ``error`` where it raised at every attempt; both NULL without an address.

    At most so many are asked for at a time.
    """
    answer = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    def one(u: str | None) -> tuple[str | None, str | None]:
        why = None
        for _ in range(attempts if u else 0):
            try:
                return ask(u) or None, None
            except Exception as e:  # noqa: BLE001  an address's failure is that row's
                why = f"{type(e).__name__}: {e}"
        return None, why

    @F.pandas_udf(answer)
    def answers(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(u) for u in urls], columns=["text", "error"], dtype=object)

    # Nondeterministic: an address is asked for once for each row, wherever its answer is used.
    found = rows.repartition(at_most).withColumn("__answer", answers.asNondeterministic()(F.col(url)))
    return found.select(*rows.columns, F.col("__answer.text").alias(into), F.col("__answer.error").alias("error"))


def release_texts(releases: DataFrame, ask: Callable[[str], str | None], url: str = "url", at_most: int = 5) -> DataFrame:
    """``releases`` with ``article_text`` and ``article_error``. A page that asks for consent is left for the one it stands for, once."""
    first = asked(releases, ask, url, "__page", at_most).withColumnRenamed("error", "__first_error")
    again = asked(first.withColumn("__target", html.consent_target(F.col("__page"))), ask, "__target", "__real", at_most)
    page = F.when(F.col("__target").isNull(), F.col("__page")).otherwise(F.col("__real"))
    return again.select(*releases.columns, html.article_text(page).alias("article_text"), F.coalesce("__first_error", "error").alias("article_error"))


class MarketData(ABC):
    """Latest values, histories and streams of trades (``TRADE``) and quotes (``QUOTE``)."""

    def __init__(self) -> None:
        self._queries: dict[tuple[str, str], StreamingQuery] = {}
        self._wanted: dict[tuple[str, str], set[str]] = {}

    @abstractmethod
    def trades(self, spark: SparkSession, stream: bool = False) -> DataFrame: ...

    @abstractmethod
    def quotes(self, spark: SparkSession, stream: bool = False) -> DataFrame: ...

    def latest_trade(self, spark: SparkSession, symbol: str) -> DataFrame:
        return ticks.latest(self.trades(spark).where(F.col("symbol") == symbol), ["symbol"], "ts", "seq")

    def latest_quote(self, spark: SparkSession, symbol: str) -> DataFrame:
        return with_midpoint(ticks.latest(self.quotes(spark).where(F.col("symbol") == symbol), ["symbol"], "ts", "seq"))

    def bars(self, spark: SparkSession, symbol: str, size: str) -> DataFrame:
        return ticks.bars(self.trades(spark).where(F.col("symbol") == symbol), ["symbol"], "ts", size, "price", "size", ["seq"])

    def subscribe(self, spark: SparkSession, kind: str, symbols: list[str], write: Callable[[DataFrame, int], None], **trigger) -> None:
        """Send the trades or quotes of these symbols to ``write``, a batch at a time, until they are unsubscribed: one query for all."""
        rows = self.trades(spark, True) if kind == "trades" else with_midpoint(self.quotes(spark, True))
        wanted = {s for s in symbols if (kind, s) not in self._queries}
        if not wanted:
            return

        def some(batch: DataFrame, n: int) -> None:
            if wanted:
                write(batch.where(F.col("symbol").isin(sorted(wanted))), n)

        w = rows.where(F.col("symbol").isin(sorted(wanted))).writeStream.foreachBatch(some)
        query = (w.trigger(**trigger) if trigger else w).start()
        for symbol in wanted:
            self._queries[kind, symbol], self._wanted[kind, symbol] = query, wanted

    def unsubscribe(self, kind: str, symbols: list[str]) -> None:
        """What is unsubscribed is left out of the next batch; a query ends with the last of its symbols."""
        for symbol in symbols:
            if query := self._queries.pop((kind, symbol), None):
                left = self._wanted.pop((kind, symbol))
                left.discard(symbol)
                if not left:
                    query.stop()

    def subscribed(self) -> list[tuple[str, str]]:
        return sorted(self._queries)


def with_midpoint(quotes: DataFrame) -> DataFrame:
    """Quotes with the middle of bid and ask; NULL where either is missing or none."""
    there = (F.col("bid") > 0) & (F.col("ask") > 0)
    return quotes.withColumn("midpoint", F.when(there, (F.col("bid") + F.col("ask")) / 2))


def whole_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path and content of text files, each whole; only the paths are read where only these are asked for."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.select("path", F.col("content").cast("string").alias("content"))


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Filings that were stored as text, analysed."""
    return filings.analyse(whole_files(spark, path).withColumnRenamed("content", "submission"))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """ticker (the file's name) and profile of stored answers of a profile service; an answer that says nothing gives NULLs."""
    files = whole_files(spark, path)
    return files.select(F.upper(F.regexp_extract("path", "([^/]+?)(\\.[^./]*)?$", 1)).alias("ticker"), payloads.profile(F.col("content")).alias("p")).select("ticker", "p.*")


def asked_profiles(companies: DataFrame, ask: Callable[[str], str | None], url: Column, from_json: bool = True, at_most: int = 5) -> DataFrame:
    """``companies`` with website_url, sector and industry, from a service's answer as JSON or from a page; NULLs where it fails twice."""
    answers = asked(companies.withColumn("__url", url), ask, "__url", "__answer", at_most, attempts=2)
    found = payloads.profile(F.col("__answer")) if from_json else html.profile_of(F.col("__answer"))
    return answers.withColumn("__profile", found).select(*companies.columns, "__profile.website_url", "__profile.sector", "__profile.industry")


def write_pages(pages: DataFrame, key: str, body: str, path: str) -> None:
    """A folder for each key with its page as text; a page's line ends are its own."""
    pages.select(key, F.col(body).alias("value")).where("value is not null").write.partitionBy(key).mode("overwrite").text(path)
