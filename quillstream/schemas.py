"""Schemas of stored tables and of records in flight. Missing numbers are NULL at rest."""

from __future__ import annotations

from pyspark.sql import types as T


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


COMPANIES = "ticker string not null, cik string, company_name string not null, sector string, industry string"
EXCHANGES = "id bigint not null, name string not null"
COMPANY_EXCHANGES = "company_ticker string not null, exchange_id bigint not null"
URLS = "company_ticker string not null, url_type string not null, url string not null"
EARNINGS_REPORTS = (
    "company_ticker string not null, report_datetime timestamp not null, fiscal_quarter int, fiscal_year int, event_name string, time_type string,"
    " eps_estimate double, reported_eps double, surprise_percentage double, market_cap double, created_at timestamp, updated_at timestamp"
)
PRESS_RELEASES = (
    "company_ticker string not null, title string, url string not null, type string, pub_date string, display_time string, company_name string,"
    " raw_html string, text_content string, created_at timestamp, updated_at timestamp"
)
#: Primary and unique keys.
KEYS = {
    "companies": ["ticker"],
    "exchanges": ["name"],
    "company_exchanges": ["company_ticker", "exchange_id"],
    "urls": ["company_ticker", "url_type"],
    "earnings_reports": ["company_ticker", "report_datetime"],
    "press_releases": ["url"],
}
PROFILE = "website_url string, sector string, industry string"
EARNINGS_EVENT = (
    "id bigint, ticker string, company_name string, event_name string, time_type string, earnings_call_time timestamp,"
    " eps_estimate double, eps_actual double, eps_surprise double, eps_surprise_percent double, market_cap double"
)
FEED_ITEM = "id string, title string, url string, timestamp timestamp, summary string"
JUDGEMENT = "is_earnings_report boolean, judgement string, judgement_score int"
TRADE = "symbol string, price double, size int, timestamp timestamp, exchange string"
QUOTE = "symbol string, bid_price double, bid_size int, ask_price double, ask_size int, timestamp timestamp"
BAR = "symbol string, start timestamp, open double, high double, low double, close double, volume double, vwap double, trades bigint"
