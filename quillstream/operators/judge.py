"""Judging of articles by a pluggable scorer, what is made of its answer, and envelopes and log lines of events."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import JUDGEMENT

#: Words of the keyword scorer; a real one is given as a function instead.
POSITIVE = ["beat", "growth", "record", "raised", "exceeded", "profit", "strong"]
NEGATIVE = ["miss", "loss", "decline", "lowered", "weak", "impairment", "fell"]
REPORT = ["earnings", "quarter", "fiscal", "results", "revenue"]


def _count(text: Column, words: list[str]) -> Column:
    return F.regexp_count(F.lower(text), F.lit(r"(?U)\b(" + "|".join(words) + r")\b"))


def by_keywords(text: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, report: list[str] = REPORT) -> Column:
    """A scorer in plain expressions: deterministic, and it never leaves the JVM. NULL text has no judgement."""
    up, down = _count(text, positive), _count(text, negative)
    score = F.greatest(F.lit(-10), F.least(F.lit(10), up - down)).cast("int")
    is_report = _count(text, report) > 0
    reason = F.format_string("%d favourable and %d unfavourable words", up, down)
    return F.when(text.isNotNull(), F.struct(is_report.alias("is_earnings_report"), F.when(is_report, reason).alias("judgement"), F.when(is_report, score).alias("judgement_score")))


def by_function(judge: Callable[[str], tuple[bool, str | None, int | None]]) -> Callable[[Column], Column]:
    """A scorer out of any function of a text, such as a call to a service; what it raises makes that row NULL."""

    @F.pandas_udf(JUDGEMENT)
    def scored(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append(judge(t) if t is not None else (None, None, None))
            except Exception:  # noqa: BLE001  a row's failure is that row's
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["is_earnings_report", "judgement", "judgement_score"], dtype=object)

    return scored


def by_function_or_error(judge: Callable[[str], tuple[bool, str | None, int | None]]) -> Callable[[Column], Column]:
    """As ``by_function``, with an ``error`` that says why a row has no judgement; a failure neither stops nor hides."""

    @F.pandas_udf(JUDGEMENT + ", error string")
    def scored(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((*(judge(t) if t is not None else (None, None, None)), None))
            except Exception as e:  # noqa: BLE001  a row's failure is that row's
                rows.append((None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["is_earnings_report", "judgement", "judgement_score", "error"], dtype=object)

    return scored


def judged(articles: DataFrame, text: str = "text_content", scorer: Callable[[Column], Column] = by_keywords) -> DataFrame:
    """Articles that are earnings reports, with reason and score."""
    rows = articles.withColumn("__judgement", scorer(F.col(text)))
    return rows.where("__judgement.is_earnings_report").select(*articles.columns, "__judgement.judgement", "__judgement.judgement_score")


def message(ticker: Column, score: Column, reason: Column) -> Column:
    """What a notification says."""
    return F.format_string("%s SELL/BUY SCORE: %d\n%s", ticker, score, reason)


def envelope(items: DataFrame, source: str, received_at: Column | None = None) -> DataFrame:
    """source, item and the time of receipt in epoch seconds, which is each row's own."""
    now = F.unix_micros(F.current_timestamp()) / 1e6 if received_at is None else received_at
    return items.select(F.lit(source).alias("source"), F.struct(*items.columns).alias("item"), now.cast("double").alias("received_at"))


def log_line(rows: DataFrame, columns: list[str]) -> Column:
    """``name=value`` of the columns in order, joined by `` | ``; NULL is ``<none>``, lists and structs are JSON."""
    parts = []
    for c in columns:
        nested = rows.schema[c].dataType.typeName() in ("array", "map", "struct")
        value = F.to_json(F.col(c)) if nested else F.col(c).cast("string")
        parts.append(F.concat(F.lit(f"{c}="), F.coalesce(value, F.lit("<none>"))))
    return F.concat_ws(" | ", *parts)
