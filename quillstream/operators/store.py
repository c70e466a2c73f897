"""Relational store semantics over DataFrames: insert if absent, upsert, coalesce-update, keys, cascades.

Parquet has neither order nor merge, so writers carry a sequence column where "first" or "last" matters, and an update
is a new table: write it to a new place, then switch. All are one pass of joins or windows on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import validate


def first_by(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """One row for each key: the first in this order, which should have no ties."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_or_ignore(base: DataFrame, new: DataFrame, key: list[str], seq: str, required: list[str] = ()) -> DataFrame:
    """``base`` and those new rows whose key it lacks; of new rows with one key the first counts.

    Rows with a null in a required column are ignored too, as they violate a constraint.
    """
    valid = new.dropna(subset=[*key, *required])
    fresh = first_by(valid.join(base.select(*key), key, "left_anti"), key, seq)
    return base.unionByName(fresh.select(*base.columns))


def upsert(base: DataFrame, new: DataFrame, key: list[str], seq: str, touched: str | None = None) -> DataFrame:
    """For each key the last new row, else the base row. ``seq`` orders new rows; it isn't part of the table.

    New rows are reduced before the shuffle, and of the base only keys are compared; ``touched`` names a time column that
    is renewed where a row is written.
    """
    rows = new.dropna(subset=key)
    columns = [F.current_timestamp().cast(base.schema[c].dataType).alias(c) if c == touched else F.col(c) for c in base.columns]
    last = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("__row")).select("__row.*")
    return base.join(last.select(*key), key, "left_anti").select(*base.columns).unionByName(last)


def checked_earnings(new: DataFrame) -> DataFrame:
    """Earnings reports with a usable ticker, company name and time; numbers that are none are NULL."""
    checked = new.select(
        validate.ticker(F.col("company_ticker")).alias("company_ticker"),
        "report_datetime",
        validate.company_name(F.col("company_name")).alias("company_name"),
        *[validate.numeric(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in new.dtypes if c not in ("company_ticker", "report_datetime", "company_name")],
    )
    return checked.dropna(subset=["company_ticker", "report_datetime", "company_name"])


def upsert_earnings(base: DataFrame, new: DataFrame, seq: str, touched: str | None = None) -> DataFrame:
    """Upsert of earnings reports; rows without a usable ticker, company name or time are left out."""
    return upsert(base, checked_earnings(new), ["company_ticker", "report_datetime"], seq, touched)


def ensure_companies(companies: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    """``companies`` (ticker, company_name) and those of new earnings reports that it lacks."""
    named = checked_earnings(new).select(F.col("company_ticker").alias("ticker"), "company_name", seq)
    return insert_or_ignore(companies, named, ["ticker"], seq, ["company_name"])


def save_counters(rows: DataFrame, valid: Column, name: str = "save") -> tuple[DataFrame, Observation]:
    """The rows, and how many there were, were saved and were skipped, once they have been written: no pass of its own."""
    counters = Observation(name)
    valid = F.coalesce(valid, F.lit(False))
    return rows.observe(counters, F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("saved"), F.count_if(~valid).alias("skipped")), counters


def upsert_referring(base: DataFrame, new: DataFrame, key: list[str], seq: str, parent: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Upsert of rows that refer to a parent; those whose parent doesn't exist are left out."""
    known = new.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")
    return upsert(base, known.select(*new.columns), key, seq)


def coalesce_update(base: DataFrame, changes: DataFrame, key: list[str], columns: list[str], touched: str | None = None) -> DataFrame:
    """New values where they aren't null, else the old; ``touched`` names a time column that a change renews."""
    new = changes.select(*key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = base.join(new, key, "left")
    values = {c: F.coalesce(f"__{c}", c) for c in columns}
    if touched:
        values[touched] = F.when(F.col("__hit"), F.current_timestamp()).otherwise(F.col(touched))
    return joined.withColumns(values).select(*base.columns)


def cascade_delete(child: DataFrame, parent_left: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Rows of a child table whose parent is still there."""
    return child.join(parent_left.select(F.col(parent_key).alias(child_key)), child_key, "left_semi").select(*child.columns)


def add_company_and_exchange(companies: DataFrame, exchanges: DataFrame, bridge: DataFrame, new: DataFrame, seq: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables with the new listings: company, exchange (with a new id where it has none) and their link.

    ``new``: ticker, cik, company_name, sector, industry, exchange and ``seq``. New exchange ids follow the largest
    one by the order of names; there are few exchanges, however many companies.
    """
    rows = new.withColumns({"ticker": F.upper("ticker"), "exchange": F.upper("exchange")})
    firms = insert_or_ignore(companies, rows.select(*companies.columns, seq), ["ticker"], seq, ["company_name"])
    names = rows.where("exchange is not null").select(F.col("exchange").alias("name")).distinct().join(exchanges, "name", "left_anti")
    largest = exchanges.agg(F.coalesce(F.max("id"), F.lit(0)).alias("largest")).first()["largest"]
    numbered = names.withColumn("id", F.row_number().over(Window.orderBy("name")) + F.lit(largest)).select("id", "name")
    places = exchanges.unionByName(numbered)
    listed = rows.join(places, rows["exchange"] == places["name"]).select(F.col("ticker").alias("company_ticker"), F.col("id").alias("exchange_id"))
    return firms, places, bridge.unionByName(listed).distinct()


def company_profile(companies: DataFrame, bridge: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Companies with the names of their exchanges, sorted and joined by commas; NULL where there is none."""
    names = bridge.join(exchanges, bridge["exchange_id"] == exchanges["id"], "left").groupBy("company_ticker").agg(F.array_sort(F.collect_list("name")).alias("names"))
    joined = companies.join(names, companies["ticker"] == names["company_ticker"], "left")
    return joined.select(*companies.columns, F.when(F.size("names") > 0, F.array_join("names", ", ")).alias("exchanges"))
