"""Seen ids, changes and gates over ordered events, in batch. Their streaming forms are in ``streaming.state``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import first_by


def unseen(items: DataFrame, id_col: str, *order: str, seen: DataFrame | None = None) -> DataFrame:
    """The first row of each id, without ids that ``seen`` has."""
    fresh = items.join(seen.select(id_col), id_col, "left_anti") if seen is not None else items
    return first_by(fresh, [id_col], *order)


def changes(events: DataFrame, key: str, value: Column, *order: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Rows whose value differs from the key's row before; the first one counts as a change. A, B, A are three.

    Where the order begins with a time, a key's rows are sorted in spans of it, each by itself, and a span's first row is
    held against what the span before ends with: one row for each span. So a key with very many rows is spread over tasks.
    """
    marked = events.withColumn("__value", F.struct(value.alias("v")))
    if events.schema[order[0]].dataType.typeName() not in ("timestamp", "timestamp_ntz"):
        last = F.lag("__value").over(Window.partitionBy(key).orderBy(*order))
        return marked.withColumn("__last", last).where(F.col("__last").isNull() | ~F.col("__value").eqNullSafe(F.col("__last"))).drop("__value", "__last")
    spans = marked.withColumn("__span", F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / bucket_seconds))
    here = Window.partitionBy(key, "__span").orderBy(*order)
    ends = spans.groupBy(F.col(key).alias("__key"), F.col("__span").alias("__at")).agg(F.max_by("__value", F.struct(*order)).alias("__end"))
    before = ends.select("__key", "__at", F.lag("__end").over(Window.partitionBy("__key").orderBy("__at")).alias("__before"))
    found = spans.withColumn("__here", F.lag("__value").over(here)).join(before, F.col(key).eqNullSafe(F.col("__key")) & F.col("__span").eqNullSafe(F.col("__at")))
    found = found.withColumn("__last", F.coalesce("__here", "__before"))
    return found.where(F.col("__last").isNull() | ~F.col("__value").eqNullSafe(F.col("__last"))).select(*events.columns)


def changed_since(batch: DataFrame, last: DataFrame, key: str, value: str) -> DataFrame:
    """All rows of a batch that differ from the value known when the batch began, which the batch itself doesn't alter."""
    known = last.select(key, F.col(value).alias("__last"), F.lit(True).alias("__known"))
    joined = batch.join(known, key, "left")
    return joined.where(F.col("__known").isNull() | ~F.col(value).eqNullSafe(F.col("__last"))).select(*batch.columns)


def gated(events: DataFrame, key: str, time: str, closes: Column) -> DataFrame:
    """Events of a key up to, and with, the first that closes its gate."""
    first = events.where(closes).groupBy(key).agg(F.min(time).alias("__closed"))
    return events.join(first, key, "left").where(F.col("__closed").isNull() | (F.col(time) <= F.col("__closed"))).drop("__closed")


def most_recent(writes: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """What a cache of ``most`` entries holds that evicts by order of writing: the last written keys."""
    latest = writes.groupBy(key).agg(F.max(F.struct(*order)).alias("__at"))
    return latest.orderBy(F.desc("__at")).limit(most).select(key)
