"""Market data: latest values, folding of ticks, bars, histograms, as-of and interval joins, order states, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ["Filled", "Cancelled", "ApiCancelled", "Inactive"]


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key. Only one row for a key and partition is shuffled."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__row")
    return rows.groupBy(*key).agg(best).select("__row.*")


def fold(ticks: DataFrame, key: str, kind: str, value: str, names: dict[str, str], *order: str) -> DataFrame:
    """The last value of each kind of tick, as a column each; complete where bid and ask are both there."""
    at = F.struct(*order)
    columns = [F.max_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, at)).alias(name) for k, name in names.items()]
    out = ticks.where(F.col(kind).isin(list(names))).groupBy(key).agg(*columns)
    return out.withColumn("complete", F.col("bid").isNotNull() & F.col("ask").isNotNull()) if {"bid", "ask"} <= set(names.values()) else out


def bars(trades: DataFrame, key: list[str], time: str, size: str, price: str, quantity: str, order: list[str]) -> DataFrame:
    """Open, high, low, close, volume, volume-weighted price and number of trades in each window."""
    at, p, q = F.struct(time, *order), F.col(price), F.col(quantity)
    grouped = trades.groupBy(*key, F.window(time, size).alias("w"))
    agg = grouped.agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"),
        F.sum(q).alias("volume"), (F.sum(p * q) / F.nullif(F.sum(q), F.lit(0.0))).alias("vwap"), F.count(F.lit(1)).alias("trades"),
    )
    return agg.select(*key, F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "vwap", "trades")


def histogram(trades: DataFrame, price: Column, size: Column) -> DataFrame:
    return trades.groupBy(price.alias("price")).agg(F.sum(size).alias("size"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, columns: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """For each left row the right row of its key that is last at or before its time, else nulls.

    Both sides go into one sorted stream for each key and span of time, and the last right row is carried forward there;
    what earlier spans end with comes in by a join with one row for each span. So there are no pairs, however many
    right rows a key has, and a key with many rows is spread over its spans.
    """
    carried = F.struct(*[F.col(c) for c in columns])
    known = right.where(F.col(key).isNotNull())
    l_rows = left.select(key, time, F.lit(1).alias("__side"), F.col(tie).alias("__tie"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType).alias("__right"))
    r_rows = known.select(key, time, F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(l_rows.schema["__left"].dataType).alias("__left"), carried.alias("__right"))
    both = l_rows.unionByName(r_rows).withColumn("__span", F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / bucket_seconds))
    here = Window.partitionBy(key, "__span").orderBy(time, "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(key, "__span").agg(F.max_by("__right", F.when(F.col("__side") == 0, F.struct(time, "__tie"))).alias("__end"))
    before = ends.select(key, "__span", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    found = both.withColumn("__here", F.last("__right", ignorenulls=True).over(here)).where("__side = 1").join(before, [key, "__span"], "left")
    return found.withColumn("__found", F.coalesce("__here", "__before")).select("__left.*", *[F.col(f"__found.{c}").alias(f"asof_{c}") for c in columns])


def within(left: DataFrame, right: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Pairs of one key where the right row comes at most so many seconds after the left; columns get l_ and r_.

    Times are cut into bins of that length, so that a key with many rows is spread and compares neighbours only.
    """
    bin_of = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], F.explode(F.array(bin_of, bin_of + 1)).alias("__bin"))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], bin_of.alias("__bin"))
    after = F.col(f"r_{time}").between(F.col(f"l_{time}"), F.col(f"l_{time}") + F.make_dt_interval(secs=F.lit(seconds)))
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (a["__bin"] == b["__bin"]) & after).drop("__bin")


def order_states(updates: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """Last status of each order, whether that is final, and whether the order is filled."""
    last = updates.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))
    return last.select(key, "status", F.col("status").isin(TERMINAL).alias("is_terminal"), (F.col("status") == "Filled").alias("is_filled"))


def positions(executions: DataFrame, key: list[str], signed_size: str, price: str, marks: DataFrame, mark_key: str, mark: str) -> DataFrame:
    """Position, average cost and unrealised profit of each key. ``marks`` has one row for each ``mark_key``."""
    held = executions.groupBy(*key).agg(F.sum(signed_size).alias("position"), F.sum(F.col(signed_size) * F.col(price)).alias("cost"))
    valued = held.join(marks.select(F.col(mark_key), F.col(mark).alias("__mark")), mark_key, "left")
    return valued.select(*key, "position", (F.col("cost") / F.nullif("position", F.lit(0.0))).alias("average_cost"), (F.col("position") * F.col("__mark") - F.col("cost")).alias("unrealised"))


def account_summary(values: DataFrame, account: str, tag: str, value: str, *order: str) -> DataFrame:
    """For each account a map of tags to their last values; values without a tag are left out."""
    last = latest(values.where(F.col(tag).isNotNull()), [account, tag], *order)
    return last.groupBy(account).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(tag, value)))).alias("summary"))


def book(updates: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last state of a depth book's rows (side, position) that aren't deleted.

    Rows say ``operation`` (0 insert, 1 update, 2 delete), ``price`` and ``size`` of a place in the book.
    """
    return latest(updates, [*key, "side", "position"], seq).where("operation <> 2")
