"""Market data over the driver tables: events stand for ticks (user for symbol, type for kind), lineitem for trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conditions, dedup, ticks
from .relational import t

KINDS = {"click": "bid", "purchase": "ask", "signup": "last", "error": "volume"}


def q13_latest(s, d):
    return ticks.latest(t(s, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id")


def q17_within_a_day(s, d):
    e = t(s, d, "events").select("event_id", "ts", "user_id", "event_type")
    found = ticks.within(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", "ts", 86_400)
    return found.select("l_event_id", "r_event_id")


def q18_quote_before_order(s, d):
    e = t(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    orders = e.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    return ticks.as_of(orders, e.where("event_type = 'click'"), "user_id", "ts", "event_id", ["event_id"]).select("event_id", F.col("asof_event_id").alias("quote_id"))


def q19_tick_folding(s, d):
    return ticks.fold(t(s, d, "events"), "user_id", "event_type", "value", KINDS, "ts", "event_id")


def q27_bars(s, d):
    trades = t(s, d, "events").where("event_type in ('click', 'purchase')").withColumn("size", (F.col("event_id") % 9 + 1).cast("double"))
    b = ticks.bars(trades, ["event_type"], "ts", "1 day", "value", "size", ["event_id"])
    return b.select("event_type", "start", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close", "volume", "vwap")], "trades")


def q28_histogram(s, d):
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 10) * 10
    return ticks.histogram(t(s, d, "lineitem"), price, F.col("l_quantity"))


def q29_first_and_last(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("head"), F.max("ts").alias("tail"))


def q43_changes(s, d):
    return dedup.changes(t(s, d, "events"), "user_id", F.col("event_type"), "ts", "event_id").select("event_id", "user_id", "event_type")


def q44_gate(s, d):
    e = t(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    return dedup.gated(e, "user_id", "ts", F.col("event_type") == "error").select("event_id", "user_id")


def q48_order_states(s, d):
    status = F.when(F.col("event_type") == "purchase", "Filled").when(F.col("event_type") == "error", "Cancelled").when(F.col("event_type") == "signup", "Submitted").otherwise("PreSubmitted")
    e = t(s, d, "events").withColumn("status", status)
    return ticks.order_states(e, "user_id", "status", "ts", "event_id")


def q49_positions(s, d):
    x = t(s, d, "lineitem").select("l_suppkey", "l_partkey", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("q"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("p"))
    got = ticks.positions(x, ["l_partkey"], "q", "p", t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey", "p_retailprice")
    return got.select("l_partkey", "position", F.round("average_cost", 4).alias("average_cost"), F.round("unrealised", 1).alias("unrealised"))


def q50_account_summary(s, d):
    e = t(s, d, "events").select("user_id", "event_type", F.col("event_id").cast("string").alias("v"), "ts", "event_id")
    got = ticks.account_summary(e, "user_id", "event_type", "v", "ts", "event_id")
    return got.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("summary")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("summary"))


def q51_depth_book(s, d):
    e = t(s, d, "events").select("user_id", (F.col("event_id") % 2).alias("side"), F.floor(F.col("value") / 20).alias("position"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("operation"), F.col("event_id").alias("seq"))
    return ticks.book(e, ["user_id"], "seq").select("user_id", "side", "position", "seq")


def q52_batch_changes(s, d):
    e = t(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    old, new = e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0")
    last = ticks.latest(old, ["user_id"], "ts", "event_id")
    return dedup.changed_since(new.select("event_id", "user_id", "event_type"), last, "user_id", "event_type")


def q53_recent_ids(s, d):
    return dedup.most_recent(t(s, d, "events"), "user_id", 10, "ts", "event_id")


def q72_order_triggers(s, d):
    """When orders with conditions on two symbols' prices and on time, joined by and or or, are first to go: users' values are prices."""
    o, k = t(s, d, "orders"), F.col("o_orderkey")
    day = lambda n: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(n)
    told = [
        (0, "price", F.col("o_custkey") % 150, k % 2 == 0, F.floor("o_totalprice") % 60, k % 4 != 0),
        (1, "price", F.col("o_custkey") * 7 % 150, k % 3 == 0, k % 40, k % 7 < 4),
        (2, "time", F.lit(None), k % 5 != 0, F.unix_seconds(day((k % 25).cast("int"))), F.lit(True)),
    ]
    told = F.array(*[F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), symbol.cast("bigint").alias("symbol"), more.alias("is_more"), level.cast("double").alias("level"), by_and.alias("conjunction")) for place, kind, symbol, more, level, by_and in told])
    chains = o.select(k.alias("order_id"), F.explode(told).alias("c")).select("order_id", "c.*")
    values = t(s, d, "events").select(F.col("user_id").alias("symbol"), F.lit("price").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), "value")
    found = conditions.triggers(o.select(k.alias("order_id"), day((k % 20).cast("int")).alias("placed")), chains, values)
    return found.select("order_id", F.col("triggered").cast("timestamp_ntz").alias("triggered"))


QUERIES = [q13_latest, q17_within_a_day, q18_quote_before_order, q19_tick_folding, q27_bars, q28_histogram, q29_first_and_last, q43_changes, q44_gate, q48_order_states, q49_positions, q50_account_summary, q51_depth_book, q52_batch_changes, q53_recent_ids, q72_order_triggers]

_LAST = ", ".join(f"arg_max(value, (ts, event_id)) FILTER (event_type = '{k}') AS {n}" for k, n in KINDS.items())
ORACLES = {
    "q13_latest": "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "q17_within_a_day": "SELECT l.event_id AS l_event_id, r.event_id AS r_event_id FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 24 HOUR WHERE l.event_type = 'signup' AND r.event_type = 'purchase'",
    "q18_quote_before_order": """
        WITH o AS (SELECT * FROM events WHERE event_type = 'purchase'), q AS (SELECT * FROM events WHERE event_type = 'click')
        SELECT o.event_id, arg_max(q.event_id, (q.ts, q.event_id)) AS quote_id FROM o LEFT JOIN q ON q.user_id = o.user_id AND q.ts <= o.ts GROUP BY o.event_id""",
    "q19_tick_folding": f"SELECT user_id, {_LAST}, bid IS NOT NULL AND ask IS NOT NULL AS complete FROM events WHERE event_type IN ('click', 'purchase', 'signup', 'error') GROUP BY user_id",
    "q27_bars": """
        SELECT event_type, date_trunc('day', ts) AS start, round(arg_min(value, (ts, event_id)), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low,
               round(arg_max(value, (ts, event_id)), 4) AS close, round(sum(size), 4) AS volume, round(sum(value * size) / sum(size), 4) AS vwap, count(*) AS trades
        FROM (SELECT *, CAST(event_id % 9 + 1 AS DOUBLE) AS size FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY 1, 2""",
    "q28_histogram": "SELECT CAST(floor(l_extendedprice / l_quantity / 10) * 10 AS BIGINT) AS price, sum(l_quantity) AS size FROM lineitem GROUP BY 1",
    "q29_first_and_last": "SELECT user_id, min(ts) AS head, max(ts) AS tail FROM events GROUP BY user_id",
    "q43_changes": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS last, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM last",
    "q44_gate": "SELECT event_id, user_id FROM events e LEFT JOIN (SELECT user_id, min(ts) AS closed FROM events WHERE event_type = 'error' GROUP BY user_id) USING (user_id) WHERE closed IS NULL OR ts <= closed",
    "q48_order_states": """
        SELECT user_id, status, status IN ('Filled', 'Cancelled', 'ApiCancelled', 'Inactive') AS is_terminal, status = 'Filled' AS is_filled FROM (
          SELECT user_id, arg_max(CASE event_type WHEN 'purchase' THEN 'Filled' WHEN 'error' THEN 'Cancelled' WHEN 'signup' THEN 'Submitted' ELSE 'PreSubmitted' END, (ts, event_id)) AS status
          FROM events GROUP BY user_id)""",
    "q49_positions": """
        SELECT l_partkey, sum(q) AS position, round(sum(q * p) / nullif(sum(q), 0), 4) AS average_cost, round(sum(q) * any_value(p_retailprice) - sum(q * p), 1) AS unrealised
        FROM (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q, floor(l_extendedprice / l_quantity) AS p FROM lineitem)
        LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_partkey""",
    "q50_account_summary": "SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS summary FROM (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS v FROM events GROUP BY ALL) GROUP BY user_id",
    "q51_depth_book": """
        SELECT user_id, side, position, seq FROM (
          SELECT user_id, event_id % 2 AS side, CAST(floor(value / 20) AS BIGINT) AS position, max(event_id) AS seq, arg_max(event_type, event_id) AS last FROM events GROUP BY 1, 2, 3) WHERE last <> 'error'""",
    "q52_batch_changes": """
        WITH last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY user_id)
        SELECT event_id, user_id, event_type FROM events LEFT JOIN last USING (user_id) WHERE event_id % 3 = 0 AND (v IS NULL OR v <> event_type)""",
    "q53_recent_ids": "SELECT user_id FROM (SELECT user_id, max((ts, event_id)) AS newest FROM events GROUP BY user_id) ORDER BY newest DESC LIMIT 10",
    "q72_order_triggers": """
        WITH o AS (
          SELECT o_orderkey AS id, o_custkey % 150 AS s0, o_custkey * 7 % 150 AS s1, floor(o_totalprice) % 60 AS l0, o_orderkey % 40 AS l1, o_orderkey % 2 = 0 AS m0, o_orderkey % 3 = 0 AS m1, o_orderkey % 5 <> 0 AS m2,
                 TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 25 AS INTEGER)) AS l2, TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 20 AS INTEGER)) AS placed, o_orderkey % 4 <> 0 AS c0, o_orderkey % 7 < 4 AS c1 FROM orders),
        v AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2),
        t AS (SELECT id, placed AS tm FROM o UNION SELECT id, l2 FROM o WHERE l2 >= placed UNION SELECT id, ts FROM o JOIN v ON user_id = s0 AND ts >= placed UNION SELECT id, ts FROM o JOIN v ON user_id = s1 AND ts >= placed),
        a AS (SELECT t.id, t.tm, s1, v.value AS v0 FROM (SELECT t.*, s0, s1 FROM t JOIN o USING (id)) t ASOF LEFT JOIN v ON t.s0 = v.user_id AND t.tm >= v.ts),
        b AS (SELECT a.id, a.tm, v0, v.value AS v1 FROM a ASOF LEFT JOIN v ON a.s1 = v.user_id AND a.tm >= v.ts),
        h AS (SELECT id, tm, c0, c1, coalesce(CASE WHEN m0 THEN v0 >= l0 ELSE v0 <= l0 END, false) AS h0, coalesce(CASE WHEN m1 THEN v1 >= l1 ELSE v1 <= l1 END, false) AS h1, CASE WHEN m2 THEN tm >= l2 ELSE tm <= l2 END AS h2 FROM b JOIN o USING (id)),
        f AS (SELECT id, tm, CASE WHEN c1 THEN x AND h2 ELSE x OR h2 END AS held FROM (SELECT *, CASE WHEN c0 THEN h0 AND h1 ELSE h0 OR h1 END AS x FROM h))
        SELECT id AS order_id, min(tm) AS triggered FROM f WHERE held GROUP BY id""",
}
