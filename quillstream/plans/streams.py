"""Streaming queries run to their end over the driver's events, as files; results are those of the batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import judge, ticks
from ..session import SETTINGS, shared_dir
from ..streaming import dataflow, state, transactions
from . import content, market

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _shared(spark: SparkSession) -> str:
    """A new folder for results and checkpoints that driver and executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(s: SparkSession, d: str) -> DataFrame:
    # The table is one file or a folder of files; a file source wants a folder, so a pattern names the files.
    rows = s.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with zone


def _to_end(rows: DataFrame, s: SparkSession) -> DataFrame:
    path = _shared(s)
    rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{path}/out")


def _rocksdb(s: SparkSession) -> None:
    for key, value in SETTINGS.items():
        if key.startswith("spark.sql.streaming."):
            s.conf.set(key, value)


def q42_stream_seen_ids(s, d):
    return _to_end(state.first_seen(_stream(s, d).where("event_type = 'purchase'"), "user_id").select("user_id"), s)


def q58_stream_changes(s, d):
    _rocksdb(s)
    got = _to_end(state.changes(_stream(s, d), "user_id", "event_type", "event_id"), s)
    return got.select(F.col("key").alias("user_id"), F.col("value").alias("event_type"), F.col("seq").alias("event_id"))


def q59_stream_gate(s, d):
    _rocksdb(s)
    return _to_end(state.gated(_stream(s, d), "user_id", "event_id", F.col("event_type") == "error"), s).select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"))


def q60_stream_pairs(s, d):
    e = _stream(s, d).select("event_id", "ts", "user_id", "event_type")
    pairs = state.followed_by(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", "ts", "24 HOURS", "25 hours")
    return _to_end(pairs.select("l_event_id", "r_event_id"), s)


def q61_stream_routes(s, d):
    """Events to purchases to messages, over channels; two sinks read one channel, which is evaluated once."""
    path = _shared(s)
    router = dataflow.Router(path)
    router.produce("events", _stream(s, d))

    @router.route("events", publish="purchases")
    def purchases(rows: DataFrame) -> DataFrame:
        return rows.where("event_type = 'purchase'").select("event_id", "user_id")

    @router.route("purchases", publish="messages")
    def messages(rows: DataFrame) -> DataFrame:
        return rows.select(F.format_string("user %d bought in event %d", "user_id", "event_id").alias("message"))

    router.sink("purchases", f"audit-{uuid.uuid4().hex[:8]}", dataflow.parquet_sink(f"{path}/audit"))
    router.sink("messages", f"messages-{uuid.uuid4().hex[:8]}", dataflow.parquet_sink(f"{path}/messages"))
    router.start(availableNow=True)
    router.wait()
    return s.read.schema("message string, batch int").parquet(f"{path}/messages").select("message")


def q62_stream_bounded_cache(s, d):
    """Users that a cache of the last 20 written ones doesn't hold, for each type of event."""
    _rocksdb(s)
    got = _to_end(state.unseen_bounded(_stream(s, d), "event_type", "user_id", "event_id", 20), s)
    return got.select(F.col("grp").alias("event_type"), F.col("id").alias("user_id"), F.col("seq").alias("event_id"))


def q63_stream_monitor(s, d):
    """The whole chain: earnings, releases within a day after them, their texts, a judgement, a message for the first report.

    Signups stand for earnings, purchases of the same user for press releases, documents, taken in turn, for their texts.
    Each stage is a channel; a keyed gate lets an earnings event's releases through up to the first that is a report.
    """
    _rocksdb(s)
    path = _shared(s)
    router = dataflow.Router(path)
    events = _stream(s, d).select("event_id", "ts", "user_id", "event_type")
    documents = s.read.parquet(f"{d}/documents.parquet")
    turns = documents.agg(F.max("doc_id") + 1).first()[0]
    texts = documents.select("doc_id", "source", judge.by_keywords(F.col("text"), ["and", "with"], ["the", "der"], ["of", "und"]).alias("j"))
    router.produce("earnings", events.where("event_type = 'signup'"))

    @router.route("earnings", publish="press_release")
    def press_release(rows: DataFrame) -> DataFrame:
        return state.followed_by(rows, events.where("event_type = 'purchase'"), "user_id", "ts", "24 HOURS", "25 hours").select("l_event_id", "r_event_id")

    @router.route("press_release", publish="press_release_content")
    def content(rows: DataFrame) -> DataFrame:
        return rows.join(texts, F.col("r_event_id") % turns == F.col("doc_id"))

    @router.route("press_release_content", publish="report")
    def report(rows: DataFrame) -> DataFrame:
        passed = state.gated(rows, "l_event_id", "r_event_id", F.col("j.is_earnings_report")).where("closes")
        return passed.select(F.col("key").alias("earnings_id"), F.col("seq").alias("release_id"))

    @router.route("report", publish="message")
    def message(rows: DataFrame) -> DataFrame:
        joined = rows.join(texts, F.col("release_id") % turns == F.col("doc_id"))
        return joined.select("earnings_id", "release_id", judge.message(F.upper("source"), F.col("j.judgement_score"), F.col("j.judgement")).alias("message"))

    router.sink("message", f"messages-{uuid.uuid4().hex[:8]}", dataflow.parquet_sink(f"{path}/messages"))
    router.start(availableNow=True)
    router.wait()
    return s.read.schema("earnings_id bigint, release_id bigint, message string, batch int").parquet(f"{path}/messages").drop("batch")


def _last_states(rows, s, keys):
    """What a query in update mode has given last for each of ``keys``, by batches."""
    path = _shared(s)
    rows.writeStream.outputMode("update").foreachBatch(dataflow.parquet_sink(f"{path}/states")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ticks.latest(s.read.schema(T.StructType([*rows.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/states"), keys, "batch").drop("batch")


def q64_stream_book(s, d):
    """A depth book kept by a stream: each place's last update, as far as it isn't a deletion."""
    updates = _stream(s, d).select("user_id", (F.col("event_id") % 2).alias("side"), F.floor(F.col("value") / 20).alias("position"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("operation"), F.col("event_id").alias("seq"))
    places = ["user_id", "side", "position"]
    return _last_states(ticks.latest(updates, places, "seq"), s, places).where("operation <> 2").select(*places, "seq")


def q65_stream_depth(s, d):
    """A depth book whose rows shift: views and clicks insert, signups and purchases update, errors delete."""
    _rocksdb(s)
    operation = F.when(F.col("event_type").isin("view", "click"), 0).when(F.col("event_type") == "error", 2).otherwise(1)
    updates = _stream(s, d).select("user_id", (F.col("event_id") % 2).alias("side"), F.floor(F.col("value") / 25).alias("position"), operation.alias("operation"), F.col("value").alias("price"), (F.col("event_id") % 7 + 1).alias("size"), "event_id")
    book = _last_states(state.depth_book(updates, "user_id", "event_id"), s, ["key", "side", "position"])
    return book.where("seq is not null").select(F.col("key").alias("user_id"), "side", "position", "price", "size", F.col("seq").alias("event_id"))


def q66_stream_gate_reopens(s, d):
    """Each user's events that find the gate open, which an error closes for a day of event time."""
    _rocksdb(s)
    got = _to_end(state.gated_for(_stream(s, d), "user_id", "ts", "event_id", F.col("event_type") == "error", 86_400), s)
    return got.select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"))


def q67_stream_polls(s, d):
    """When each user is polled: from a signup on every six hours for a day, until some error ends it for ever."""
    _rocksdb(s)
    done = (F.col("event_type") == "error") & (F.col("event_id") % 11 == 0)
    got = _to_end(state.polls(_stream(s, d), "user_id", "ts", "event_id", F.col("event_type") == "signup", done, 21_600, 86_400), s)
    return got.select(F.col("key").alias("user_id"), "started", "poll")


def q68_stream_recent(s, d):
    """Whether a set of the 20 users seen last holds the user, for each type of event."""
    _rocksdb(s)
    got = _to_end(state.recent(_stream(s, d), "event_type", "user_id", "event_id", 20), s)
    return got.select(F.col("grp").alias("event_type"), F.col("id").alias("user_id"), F.col("seq").alias("event_id"), "seen")


def q71_stream_store(s, d):
    """Companies, exchanges, their links and earnings out of one stream, written together: users with their types of event, and the last value of each day."""
    store = transactions.Store(s, _shared(s), transactions.EARNINGS_STORE)
    events = _stream(s, d)
    ticker, place = F.concat(F.lit("U"), F.col("user_id")), F.upper("event_type")
    none = F.lit(None)
    rows = store.rows(
        events, "event_id",
        companies={"ticker": ticker, "cik": none, "company_name": F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("Firm "), F.col("event_id"))), "sector": none, "industry": none},
        exchanges={"name": place},
        company_exchanges={"company_ticker": ticker, "exchange": F.when(F.col("event_id") % 3 == 0, place)},
        earnings_reports={"company_ticker": ticker, "report_datetime": F.date_trunc("day", "ts"), "eps_estimate": none, "reported_eps": F.col("value")},
    )
    store.writer(rows, "events").trigger(availableNow=True).start().awaitTermination()
    now = store.committed()
    listed = store.read("company_exchanges", now).groupBy("company_ticker").agg(F.array_join(F.array_sort(F.collect_set("exchange")), ", ").alias("exchanges"))
    reports = store.read("earnings_reports", now).groupBy("company_ticker").agg(F.count(F.lit(1)).alias("reports"), F.round(F.max_by("reported_eps", "report_datetime"), 4).alias("last_eps"))
    firms = store.read("companies", now).select("ticker", "company_name")
    joined = firms.join(listed, F.col("ticker") == listed["company_ticker"], "left").join(reports, F.col("ticker") == reports["company_ticker"], "left")
    return joined.select("ticker", "company_name", "exchanges", "reports", "last_eps")


QUERIES = [q42_stream_seen_ids, q58_stream_changes, q59_stream_gate, q60_stream_pairs, q61_stream_routes, q62_stream_bounded_cache, q63_stream_monitor, q64_stream_book, q65_stream_depth, q66_stream_gate_reopens, q67_stream_polls, q68_stream_recent, q71_stream_store]

ORACLES = {
    "q42_stream_seen_ids": "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'",
    "q58_stream_changes": "SELECT user_id, event_type, event_id FROM (SELECT *, lag(event_type) OVER w AS last, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR event_type <> last",
    "q59_stream_gate": "SELECT user_id, event_id FROM events LEFT JOIN (SELECT user_id, min(event_id) AS closed FROM events WHERE event_type = 'error' GROUP BY user_id) USING (user_id) WHERE closed IS NULL OR event_id <= closed",
    "q60_stream_pairs": market.ORACLES["q17_within_a_day"],
    "q61_stream_routes": "SELECT 'user ' || user_id || ' bought in event ' || event_id AS message FROM events WHERE event_type = 'purchase'",
    "q63_stream_monitor": f"""
        WITH p AS (SELECT l.event_id AS l_id, r.event_id AS r_id FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 24 HOUR WHERE l.event_type = 'signup' AND r.event_type = 'purchase'),
        j AS ({content.ORACLES["q54_judged"]})
        SELECT l_id AS earnings_id, r_id AS release_id, message FROM p JOIN j ON r_id % (SELECT max(doc_id) + 1 FROM documents) = doc_id QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY r_id) = 1""",
    "q64_stream_book": market.ORACLES["q51_depth_book"],
    "q65_stream_depth": """
        WITH RECURSIVE u AS (
          SELECT user_id, CAST(event_id % 2 AS INTEGER) AS side, CAST(floor(value / 25) AS INTEGER) AS p, event_id,
                 CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
                 row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS n FROM events),
        b AS (
          SELECT DISTINCT user_id, side, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS l FROM u
          UNION ALL
          SELECT b.user_id, b.side, u.n, CASE WHEN op = 0 THEN list_slice(list_slice(l, 1, p) || [event_id] || list_slice(l, p + 1, len(l)), 1, 10)
                 WHEN p >= len(l) THEN l WHEN op = 1 THEN list_slice(l, 1, p) || [event_id] || list_slice(l, p + 2, len(l)) ELSE list_slice(l, 1, p) || list_slice(l, p + 2, len(l)) END
          FROM b JOIN u ON u.user_id = b.user_id AND u.side = b.side AND u.n = b.n + 1),
        x AS (SELECT user_id, side, unnest(l) AS event_id, CAST(unnest(range(len(l))) AS INTEGER) AS position FROM b QUALIFY n = max(n) OVER (PARTITION BY user_id, side))
        SELECT x.user_id, side, position, value AS price, CAST(event_id % 7 + 1 AS DOUBLE) AS size, event_id FROM x JOIN events USING (event_id)""",
    "q66_stream_gate_reopens": """
        WITH RECURSIVE c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error'),
        after AS (SELECT a.event_id, arg_min(b.event_id, (b.ts, b.event_id)) AS next FROM c a JOIN c b ON a.user_id = b.user_id AND b.ts >= a.ts + INTERVAL 24 HOUR GROUP BY a.event_id),
        k AS (SELECT arg_min(event_id, (ts, event_id)) AS event_id FROM c GROUP BY user_id UNION ALL SELECT next FROM k JOIN after USING (event_id)),
        closed AS (SELECT * FROM k JOIN c USING (event_id))
        SELECT user_id, event_id FROM events e WHERE NOT EXISTS (
          SELECT 1 FROM closed x WHERE x.user_id = e.user_id AND e.ts < x.ts + INTERVAL 24 HOUR AND (x.ts < e.ts OR (x.ts = e.ts AND x.event_id < e.event_id)))""",
    "q67_stream_polls": """
        WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, ts, event_id, event_type FROM events),
        done AS (SELECT user_id, min(ms) AS done_ms, arg_min(event_id, (ts, event_id)) AS done_id, min(ts) AS done_ts FROM e WHERE event_type = 'error' AND event_id % 11 = 0 GROUP BY user_id),
        c AS (SELECT user_id, ms, ts, event_id, done_ms FROM e LEFT JOIN done USING (user_id) WHERE event_type = 'signup' AND (done_id IS NULL OR ts < done_ts OR (ts = done_ts AND event_id < done_id))),
        after AS (SELECT a.event_id, arg_min(b.event_id, (b.ts, b.event_id)) AS next FROM c a JOIN c b ON a.user_id = b.user_id AND b.ms >= a.ms + 86400000 AND b.event_id <> a.event_id GROUP BY a.event_id),
        k AS (SELECT arg_min(event_id, (ts, event_id)) AS event_id FROM c GROUP BY user_id UNION ALL SELECT next FROM k JOIN after USING (event_id)),
        p AS (SELECT user_id, ms AS started, ms + 21600000 * unnest(range(4)) AS poll, done_ms FROM k JOIN c USING (event_id)),
        last AS (SELECT user_id, max(ms) AS last_ms FROM e GROUP BY user_id)
        SELECT user_id, started, poll FROM p JOIN last USING (user_id)
        WHERE (poll = started OR ((done_ms IS NULL OR poll < done_ms) AND (poll < last_ms OR poll <= (SELECT max(ms) - 3600000 FROM e))))""",
    "q68_stream_recent": """
        WITH r AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
        p AS (SELECT *, lag(n) OVER (PARTITION BY event_type, user_id ORDER BY n) AS was FROM r),
        between_ AS (SELECT p.event_type, p.n, count(DISTINCT r.user_id) AS others FROM p JOIN r ON p.event_type = r.event_type AND r.n > p.was AND r.n < p.n GROUP BY p.event_type, p.n)
        SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, event_id, was IS NOT NULL AND coalesce(others, 0) < 20 AS seen FROM p LEFT JOIN between_ USING (event_type, n)""",
    "q71_stream_store": """
        WITH e AS (SELECT *, 'U' || user_id AS ticker FROM events),
        firms AS (SELECT ticker, 'Firm ' || min(event_id) AS company_name FROM e WHERE event_id % 5 <> 0 GROUP BY ticker),
        listed AS (SELECT ticker, string_agg(DISTINCT upper(event_type), ', ' ORDER BY upper(event_type)) AS exchanges FROM e WHERE event_id % 3 = 0 GROUP BY ticker),
        days AS (SELECT ticker, date_trunc('day', ts) AS day, arg_max(value, event_id) AS eps FROM e GROUP BY 1, 2),
        reports AS (SELECT ticker, count(*) AS reports, round(arg_max(eps, day), 4) AS last_eps FROM days GROUP BY ticker)
        SELECT ticker, company_name, exchanges, reports, last_eps FROM firms LEFT JOIN listed USING (ticker) LEFT JOIN reports USING (ticker)""",
}
