"""Channels, polled sources and keyed state over several batches, restarts and failures, against plain replays."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from quillstream.streaming import dataflow, polling, state


def stream(spark, folder, schema, batches):
    """A stream of one file for each batch, in this order."""
    for i, rows in enumerate(batches):
        path = f"{folder}/in/{i:03d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))  # the file source goes by time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def appended(rows, folder):
    """All that a query in append mode gives, run to its end."""
    rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out").collect()


def cut(rows, n):
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


# Channels


def test_two_sinks_one_evaluation(spark, tmp_path):
    calls = tmp_path / "calls"
    router = dataflow.Router(f"file://{tmp_path}/bus")
    router.produce("numbers", stream(spark, tmp_path, "n int", [[(1,), (2,)], [(3,), (4,)]]))

    @router.handler("numbers", "squares", "n int, square int")
    def square(message):
        with calls.open("a") as f:
            f.write(f"{message['n']}\n")
        return {"n": message["n"], "square": message["n"] ** 2} if message["n"] != 3 else None

    @router.route("squares", publish="large")
    def large(rows):
        return rows.where("square > 1")

    for sink in ("one", "two"):
        router.sink("squares", sink, dataflow.parquet_sink(f"{tmp_path}/{sink}"))
    router.sink("large", "three", dataflow.parquet_sink(f"{tmp_path}/three"))
    router.start(availableNow=True)
    assert router.wait(120)
    assert sorted(calls.read_text().split()) == ["1", "2", "3", "4"]  # once each, for three readers
    for sink, want in (("one", [1, 4, 16]), ("two", [1, 4, 16]), ("three", [4, 16])):
        assert sorted(r["square"] for r in spark.read.parquet(f"{tmp_path}/{sink}").collect()) == want
    later: list = []
    q = router.channel("squares").writeStream.foreachBatch(lambda b, n: later.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(later) == 3 and len(calls.read_text().split()) == 4  # a late reader evaluates nothing


def test_a_failed_sink_goes_on_from_its_own_offset(spark, tmp_path):
    calls = tmp_path / "calls"

    def run(fails):
        router = dataflow.Router(f"file://{tmp_path}/bus")
        router.produce("numbers", spark.readStream.schema("n int").parquet(f"{tmp_path}/in/*"))

        @router.handler("numbers", "seen", "n int")
        def seen(message):
            with calls.open("a") as f:
                f.write("x")
            return message

        got: list = []

        def write(batch, _):
            if fails:
                raise RuntimeError("the sink is down")
            got.extend(r["n"] for r in batch.collect())

        router.sink("seen", "sink", write)
        router.start(availableNow=True)
        try:
            router.wait(120)
        except Exception:  # noqa: BLE001  meant to fail
            pass
        router.stop()
        return got

    stream(spark, tmp_path, "n int", [[(1,), (2,)]])
    assert run(True) == []
    assert sorted(run(False)) == [1, 2]
    assert calls.read_text() == "xx"


def test_a_bad_message_is_kept_and_told_and_the_others_pass(spark, tmp_path):
    router = dataflow.Router(f"file://{tmp_path}/bus")
    router.produce("texts", stream(spark, tmp_path, "id int, text string", [[(1, "5"), (2, "five"), (3, None)], [(4, "7")]]))
    router.handler("texts", "numbers", "id int, n int")(lambda m: [{"id": m["id"], "n": int(m["text"])}, {"id": m["id"], "n": -int(m["text"])}])
    router.route("numbers", "positive")(lambda rows: rows.where("n > 0"))
    got: list = []
    router.sink("positive", "sink", lambda b, _: got.extend(tuple(r) for r in b.collect()))
    router.start(availableNow=True)
    assert router.wait(120)
    assert sorted(got) == [(1, 5), (4, 7)]
    failed = {json.loads(r["message"])["id"]: r["error"] for r in router.failures("numbers").collect()}
    assert failed[2].startswith("ValueError") and failed[3].startswith("KeyError") and len(failed) == 2
    assert router.failures("positive").count() == 0


def test_messages_are_sent_by_tasks(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()
    write = dataflow.message_sink(lambda text: (sent / text).write_text(str(os.getpid())))
    write(spark.createDataFrame([("a",), ("b",)], "message string"), 0)
    assert {p.name for p in sent.iterdir()} == {"a", "b"}
    assert {p.read_text() for p in sent.iterdir()} != {str(os.getpid())}


# Polled sources


def polled(spark, folder, name, write, rounds):
    """Run a polled source until it has made so many more batches, or has failed."""
    q = spark.readStream.format(name).load().writeStream.foreachBatch(write).option("checkpointLocation", f"file://{folder}/c").trigger(processingTime="0 seconds").start()
    try:
        for _ in range(600):
            if not q.isActive or (q.lastProgress or {}).get("batchId", -1) >= rounds:
                break
            q.awaitTermination(0.1)
    except Exception:  # noqa: BLE001  a run may be meant to fail
        pass
    q.stop()


def test_feeds_are_partitions_and_restarts_replay_them(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    feeds = [f"http://feed/{i}" for i in range(5)]

    def fetch(feed, marks):
        n = int(marks["etag"] or 0) + 1
        i = feed[-1]
        mine = asked / f"{i}-{n}"
        first = not mine.exists()
        with mine.open("a") as f:
            f.write(f"{os.getpid()} ")
        if i == "4" and n == 2:
            raise OSError("not reached")
        # A service's answer is another one each time it is asked.
        return {"etag": str(n)}, [(i, n, "first" if first else "again")]

    polling.register(spark, "feeds_test", "feed string, n int, what string", fetch, feeds, f"file://{tmp_path}/spool", most=2, every=0)
    got, fails, partitions = [], [True], []

    def write(batch, n):
        partitions.append(batch.rdd.getNumPartitions())
        rows = batch.collect()  # every feed of the round has been asked
        if fails[0] and n == 1:
            raise RuntimeError("the sink is down")
        got.extend(tuple(r) for r in rows)

    polled(spark, tmp_path, "feeds_test", write, 5)
    assert {r[0] for r in got} == {"0", "1"}
    fails[0] = False
    polled(spark, tmp_path, "feeds_test", write, 7)
    assert all(what == "first" for _, _, what in got)  # what had been asked before the failure was replayed
    assert [len([1 for r in got if r[0] == str(i) and r[1] == 1]) for i in range(5)] == [1] * 5
    assert len(got) == len(set(got)) and max(n for _, n, _ in got) >= 2
    assert max(partitions) == 2  # two feeds a round, a partition each
    assert not [r for r in got if r[0] == "4" and r[1] == 2]  # a feed that can't be reached stops none
    spool = [p.name for p in (tmp_path / "spool").rglob("*.json")]
    assert len(spool) <= 2 * len(feeds)  # what is committed goes


def test_a_feed_without_marks_is_read_each_time_and_one_that_is_unchanged_never(spark, tmp_path):
    spool = polling.Spool(f"file://{tmp_path}/spool")
    answers = [polling.answered(spool, lambda feed, marks: ({}, [(1,)]), "plain", turn)["rows"] for turn in (1, 2)]
    assert answers == [[[1]], [[1]]]
    answers = [polling.answered(spool, lambda feed, marks: ({"etag": "v"}, [(turn,)]), "etag", turn)["rows"] for turn in (1, 2, 3)]
    assert answers == [[[1]], [], []]
    assert polling.answered(spool, lambda feed, marks: 1 / 0, "etag", 4) == {"marks": {"etag": "v", "last_modified": ""}, "rows": [], "error": "ZeroDivisionError: division by zero"}
    assert polling.answered(spool, lambda feed, marks: ({"etag": "w"}, [("later",)]), "etag", 2)["rows"] == []  # the file decides
    assert [polling.asked_in(list("abcde"), 2, t) for t in range(1, 5)] == [["a", "b"], ["c", "d"], ["e"], ["a", "b"]]


# Keyed state


@pytest.mark.parametrize("touch", [True, False])
def test_recent_ids_against_a_replay_with_touches(spark, tmp_path, touch):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), str(min(int(rng.expovariate(0.15)), 40)), n) for n in range(400)]
    got = appended(state.recent(stream(spark, tmp_path, "g string, id string, seq long", cut(rows, 4)), "g", "id", "seq", 7, touch), tmp_path)
    held: dict = {"a": OrderedDict(), "b": OrderedDict()}
    want = []
    for g, i, n in rows:
        own = held[g]
        want.append((g, i, n, i in own))
        if i in own and touch:
            own.move_to_end(i)
        own.setdefault(i)
        if len(own) > 7:
            own.popitem(last=False)
    assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(ValueError, match="one at least"):
        state.recent(spark.range(1), "id", "id", "id", 0)


def test_depth_book_against_a_replay(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("xy"), rng.randint(0, 1), rng.randint(-1, 8), rng.choice([0, 0, 0, 1, 2]), float(n), 1.0, n) for n in range(300)]
    updates = stream(spark, tmp_path, "k string, side int, position int, operation int, price double, size double, seq long", cut(rows, 5))
    sink = dataflow.parquet_sink(f"{tmp_path}/states")
    state.depth_book(updates, "k", "seq", 6).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    last: dict = {}
    written = spark.read.parquet(f"{tmp_path}/states").orderBy("batch").collect()
    for r in written:
        last[r["key"], r["side"], r["position"]] = r["seq"]
    book: dict = {}
    for k, side, at, op, _, _, n in rows:
        own = book.setdefault((k, side), [])
        if at >= 0 and op == 0:
            own.insert(at, n)
            del own[6:]
        elif 0 <= at < len(own):
            own[at : at + 1] = [n] if op == 1 else []
    assert {p: n for p, n in last.items() if n is not None} == {(*k, i): n for k, own in book.items() for i, n in enumerate(own)}
    assert len({r["batch"] for r in written}) == 5 and len(written) < 5 * 24 + 1


def times(rng, n, step):
    at = dt.datetime(2025, 1, 1)
    for _ in range(n):
        at += dt.timedelta(minutes=rng.randint(1, step))
        yield at


def test_a_gate_reopens_by_event_time_in_any_cut_of_batches(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), at, n, rng.random() < 0.2) for n, at in enumerate(times(rng, 160, 400))]
    want, until = [], {}
    for k, at, n, closes in rows:
        if until.get(k) is None or at >= until[k]:
            want.append(n)
            until[k] = at + dt.timedelta(hours=24) if closes else None
    assert 0 < len(want) < len(rows)
    for parts in (1, 8):
        folder = tmp_path / str(parts)
        events = stream(spark, folder, "k string, t timestamp, seq long, c boolean", cut(rows, parts))
        assert sorted(r["seq"] for r in appended(state.gated_for(events, "k", "t", "seq", F.col("c"), 86_400), folder)) == want


def test_polls_have_exact_times_in_any_cut_of_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("abcdef"), at, n, rng.choice(["earnings", "other", "other", "report" if n > 100 else "other"])) for n, at in enumerate(times(rng, 200, 300))]
    hour = 3_600_000
    ms = lambda at: round((at - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    horizon = ms(rows[-1][1]) - hour
    want = []
    for key in "abcdef":
        own = [(ms(at), what) for k, at, _, what in rows if k == key]
        over = next((t for t, what in own if what == "report"), None)
        ends = None
        for t, what in own:
            if what == "earnings" and (over is None or t < over) and (ends is None or t >= ends):
                ends = t + 24 * hour
                last = max(x for x, _ in own)
                want += [(key, t, p) for p in range(t, ends, 5 * hour) if p == t or ((over is None or p < over) and (p < last or p <= horizon))]
    for parts in (1, 9):
        folder = tmp_path / str(parts)
        events = stream(spark, folder, "k string, t timestamp, seq long, what string", cut(rows, parts))
        got = appended(state.polls(events, "k", "t", "seq", F.col("what") == "earnings", F.col("what") == "report", 5 * 3600, 24 * 3600), folder)
        assert sorted(map(tuple, got)) == sorted(want)


# Transactions


def stored(spark, tmp_path, poison, batches=2):
    """Write events into three tables; a poisoned row makes its task fail after others have written."""
    from quillstream.streaming import transactions

    tables = {
        "companies": transactions.Table("ticker string, company_name string", ("ticker",), required=("company_name",)),
        "exchanges": transactions.Table("name string", ("name",)),
        "links": transactions.Table("company_ticker string, exchange string, n int", ("company_ticker", "exchange"), replaces=True, parents=(("company_ticker", "companies"), ("exchange", "exchanges"))),
    }
    store = transactions.Store(spark, f"file://{tmp_path}/store", tables)

    @F.udf("string")
    def checked(ticker):
        if poison.exists() and ticker == "BAD":
            raise RuntimeError("poison")
        return ticker

    events = spark.readStream.schema("seq long, ticker string, name string, place string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    spread = events.repartition(3)
    rows = store.rows(spread, "seq", companies={"ticker": checked("ticker"), "company_name": F.col("name")}, exchanges={"name": F.col("place")}, links={"company_ticker": F.col("ticker"), "exchange": F.col("place"), "n": F.col("seq")})
    q = store.writer(rows, "events").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception:  # noqa: BLE001  poison is meant to fail
        pass
    return store


EVENTS = [
    [(1, "A", "Firm A", "NYSE"), (2, "B", "Firm B", "LSE"), (3, "A", "Firm A again", "NYSE"), (4, "C", None, "LSE")],
    [(5, "BAD", "Firm bad", "XETRA"), (6, "A", "Later", "LSE"), (7, "D", "Firm D", None), (8, "B", "Later", "LSE"), (9, "E", "Firm E", "XETRA")],
]


def test_a_killed_batch_leaves_all_or_none(spark, tmp_path):
    stream(spark, tmp_path, "seq long, ticker string, name string, place string", EVENTS)
    poison = tmp_path / "poison"
    poison.write_text("x")
    store = stored(spark, tmp_path, poison)
    assert {r["ticker"]: r["company_name"] for r in store.read("companies").collect()} == {"A": "Firm A", "B": "Firm B"}
    assert {r["name"] for r in store.read("exchanges").collect()} == {"NYSE", "LSE"}  # nothing of the batch that failed, in any table
    assert sorted(tuple(r) for r in store.read("links").collect()) == [("A", "NYSE", 3), ("B", "LSE", 2)]
    poison.unlink()
    for _ in range(2):  # a restart, and one with nothing to do
        store = stored(spark, tmp_path, poison)
        now = store.committed()
        assert {r["ticker"]: r["company_name"] for r in store.read("companies", now).collect()} == {"A": "Firm A", "B": "Firm B", "BAD": "Firm bad", "D": "Firm D", "E": "Firm E"}
        assert sorted(tuple(r) for r in store.read("links", now).collect()) == [("A", "LSE", 6), ("A", "NYSE", 3), ("B", "LSE", 8), ("BAD", "XETRA", 5), ("E", "XETRA", 9)]
        assert store.written("companies", now).count() == 9  # each event once


def test_a_batch_is_committed_once_and_what_has_no_entry_is_not_there(spark, tmp_path):
    from quillstream.streaming import transactions

    stream(spark, tmp_path, "seq long, ticker string, name string, place string", EVENTS)
    store = stored(spark, tmp_path, tmp_path / "no poison")
    before = store.committed()
    import shutil

    shutil.rmtree(tmp_path / "store/checkpoint")  # all batches come again
    assert stored(spark, tmp_path, tmp_path / "no poison").committed() == before
    entry = sorted((tmp_path / "store/log/events").glob("*.json"))[-1]
    entry.unlink()  # a driver that died before its commit: files without an entry
    assert {r["name"] for r in store.read("exchanges").collect()} == {"NYSE", "LSE"}
    assert transactions.Store(spark, f"file://{tmp_path}/none", store.tables).read("links").count() == 0


def test_a_compacted_store_reads_the_same_and_goes_on(spark, tmp_path):
    none = tmp_path / "no poison"
    stream(spark, tmp_path, "seq long, ticker string, name string, place string", EVENTS[:1])
    store = stored(spark, tmp_path, none)

    def state_of():
        now = store.committed()
        return {t: sorted(map(tuple, store.read(t, now).collect()), key=repr) for t in store.tables}

    before = state_of()
    for remove in (False, True):
        store.compact(remove)
        assert state_of() == before
    assert len(list((tmp_path / "store/log/events").glob("*.json"))) == 1
    assert len(list((tmp_path / "store/data/companies").glob("*.parquet"))) == 0  # the batch's own files are gone
    spark.createDataFrame([*EVENTS[1], (10, "Z", "Firm Z", "NYSE"), (11, "F", None, "NYSE")], "seq long, ticker string, name string, place string").coalesce(1).write.parquet(f"{tmp_path}/in/later")
    store = stored(spark, tmp_path, none)
    after = state_of()
    assert {r[0]: r[1] for r in after["companies"]} == {"A": "Firm A", "B": "Firm B", "BAD": "Firm bad", "D": "Firm D", "E": "Firm E", "Z": "Firm Z"}
    assert ("A", "LSE", 6) in after["links"] and ("A", "NYSE", 3) in after["links"] and not any(r[0] in ("C", "F") for r in after["links"])
    store.compact(remove=True)
    store.compact(remove=True)
    assert state_of() == after and store.written("companies").count() == 6
    with pytest.raises(ValueError, match="snapshots"):
        store.writer(spark.range(1), "snapshots")


# Counters


def test_counters_of_a_running_stream_equal_those_of_the_batch(spark, tmp_path):
    import time

    from quillstream.operators import store

    schema = "id long, text string"
    batches = [[(1, "5"), (2, "x"), (3, None)], [(4, "7"), (5, "8")], [(6, "y")]]
    tries = tmp_path / "tries"

    def number(message):
        with tries.open("a") as f:
            f.write(f"{message['id']} ")
        if message["id"] == 4 and tries.read_text().split().count("4") < 3:
            raise OSError("later")
        return {"id": message["id"], "n": int(message["text"])}

    rows = dataflow.handled(stream(spark, tmp_path, schema, batches), number, "id long, n int", attempts=3)
    counters = dataflow.Counters()
    spark.streams.addListener(counters)
    got: list = []
    try:
        q = dataflow.counted(rows, F.col("_error").isNull(), "numbers").writeStream.foreachBatch(lambda b, _: got.extend(r["n"] for r in b.where("_error is null").collect()))
        q = q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):  # listeners hear of a batch some time after it
            if counters.of("numbers").get("total") == 6:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    observed, batch = store.save_counters(whole, F.col("text").try_cast("int").isNotNull(), "batch")
    observed.write.format("noop").mode("overwrite").save()
    assert counters.of("numbers") == batch.get == {"total": 6, "saved": 3, "skipped": 3}
    assert sorted(got) == [5, 7, 8]
    assert sorted(tries.read_text().split()) == ["1", "2", "2", "2", "3", "3", "3", "4", "4", "4", "5", "6", "6", "6"]
    assert counters.of("nothing") == {}
