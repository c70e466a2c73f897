"""Channels, routes and sinks over Structured Streaming.

A channel is a log: a folder of Parquet files that one query writes, exactly once, and any number of readers read, each
from offsets of its own. What publishes to a channel is evaluated once for each message, however many listen to it; a
reader that fails or comes later reads the log and evaluates nothing above it again. Every route and sink has a
checkpoint of its own, so that a restart goes on where it was.

A route is a function of DataFrames, which Spark plans as a whole, or a handler of single messages. A handler's failure
is that message's: it goes into the same log with its error, and the others go on. Any other route that can tell which of
its rows have failed, as by a scorer that returns errors, does the same by giving them the columns ``_error`` and ``_failed``.
"""

from __future__ import annotations

import json
import threading
import traceback
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

Transform = Callable[[DataFrame], DataFrame]
Handler = Callable[[dict], dict | list[dict] | None]
Write = Callable[[DataFrame, int], None]

#: What a log says of a message that failed: the error, and the message as JSON. Both are NULL for all others.
ERROR, FAILED = "_error", "_failed"


class Router:
    """A registry of channels; nothing flows until ``start``.

    ``folder`` holds the logs and checkpoints, in a file system that driver and executors share.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self.producers: dict[str, list[DataFrame]] = {}
        self.routes: list[tuple[str, Transform, str | None]] = []
        self.sinks: list[tuple[str, str, Write]] = []
        self.queries: list[StreamingQuery] = []
        self.logs: dict[str, Log] = {}

    def produce(self, publish: str | None, rows: DataFrame) -> None:
        if publish is None:
            raise ValueError("a producer needs a channel to publish to")
        self.producers.setdefault(publish, []).append(rows)

    def route(self, listen: str, publish: str | None = None) -> Callable[[Transform], Transform]:
        def register(f: Transform) -> Transform:
            self.routes.append((listen, f, publish))
            return f

        return register

    def handler(self, listen: str, publish: str, schema: str, at_most: int | None = None, attempts: int = 1) -> Callable[[Handler], Handler]:
        """Register a function of one message that returns a message, several, or none.

        What it raises, so many ``attempts`` one after the other, is kept beside the message that made it (``failures``).
        ``at_most`` bounds how many messages are handled at a time, as for a service that wants no more.
        """

        def register(f: Handler) -> Handler:
            self.routes.append((listen, lambda rows: handled(rows, f, schema, at_most, attempts), publish))
            return f

        return register

    def sink(self, listen: str, name: str, write: Write) -> None:
        self.sinks.append((listen, name, write))

    @property
    def node_count(self) -> int:
        return sum(map(len, self.producers.values())) + len(self.routes) + len(self.sinks)

    def _visit(self, name: str, above: tuple[str, ...], done: list[str]) -> None:
        if name in above:
            raise ValueError(f"channels feed each other: {' -> '.join([*above, name])}")
        feeding = [listen for listen, _, publish in self.routes if publish == name]
        if name not in self.producers and not feeding:
            raise KeyError(f"nothing publishes to {name}")
        for listen in feeding:
            self._visit(listen, (*above, name), done)
        if name not in done:
            done.append(name)

    def order(self) -> list[str]:
        """Channels that something publishes to, each after those it depends on."""
        done: list[str] = []
        for name in [*self.producers, *(p for _, _, p in self.routes if p), *(listen for listen, _, _ in self.sinks)]:
            self._visit(name, (), done)
        return done

    def channel(self, name: str) -> DataFrame:
        """The messages of a channel that has been started, as a stream, for a reader of one's own."""
        self._visit(name, (), [])
        return self.logs[name].read()

    def published(self, name: str, logs: dict[str, Log]) -> DataFrame:
        """All that is published to a channel, by reading the logs of those it listens to."""
        parts = [*self.producers.get(name, []), *(f(logs[listen].read()) for listen, f, publish in self.routes if publish == name)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def start(self, **trigger) -> list[StreamingQuery]:
        """One query for each channel and one for each sink; ``trigger`` is Spark's.

        With availableNow=True a channel has ended before those that listen to it begin, so that all that is there flows
        through. Otherwise all run side by side until they are stopped.
        """
        once = bool(trigger.get("availableNow"))
        for name in self.order():
            rows = self.published(name, self.logs)
            log = self.logs[name] = Log(rows.sparkSession, f"{self.folder}/log/{name}", rows.schema)
            self._begin(rows.writeStream.format("parquet").option("path", log.path), f"log/{name}", trigger, once)
        for listen, name, write in self.sinks:
            self._begin(self.logs[listen].read().writeStream.foreachBatch(write).queryName(name), name, trigger, False)
        return self.queries

    def _begin(self, writer: Any, name: str, trigger: dict, wait: bool) -> None:
        writer = writer.option("checkpointLocation", f"{self.folder}/checkpoint/{name}")
        self.queries.append((writer.trigger(**trigger) if trigger else writer).start())
        if wait:
            self.queries[-1].awaitTermination()

    def failures(self, name: str) -> DataFrame:
        """error and message (as JSON) of all that failed on its way into a channel, so far."""
        return self.logs[name].failures()

    def wait(self, seconds: float | None = None) -> bool:
        """Wait for the end of all queries; after so many seconds stop those that still run."""
        done = all([q.awaitTermination(seconds) if seconds is not None else q.awaitTermination() is None for q in self.queries])
        if not done:
            self.stop()
        return done

    def stop(self) -> None:
        for q in self.queries:
            q.stop()


class Log:
    """A channel's messages as files, with those that failed beside them."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)  # a reader may come first

    def _good(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col(ERROR).isNull()).drop(ERROR, FAILED) if ERROR in rows.columns else rows

    def read(self) -> DataFrame:
        """The messages as a stream, from the first on. Only what has been committed is read."""
        return self._good(self.spark.readStream.schema(self.schema).parquet(self.path))

    def so_far(self) -> DataFrame:
        return self._good(self.spark.read.schema(self.schema).parquet(self.path))

    def failures(self) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        if ERROR not in rows.columns:
            return self.spark.createDataFrame([], "error string, message string")
        return rows.where(F.col(ERROR).isNotNull()).select(F.col(ERROR).alias("error"), F.col(FAILED).alias("message"))


def _answers(handler: Handler, message: dict, attempts: int) -> list[dict]:
    for left in range(attempts - 1, -1, -1):
        try:
            answer = handler(dict(message))
            return answer if isinstance(answer, list) else [] if answer is None else [answer]
        except Exception:
            if not left:
                raise
    return []


def handled(rows: DataFrame, handler: Handler, schema: str, at_most: int | None = None, attempts: int = 1) -> DataFrame:
    """What ``handler`` makes of each row, with ``_error`` and ``_failed`` for rows that it raises on at every attempt."""
    if attempts < 1:
        raise ValueError("a message is handled once at least")
    out = T.StructType.fromDDL(schema)
    names = out.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[tuple] = []
            for text in frame["message"]:
                try:
                    found += [(*(a.get(n) for n in names), None, None) for a in _answers(handler, json.loads(text), attempts)]
                except Exception as e:  # noqa: BLE001  a message's failure is that message's
                    found.append((*[None] * len(names), traceback.format_exception_only(e)[-1].strip(), text))
            yield pd.DataFrame(found, columns=[*names, ERROR, FAILED], dtype=object)

    messages = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("message"))
    if at_most is not None:
        messages = messages.repartition(at_most)
    return messages.mapInPandas(run, T.StructType([*[T.StructField(f.name, f.dataType) for f in out], T.StructField(ERROR, T.StringType()), T.StructField(FAILED, T.StringType())]))


class Counters(StreamingQueryListener):
    """What running streams have counted so far, by the name of what was observed: sums over all batches.

    Streams count with ``counted`` (or ``observe``), in the pass that they make anyway. A batch that is repeated after a
    failure counts once: its last figures replace those before.
    """

    def __init__(self) -> None:
        self._by_batch: dict[tuple[str, str, int], dict[str, int]] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        with self._lock:
            for name, row in progress.observedMetrics.items():
                self._by_batch[name, str(progress.id), progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def of(self, name: str) -> dict[str, int]:
        out: dict[str, int] = {}
        with self._lock:
            for (observed, _, _), figures in self._by_batch.items():
                if observed == name:
                    out = {k: out.get(k, 0) + (v or 0) for k, v in figures.items()}
        return out


def counted(rows: DataFrame, valid: Column, name: str) -> DataFrame:
    """Rows of a stream, observed as ``name``: how many there were (total), were valid (saved) and weren't (skipped)."""
    valid = F.coalesce(valid, F.lit(False))
    return rows.observe(name, F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("saved"), F.count_if(~valid).alias("skipped"))


def parquet_sink(path: str) -> Write:
    """Each batch in a folder of its own, so that a repeated batch replaces what it had written."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def message_sink(send: Callable[[str], None], column: str = "message") -> Write:
    """Notifications, sent by the tasks that have them; a batch that is repeated sends again."""

    def deliver(rows: Iterable[Any]) -> None:
        for row in rows:
            send(row[0])

    return lambda batch, n: batch.select(column).foreachPartition(deliver)


def numbered(rows: DataFrame, source: str) -> DataFrame:
    """Rows in the envelope of a named source."""
    return rows.select(F.lit(source).alias("source"), F.struct(*rows.columns).alias("item"), (F.unix_micros(F.current_timestamp()) / 1e6).alias("received_at"))
