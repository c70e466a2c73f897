"""Polled services as streaming sources: many feeds, asked in turn by the tasks, their answers kept in files.

An offset is the number of a round; nothing else of a service comes into offsets or to the driver. A round asks some of
the feeds (``most``, so that no more requests are made at a time than a service wants), one partition each. The task of
(round, feed) makes the conditional request with the etag and time of the feed's round before, writes the answer to the
spool as one file, and only then hands on its rows. A task that finds its file reads it and asks nobody: so a retry, a
repeated batch and a restarted query get the same rows, whatever the service says by then. A feed that hasn't changed,
or can't be reached, gives no rows in that round; its marks stay as they were, and what went wrong stands in the file.

The spool is a folder in any file system that Arrow opens by URI, shared by driver and executors. Once a round has been
committed, files of rounds before the feed's last are removed.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import shared_dir

#: fetch(feed, marks) -> (marks, rows): marks are a feed's etag and time of modification; None for rows that are as they were.
Fetch = Callable[[str, dict], tuple[dict, list[tuple] | None]]
MARKS = ("etag", "last_modified")


class Spool:
    """Answers by feed and round."""

    def __init__(self, uri: str) -> None:
        self.files, self.path = fs.FileSystem.from_uri(uri)

    def _of(self, feed: str, turn: int) -> str:
        return f"{self.path}/{quote(feed, safe='')}/{turn:012d}.json"

    def get(self, feed: str, turn: int) -> dict | None:
        if self.files.get_file_info(self._of(feed, turn)).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(self._of(feed, turn)) as f:
            return json.loads(f.read())

    def put(self, feed: str, turn: int, answer: dict) -> dict:
        """Write an answer whole or not at all, and return what then stands there."""
        path = self._of(feed, turn)
        part = f"{path}.{uuid.uuid4().hex}"
        self.files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.files.open_output_stream(part) as f:
            f.write(json.dumps(answer).encode())
        if found := self.get(feed, turn):  # another attempt of the same task was first
            self.files.delete_file(part)
            return found
        self.files.move(part, path)
        return answer

    def turns(self, feed: str) -> list[int]:
        """The rounds that have an answer of a feed: its last ones."""
        folder = fs.FileSelector(self._of(feed, 0).rsplit("/", 1)[0], allow_not_found=True)
        return sorted(int(i.base_name[:12]) for i in self.files.get_file_info(folder) if i.base_name.endswith(".json"))

    def last_turn(self) -> int:
        found = self.files.get_file_info(fs.FileSelector(self.path, allow_not_found=True, recursive=True))
        return max((int(i.base_name[:12]) for i in found if i.base_name.endswith(".json")), default=0)

    def clear(self, feed: str, before: int) -> None:
        """Remove a feed's rounds before the given one."""
        for turn in self.turns(feed):
            if turn < before:
                self.files.delete_file(self._of(feed, turn))


def answered(spool: Spool, fetch: Fetch, feed: str, turn: int) -> dict:
    """The answer of a feed in a round: the one that is there, else a new one to the marks of the feed's round before."""
    if found := spool.get(feed, turn):
        return found
    last = max((t for t in spool.turns(feed) if t < turn), default=0)
    marks = (spool.get(feed, last) or {}).get("marks", dict.fromkeys(MARKS, ""))
    try:
        seen, rows = fetch(feed, dict(marks))
        new = {k: seen.get(k) or "" for k in MARKS}
        same = rows is None or (any(marks.values()) and new == marks)
        answer = {"marks": marks if same else new, "rows": [] if same else [list(r) for r in rows], "error": None}
    except Exception as e:  # noqa: BLE001  a feed's failure is that feed's, and its next round asks again
        answer = {"marks": marks, "rows": [], "error": f"{type(e).__name__}: {e}"}
    return spool.put(feed, turn, answer)


class Ask(InputPartition):
    def __init__(self, feed: str, turn: int) -> None:
        self.feed, self.turn = feed, turn


def asked_in(feeds: list[str], most: int, turn: int) -> list[str]:
    """The feeds that a round asks: the next ``most``, until all have been asked."""
    first = (turn - 1) % -(-len(feeds) // most) * most
    return feeds[first : first + most]


def register(spark: SparkSession, name: str, schema: str, fetch: Callable, feeds: list[str] | None = None, spool: str | None = None, most: int = 5, every: float = 60.0) -> None:
    """Make ``name`` a streaming source of ``feeds``, of which ``most`` are asked in a round; rounds are ``every`` seconds apart at least.

    ``fetch`` gets a feed and its marks; without ``feeds`` there is one service, and it gets the marks only. Rows are of
    ``schema`` and hold what JSON holds. A spool belongs to one query; without one it is a folder of the name below the
    session's shared folder.
    """
    if feeds is not None and (not feeds or most < 1):
        raise ValueError("a polled source needs feeds, and at least one in a round")
    ask: Fetch = (lambda _, marks: fetch(marks)) if feeds is None else fetch
    feeds = [name] if feeds is None else list(feeds)
    spool = f"{shared_dir(spark)}/spool/{quote(name, safe='')}" if spool is None else spool

    class Reader(DataSourceStreamReader):
        def __init__(self) -> None:
            self.turn: int | None = None
            self.asked = -math.inf

        def initialOffset(self) -> dict:  # noqa: N802
            return {"turn": 0}

        def latestOffset(self) -> dict:  # noqa: N802
            """One round after the last that was planned, or else after the last that the spool knows, if it is time for it."""
            if self.turn is None:
                self.turn = Spool(spool).last_turn()
            if (now := time.monotonic()) >= self.asked + every:
                self.turn, self.asked = self.turn + 1, now
            return {"turn": self.turn}

        def partitions(self, start: dict, end: dict) -> list[Ask]:
            self.turn = max(self.turn or 0, end["turn"])
            return [Ask(feed, turn) for turn in range(start["turn"] + 1, end["turn"] + 1) for feed in asked_in(feeds, most, turn)]

        def read(self, partition: Ask) -> Iterator[tuple]:
            for row in answered(Spool(spool), ask, partition.feed, partition.turn)["rows"]:
                yield tuple(row)

        def commit(self, end: dict) -> None:
            own = Spool(spool)
            for feed in asked_in(feeds, most, end["turn"]) if end["turn"] else ():
                own.clear(feed, end["turn"])

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema):  # noqa: N802
            return Reader()

    spark.dataSource.register(Source)
