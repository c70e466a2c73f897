"""Periodic runs of words: maximal stretches that repeat themselves, found by counting matches at every lag.

Words that are ``q`` places apart and equal match at lag ``q``; a run of period ``q`` is an island of matches at that lag.
All matches at all lags up to half the text are counted first: for a frequent word by the autocorrelation of its places
(fast Fourier transform, rounded to the whole numbers that the counts are), for a rare one by the differences of all
pairs of its places. Only a lag with as many matches as its shortest run needs is scanned for islands.

Lags are taken from small to large, and two exact shortcuts keep texts of many repetitions cheap. A run of period ``p``
matches at every multiple ``q`` of ``p``, but a run whose smallest period is ``q`` shares no match with it (a stretch
of more than ``q`` words with both periods has the smaller one throughout), so its matches are taken off the counts of
the multiples. And an island of ``q`` matches covers ``q // s`` neighbours of every ``s``-th place, so a long lag is
looked at in steps first, and scanned whole only if so many neighbours match.

Edge cases: null and empty texts, and texts of white space only, have no words, no runs and an empty collapsed text;
texts of any length are read whole, with memory in proportion to their words; repeated rows and ids are rows of their
own; of runs of equal length the one that starts first, then the one of smaller period, is the longest; a table without
rows gives none; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, table

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 12, 2
#: Pairs of places that are built at a time.
PAIRS = 1 << 20
#: A lag is looked at in this many steps before it is scanned whole.
STEPS = 8

RUN = "struct<start: bigint, length: bigint, period: bigint>"
Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal ones."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _needed(lags: np.ndarray) -> np.ndarray:
    """Matches of the shortest run of each period."""
    return np.maximum((LEAST_PERIODS - 1) * lags, LEAST_WORDS - lags)


def matches(ids: np.ndarray) -> np.ndarray:
    """For each lag from 0 to half the text, how many words equal the word so many places on; exact. Lag 0 counts as none."""
    n, most = len(ids), len(ids) // LEAST_PERIODS
    found = np.zeros(most + 1, np.int64)
    if most < 1:
        return found
    places = np.argsort(ids, kind="stable")
    times = np.bincount(ids)
    heavy = np.flatnonzero(times.astype(np.float64) ** 2 > n * np.log2(n) + PAIRS / 256)  # a transform costs less than the pairs
    if len(heavy):
        size = 1 << int(n + most - 1).bit_length()
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            spectrum = np.fft.rfft(ids == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        found += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        places = places[~np.isin(ids[places], heavy)]
    if len(places):
        for first, second in _pairs(places, _ends(ids[places])):
            lags = second - first
            found += np.bincount(lags[lags <= most], minlength=most + 1)
    found[0] = 0
    return found


def _ends(words: np.ndarray) -> np.ndarray:
    """For each of sorted words the place after the last that equals it."""
    last = np.append(np.flatnonzero(words[1:] != words[:-1]) + 1, len(words))
    return np.repeat(last, np.diff(last, prepend=0))


def _pairs(places: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of one word, a bounded number at a time. ``places`` are in the order of words, then places."""
    after = ends - np.arange(len(places)) - 1
    before = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(places):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, "right")) - 1)
        own = after[at:to]
        one = np.repeat(np.arange(at, to), own)
        other = one + 1 + np.arange(len(one)) - np.repeat(before[at:to] - before[at], own)
        yield places[one], places[other]
        at = to


def _may_have(ids: np.ndarray, lag: int) -> bool:
    """False only if the lag has no island of as many matches as the lag is long."""
    step = lag // STEPS
    if step < 2:
        return True
    same = ids[lag::step] == ids[: len(ids) - lag : step]
    return bool((_islands(same, lag // step)[0]).size)


def _islands(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of at least so many true values."""
    edges = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    long = lengths >= least
    return starts[long], lengths[long]


def runs(ids: np.ndarray) -> np.ndarray:
    """start, length and period of every run, by start, then period."""
    counts = matches(ids)
    lags = np.arange(len(counts))
    needed = _needed(lags)
    found: dict[tuple[int, int], int] = {}  # the smallest period of each stretch; any other divides by it
    for lag in np.flatnonzero(counts >= needed).tolist():
        if lag and counts[lag] >= needed[lag] and _may_have(ids, lag):  # the count may have gone down meanwhile
            for start, own in zip(*_islands(ids[lag:] == ids[: len(ids) - lag], int(needed[lag])), strict=True):
                length = int(own) + lag
                if found.setdefault((int(start), length), lag) == lag:
                    more = np.arange(2 * lag, min(length, len(counts)), lag)
                    counts[more] -= length - more
    return np.array(sorted(((*stretch, lag) for stretch, lag in found.items()), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run has after its first period."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, found[:, 0] + found[:, 2], 1)
    np.add.at(marks, found[:, 0] + found[:, 1], -1)
    return np.cumsum(marks[:-1]) == 0


def periodic_runs(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", prepare: Prepare | None = None) -> DataFrame:
    """``keep``, runs (start, length and period in words, by start, then period) and collapsed (the words outside repetitions).

    ``prepare`` makes other words of a row's id and words before they are looked at.
    """

    def make() -> Callable[[pa.Array], dict]:
        def work(rows: pa.Array) -> dict:
            found, kept = [], []
            for row in zip(rows.field(0).to_pylist(), rows.field(1).cast(pa.binary()).to_pylist(), strict=True):
                words = (row[1] or b"").split()  # splits at 20 and 09-0D, as bytes do
                words = prepare(row[0], words) if prepare else words
                own = runs(numbered(words))
                found.append(own)
                stay = collapsed(len(words), own)
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stay)] if len(own) else words))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
            all_ = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            cells = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(all_[:, k])) for k in range(3)], names=["start", "length", "period"])
            return {"runs": pa.ListArray.from_arrays(offsets, cells), "collapsed": pa.array(kept, pa.binary()).cast(pa.string())}

        return work

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).alias("periodic input"))
    found = boxed(rows, "periodic input", keep, make, f"runs array<{RUN}>, collapsed string")
    return found.select(*(["keep.*"] if keep else []), "runs", "collapsed")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of one row in ten, by its id: the words from some place on become repetitions of the first of them. An id of null changes nothing."""
    if doc_id is None or not words:
        return words
    group, none = divmod(crc32(str(doc_id).encode()), 10)
    if none:
        return words
    n = len(words)
    at = group % n
    period = 1 + (n - at) // (3 + group % 8)
    return words[:at] + [words[at + i % period] for i in range(n - at)]


def document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    found = periodic_runs(table(spark, sf_dir, "documents"), ["doc_id"], prepare=repeated_tail)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("run"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", F.col("run.start").alias("start"), (-F.col("run.less")).alias("length"), F.col("run.period").alias("period"), F.expr("-1000 * run.less div run.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
