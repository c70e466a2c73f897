"""What the text operators share: tables, materialisation, Arrow streaming, ASCII lower case."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_LOWER = str.maketrans(UPPER, LOWER)
BYTES_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: About so many bytes of a batch are Python objects at a time.
PYTHON_BYTES = 8_000_000
#: Rows of a batch where rows go to Python and back with all their columns.
BATCH_ROWS = 1_000
#: Where the number of rows is known, a stored file has so many.
FILE_ROWS = 20_000
#: Spark's setting that removes a query's shuffle files when the query ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the size of shuffled partitions up to which it joins them by hash tables, without sorting both sides.
HASHED_UP_TO = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
#: That size, as it is shuffled: small enough for some tasks of an executor of 1 GB at once.
HASHED = "64m"


#: Folders made for local sessions that name none, by application.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a fresh local one only where a local session names none."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='quillstream-')}"
    return _OWN[app]


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has no more than so many rows, in as many partitions as it needs files."""
    if (files := max(1, -(-rows // FILE_ROWS))) < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(files)  # dealt out by a shuffle of these rows alone, so what makes them stays as parallel as it is
    return df


@contextmanager
def hashed_joins(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile joins by hash tables where no shuffled partition of a side is over ``HASHED``, and by sorting where one is."""
    before = spark.conf.get(HASHED_UP_TO)
    spark.conf.set(HASHED_UP_TO, HASHED)
    try:
        yield
    finally:
        spark.conf.set(HASHED_UP_TO, before)


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor costs nothing.

    What the write has shuffled is not needed any more, so it is removed from the executors' disks. ``rows``: there are no
    more, so that few rows don't become a file for each partition (for each file on a local disk Hadoop starts two
    processes, and a process that is starting has all of the executor's memory for a moment).
    """
    spark = df.sparkSession
    if rows is not None:
        df = in_few_files(df, rows)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    if before is not None:  # a session without the setting keeps shuffles until their plans are collected
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the folders of frames that ``saved`` has returned and that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: The one thing that a worker keeps for its next tasks, by what it was made from.
_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, once for a worker's tasks in a row that ask for ``key``."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return memory that is free to the system: a worker lives on after its task, and is counted to its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def let_go() -> None:
    """What another operator's tasks have left in this worker."""
    if _HELD:
        _HELD.clear()
        give_back()


def small_batches(spark: SparkSession) -> None:
    """From here on this session hands whole rows to Python in batches of at most ``BATCH_ROWS``, or fewer if it did.

    Such a batch stands in the JVM, in Arrow's memory and in the worker at once, in each task.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(rows, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def boxed(df: DataFrame, text: str, keep: list[str], make: Callable[[], Callable[[pa.Array], dict]], out: str, holds: bool = False) -> DataFrame:
    """Run ``make()`` once in each task; it gets Arrow arrays of whole texts and returns the new columns.

    ``holds``: it asks for something ``held``; else a worker lets that go.

    ``out`` declares these in DDL. The columns ``keep`` stand in one struct of that name, so that they clash with no other,
    and pass unchanged as Arrow arrays, so that their values are never built as Python objects.
    """
    added = T.StructType.fromDDL(out)
    names = added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            let_go()
        work = make()
        for batch in batches:
            rows = max(1, batch.num_rows * PYTHON_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                new = work(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0)] + [a if isinstance(a := new[n], pa.Array) else pa.array(a) for n in names], names=["keep", *names])
        give_back()

    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = df.select(kept.alias("keep"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["keep"], *added]))


def rowwise(df: DataFrame, text: str, keep: list[str], make: Callable[[], Callable[[pa.Array], dict]], out: str, holds: bool = False) -> DataFrame:
    """``boxed``, with the columns ``keep`` beside the new ones."""
    found = boxed(df, text, keep, make, out, holds)
    return found.select(*(["keep.*"] if keep else []), *T.StructType.fromDDL(out).names)
