"""A store of several tables that a stream writes in transactions: a batch's rows appear in all of them, or in none.

Tasks write a batch's rows as files, one for each table and task, which nothing refers to yet. The commit writes one small
file, the batch's entry in the log, that names them all; it appears under its name whole or not at all. Readers read the
files that the log names. A batch whose tasks or driver die leaves files without an entry, which no reader sees; what is
repeated after a restart commits once, since a batch that has an entry isn't given another.

Tables are kept as the rows that were written, and read as what these rows come to: the first or the last row of each key,
in the order of ``seq``, without rows that lack a required column or refer to a parent that isn't there. So inserting, or
replacing, many rows is one append, and reading is one aggregation over a key. ``compact`` writes what they come to anew,
so that neither files nor entries pile up.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

FORMAT = "quillstream_store"
SEQ = "_seq"
#: The folder of the log that holds snapshots; no stream may have this name.
SNAPSHOTS = "snapshots"


@dataclass(frozen=True)
class Table:
    """What a table's rows are, and what they come to.

    Of the rows of a key the first counts (insert or ignore), or the last (``replaces``). ``parents`` are pairs of a column
    and another table's key that it must be found in.
    """

    ddl: str
    key: tuple[str, ...]
    replaces: bool = False
    required: tuple[str, ...] = ()
    parents: tuple[tuple[str, str], ...] = field(default=())

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType) for f in T.StructType.fromDDL(self.ddl)])


@dataclass
class Staged(WriterCommitMessage):
    """The files that a task has written, by table."""

    files: dict[str, list[str]]


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.writer = options["folder"].rstrip("/"), options["writer"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, base = fs.FileSystem.from_uri(self.folder)
        open_: dict[str, pq.ParquetWriter] = {}
        staged: dict[str, list[str]] = {}
        for batch in iterator:
            rows = pa.Table.from_batches([batch])
            for name in rows.column("table").unique().to_pylist():
                mine = rows.filter(pc.equal(rows.column("table"), name))
                cells = mine.column(name).combine_chunks()
                cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
                out = pa.Table.from_arrays([*cells.flatten(), mine.column("seq")], names=[f.name for f in cells.type] + [SEQ])
                if name not in open_:
                    path = f"data/{name}/{uuid.uuid4().hex}.parquet"
                    files.create_dir(f"{base}/data/{name}", recursive=True)
                    open_[name] = pq.ParquetWriter(f"{base}/{path}", out.schema, filesystem=files, compression="zstd")
                    staged[name] = [path]
                open_[name].write_table(out)
        for writer in open_.values():
            writer.close()
        return Staged(staged)

    def _entry(self, base: str, batch: int) -> str:
        return f"{base}/log/{self.writer}/{batch:012d}.json"

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        files, base = fs.FileSystem.from_uri(self.folder)
        entry = self._entry(base, batchId)
        if files.get_file_info(entry).type == fs.FileType.File:  # the batch has been committed before
            self._remove(messages)
            return
        named: dict[str, list[str]] = {}
        for m in messages:
            for table, paths in (m.files if m else {}).items():
                named.setdefault(table, []).extend(paths)
        files.create_dir(f"{base}/log/{self.writer}", recursive=True)
        part = f"{base}/log/{self.writer}/.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(json.dumps(named).encode())
        files.move(part, entry)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self._remove(messages)

    def _remove(self, messages: list[Staged | None]) -> None:
        files, base = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            for paths in (m.files if m else {}).values():
                for p in paths:
                    files.delete_file(f"{base}/{p}")


class _Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return _Writer(dict(self.options))


class Store:
    """Tables in a folder that driver and executors share, in any file system that Arrow and Spark open by its URI."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table]) -> None:
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables
        spark.dataSource.register(_Source)

    def rows(self, events: DataFrame, seq: str, **parts: dict[str, Column]) -> DataFrame:
        """For each event a row of each of these tables, out of its columns; each says its table. For ``writer``."""
        made = []
        for name, columns in parts.items():
            own = F.struct(*[columns[f.name].cast(f.dataType).alias(f.name) for f in self.tables[name].schema])
            made.append(F.struct(F.lit(name).alias("table"), *[own.alias(t) if t == name else F.lit(None).cast(self.tables[t].schema).alias(t) for t in self.tables]))
        return events.select(F.col(seq).cast("long").alias("seq"), F.explode(F.array(*made)).alias("row")).select("row.table", "seq", *[f"row.{t}" for t in self.tables])

    def writer(self, rows: DataFrame, name: str) -> DataStreamWriter:
        """A stream that writes ``rows`` in transactions, a batch each. ``name`` tells the store's streams apart."""
        if name == SNAPSHOTS:
            raise ValueError(f"a stream can't be called {SNAPSHOTS}")
        return rows.writeStream.format(FORMAT).option("folder", self.folder).option("writer", name).option("checkpointLocation", f"{self.folder}/checkpoint/{name}")

    def _log(self) -> tuple[dict, dict[str, dict[str, list[str]]]]:
        """The last snapshot (its entries and files), and the entries that it hasn't taken in, by their paths in the log."""
        files, base = fs.FileSystem.from_uri(self.folder)
        found = [i.path for i in files.get_file_info(fs.FileSelector(f"{base}/log", allow_not_found=True, recursive=True)) if i.base_name.endswith(".json")]
        names = sorted(p.removeprefix(f"{base}/log/") for p in found)

        def read(name: str) -> dict:
            with files.open_input_stream(f"{base}/log/{name}") as f:
                return json.loads(f.read())

        snapshots = [n for n in names if n.startswith(f"{SNAPSHOTS}/")]
        last = read(snapshots[-1]) if snapshots else {"entries": [], "files": {}}
        taken = set(last["entries"])
        return last, {n: read(n) for n in names if not n.startswith(f"{SNAPSHOTS}/") and n not in taken}

    def committed(self) -> dict[str, list[str]]:
        """The files of each table that the log names: the last snapshot's, and those of batches since."""
        last, entries = self._log()
        out: dict[str, list[str]] = {t: [] for t in self.tables}
        for named in (last["files"], *entries.values()):
            for table, paths in named.items():
                out[table] += [f"{self.folder}/{p}" for p in paths]
        return out

    def compact(self, remove: bool = False) -> None:
        """Write what all rows come to as a snapshot, so that reading goes on from there; one small file commits it.

        Batches may be committed meanwhile: what the snapshot hasn't taken in is read beside it. ``remove`` deletes what it
        replaces, once no reader goes by an older ``committed()``; of each stream the last entry stays, since it says
        which batch was the last.
        """
        files, base = fs.FileSystem.from_uri(self.folder)
        last, entries = self._log()
        now = self.committed()
        written: dict[str, list[str]] = {}
        for name, table in self.tables.items():
            row = F.struct(*[f.name for f in table.schema], SEQ)
            pick = F.max_by(row, SEQ) if table.replaces else F.min_by(row, SEQ)
            rows = self.written(name, now).dropna(subset=[*table.key, *table.required])
            kept = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in table.key]).agg(pick.alias("__row")).select("__row.*")
            path = f"data/{name}/snapshot-{uuid.uuid4().hex}"
            kept.write.option("compression", "zstd").parquet(f"{self.folder}/{path}")
            written[name] = [f"{path}/{i.base_name}" for i in files.get_file_info(fs.FileSelector(f"{base}/{path}")) if i.base_name.endswith(".parquet")]
        number = 1 + max((int(i.base_name[:12]) for i in files.get_file_info(fs.FileSelector(f"{base}/log/{SNAPSHOTS}", allow_not_found=True)) if i.base_name.endswith(".json")), default=0)
        files.create_dir(f"{base}/log/{SNAPSHOTS}", recursive=True)
        part = f"{base}/log/{SNAPSHOTS}/.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(json.dumps({"entries": sorted({*last["entries"], *entries}), "files": written}).encode())
        files.move(part, f"{base}/log/{SNAPSHOTS}/{number:012d}.json")
        if remove:
            self._remove({*last["entries"], *entries}, number)

    def _remove(self, taken: set[str], number: int) -> None:
        """Delete the files that entries and snapshots before the given one name, and all but each stream's last entry."""
        files, base = fs.FileSystem.from_uri(self.folder)
        log = sorted(i.path.removeprefix(f"{base}/log/") for i in files.get_file_info(fs.FileSelector(f"{base}/log", recursive=True)) if i.base_name.endswith(".json"))
        older = [n for n in log if n.startswith(f"{SNAPSHOTS}/") and int(n[-17:-5]) < number]
        latest = {n.rpartition("/")[0]: n for n in log}
        for n in [*older, *(n for n in log if n in taken)]:
            with files.open_input_stream(f"{base}/log/{n}") as f:
                named = json.loads(f.read())
            for paths in (named["files"] if n in older else named).values():
                for info in files.get_file_info([f"{base}/{p}" for p in paths]):
                    if info.type == fs.FileType.File:
                        files.delete_file(info.path)
            if n != latest[n.rpartition("/")[0]]:
                files.delete_file(f"{base}/log/{n}")

    def written(self, name: str, committed: dict[str, list[str]] | None = None) -> DataFrame:
        """All rows of a table that have been committed, with their ``_seq``."""
        schema = T.StructType([*self.tables[name].schema, T.StructField(SEQ, T.LongType())])
        paths = (self.committed() if committed is None else committed)[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, committed: dict[str, list[str]] | None = None) -> DataFrame:
        """What a table's rows come to. To read several tables as of one moment, give each the same ``committed()``."""
        committed = self.committed() if committed is None else committed
        table = self.tables[name]
        rows = self.written(name, committed).dropna(subset=[*table.key, *table.required])
        for column, parent in table.parents:
            own = self.read(parent, committed).select(F.col(self.tables[parent].key[0]).alias("__parent"))
            rows = rows.join(own, F.col(column) == F.col("__parent"), "left_semi")
        row = F.struct(*[f.name for f in table.schema])
        pick = F.max_by(row, SEQ) if table.replaces else F.min_by(row, SEQ)
        return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in table.key]).agg(pick.alias("__row")).select("__row.*")


#: Companies, the exchanges that list them, and their earnings: the first company or exchange of a name stays, reports are replaced.
EARNINGS_STORE = {
    "companies": Table("ticker string, cik string, company_name string, sector string, industry string", ("ticker",), required=("company_name",)),
    "exchanges": Table("name string", ("name",)),
    "company_exchanges": Table("company_ticker string, exchange string", ("company_ticker", "exchange"), parents=(("company_ticker", "companies"), ("exchange", "exchanges"))),
    "earnings_reports": Table("company_ticker string, report_datetime timestamp, eps_estimate double, reported_eps double", ("company_ticker", "report_datetime"), replaces=True, parents=(("company_ticker", "companies"),)),
}
