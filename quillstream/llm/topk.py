"""Exact top-k search by inner product, term at a time over all rows.

Vectors are quantised to integers; a component is a term, the candidates that have it (with a weight other than zero)
its postings. For a query row, the postings of its terms, times its weights, are added into a dense array of scores of
a block of candidates; a term that most candidates have is added to the whole array at once. A partition of each array
selects the block's best, which are merged with the query's best of the blocks before.

Rows are packed once into stored blocks, queries once more into blocks of their own, so that a block of queries is full of
them however few they are among the rows. Both meet in tiles of bounded bytes: a tile's candidates stay in one task, which
takes the tile's queries one block after the other and returns k rows for each query; the best of all tiles are merged in
Spark. So a candidate is copied once for each 32,768 queries, and a query once for each tile of candidates.

Edge cases: vectors that are null, empty of components, or hold null or non-finite components take no part; of vectors
of unequal length the shorter is filled up with zeros; every row is a candidate of every query but the one that it
is itself, so repeated rows and rows that repeat a query's id are candidates, and each query row has its own ranks;
ids of null take no part as queries and come last among ties; a table without rows or queries gives none. Scores are
exact whatever the components: where 64 bits might not do they are summed as integers of any size, and a score that
doesn't fit a long is returned as the nearest long, ranked by its true value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Rows and components of a block; blocks of queries, blocks and components of candidates in a tile (each component is held as
#: eight bytes at most, or as an integer of any size).
ROWS, CELLS, TILE_QUERIES, TILE_CANDIDATES, TILE_CELLS = 2_048, 1 << 21, 16, 128, 1 << 24
SCALE = 64
#: Postings of a term that more than this share of the candidates have are kept in full length.
FULL = 0.25
LONG = np.iinfo(np.int64)
#: Bytes of a component that needs more than eight; the largest double times 64 has 1030 bits.
WIDE = 136
#: Bytes of a score that doesn't fit a long, so that they sort as its value does.
WIDE_SCORE = 2 * WIDE + 8

BLOCK = "block long, ids binary, null binary, data binary, width int, dim int, of binary, place binary"


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(64 x) of finite doubles, exactly: as longs, or as integers of any size."""
    if len(x) == 0 or np.abs(x).max() < 2.0**56:
        return np.floor(SCALE * x).astype(np.int64)
    return np.array([math.floor(SCALE * v) if abs(v) < 2.0**56 else SCALE * int(v) for v in x.tolist()], object)


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of usable vectors and their quantised components, filled up with zeros; those of long integers apart."""
    found: dict[bool, list] = {False: [], True: []}
    for i, v in enumerate(vectors):
        if v.is_valid and len(v) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                x = quantised(x)
                found[x.dtype == object].append((i, x))
    for wide, rows in found.items():
        if rows:
            out = np.zeros((len(rows), max(len(x) for _, x in rows)), object if wide else np.int64)
            for k, (_, x) in enumerate(rows):
                out[k, : len(x)] = x
            yield np.array([i for i, _ in rows], np.int64), out


def _to_bytes(matrix: np.ndarray) -> tuple[bytes, int]:
    if matrix.dtype == object:
        return b"".join(int(x).to_bytes(WIDE, "little", signed=True) for x in matrix.ravel()), WIDE
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return matrix.astype(kind).tobytes(), kind().itemsize


def _from_bytes(data: bytes, width: int, rows: int, dim: int) -> np.ndarray:
    if width == WIDE:
        out = np.empty(rows * dim, object)
        out[:] = [int.from_bytes(data[i : i + WIDE], "little", signed=True) for i in range(0, len(data), WIDE)]
        return out.reshape(rows, dim)
    return np.frombuffer(data, {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(rows, dim)


def pack(rows: DataFrame) -> DataFrame:
    """Blocks of rows of (id, v, query): all rows as candidates, and once more those that are queries, packed by themselves.

    A block has its key, ids, which are null, and components as bytes; blocks of queries also say of each row which block
    of candidates, and which place in it, it is itself. A block has at most ``ROWS`` rows and about ``CELLS`` components.
    """

    def block(key: int, ids: np.ndarray, null: np.ndarray, matrix: np.ndarray, of: np.ndarray | None = None, place: np.ndarray | None = None) -> pa.RecordBatch:
        data, width = _to_bytes(matrix)
        cells = {"block": pa.array([key], pa.int64()), "ids": [ids.astype("<i8").tobytes()], "null": [null.tobytes()], "data": [data], "width": pa.array([width], pa.int32()), "dim": pa.array([matrix.shape[1]], pa.int32())}
        own = {c: [None if x is None else x.astype("<i8").tobytes()] for c, x in (("of", of), ("place", place))}
        return pa.RecordBatch.from_pydict({k: x if isinstance(x, pa.Array) else pa.array(x, pa.binary()) for k, x in (cells | own).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33  # the same when the task is repeated
        waiting: dict[tuple[bool, int], list[tuple]] = {}

        def queries(kind: tuple[bool, int]) -> pa.RecordBatch:
            ids, of, place, rows = (np.concatenate(x) for x in zip(*waiting.pop(kind), strict=True))
            return block(made, ids, np.zeros(len(ids), bool), rows, of, place)

        for batch in batches:
            longest = pc.max(pc.list_value_length(batch.column(1))).as_py() or 1
            step = max(1, min(ROWS, CELLS // longest))
            for at in range(0, batch.num_rows, step):
                own = batch.slice(at, step)
                for usable, matrix in _matrices(own.column(1)):
                    ids, query = (own.column(c).take(pa.array(usable)) for c in (0, 2))
                    null = ids.is_null().to_numpy(zero_copy_only=False)
                    values = np.where(null, LONG.max, ids.fill_null(0).to_numpy(zero_copy_only=False))
                    yield block(made, values, null, matrix)
                    places = np.flatnonzero(query.fill_null(False).to_numpy(zero_copy_only=False) & ~null)
                    made += 1
                    if len(places):
                        kind = matrix.dtype == object, matrix.shape[1]
                        waiting.setdefault(kind, []).append((values[places], np.full(len(places), made - 1), places, matrix[places]))
                        if sum(len(x[0]) for x in waiting[kind]) >= step:
                            yield queries(kind)
                            made += 1
        for kind in list(waiting):
            yield queries(kind)
            made += 1

    return rows.mapInArrow(run, BLOCK)


class Block:
    """A stored block's ids, which of them are null, and components; of queries also the block and place that each is itself."""

    def __init__(self, row: dict) -> None:
        self.key = row["block"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.null = np.frombuffer(row["null"], bool)
        self.of, self.place = (None if row[c] is None else np.frombuffer(row[c], "<i8") for c in ("of", "place"))
        self.matrix = _from_bytes(row["data"], row["width"], len(self.ids), row["dim"])
        self._postings: dict[type, list] = {}

    def postings(self, kind: type) -> list[tuple[np.ndarray | None, np.ndarray]]:
        if kind not in self._postings:
            self._postings = {kind: _postings(self.matrix.astype(kind))}
        return self._postings[kind]


def _postings(candidates: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term the places of the candidates that have it, None for all of them, and their weights."""
    out = []
    for t in range(candidates.shape[1]):
        column = np.ascontiguousarray(candidates[:, t])
        places = np.flatnonzero(column)
        out.append((None, column) if len(places) > FULL * len(column) else (places, column[places]))
    return out


def _kind(queries: np.ndarray, candidates: np.ndarray) -> type:
    """The smallest kind of number that holds every score."""
    largest = [max((abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))) for m in (queries, candidates)]
    bound = largest[0] * largest[1] * max(1, queries.shape[1])
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def scores(queries: np.ndarray, candidates: np.ndarray, postings: list | None = None) -> Iterator[np.ndarray]:
    """For each query row its scores of all candidates, accumulated term at a time."""
    kind = _kind(queries, candidates)
    postings = _postings(candidates.astype(kind)) if postings is None else postings
    dim = min(queries.shape[1], len(postings))
    for q in queries[:, :dim].astype(kind):
        total = np.zeros(len(candidates), kind)
        for t in np.flatnonzero(q):
            places, weights = postings[t]
            if places is None:
                total += q[t] * weights
            else:
                total[places] += q[t] * weights
        yield total


def best(total: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; by partition, then sorting only what can be among them."""
    places = np.arange(len(total))
    if len(total) > k:
        edge = np.partition(total, len(total) - k)[len(total) - k] if total.dtype != object else sorted(total)[len(total) - k]
        places = np.flatnonzero(total >= edge)
    if total.dtype == object:
        return np.array(sorted(places.tolist(), key=lambda i: (-total[i], null[i], ids[i]))[:k], np.int64)
    return places[np.lexsort((ids[places], null[places], -total[places].astype(np.int64)))[:k]]


def _merged(queries: Block, candidates: list[Block], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of a block of queries: its number, and the ids, nulls and scores of its best in a tile's candidates."""
    held: list[list[tuple]] = [[] for _ in queries.ids]
    for c in candidates:
        kind = _kind(queries.matrix, c.matrix)
        for n, total in enumerate(scores(queries.matrix, c.matrix, c.postings(kind))):
            own = best(total, c.ids, c.null, k + 1)
            if c.key == queries.of[n]:  # one more than k, since the query may be among them
                own = own[own != queries.place[n]]
            held[n].append((c.ids[own[:k]], c.null[own[:k]], total[own[:k]]))
    for n, parts in enumerate(held):
        ids, null, total = (np.concatenate(x) for x in zip(*parts, strict=True))
        own = best(total, ids, null, k)
        yield n, ids[own], null[own], total[own]


def _cells(total: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Scores as longs, and those that a long doesn't tell from others as bytes that sort as they do."""
    if total.dtype != object:
        return total.astype(np.int64), [None] * len(total)
    near = np.array([min(max(int(s), LONG.min), LONG.max) for s in total], np.int64)
    middle = 1 << (8 * WIDE_SCORE - 1)
    return near, [(int(s) + middle).to_bytes(WIDE_SCORE, "big") if n in (LONG.min, LONG.max) else None for s, n in zip(total, near.tolist(), strict=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), is_query.alias("query"))
    blocks = saved(pack(rows), "topk-blocks")
    is_asked = F.col("of").isNotNull()
    counts = blocks.agg(F.count_if(is_asked), F.count_if(~is_asked), F.coalesce(F.max(F.octet_length("ids") / 8 * F.col("dim")), F.lit(1.0))).first()
    # Tiles are no larger than memory allows, and small enough that all cores have some.
    wide = max(1, min(TILE_CANDIDATES, int(TILE_CELLS // counts[2]), counts[1] // max(1, spark.sparkContext.defaultParallelism)))
    down, across = -(-counts[0] // TILE_QUERIES) or 1, -(-counts[1] // wide) or 1

    def dealt(df: DataFrame, own: str, into: int, other: str, times: int) -> DataFrame:
        dealt = df.withColumn(own, F.pmod(F.xxhash64("block"), F.lit(into)).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))

    queries, candidates = dealt(blocks.where(is_asked), "down", down, "across", across), dealt(blocks.where(~is_asked), "across", across, "down", down)

    def tile(asked: pa.Table, held: pa.Table) -> pa.Table:
        own = [Block(r) for r in held.to_pylist()]
        out: dict[str, list] = {c: [] for c in ("query_id", "block", "place", "vec_id", "score", "wide")}
        for row in asked.to_pylist() if own else ():
            q = Block(row)
            for n, ids, null, total in _merged(q, own, k):
                near, wide = _cells(total)
                for c, x in zip(out, (np.full(len(ids), q.ids[n]), np.full(len(ids), q.of[n]), np.full(len(ids), q.place[n]), pa.array(ids, mask=null), near, pa.array(wide, pa.binary())), strict=True):
                    out[c].append(x if isinstance(x, pa.Array) else pa.array(x, pa.int64()))
        kinds = dict.fromkeys(out, pa.int64()) | {"wide": pa.binary()}
        return pa.table({c: pa.chunked_array(x, kinds[c]) for c, x in out.items()})

    found = queries.groupBy("down", "across").cogroup(candidates.groupBy("down", "across")).applyInArrow(tile, "query_id long, block long, place long, vec_id long, score long, wide binary")
    order = Window.partitionBy("query_id", "block", "place").orderBy(F.desc("score"), F.desc("wide"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_documents(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
