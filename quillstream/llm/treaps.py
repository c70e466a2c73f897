"""Ranked lexical search over inverted treaps.

A block of documents has one treap for each term of the queries: a node is a document that holds the term, in search
order by document and in heap order by impact (what the term adds to the document's score). So the first node of a treap
that lies in a span of documents has the span's highest impact, and the sum over a query's terms bounds every score of
the span. A query walks all treaps of its terms at once: a span whose bound can't enter the best k is cut off;
otherwise the document of its strongest node is scored exactly and parts the span in two. Spans are held as arrays, a
level of the walk at a time, so that the steps of many spans and terms are steps of arrays.

Heap order is by impact rounded up to a step of a fixed scale (a sixteenth of an octave) and random within one: bounds
lose a few per cent, and treaps stay shallow also where impacts rise or fall with the document's number.

Documents are read once: each task finds the queries' terms in its texts, and what it found is stored; counts over all
documents come from there, then impacts, treaps and walks. A task keeps each query's best of the blocks before, which
cuts off more of the later ones. The best of all tasks are merged in Spark. Queries are taken in sets of bounded bytes.

Edge cases: null and empty texts, and texts without letters or digits, have no terms: such documents are never found and
count neither for N nor for L, such items find nothing; repeated documents and repeated ids are rows of their own, and
so are repeated items; of equal scores the smaller id comes first, an id of null last; texts of any length are read
whole; tables without rows give none; other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, rowwise, saved, table
from .topk import LONG, best

#: Documents of a block; bytes of queries that are answered in one go; cells (spans by terms) of one step.
ROWS, QUERY_BYTES, CELLS = 16_384, 4_000_000, 1 << 16
#: Impacts are rounded up to these for the order of heaps.
SCALE = np.unique(np.ceil(2.0 ** (np.arange(16 * 52) / 16)).astype(np.int64))
#: Everything but letters, digits and what isn't ASCII parts terms.
TERMS = bytes(c + 32 if chr(c) in UPPER else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a document's score; all integers."""
    m = 50 + (50 * n * n_docs) // max(1, n_terms)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Treaps:
    """Treaps of all terms of a block in common arrays. Node ``none`` stands for an empty treap."""

    def __init__(self, term: np.ndarray, place: np.ndarray, impact: np.ndarray, n_terms: int, seed: int = 0) -> None:
        """Postings by term, then place; impacts above zero."""
        self.none = len(term)
        self.place = np.append(place, -1).astype(np.int32)
        self.impact = np.append(impact, 0)
        step = np.searchsorted(SCALE, impact)
        self.most = np.append(SCALE[step], 0)
        chance = np.random.default_rng(seed).permutation(len(term))
        heap = ((step.astype(np.int64) << 40) + chance).tolist()
        starts = np.searchsorted(term, np.arange(n_terms + 1)).tolist()
        self.left, self.right, self.roots = self._linked(heap, starts)

    def _linked(self, heap: list[int], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = [self.none] * (self.none + 1), [self.none] * (self.none + 1)
        roots = []
        for a, b in zip(starts, starts[1:], strict=False):
            spine: list[int] = []  # from the root to the right
            for i in range(a, b):
                own, under = heap[i], self.none
                while spine and heap[spine[-1]] < own:
                    under = spine.pop()
                left[i] = under
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            roots.append(spine[0] if spine else self.none)
        return np.array(left, np.int32), np.array(right, np.int32), np.array(roots, np.int32)

    def first_in(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Under each node the first one, from above, whose document lies between ``low`` and ``high``."""
        now = node.ravel().copy()
        low, high = (np.broadcast_to(x, node.shape).ravel() for x in (low, high))
        open_ = np.flatnonzero(now != self.none)
        while open_.size:
            at = now[open_]
            place = self.place[at]
            below = place < low[open_]
            moves = below | (place > high[open_])
            open_, at = open_[moves], at[moves]
            at = np.where(below[moves], self.right[at], self.left[at])
            now[open_] = at
            open_ = open_[at != self.none]
        return now.reshape(node.shape)

    def walk(self, own: np.ndarray, last: int, held: Best) -> None:
        """Give ``held`` the documents of all spans whose bound can enter; ``own`` are a query's terms, ``last`` the last place."""
        roots = self.roots[own]
        roots = roots[roots != self.none]
        if not len(roots):
            return
        node, low, high = roots[None, :], np.zeros(1, np.int32), np.full(1, last, np.int32)
        rows = max(1, CELLS // len(roots))
        while len(node):
            bound = self.most[node].sum(axis=1)
            order = np.argsort(-bound, kind="stable")
            parts = []
            for at in range(0, len(order), rows):
                own = order[at : at + rows]
                own = own[bound[own] >= held.needed]
                if not len(own):
                    break
                parts.append(self._parted(node[own], low[own], high[own], held))
            node, low, high = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (node[:0], low, high)

    def _parted(self, node: np.ndarray, low: np.ndarray, high: np.ndarray, held: Best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score each span's strongest document, and return the spans before and after it that can enter."""
        strongest = self.most[node].argmax(axis=1)
        place = self.place[node[np.arange(len(node)), strongest]]
        found = self.first_in(np.stack([node, node, node]), np.stack([place, low, place + 1])[..., None], np.stack([place, place - 1, high])[..., None])
        held.add(place, self.impact[found[0]].sum(axis=1))
        node, low, high = np.concatenate(found[1:]), np.concatenate([low, place + 1]), np.concatenate([place - 1, high])
        stay = self.most[node].sum(axis=1) >= held.needed
        return node[stay], low[stay], high[stay]


class Best:
    """A query's best documents so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.needed = 1
        self.ids, self.null, self.scores = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.block: tuple[np.ndarray, np.ndarray] = self.ids, self.null

    def add(self, places: np.ndarray, scores: np.ndarray) -> None:
        """Documents of the block that is being walked, by their places."""
        enter = scores >= self.needed
        places, scores = places[enter], scores[enter]
        ids, null, scores = (np.concatenate(x) for x in ((self.ids, self.block[0][places]), (self.null, self.block[1][places]), (self.scores, scores)))
        own = best(scores, ids, null, self.k)
        self.ids, self.null, self.scores = ids[own], null[own], scores[own]
        if len(own) == self.k:
            self.needed = int(self.scores[-1])


def holdings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (terms of the text with repeats), and of the vocabulary's terms in it their numbers and how often they occur."""

    def work(texts: pa.Array) -> dict:
        n, places, numbers, times = [], [0], [], []
        for t in texts.cast(pa.binary()).to_pylist():
            own = terms(t)
            n.append(len(own))
            held = [(vocabulary[w], c) for w, c in Counter(own).items() if w in vocabulary]
            numbers += [k for k, _ in held]
            times += [c for _, c in held]
            places.append(len(numbers))
        offsets = pa.array(places, pa.int32())
        return {"n": pa.array(n, pa.int64()), "terms": pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int32())), "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))}

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rowwise(rows, "text", ["id"], lambda: work, "n bigint, terms array<int>, times array<bigint>")


def _treaps_of(batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int) -> tuple[Treaps, np.ndarray, np.ndarray]:
    """The treaps of a block of holdings, and the ids of its places with those that are null."""
    null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
    ids = np.where(null, LONG.max, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
    order = np.lexsort((ids, null))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = batch.column(1).to_numpy()
    sizes = np.diff(batch.column(2).offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    term, tf = (batch.column(c).flatten().to_numpy() for c in (2, 3))
    impact = impacts(weights[term], tf, n[row], n_docs, n_terms)
    place = place[row]
    by = np.lexsort((place, term))
    by = by[impact[by] > 0]
    return Treaps(term[by], place[by], impact[by], len(weights)), ids[order], null[order]


def _ranked(stored: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query (its number), doc_id and score: each task's best of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Best(k) for _ in queries]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                treaps, ids, null = _treaps_of(batch.slice(at, ROWS), weights, n_docs, n_terms)
                for own, found in zip(queries, held, strict=True):
                    found.block = ids, null
                    treaps.walk(own, len(ids) - 1, found)
        sizes = [len(b.ids) for b in held]
        if sum(sizes):
            number = pa.array(np.repeat(np.arange(len(held)), sizes).astype(np.int32))
            ids, null, scores = (np.concatenate([getattr(b, c) for b in held]) for c in ("ids", "null", "scores"))
            yield pa.RecordBatch.from_arrays([number, pa.array(ids, mask=null), pa.array(scores)], names=["query", "doc_id", "score"])

    return stored.mapInArrow(run, "query int, doc_id long, score long")


def _query_sets(items: DataFrame) -> Iterator[list]:
    """Different items with their number of rows, so many at a time that their texts are of bounded size."""
    same = items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    size = same.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = 1 + size // QUERY_BYTES
    for s in range(sets):
        yield same.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == s).collect()


def rank(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents with the highest score above zero."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for rows in _query_sets(items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text"))):
        vocabulary: dict[bytes, int] = {}
        queries = [np.array(sorted({vocabulary.setdefault(w, len(vocabulary)) for w in terms((r["text"] or "").encode())}), np.int64) for r in rows]
        if not vocabulary:
            continue
        stored = saved(holdings(docs, vocabulary, id_col, text), "treaps-holdings")
        n_docs, n_terms = stored.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[term] = weight(n_docs, df)
        found = _ranked(stored.where(F.size("terms") > 0), queries, weights, n_docs, n_terms, k)
        merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        asked = spark.createDataFrame([(i, r["item_id"], r["copies"]) for i, r in enumerate(rows)], "query int, item_id long, copies long")
        named = merged.join(asked, "query").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        out = out.unionByName(named.select("item_id", "rank", "doc_id", "score"))
    return out


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT row_number() OVER () AS i, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT i, item_id, unnest(w) AS t FROM b),
x AS (
  SELECT i, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
WINDOW o AS (PARTITION BY i ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 50
"""
