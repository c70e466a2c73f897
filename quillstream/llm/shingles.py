"""Near-duplicate groups by SimHash with exact verification, and an exact set-similarity join for what it can't reach.

A text is the set of its shingles of ``WIDTH`` words, lower-cased in A-Z, as XXH64 values. Texts with a Jaccard
similarity of ``NUM / DEN`` or more are linked; groups are the connected components of the links.

First come the texts whose SimHash fingerprints differ in at most three bits, found by multi-index hashing (as in
``simhash``) and verified on the whole sets. Fingerprints of similar texts may also differ in more bits, so links between
the groups found so far are searched by the sets themselves; shingles that only one group has take no part.

Two such sets share ``SHARED`` shingles (or all that their sizes ask for) among the first of each in any common order,
so only these are posted; length, positional and parity filters follow. The order is by rarity, counted over all
texts. Texts that meet are first compared to the smallest and largest set of each posting only, then all that are still in different components to each other, so a large group of near
copies isn't compared pair by pair. Candidates are verified on the whole sets.

Edge cases: null and empty texts, and texts of white space only, are one empty set, and equal; fewer words than a
shingle has are one shingle; repeated rows and repeated ids are rows of their own; a similarity of exactly the threshold
links; texts of any length are read whole; a table without rows gives none; other columns may have any name and pass
unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .bloom import BlockedBloom
from .common import BYTES_LOWER, discard, give_back, let_go, rowwise, saved
from .components import connected_components
from .simhash import marked, one_of_each

NUM, DEN, WIDTH = 4, 5, 5
SEED = 42
SHARED = 8
#: Shingles are counted by so many buckets of their hash.
BUCKETS = 1 << 16


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The different XXH64 values of a text's shingles in UTF-8, sorted."""
    words = (text or b"").translate(BYTES_LOWER).split()  # splits at 20 and 09-0D, as bytes do
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def sets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, set (a hash of the whole set) and hashes of each row."""

    def work(texts: pa.Array) -> dict:
        own = [shingles(t) for t in texts.cast(pa.binary()).to_pylist()]
        return {"set": pa.array(np.array([_key(o) for o in own], np.uint64).view(np.int64)), "hashes": _lists(own)}

    return rowwise(docs, "text", keep, lambda: work, "set bigint, hashes array<bigint>")


def parities(hashes: np.ndarray) -> tuple[int, int]:
    """128 parities in two numbers: seven bits of a hash say which one it turns. Sets differ in no fewer shingles than bits."""
    bits = np.uint64(1) << (hashes & np.uint64(63))
    second = (hashes >> np.uint64(6)) & np.uint64(1)
    return tuple(int(np.bitwise_xor.reduce(bits * (second == k)).astype(np.int64)) if len(bits) else 0 for k in (np.uint64(0), np.uint64(1)))


def prefixes(docs: DataFrame, keep: list[str], levels: np.ndarray) -> DataFrame:
    """``keep``, fp (the SimHash of three-word shingles), set, n (its size), s1, s2 (parities) and prefix: its first shingles, the rarest first by their buckets' ``levels``."""

    def first(own: np.ndarray) -> np.ndarray:
        order = np.lexsort((own, levels[_buckets(own)]))
        return own[order[: len(own) - -(-len(own) * NUM // DEN) + SHARED]]

    def work(texts: pa.Array) -> dict:
        whole = texts.cast(pa.binary()).to_pylist()
        own = [shingles(t) for t in whole]
        prints = np.array([simhash.fingerprint(t) for t in whole], np.uint64).view(np.int64)
        keys = np.array([_key(o) for o in own], np.uint64).view(np.int64)
        s1, s2 = zip(*map(parities, own), strict=True) if own else ((), ())
        return {"fp": pa.array(prints), "set": pa.array(keys), "n": pa.array([len(o) for o in own], pa.int32()), "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()), "prefix": _lists([first(o) for o in own])}

    return rowwise(docs, "text", keep, lambda: work, "fp bigint, set bigint, n int, s1 bigint, s2 bigint, prefix array<bigint>")


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def commonness(docs: DataFrame) -> np.ndarray:
    """For each bucket of shingles, the binary logarithm of how many texts have them, over all texts.

    Each task adds up its own texts, so a bounded number of counts leaves it, and as many come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                total += np.bincount(_buckets(shingles(text)), minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["bucket", "n"])
        give_back()

    counted = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.ceil(F.log2(F.sum("n"))).cast("int").alias("level"))
    levels = np.zeros(BUCKETS, np.uint8)
    found = counted.toPandas()
    levels[found["bucket"].to_numpy(int)] = found["level"].to_numpy(int)
    return levels


def _needed(a: str, b: str):
    """How many shingles the prefixes of similar sets share at least."""
    return F.least(F.lit(SHARED), F.ceil(F.greatest(a, b) * F.lit(NUM) / F.lit(DEN)))


def _differ(a: str, b: str) -> Column:
    """False only for sets whose parities differ in more bits than similar ones do in shingles."""
    bits = sum(F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in ("s1", "s2"))
    return bits * (NUM + DEN) <= (F.col(f"{a}n") + F.col(f"{b}n")) * (DEN - NUM)


def close(rows: DataFrame) -> DataFrame:
    """Candidates a < b: sets under one fingerprint with the least of them, and the least sets of fingerprints that SimHash links."""
    prints = saved(rows.select("fp", "set").distinct(), "shingles-prints")
    least = saved(prints.groupBy("fp").agg(F.min("set").alias("least")), "shingles-least")
    same = prints.join(least, "fp").select(F.col("set").alias("x"), F.col("least").alias("y"))
    linked = simhash.links(least.select("fp"))
    for side, to in (("a", "x"), ("b", "y")):
        linked = linked.join(least.select(F.col("fp").alias(side), F.col("least").alias(to)), side)
    found = same.unionByName(linked.select("x", "y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = saved(found, "shingles-close")
    discard(prints, least)
    return found


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the stored candidates that are similar, by their whole sets, which are built again from the texts that have them."""
    n = pairs.count()
    wanted = saved(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), "shingles-wanted", 2 * n)
    marks = saved(rows.join(wanted, "set", "left_semi").groupBy("set").agg(F.min("mark").alias("mark")), "shingles-marks", 2 * n)
    may = BlockedBloom(marks, "mark", marks.count()).may_hold(F.col("mark"))
    texts = docs.where(may).select("text")
    whole = saved(sets(texts, []).join(wanted, "set", "left_semi").groupBy("set").agg(F.first("hashes").alias("hashes")), "shingles-sets", 2 * n)
    left, right = (whole.select(F.col("set").alias(s), F.col("hashes").alias(f"{s}_hashes")) for s in "ab")
    enough = F.size(F.array_intersect("a_hashes", "b_hashes")) * (NUM + DEN) >= (F.size("a_hashes") + F.size("b_hashes")) * NUM
    out = saved(pairs.join(left, "a").join(right, "b").where(enough).select("a", "b"), "shingles-links", n)
    discard(pairs, wanted, marks, whole)
    return out


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links a, b of similar sets that give their components. ``rows`` has mark, fp, set, n, s1, s2, prefix of ``docs``, and is stored."""
    near = _verified(close(rows), rows, docs)
    parts = saved(connected_components(near), "shingles-parts")
    own = ("set", "n", "s1", "s2", "in")
    in_ = F.coalesce("component", "set").alias("in")
    distinct = rows.groupBy("set").agg(*[F.first(c).alias(c) for c in (*own[1:4], "prefix")])
    distinct = distinct.join(parts, F.col("set") == F.col("node"), "left").select(*own[:4], in_, "prefix")
    posted = distinct.select(*own, F.posexplode("prefix").alias("at", "word"))
    one = F.struct(*own)
    met = posted.groupBy("word").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.min("in").alias("x"), F.max("in").alias("y")).where("x <> y").select("word", "low", "high")
    met = saved(met, "shingles-met")
    bloom = BlockedBloom(met.select("word"), "word", met.count())
    postings = saved(posted.where(bloom.may_hold(F.col("word"))).join(met, "word"), "shingles-postings")
    length = (F.col("a_n") * DEN >= F.col("b_n") * NUM) & (F.col("b_n") * DEN >= F.col("a_n") * NUM)
    apart = F.col("a_in") != F.col("b_in")

    def similar(pairs: DataFrame) -> DataFrame:
        """Of candidates (one row for each shingle that they share) those that are similar."""
        pairs = pairs.groupBy("a", "a_n", "b", "b_n").count().where(F.col("count") >= _needed("a_n", "b_n")).select("a", "b")
        return _verified(saved(pairs, "shingles-pairs"), rows, docs)

    def named(side: str, *columns: str, of: str = "") -> list[Column]:
        return [F.col(f"{of}{c}").alias(side if c == "set" else f"{side}_{c}") for c in columns]

    ends = [postings.select(*named("a", *own), *named("b", *own, of=f"{end}.")).where(apart & length & _differ("a_", "b_")) for end in ("low", "high")]
    found = near.unionByName(similar(ends[0].unionByName(ends[1])))
    members = saved(connected_components(found), "shingles-members")
    open_ = saved(postings.select("word", "at", *own[:4]).join(members, F.col("set") == F.col("node"), "left").select("word", "at", *own[:4], in_), "shingles-open")
    discard(met, postings, parts)
    mixed = open_.groupBy("word").agg(F.min("in").alias("x"), F.max("in").alias("y")).where("x <> y").select("word")
    open_ = open_.join(mixed, "word", "left_semi")
    a, b = (open_.select("word", *named(s, *own, "at")) for s in "ab")
    # Of the first SHARED shingles in common, each is followed by enough of both sets for the smallest overlap, less those before it.
    rest = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) + (SHARED - 1)
    position = rest * (NUM + DEN) >= (F.col("a_n") + F.col("b_n")) * NUM
    return found.unionByName(similar(a.join(b, "word").where((F.col("a") < F.col("b")) & apart & length & position & _differ("a_", "b_"))))


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` less all but one of each group of similar texts: one with the group's smallest id."""
    slim = marked(docs, id_col)
    rows = saved(prefixes(slim, ["id", "mark"], commonness(docs)), "shingles")
    members = connected_components(links(slim, rows)).select(F.col("node").alias("set"), "component")
    labelled = rows.select("id", "mark", "set").join(members, "set", "left").select("id", "mark", F.coalesce("component", "set").alias("component"))
    return one_of_each(docs, labelled, id_col)
