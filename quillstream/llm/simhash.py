"""SimHash fingerprints of word shingles, near-duplicate groups by multi-index hashing.

Every text gets a 64-bit fingerprint: a bit is 1 where more than half of the XXH64 values of its shingles have it.
Two fingerprints that differ in at most ``radius`` bits are linked. To find all links, a fingerprint is cut into
``parts`` segments; of two linked ones some segment differs in at most ``radius // parts`` bits. Each fingerprint
is stored under its own segment values and probes that table under every value in the small Hamming ball around
them; matches are verified over all 64 bits. Only distinct fingerprints take part, so exact copies cost nothing, and
a link is emitted once: by its smaller fingerprint, in the first segment that is close enough.

Edge cases: null and empty texts, and texts of white space only, have fingerprint 0 and are linked like any other;
fewer words than a shingle has are one shingle; repeated rows and repeated ids give one output row each; texts of any
length are read whole, a bounded number of shingles at a time; fingerprints at exactly the radius are linked; a table
without rows gives none; other columns may have any name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import BlockedBloom
from .common import BYTES_LOWER, rowwise, saved
from .components import connected_components

BITS = 64
SEED = 42
#: Shingles hashed at a time, so that a very long text needs no more memory than a short one.
CHUNK = 65_536
#: Row b holds the bits of byte value b, lowest first.
BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The SimHash of a text in UTF-8; null and texts without words give 0."""
    words = (text or b"").translate(BYTES_LOWER).split()  # splits at 20 and 09-0D, as bytes do
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        h = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)[:, ::-1]
        if len(h) < 200:
            ones += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            ones += np.concatenate([np.bincount(h[:, k], minlength=256) @ BITS_OF_BYTE for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(texts: pa.Array, width: int) -> pa.Array:
    found = [fingerprint(t, width) for t in texts.cast(pa.binary()).to_pylist()]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def with_fingerprints(docs: DataFrame, keep: list[str], width: int = 3, text: str = "text") -> DataFrame:
    """``keep`` and the fingerprint ``fp`` as a signed long; one row for each row of ``docs``."""
    return rowwise(docs, text, keep, lambda: lambda texts: {"fp": _fingerprints(texts, width)}, "fp bigint")


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``bits`` bits, the empty one first."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def links(distinct: DataFrame, radius: int = 3, parts: int = 2) -> DataFrame:
    """All pairs a < b of the distinct fingerprints ``fp`` that differ in at most ``radius`` bits, each once."""
    width, within = BITS // parts, radius // parts
    low = (1 << width) - 1
    fp = F.col("fp")

    def key(part: int, mask=None):
        segment = F.shiftrightunsigned(fp, part * width).bitwiseAND(F.lit(low))
        segment = segment if mask is None else segment.bitwiseXOR(mask)
        return F.shiftleft(segment, 4).bitwiseOR(F.lit(part).cast("long"))  # the part in the lowest bits

    if width + 4 > 63 or parts > 16:
        raise ValueError("parts must be from 2 to 16")
    masks = F.lit(ball(width, within)).cast("array<bigint>")

    def around(part: int):
        return F.transform(masks, lambda m: key(part, m))

    stored = distinct.select(fp.alias("b"), F.explode(F.array(*[key(p) for p in range(parts)])).alias("key"))
    probing = distinct.select(fp.alias("a"), F.explode(F.flatten(F.array(*[around(p) for p in range(parts)]))).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    part = F.col("key").bitwiseAND(F.lit(15).cast("long"))
    first = F.lit(True)
    for p in range(parts - 1):  # a pair that an earlier segment finds is not found again by a later one
        earlier = F.bit_count(F.shiftrightunsigned(differ, p * width).bitwiseAND(F.lit(low))) <= within
        first = first & ((part <= p) | ~earlier)
    return probing.join(stored, "key").where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & first).select("a", "b")


def groups(fingerprints: DataFrame, radius: int = 3, parts: int = 2, id_col: str = "doc_id") -> DataFrame:
    """Columns fp, component (its smallest linked fingerprint) and component_id: the smallest id reachable over links.

    ``fingerprints`` has ``id_col`` and ``fp`` and should be stored, since it is read more than once. An id of null
    takes part, but is the smallest of a group only if the group has no other.
    """
    least = saved(fingerprints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    found = saved(links(least.select("fp"), radius, parts), "simhash-links")
    members = connected_components(found).withColumnRenamed("node", "fp")
    labelled = least.join(members, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return labelled.join(smallest, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id") -> DataFrame:
    """Columns ``id_col``, fingerprint (16 hex digits), component_id: one row for each row of ``docs``."""
    prints = saved(with_fingerprints(docs, [id_col], width), "simhash")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(groups(prints, radius, id_col=id_col), "fp").select(id_col, digits, "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group one row with the group's smallest id stays.

    Columns are unchanged, whatever their names.
    """
    slim = marked(docs, id_col)
    prints = saved(with_fingerprints(slim, ["id", "mark"], width), "simhash")
    found = groups(prints, radius, id_col="id").select("fp", "component")
    return one_of_each(docs, prints.join(found, "fp").select("id", "mark", "component"), id_col)


def marked(docs: DataFrame, id_col: str) -> DataFrame:
    """id, mark and text of each row; the mark tells texts under one id apart."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), mark_of("text").alias("mark"), "text")


def mark_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def one_of_each(docs: DataFrame, labelled: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: of the rows with its smallest id, one with the least mark.

    ``labelled`` has id, mark and component for each row of ``docs``. Where that row is repeated, one of the equal ones
    stays. Only rows that may go or are repeated are shuffled.
    """
    keys = labelled.groupBy("component", "id", "mark").agg(F.count(F.lit(1)).alias("copies"))
    keys = saved(keys, "near-keys")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")  # an id of null only where there is no other
    stays = keys.groupBy("component").agg(F.min(order).alias("stays"))
    again = order.eqNullSafe(F.col("stays"))
    fate = saved(keys.join(stays, "component").select("id", "mark", again.alias("again"), "copies").where("not again or copies > 1"), "near-fate")
    bloom = BlockedBloom(fate, "mark", fate.count())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"), mark_of("text").alias("own_mark"))
    may = bloom.may_hold(F.col("own_mark"))
    met = rows.where(may).join(fate, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark")), "left")
    out = rows.where(~may).select("row").unionByName(met.where("again is null").select("row"))
    if fate.where("again").count():
        first = met.where("again").groupBy("own_id", "own_mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.unionByName(first.select("row"))
    return out.select("row.*")
