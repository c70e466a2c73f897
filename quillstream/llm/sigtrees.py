"""N-gram Jaccard join by signature trees: links of texts whose shingle sets have a similarity of 0.8 or more.

A text is its set of five-word shingles (as in ``shingles``). A set hangs in a tree under each of its first shingles in
one common order, rarest first: similar sets have ``SHARED`` of these in common (or all that they need), so two sets
that no tree holds together aren't similar. Inside a tree the sets stand in order of size, ``FAN`` to a node and ``FAN``
nodes to the next; a node holds the range of its sets' sizes, the OR of their bitmaps, and the most shingles that one
of its sets has beyond its bits. Two sets share at most as many shingles as their bitmaps have bits in common, plus
what the one with fewer has beyond its bits. The same bound over two nodes holds for all pairs below them, so a walk
down both sides at once leaves out every pair of nodes that can't hold a link by overlap or by size.

Trees are walked twice. First each tree is searched with two of its own sets, those with the fewest shingles that no
other set has; what these are linked with falls into components. Then every tree of more than one component is joined
with itself, and a pair of nodes within one component is left out as well: so a family of near copies costs as
many pairs as it has members, and links between components are all found. Pairs that enough trees have found are
verified on the whole sets.

Many trees make one task's group, of bounded size. A shingle with more than ``TREE`` sets has several trees, by size of
the sets and by chance, which are joined with each other where their sizes and components allow it.

Edge cases: null and empty texts, and texts of white space only, have no shingles and are linked with nothing, also not
with each other; fewer words than a shingle has are one shingle; equal sets are linked; repeated rows and repeated ids
give a row each; an id of null takes part, but is the smallest of a component only if that has no other; a similarity of
exactly 0.8 links; texts of any length are read whole; a table without rows gives none; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import BlockedBloom
from .common import discard, rowwise, saved, table
from .components import connected_components
from .shingles import DEN, NUM, SHARED, _buckets, _key, _lists, commonness, sets, shingles
from .simhash import mark_of

#: Children of a node; sets of a tree; sets of the trees of one group; pairs of nodes that are parted at a time.
FAN, TREE, GROUP, STEP = 16, 4_096, 50_000, 1_024
#: Bits of a bitmap.
BITS = 1_024

MEMBER = "word bigint, tree int, set bigint, n int, spare int, bits binary, part bigint, alone int"
PAIR = "a bigint, b bigint, needed int"


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bits that a set's shingles turn on, as 64-bit words."""
    on = np.zeros(BITS, bool)
    on[((hashes >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").view(np.uint64)


def signed(docs: DataFrame, keep: list[str], levels: np.ndarray) -> DataFrame:
    """``keep``, set (a hash of the whole set), n (its size), spare (shingles beyond its bits), bits and prefix of each row."""

    def first(own: np.ndarray) -> np.ndarray:
        order = np.lexsort((own, levels[_buckets(own)]))
        return own[order[: len(own) - -(-len(own) * NUM // DEN) + SHARED]]

    def work(texts: pa.Array) -> dict:
        own = [shingles(t) for t in texts.cast(pa.binary()).to_pylist()]
        bits = [bitmap(o) for o in own]
        spare = [len(o) - int(np.bitwise_count(b).sum()) for o, b in zip(own, bits, strict=True)]
        keys = np.array([_key(o) for o in own], np.uint64).view(np.int64)
        return {"set": pa.array(keys), "n": pa.array([len(o) for o in own], pa.int32()), "spare": pa.array(spare, pa.int32()), "bits": pa.array([b.tobytes() for b in bits], pa.binary()), "prefix": _lists([first(o) for o in own])}

    return rowwise(docs, "text", keep, lambda: work, "set bigint, n int, spare int, bits binary, prefix array<bigint>")


class Nodes:
    """Nodes of one level of all trees of a group. The lowest level's are the sets themselves."""

    def __init__(self, tree: np.ndarray, low: np.ndarray, high: np.ndarray, spare: np.ndarray, bits: np.ndarray, part_low: np.ndarray, part_high: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> None:
        self.tree, self.low, self.high, self.spare, self.bits, self.part_low, self.part_high, self.first, self.last = tree, low, high, spare, bits, part_low, part_high, first, last

    def above(self) -> Nodes:
        starts = np.flatnonzero(np.append(True, self.tree[1:] != self.tree[:-1]))
        place = np.arange(len(self.tree)) - np.repeat(starts, np.diff(np.append(starts, len(self.tree))))
        first = np.flatnonzero(place % FAN == 0)
        over = lambda how, x: how.reduceat(x, first, axis=0)
        return Nodes(
            self.tree[first], over(np.minimum, self.low), over(np.maximum, self.high), over(np.maximum, self.spare), over(np.bitwise_or, self.bits),
            over(np.minimum, self.part_low), over(np.maximum, self.part_high), first, np.append(first[1:], len(self.tree)),
        )


def may_link(a: Nodes, i: np.ndarray, b: Nodes, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes may hold a link between two components: by sizes, components and the most that two sets can share."""
    inside = (a.part_low[i] == b.part_high[j]) & (a.part_high[i] == b.part_low[j])  # then all four are one
    sizes = (a.high[i] * DEN >= b.low[j] * NUM) & (b.high[j] * DEN >= a.low[i] * NUM)
    stay = np.flatnonzero(sizes & ~inside)
    i, j = i[stay], j[stay]
    common = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(a.spare[i], b.spare[j])
    most = np.minimum(common, np.minimum(a.high[i], b.high[j]))
    return stay[most * (NUM + DEN) >= (a.low[i] + b.low[j]) * NUM]


class Forest:
    """The trees of a group, level over level; the highest has one node for each tree."""

    def __init__(self, members: pa.Table) -> None:
        column = lambda c: members.column(c).to_numpy()
        keys = [column(c) for c in ("word", "tree", "n", "set")]
        order = np.lexsort(keys[::-1])
        word, tree, n, self.set = (k[order] for k in keys)
        edge = np.append(True, (word[1:] != word[:-1]) | (tree[1:] != tree[:-1]))
        n, spare = n.astype(np.int64), column("spare")[order].astype(np.int64)
        bits = np.frombuffer(b"".join(members.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)[order]
        part = column("part")[order]
        self.alone = column("alone")[order]
        self.levels = [Nodes(np.cumsum(edge) - 1, n, n, spare, bits, part, part)]
        while len(self.levels) == 1 or len(self.levels[-1].tree) > self.levels[-1].tree[-1] + 1:
            self.levels.append(self.levels[-1].above())

    def joined(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of sets that may be linked: one under tree ``a[k]`` and one under tree ``b[k]``, each pair once."""
        todo = [(len(self.levels) - 1, a, b)]
        while todo:
            level, a, b = todo.pop()
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            if len(a) > STEP:
                todo += [(level, a[at : at + STEP], b[at : at + STEP]) for at in range(0, len(a), STEP)]
                continue
            nodes, below = self.levels[level], self.levels[level - 1]
            across = (nodes.last - nodes.first)[b]
            times = (nodes.last - nodes.first)[a] * across
            own = np.repeat(np.arange(len(a)), times)
            k = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
            i, j = nodes.first[a][own] + k // across[own], nodes.first[b][own] + k % across[own]
            once = (a[own] != b[own]) | (i < j) | ((i == j) & (level > 1))
            i, j = i[once], j[once]
            stay = may_link(below, i, below, j)
            todo.append((level - 1, i[stay], j[stay]))

    def searched(self, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For sets at these places, the places of others of their tree that may be linked with them."""
        sets_, a, node = self.levels[0], place, self.levels[0].tree[place]
        for level in range(len(self.levels) - 1, 0, -1):
            nodes = self.levels[level]
            times = (nodes.last - nodes.first)[node]
            own = np.repeat(np.arange(len(a)), times)
            node = nodes.first[node][own] + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
            a = a[own]
            stay = np.concatenate([at + may_link(sets_, a[at : at + STEP * FAN], self.levels[level - 1], node[at : at + STEP * FAN]) for at in range(0, len(a), STEP * FAN)] or [np.zeros(0, np.int64)])
            a, node = a[stay], node[stay]
        yield a, node

    def pairs(self, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.Table]:
        for i, j in found:
            a, b = self.set[i], self.set[j]
            n = np.maximum(self.levels[0].low[i], self.levels[0].low[j])
            needed = np.minimum(SHARED, -(-n * NUM // DEN)).astype(np.int32)
            yield pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "needed": needed})

    def representatives(self) -> np.ndarray:
        """Two places of each tree: the sets with the fewest shingles of their own."""
        tree = self.levels[0].tree
        order = np.lexsort((self.set, self.alone, tree))
        first = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
        return order[np.unique(np.concatenate([first, np.minimum(first + 1, np.append(first[1:], len(tree)) - 1)]))]


def _together(pairs: Iterator[pa.Table]) -> pa.Table:
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "needed": pa.array([], pa.int32())})
    return pa.concat_tables([none, *pairs])


def _search(members: pa.Table) -> pa.Table:
    forest = Forest(members)
    return _together(forest.pairs(forest.searched(forest.representatives())))


def _self_join(members: pa.Table) -> pa.Table:
    forest = Forest(members)
    trees = np.arange(len(forest.levels[-1].tree))
    return _together(forest.pairs(forest.joined(trees, trees)))


def _cross_join(one: pa.Table, other: pa.Table) -> pa.Table:
    if not one.num_rows or not other.num_rows:
        return _together(iter(()))
    forest = Forest(pa.concat_tables([one, other]))
    return _together(forest.pairs(forest.joined(np.array([0]), np.array([1]))))


def _planted(members: DataFrame, total: int, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``work`` over groups of whole trees, about ``GROUP`` sets in each."""
    groups = -(-total // GROUP) or 1
    return members.groupBy(F.pmod(F.xxhash64("word", "tree"), F.lit(groups))).applyInArrow(work, PAIR)


def _tree_of(times: str) -> Column:
    """0 for a shingle that few sets have; else by size of the set, in steps of a quarter, and by chance."""
    band = F.floor(F.log(DEN / NUM, F.col("n"))).cast("int")
    parts = F.ceil(F.col(times) / TREE).cast("int")
    return F.when(F.col(times) <= TREE, 0).otherwise(1 + band * parts + F.pmod(F.xxhash64("set"), parts).cast("int"))


def _counted(pairs: DataFrame) -> DataFrame:
    """Pairs that as many trees have found as similar sets have in common."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("found"), F.min("needed").alias("needed")).where("found >= needed").select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Those candidates that are similar, by their whole sets, which are built again from the texts that have them."""
    pairs = saved(pairs, "trees-pairs")
    wanted = saved(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), "trees-wanted")
    marks = saved(rows.join(wanted, "set", "left_semi").groupBy("set").agg(F.min("mark").alias("mark")), "trees-marks")
    texts = docs.where(BlockedBloom(marks, "mark", marks.count()).may_hold(mark_of("text"))).select("text")
    whole = saved(sets(texts, []).join(wanted, "set", "left_semi").groupBy("set").agg(F.first("hashes").alias("hashes")), "trees-sets")
    left, right = (whole.select(F.col("set").alias(s), F.col("hashes").alias(f"{s}_hashes")) for s in "ab")
    enough = F.size(F.array_intersect("a_hashes", "b_hashes")) * (NUM + DEN) >= (F.size("a_hashes") + F.size("b_hashes")) * NUM
    out = saved(pairs.join(left, "a").join(right, "b").where(enough).select("a", "b"), "trees-links")
    discard(pairs, wanted, marks, whole)
    return out


def links(docs: DataFrame, rows: DataFrame, full: DataFrame) -> DataFrame:
    """Links a, b of similar sets that give their components. ``rows`` has mark and set of ``docs``, ``full`` has set, n, spare, bits and prefix; both are stored, and ``full`` goes.

    Bitmaps are met only where trees are built, so they aren't stored or dealt out once for each tree.
    """
    distinct = full.where("n > 0").groupBy("set").agg(*[F.first(c).alias(c) for c in ("n", "spare", "bits", "prefix")])
    distinct = saved(distinct, "trees-distinct")
    discard(full)
    posted = distinct.select("set", F.explode("prefix").alias("word"))
    met = posted.groupBy("word").agg(F.count(F.lit(1)).alias("times"), F.min("set").alias("lowest")).where("times > 1")
    met = saved(met, "trees-met")
    bloom = BlockedBloom(met.select("word"), "word", met.count())
    shared = saved(posted.where(bloom.may_hold(F.col("word"))).join(met, "word"), "trees-shared")
    discard(met)
    total = shared.count()
    own = shared.groupBy("set").agg(F.count(F.lit(1)).cast("int").alias("in_trees"))
    known = saved(distinct.join(own, "set").select("set", "n", "spare", "bits", (F.size("prefix") - F.col("in_trees")).alias("alone")), "trees-known")
    discard(distinct)
    members = saved(shared.join(known.select("set", "n", "alone"), "set").withColumn("tree", _tree_of("times")), "trees-members")
    discard(shared)

    def drawn(of: DataFrame, *more: Column | str) -> DataFrame:
        """Members as trees have them, with their bitmaps."""
        return of.join(known.select("set", "spare", "bits"), "set").select("word", "tree", "set", "n", "spare", "bits", *more)

    found = _planted(drawn(members, F.col("set").alias("part"), "alone"), total, _search)
    # A shingle with several trees has them meet in its lowest set.
    ends = members.where(F.col("tree") > 0).groupBy("word", "tree", "lowest").agg(F.min_by("set", F.struct("alone", "set")).alias("set")).where("set <> lowest")
    anchors = ends.select(F.least("set", "lowest").alias("a"), F.greatest("set", "lowest").alias("b"), F.lit(1).alias("needed"))
    near = _verified(_counted(found.unionByName(anchors)), rows, docs)

    parts = saved(connected_components(near), "trees-parts")
    in_ = F.coalesce("component", "set")
    placed = members.join(parts, F.col("set") == F.col("node"), "left").select("word", "tree", "set", "n", in_.alias("part"))
    mixed = members.select("word", "set").join(parts, F.col("set") == F.col("node"), "left").groupBy("word").agg(F.min(in_).alias("x"), F.max(in_).alias("y")).where("x <> y")
    placed = saved(placed.join(mixed.select("word"), "word", "left_semi"), "trees-placed")
    discard(members, parts)
    whole = drawn(placed, "part", F.lit(0).alias("alone"))
    between = _planted(whole, max(1, placed.count()), _self_join)
    roots = placed.where("tree > 0").groupBy("word", "tree").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("n", "part") for f in (F.min, F.max)])
    a, b = (roots.select("word", *[F.col(c).alias(f"{s}_{c}") for c in roots.columns if c != "word"]) for s in "ab")
    sizes = (F.col("a_max_n") * DEN >= F.col("b_min_n") * NUM) & (F.col("b_max_n") * DEN >= F.col("a_min_n") * NUM)
    apart = (F.col("a_min_part") != F.col("b_max_part")) | (F.col("a_max_part") != F.col("b_min_part"))
    meet = a.join(b, "word").where((F.col("a_tree") < F.col("b_tree")) & sizes & apart).select(F.col("word").alias("of"), "a_tree", "b_tree")
    sides = [whole.join(meet, (F.col("word") == F.col("of")) & (F.col("tree") == F.col(f"{s}_tree"))).drop("of") for s in "ab"]
    sides = [side.toDF(*side.columns).groupBy("word", "a_tree", "b_tree") for side in sides]  # under names of their own: both are of one frame
    across = sides[0].cogroup(sides[1]).applyInArrow(_cross_join, PAIR)
    out = near.unionByName(_verified(_counted(between.unionByName(across)), rows, docs))
    discard(placed, known)
    return out


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, n_shingles and component_id (the smallest id reachable by links): one row for each row of ``docs``."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    marked = slim.select("id", mark_of("text").alias("mark"), "text")
    full = saved(signed(marked, ["id", "mark"], commonness(slim)), "trees")
    rows = saved(full.select("id", "mark", "set", "n"), "trees-rows")
    members = connected_components(links(slim, rows, full))
    least = rows.where("n > 0").groupBy("set").agg(F.min("id").alias("least"))
    labelled = least.join(members, F.col("set") == F.col("node"), "left").withColumn("component", F.coalesce("component", "set"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = labelled.join(smallest, "component").select("set", "component_id")
    out = rows.select("id", "set", "n").join(of_set, "set", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
sets AS (SELECT r, n, min(r) OVER (PARTITION BY key) AS head FROM (SELECT r, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS key FROM s GROUP BY r)),
p AS (SELECT s.g, s.r, sets.n FROM s JOIN sets ON s.r = sets.r AND sets.r = sets.head),
l AS (
  SELECT a.r AS x, b.r AS y FROM p a JOIN p b ON a.g = b.g AND a.r < b.r AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.r, b.r, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT head AS x, head AS y FROM sets WHERE r = head UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
o AS (SELECT sets.r, min(doc_id) OVER (PARTITION BY c) AS component_id FROM sets JOIN c ON sets.head = c.x JOIN d ON sets.r = d.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN o USING (r)
"""
